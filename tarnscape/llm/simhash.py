"""Near-duplicate documents by SimHash fingerprints, compared as vertical bit planes."""

from __future__ import annotations

from itertools import chain, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnscape.operators.graph import components
from tarnscape.session import cut

BITS = 64
#: A bucket of more fingerprints is split by a second choice of pieces, which bounds it (see masks).
LIMIT = 1024
#: Rows that a task compares at once, but for the end of a bucket.
ROWS = 1 << 16
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15
_ALL = np.uint64(2**64 - 1)


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64 bits: each is 1 if it is set in over half the XXH64 (seed 42) of the text's word shingles, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    k = min(width, len(words))
    flat = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start, end = (end - size)[: len(words) - k + 1].tolist(), end[k - 1 :].tolist()
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(flat.__getitem__, map(slice, start, end)), repeat(42)), np.uint64, len(start))
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(h), BLOCK):
        count += np.unpackbits(h[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text, as a signed 64-bit number."""

    def make(batches):
        for b in batches:
            texts = b.column("text").cast(pa.large_binary())
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, fp long")


# ---- buckets ---------------------------------------------------------------------------------


def _pieces(bits: list[int], many: int) -> list[int]:
    """Masks of ``many`` pieces of nearly equal size of the given bit places."""
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), many)]


def masks(radius: int) -> list[tuple[int, list[int]]]:
    """Masks of 3 of radius + 3 pieces, and for each the masks that a second choice among its other bits adds.

    Fingerprints that differ in ``radius`` bits at most agree in 3 of radius + 3 pieces at
    least, so they agree under one of the masks; and in it, under one of the second ones. At
    radius 2, 38 or 39 bits are fixed at first and 53 or 54 then, which leaves 2,048 different
    fingerprints to a bucket at most."""
    first = [sum(c) for c in combinations(_pieces(list(range(BITS)), radius + 3), 3)]
    return [(m, [m | sum(c) for c in combinations(_pieces([b for b in range(BITS) if not m >> b & 1], radius + 3), 3)]) for m in first]


def _signed(m: int) -> Column:
    return F.lit(m - 2**64 if m >> 63 else m).cast("long")


def buckets(fps: DataFrame, radius: int, limit: int = LIMIT) -> DataFrame:
    """(code, v, fp): each distinct fingerprint under the masks under which another one agrees with it.

    A bucket of more than ``limit`` is dealt out by the second masks instead, whatever its
    size, so none is larger than what these leave, and no pair within the radius is lost."""
    all_masks = masks(radius)
    step = 1 + max(len(more) for _, more in all_masks)
    one = F.array(*[F.struct(F.lit(i * step).alias("code"), F.col("fp").bitwiseAND(_signed(m)).alias("v")) for i, (m, _) in enumerate(all_masks)])
    each = fps.select("fp", F.explode(one).alias("b")).select("b.code", "b.v", "fp")
    many = each.groupBy("code", "v").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    each = cut(each.join(many, ["code", "v"]), "buckets")
    second = F.array(*[F.array(*[_signed(m) for m in more]) for _, more in all_masks])
    split = F.transform(F.element_at(second, (F.col("code") / step).cast("int") + 1), lambda m, j: F.struct((F.col("code") + 1 + j).alias("code"), F.col("fp").bitwiseAND(m).alias("v")))
    small = each.where(F.col("c") <= limit).select("code", "v", "fp")
    large = each.where(F.col("c") > limit).select(F.explode(split).alias("b"), "fp").select("b.code", "b.v", "fp")
    return small.unionByName(large)


# ---- bit-sliced comparison -------------------------------------------------------------------


def planes(fps: np.ndarray) -> np.ndarray:
    """(bit, word): plane b holds bit b of 64 fingerprints a word; two words of zeros end each plane."""
    words = -(-len(fps) // 64)
    flat = np.zeros((words + 2) * 64, np.uint64)
    flat[: len(fps)] = fps
    bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little").copy().view(np.uint64)


def _over(counter: list[np.ndarray], carried: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is over the radius: a comparison of bitwise counters with a constant."""
    more, same = np.zeros_like(carried), np.full_like(carried, _ALL)
    for level in reversed(range(len(counter))):
        if radius >> level & 1:
            same = same & counter[level]
        else:
            more = more | (same & counter[level])
            same = same & ~counter[level]
    return carried | more


def near_lanes(p: np.ndarray, active: np.ndarray, shift: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and their lanes i, among the active, whose fingerprints i and i + shift differ in ``radius`` bits at most.

    Each lane has a counter of a few bits, held vertically: 64 lanes add two differences by one
    carry-save step of bitwise operations. After every eight planes, blocks of 64 lanes of
    which all are over the radius are abandoned."""
    q, b = divmod(shift, 64)
    at = np.nonzero(active)[0]
    dead = ~active[at]
    counter = [np.zeros(len(at), np.uint64) for _ in range(max(1, radius.bit_length()))]
    carried = np.zeros(len(at), np.uint64)
    right, left = np.uint64(b), np.uint64(64 - b)

    def differ(plane: np.ndarray) -> np.ndarray:
        other = plane[at + q]
        if b:
            other = (other >> right) | (plane[at + q + 1] << left)
        return plane[at] ^ other

    for group in range(0, BITS, 8):
        for plane in range(group, group + 8, 2):
            x, y = differ(p[plane]), differ(p[plane + 1])
            half = counter[0] ^ x
            carry = (counter[0] & x) | (half & y)
            counter[0] = half ^ y
            for level in range(1, len(counter)):
                counter[level], carry = counter[level] ^ carry, counter[level] & carry
            carried |= carry
        over = dead | _over(counter, carried, radius)
        live = over != _ALL
        if not live.all():
            at, dead, carried, over = at[live], dead[live], carried[live], over[live]
            counter = [c[live] for c in counter]
        if not len(at):
            break
    return at, ~over if len(at) else np.empty(0, np.uint64)


def stars(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """For each of n nodes the smallest one that it reaches over the links (a, b)."""
    label = np.arange(n) if label is None else label
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while (label != label[label]).any():
            label = label[label]


def linked(run: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """For rows in order of their bucket ``run``: the first row of each one's group of linked fingerprints in its bucket."""
    n = len(fps)
    ends = np.append(np.nonzero(np.diff(run))[0] + 1, n)
    rest = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - 1 - np.arange(n)
    p, label = planes(fps), np.arange(n)
    wide = np.zeros((p.shape[1] - 2) * 64, np.int64)
    wide[:n] = rest
    for shift in range(1, int(rest.max(initial=0)) + 1):
        active = np.packbits(wide >= shift, bitorder="little").view(np.uint64)
        words, lanes = near_lanes(p, active, shift, radius)
        if len(words):
            w, lane = np.nonzero(np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            a = words[w] * 64 + lane
            label = stars(n, a, a + shift, label)
    return label


def links(fps: DataFrame, radius: int = 2, limit: int = LIMIT) -> DataFrame:
    """(a, b): links that join all distinct fingerprints within ``radius`` bits of each other, one for each bucket and member at most.

    A member of a bucket is linked with the smallest one that it reaches in the bucket, so a
    large group of near copies costs a row a member, not a row a pair."""

    def match(batches):
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def whole(parts, last: bool):
            code, v, fp = (np.concatenate([x[k] for x in parts]) for k in range(3))
            new = np.concatenate([[True], (code[1:] != code[:-1]) | (v[1:] != v[:-1])])
            end = len(fp) if last else int(np.nonzero(new)[0][-1])  # the last bucket may go on in the next batch
            label = linked(np.cumsum(new)[:end], fp[:end].view(np.uint64), radius)
            far = np.nonzero(label != np.arange(end))[0]
            return pa.RecordBatch.from_arrays([pa.array(fp[label[far]]), pa.array(fp[far])], names=["a", "b"]), (code[end:], v[end:], fp[end:])

        for b in chain(batches, [None]):
            if b is not None and b.num_rows:
                held.append(tuple(b.column(c).to_numpy() for c in ("code", "v", "fp")))
                size += b.num_rows
            if held and (b is None or size >= ROWS):
                out, rest = whole(held, b is None)
                held, size = [rest], len(rest[0])
                yield out

    rows = buckets(fps, radius, limit).repartition("code", "v").sortWithinPartitions("code", "v", "fp")
    return rows.mapInArrow(match, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3, limit: int = LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each document.

    Documents whose fingerprints differ in ``radius`` bits at most are linked; component_id is
    the smallest doc_id reachable over links, its own included. Equal fingerprints are one
    node, so copies are never paired. Buckets of fingerprints that agree in most bits hold the
    candidates of a pair (see buckets), and bit-sliced comparison finds the links in them.

    Null and blank texts have the fingerprint zero and are linked like any other; equal rows
    stay. Rows with a null doc_id link as any other, but only the other ids count as smallest:
    a component of nothing else has a null component_id. Columns besides doc_id and text
    aren't read. An empty table gives no rows."""
    sig = cut(fingerprints(docs, width), "fingerprints")
    nodes = cut(sig.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    comp = components(links(nodes.select("fp"), radius, limit))
    of = nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("low").alias("component_id"))
    named = of.join(least, "root").select("fp", "component_id")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return sig.join(named, "fp").select("doc_id", shown, "component_id")
