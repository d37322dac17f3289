"""Near-duplicate documents by SetSketch registers, banding, likelihood and exact check."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnscape.llm.memo import Memo
from tarnscape.llm.mixing import running
from tarnscape.operators.graph import components
from tarnscape.session import cut, drop

#: Registers in a band, and bands. At similarity 0.75 a pair shares no band with probability (1 - 0.75**4)**40 = 2.5e-7.
ROWS, BANDS = 4, 40
#: SetSketch base and rate. With the base near 1, registers collide as often as those of MinHash.
BASE, RATE, TOP = 1.001, 20.0, 65_534
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _keys(m: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_24).integers(0, 2**63, (2, m), dtype=np.int64).astype(np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def shingle_hashes(text: str | None, memo: Memo, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; ASCII letters in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = memo.array(words, len(words), np.uint64)
    k = min(width, len(h))
    out = np.full(len(h) - k + 1, np.uint64(len(h) if k < width else width), np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def registers(hashes: np.ndarray, m: int, keys=None) -> np.ndarray:
    """SetSketch: each register holds the truncated logarithm of the least exponential value.

    Taking the larger register of two sketches gives the sketch of the union."""
    mul, add = keys or _keys(m)
    least = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        x = (hashes[at : at + 2048, None] ^ add) * mul
        least = np.minimum(least, x.min(axis=0))
    u = (least.astype(np.float64) + 1.0) / 2.0**64
    k = np.floor(1 - np.log(-np.log1p(-np.minimum(u, 1 - 2**-53)) / RATE) / np.log(BASE))
    return np.clip(k, 0, TOP + 1).astype(np.uint16)


def sketches(docs: DataFrame, rows: int = ROWS, bands: int = BANDS, width: int = 5) -> DataFrame:
    """(doc_id, n, h1, h2, sketch): set size, a 128-bit hash of the set, and its registers."""
    m = rows * bands

    def make(batches):
        memo, keys = Memo(xxhash.xxh3_64_intdigest), _keys(m)
        for b in batches:
            out = []
            for d, t in zip(b["doc_id"], b["text"], strict=True):
                s = shingle_hashes(t, memo, width)
                h = xxhash.xxh3_128(s.tobytes()).digest()
                h1, h2 = np.frombuffer(h, np.int64)
                out.append((d, len(s), int(h1), int(h2), registers(s, m, keys).tobytes() if len(s) else None))
            yield pd.DataFrame(out, columns=["doc_id", "n", "h1", "h2", "sketch"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(make, "doc_id long, n long, h1 long, h2 long, sketch binary")


def _near(m: int, least: float):
    """Pairs whose joint likelihood puts the similarity at ``least`` or more, by a grid of similarities."""
    grid = np.linspace(0, 1, 101)

    def keep(batches):
        for b in batches:
            if not len(b):
                continue
            ka = np.frombuffer(b"".join(b["sa"]), np.uint16).reshape(-1, m)
            kb = np.frombuffer(b"".join(b["sb"]), np.uint16).reshape(-1, m)
            more, less = (ka > kb).sum(1), (ka < kb).sum(1)
            na, nb = b["na"].to_numpy(float), b["nb"].to_numpy(float)
            u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
            p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
            up, down = p(u - v * grid), p(v - u * grid)
            tie = np.clip(1 - up - down, 1e-12, 1)
            ok = grid <= np.minimum(na / nb, nb / na)[:, None] + 1e-9
            score = more[:, None] * np.log(np.maximum(up, 1e-12)) + less[:, None] * np.log(np.maximum(down, 1e-12)) + (m - more - less)[:, None] * np.log(tie)
            best = grid[np.where(ok, score, -np.inf).argmax(1)]
            yield b.loc[best >= least, ["a", "b"]]

    return keep


def _exact(percent: int):
    def keep(batches):
        for b in batches:
            ok = []
            for x, y in zip(b["xa"], b["xb"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.loc[np.array(ok, bool), ["a", "b"]]

    return keep


def shingle_sets(reps: DataFrame, docs: DataFrame, width: int = 5) -> DataFrame:
    """(rep, x): the hashed shingles of each doc_id in ``reps``; texts are shuffled for this alone."""

    def sets(batches):
        memo = Memo(xxhash.xxh3_64_intdigest)
        for b in batches:
            yield pd.DataFrame({"rep": b["rep"], "x": [shingle_hashes(t, memo, width).tobytes() for t in b["text"]]})

    wanted = docs.select(F.col("doc_id").alias("rep"), "text").join(reps, "rep", "left_semi")
    return wanted.mapInPandas(sets, "rep long, x binary")


def verified(pairs: DataFrame, reps: DataFrame, full: DataFrame, percent: int = 75, m: int = ROWS * BANDS) -> DataFrame:
    """Pairs (a, b) that the likelihood keeps and whose full shingle sets then pass.

    A pair may come twice if its doc_id stands for two sets."""
    s = reps.select("rep", "n", "sketch")
    p = pairs.join(s.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    p = p.join(s.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    p = p.where(F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)"))
    likely = p.mapInPandas(_near(m, max(0.0, percent / 100 - 0.2)), "a long, b long")
    q = likely.join(full.select(F.col("rep").alias("a"), F.col("x").alias("xa")), "a").join(full.select(F.col("rep").alias("b"), F.col("x").alias("xb")), "b")
    return cut(q.mapInPandas(_exact(percent), "a long, b long"), "linked")


def rarest(who: DataFrame, full: DataFrame, percent: int = 75, bits: int = 18) -> DataFrame:
    """(rep, n, comp, key, at): for each set, as many of its rarest shingles as a similar set can't all lack.

    A set of n shingles shares ceil(n * percent / 100) of them with any set at that similarity
    or more. So two such sets, each in one order that holds for all, meet in their first
    n - ceil(n * percent / 100) + 1. The order goes by how often the shingle's cell of
    2**bits cells occurs, then by the shingle: passages of many documents come last and are
    left out. ``at`` is the place in the order, from 0. The counts of the cells are of a fixed size and go to all tasks."""

    def count(batches):
        size = np.zeros(1 << bits, np.int64)
        for b in batches:
            for x in b["x"]:
                size += np.bincount((np.frombuffer(x, np.uint64) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        at = np.nonzero(size)[0]
        yield pd.DataFrame({"at": at, "c": size[at]})

    cells = full.select("x").mapInPandas(count, "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).toArrow()
    size = np.zeros(1 << bits, np.int64)
    size[cells["at"].to_numpy()] = cells["c"].to_numpy()
    shared = full.sparkSession.sparkContext.broadcast(size)

    def pick(batches):
        for b in batches:
            for rep, n, comp, x in zip(b["rep"], b["n"], b["comp"], b["x"], strict=True):
                x = np.frombuffer(x, np.uint64)
                order = np.lexsort((x, shared.value[(x >> np.uint64(64 - bits)).astype(np.int64)]))
                first = x[order[: len(x) + percent * len(x) // -100 + 1]]
                yield pd.DataFrame({"rep": rep, "n": n, "comp": comp, "key": first.view(np.int64), "at": np.arange(len(first))})

    return who.join(full, "rep").mapInPandas(pick, "rep long, n long, comp long, key long, at long")


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows whose key occurs in more than one component."""
    keys = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("key")
    return rows.join(keys, "key")


def near_duplicates(docs: DataFrame, percent: int = 75, rows: int = ROWS, bands: int = BANDS, width: int = 5, rounds: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each document.

    Documents whose sets of ``width``-word shingles have a Jaccard similarity of at least
    ``percent`` % are linked; component_id is the smallest doc_id reachable over links, and
    kept says that it is the document's own. Copies with one shingle set are one class, so a
    group of thousands of copies is one row of the join. Register bands give buckets. In a
    bucket of any size, first every class is compared with the bucket's smallest; components
    follow; later rounds compare with more centres, and only between components that share a
    bucket and aren't linked yet; the last round compares, of all sets that then share a
    bucket with another component, those that share one of their rarest shingles, which no
    similar pair lacks (see rarest), so documents with a common passage aren't paired. It comes as soon as these are at most sixteen times as many as the
    pairs that one more round of centres could give. So no link between components is lost, and a large group of near
    copies costs a row a member, not a row a pair.

    Documents without words (null and blank texts) have n_shingles 0 and are alone. Null
    doc_ids come back alone with a null component. Rows that repeat a doc_id are one node."""
    m = rows * bands
    sig = cut(sketches(docs, rows, bands, width), "sketches")
    named = sig.where("n > 0 AND doc_id IS NOT NULL")
    least = F.min(F.struct(F.col("doc_id").alias("rep"), "n", "sketch")).alias("least")
    reps = cut(named.groupBy("h1", "h2").agg(least).select("h1", "h2", "least.*"), "reps")
    classes = reps.select("h1", "h2", "rep")
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", 2 * rows * i + 1, 2 * rows)) for i in range(bands)])
    banded = reps.select("rep", "n", F.explode(keys).alias("key"))
    many = banded.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("low")).where("c > 1").drop("c")
    member = cut(banded.join(many, "key").select("key", "rep", "n", "low"), "buckets")
    # rows that share a doc_id but not a set are joined through it
    own = named.join(classes, ["h1", "h2"]).where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    tested = cut(member.where("rep != low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct(), "tested")
    full = cut(shingle_sets(member.select("rep").distinct(), docs, width), "sets")
    links = verified(tested, reps, full, percent, m)
    twice = named.groupBy("doc_id").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x != y").select("doc_id")
    extra = own.join(twice, own["a"] == twice["doc_id"], "left_semi")
    for step in range(1, rounds + 1):
        comp = components(links)
        left = member.drop("low").join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
        left = cut(_mixed(left), "left")
        size = left.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("in"))
        total = size.agg(F.sum((F.col("all") * F.col("all") - F.col("in")) / 2).alias("pairs"), F.sum("all").alias("rows")).first()
        if not total["rows"]:
            break
        last = step == rounds or total["pairs"] <= 16 * 8**step * total["rows"]
        if last:
            who = left.select("rep", "n", "comp").distinct()
            left = centre = cut(_mixed(cut(rarest(who, full, percent), "rarest")), "rare")
        else:
            spread = F.pmod(F.xxhash64("rep", F.lit(step)), F.lit(8**step))
            lows = left.groupBy("key", spread.alias("part")).agg(F.min("rep").alias("rep")).drop("part")
            centre = left.join(lows, ["key", "rep"])
        x, y = centre.alias("x"), left.alias("y")
        apart = F.expr("x.comp != y.comp AND x.rep != y.rep") & F.expr(f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)")
        if last:
            # what two sets share from their first common shingle on must do for the similarity
            enough = f"least(x.n - x.at, y.n - y.at) * {100 + percent} >= (x.n + y.n) * {percent}"
            apart = apart & F.expr("x.rep < y.rep") & F.expr(enough)
        more = x.join(y, (F.col("x.key") == F.col("y.key")) & apart).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
        more = cut(more.join(tested, ["a", "b"], "left_anti"), "more")
        found = verified(more, reps, full, percent, m)
        links, tested = links.union(found), tested.union(more)
        if last:
            break
    comp = components(links.union(extra.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))))
    member_of = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    out = sig.join(member_of, ["h1", "h2"], "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    cid = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), cid.alias("component_id"), (F.coalesce(cid == F.col("doc_id"), F.lit(True))).alias("kept"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The documents without near copies: of each component one text stays, with its smallest doc_id, once.

    A text is a document of its own, also where several have one doc_id: then each pair of
    doc_id and text counts as a node, in order of doc_id and a hash of the text, and unrelated
    texts of one id all stay. Of rows with equal doc_id and text one stays: that with the
    smallest hash of all its columns. Rows without words stay, but for such repeats; rows with
    a null doc_id all stay."""
    # rows travel as one column each, so no column of theirs can clash
    named = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("t"), "text", F.struct(*docs.columns).alias("row"))
    rest = docs.where("doc_id IS NULL")
    ids = named.select("doc_id", "t")
    if ids.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = near_duplicates(named, **how).where("kept").select("doc_id").distinct()
        return named.join(kept, "doc_id", "left_semi").select("row.*").unionByName(rest)
    numbers = cut(running(ids.distinct(), [F.col("doc_id"), F.col("t")], n=F.lit(1)), "numbers")
    nodes = named.select("doc_id", "t", "text").join(numbers, ["doc_id", "t"]).select(F.col("n").cast("long").alias("doc_id"), "text")
    kept = near_duplicates(nodes, **how).where("kept").select(F.col("doc_id").alias("n")).distinct()
    left = named.join(numbers.join(kept, "n").drop("n"), ["doc_id", "t"], "left_semi")
    one = left.groupBy("doc_id", "t").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return one.select("row.*").unionByName(rest)
