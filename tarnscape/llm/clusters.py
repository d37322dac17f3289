"""Centroid clustering (k-means in exact integers) with a heap of expiring bounds for each cluster."""

from __future__ import annotations

import hashlib
import math
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnscape.session import cut

#: Vectors of a block: a row of the state table, with the heaps of its vectors.
BLOCK = 4096
#: Components up to this size are held as integers. Blocks with larger ones are held apart, and scanned in Python's integers.
NARROW = 2**27
#: Sums beyond 64 bits travel in digits of this base.
LIMB = 2**60
STATE = "ids array<long>, kind string, x binary, cluster binary, keys binary, items binary, sizes binary, delta array<struct<c: int, d: int, limb: int, v: long>>"


def kept(embeddings: DataFrame, dim: int) -> DataFrame:
    """(vec_id, x): rows whose vector has exactly ``dim`` components, none of them null or non-finite."""
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return embeddings.where((F.size("embedding") == dim) & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))


def whole(x: float, scale: int) -> int:
    """floor(scale * x) of a double, also where the product passes a double's range."""
    y = scale * x
    return math.floor(y) if math.isfinite(y) else scale * int(x)


def squared(x: np.ndarray, c: list[list[int]]) -> np.ndarray:
    """(row, centroid): exact squared distances, in the narrowest arithmetic that holds them."""
    reach = max(int(np.abs(x).max(initial=0)), max((abs(v) for row in c for v in row), default=0))
    most = x.shape[1] * (2 * reach) ** 2
    if x.dtype != object and most < 2**53:
        a, b = x.astype(np.float64), np.array(c, np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    kind = np.int64 if x.dtype != object and most < 2**63 else object
    a, b = x.astype(kind), np.array(c, kind)
    return np.stack([((a - row) ** 2).sum(1) for row in b], axis=1)


def _root(x: int) -> float:
    try:
        return math.sqrt(x)
    except OverflowError:
        return math.inf


def scan(x: np.ndarray, c: list[list[int]], offset: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (ties: the smaller number), and the offset of its cluster at which that expires.

    The gap between the second nearest and the nearest distance shrinks by no more than the
    cluster's offset grows. Rounding is met by a slack. Rows of Python integers expire at once."""
    d = squared(x, c)
    rows, first = np.arange(len(x)), d.argmin(axis=1).astype(np.int64)
    if d.dtype == object:
        return first, np.full(len(x), -np.inf)
    upper = np.sqrt(d[rows, first].astype(np.float64))
    d[rows, first] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(axis=1).astype(np.float64)) if len(c) > 1 else np.full(len(x), np.inf)
    now = np.array(offset)[first]
    return first, lower - upper + now - 1e-9 * (1 + upper + np.where(np.isfinite(lower), lower, 0) + now)


def _digits(v: int) -> list[tuple[int, int]]:
    out, sign, v, limb = [], (1 if v >= 0 else -1), abs(v), 0
    while v:
        v, digit = divmod(v, LIMB)
        out.append((limb, sign * digit))
        limb += 1
    return out


def _delta(x: np.ndarray, old: np.ndarray | None, new: np.ndarray, k: int) -> list[dict]:
    """What these rows change in the sums (by dimension) and counts (dimension -1) of clusters, without zeros."""
    one = np.zeros((k, len(x)), np.int64)
    one[new, np.arange(len(x))] = 1
    if old is not None:
        one[old, np.arange(len(x))] -= 1
    if x.dtype == object:
        sums = one.astype(object) @ x
    else:  # rows of a block times NARROW stay under 2**53
        sums = (one.astype(np.float64) @ x.astype(np.float64)).astype(np.int64)
    out = [{"c": c, "d": -1, "limb": 0, "v": int(n)} for c, n in enumerate(one.sum(axis=1)) if n]
    return out + [{"c": int(c), "d": int(d), "limb": limb, "v": digit} for c, d in zip(*np.nonzero(sums), strict=True) for limb, digit in _digits(int(sums[c, d]))]


class Block:
    """Vectors with their clusters and, for each cluster, a heap of (expiry, vector), as one row of the state table."""

    def __init__(self, ids: pa.Array, kind: str, raw: np.ndarray, dim: int, scale: int):
        self.ids, self.kind, self.raw = ids, kind, raw
        if kind == "f8":  # too large for the integers: the source's values
            x = np.empty(raw.size, object)
            x[:] = [whole(v, scale) for v in raw.ravel().tolist()]
            self.x = x.reshape(-1, dim)
        else:
            self.x = raw.reshape(-1, dim)
        self.cluster, self.heaps, self.delta = np.zeros(len(self.x), np.int32), [], []

    @classmethod
    def made(cls, ids: pa.Array, x: np.ndarray, scale: int):
        """The blocks of some vectors: narrow ones in the smallest integers that hold them, others apart."""
        with np.errstate(over="ignore"):
            q = np.floor(scale * x)
        wide = (np.abs(q) > NARROW).any(axis=1)
        for at in range(0, len(x), BLOCK):
            part = np.arange(at, min(at + BLOCK, len(x)))
            for rows, is_wide in ((part[~wide[part]], False), (part[wide[part]], True)):
                if len(rows):
                    values = x[rows] if is_wide else q[rows].astype(np.int32)
                    kind = "f8" if is_wide else np.result_type(np.min_scalar_type(int(values.min())), np.min_scalar_type(int(values.max())), np.int8).str[1:]
                    yield cls(ids.take(pa.array(rows)), kind, np.ascontiguousarray(values.astype(kind)), x.shape[1], scale)

    @classmethod
    def read(cls, row: dict, dim: int, scale: int):
        self = cls(row["ids"], row["kind"], np.frombuffer(row["x"], row["kind"]), dim, scale)
        self.cluster = np.frombuffer(row["cluster"], np.int32).copy()
        ends = np.cumsum(np.frombuffer(row["sizes"], np.int64))
        self.heaps = list(zip(np.split(np.frombuffer(row["keys"], np.float64), ends[:-1]), np.split(np.frombuffer(row["items"], np.int32), ends[:-1]), strict=True))
        return self

    def first(self, c: list[list[int]]) -> None:
        new, keys = scan(self.x, c, [0.0] * len(c))
        self.cluster = new.astype(np.int32)
        self.delta = _delta(self.x, None, new, len(c))
        for k in range(len(c)):
            items = np.nonzero(new == k)[0].astype(np.int32)
            heap = list(zip(keys[items].tolist(), items.tolist(), strict=True))
            heapify(heap)
            self.heaps.append((np.array([h[0] for h in heap]), np.array([h[1] for h in heap], np.int32)))

    def expire(self, c: list[list[int]], offset: list[float]) -> int:
        """Pops the vectors whose gap is used up and scans only these; how many they were."""
        heaps: dict[int, list] = {}
        held = lambda k: heaps.setdefault(k, list(zip(self.heaps[k][0].tolist(), self.heaps[k][1].tolist(), strict=True)))
        popped = []
        for k, (keys, _) in enumerate(self.heaps):
            if len(keys) and keys[0] <= offset[k]:
                heap = held(k)
                while heap and heap[0][0] <= offset[k]:
                    popped.append(heappop(heap)[1])
        self.delta = []
        if popped:
            rows = np.array(popped)
            new, keys = scan(self.x[rows], c, offset)
            for k, key, item in zip(new.tolist(), keys.tolist(), popped, strict=True):
                heappush(held(k), (key, item))
            moved = np.nonzero(new != self.cluster[rows])[0]
            if len(moved):
                self.delta = _delta(self.x[rows[moved]], self.cluster[rows[moved]], new[moved], len(c))
                self.cluster[rows[moved]] = new[moved]
            for k, heap in heaps.items():
                self.heaps[k] = (np.array([h[0] for h in heap]), np.array([h[1] for h in heap], np.int32))
        return len(popped)

    def row(self) -> pa.RecordBatch:
        flat = lambda k, kind: np.concatenate([h[k] for h in self.heaps]).astype(kind).tobytes()
        ids = pa.ListArray.from_arrays(pa.array([0, len(self.ids)], pa.int32()), self.ids)
        delta = pa.array([self.delta], pa.list_(pa.struct([("c", pa.int32()), ("d", pa.int32()), ("limb", pa.int32()), ("v", pa.int64())])))
        sizes = np.array([len(h[0]) for h in self.heaps], np.int64).tobytes()
        binary = [pa.array([v], pa.binary()) for v in (self.raw.tobytes(), self.cluster.tobytes(), flat(0, np.float64), flat(1, np.int32), sizes)]
        return pa.RecordBatch.from_arrays([ids, pa.array([self.kind]), *binary, delta], names=["ids", "kind", "x", "cluster", "keys", "items", "sizes", "delta"])

    def distances(self, c: list[list[int]]) -> list[int]:
        out = np.zeros(len(self.x), object)
        for k in np.unique(self.cluster):
            rows = np.nonzero(self.cluster == k)[0]
            out[rows] = squared(self.x[rows], [c[k]])[:, 0]
        return [int(d) for d in out]


def _blocks(batches, dim: int, scale: int):
    """The written blocks of a task."""
    for b in batches:
        for i in range(b.num_rows):
            row = {n: b.column(n)[i].as_py() for n in ("kind", "x", "cluster", "keys", "items", "sizes")}
            yield Block.read(row | {"ids": b.column("ids")[i].values}, dim, scale)


def _totals(state: DataFrame, sums: dict[tuple[int, int], int]) -> None:
    """Adds what the state's blocks changed; the driver gets a number for each cluster and dimension."""
    each = state.select(F.explode("delta").alias("e")).select("e.*").groupBy("c", "d", "limb").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    for r in each.collect():
        sums[r["c"], r["d"]] = sums.get((r["c"], r["d"]), 0) + int(r["v"]) * LIMB ** r["limb"]


def clustered(embeddings: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each kept vector of (vec_id, embedding).

    Kept are vectors of exactly ``dim`` components, none null or non-finite; a component x
    counts as floor(scale * x). Centroids start as the ``k`` vectors with the smallest
    lowercase-hex sha256 of "seed:vec_id" (of repeated ids: in order of the vector); each of
    ``rounds`` rounds assigns every vector to its nearest centroid and then moves each centroid
    that has vectors to the floor of their mean; then vectors are assigned once more.

    A vector's gap is the distance to its second nearest centroid less that to its own. When
    centroids move, the gap shrinks by the drift of its own and the largest drift of another at
    most, the same for all vectors of a cluster. So each block of vectors has a heap for each
    cluster, ordered by gap plus the drift accumulated when it was computed; a round pops those
    that the accumulated drift has reached, scans them exactly and pushes them anew. All others
    keep their cluster unseen. Sums change by the moved vectors only, and the driver gets k
    times dim of them. Blocks are rows of a written table, so a lost executor costs one round
    of its blocks; no row is shuffled before the result.

    Null ids are kept and come last as seeds. Fewer than k vectors give fewer clusters; none,
    no rows. Repeated rows count each. All arithmetic is exact: components beyond 2**27 are
    compared in Python's integers, and a distance or sum beyond 64 bits is null."""
    spark = embeddings.sparkSession
    rows = kept(embeddings, dim)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(order.asc_nulls_last(), "x").limit(k).select("x").collect()
    c = [[whole(v, scale) for v in r["x"]] for r in first]
    out_schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not c:
        return spark.createDataFrame([], out_schema)

    def begin(batches, c=c):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy().reshape(-1, dim)
            for block in Block.made(b.column("vec_id"), x, scale):
                block.first(c)
                yield block.row()

    state = cut(rows.mapInArrow(begin, STATE), "blocks")
    sums: dict[tuple[int, int], int] = {}
    offset = [0.0] * len(c)
    for r in range(rounds):
        _totals(state, sums)
        moved = [[sums.get((j, d), 0) // n for d in range(dim)] if (n := sums.get((j, -1), 0)) else c[j] for j in range(len(c))]
        drift = [_root(sum((a - b) ** 2 for a, b in zip(old, new, strict=True))) * (1 + 1e-12) for old, new in zip(c, moved, strict=True)]
        offset = [o + drift[j] + max([*drift[:j], *drift[j + 1 :]], default=0.0) for j, o in enumerate(offset)]
        c = moved
        if r + 1 < rounds:

            def again(batches, c=c, offset=offset):
                for block in _blocks(batches, dim, scale):
                    block.expire(c, offset)
                    yield block.row()

            state = cut(state.mapInArrow(again, STATE), "blocks")

    def final(batches, c=c, offset=offset):
        for block in _blocks(batches, dim, scale):
            block.expire(c, offset)
            far = [d if d < 2**63 else None for d in block.distances(c)]
            yield pa.RecordBatch.from_arrays([block.ids, pa.array(block.cluster), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    out = cut(state.mapInArrow(final, "vec_id long, cluster int, distance long"), "assigned")
    per = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), (F.count("distance") == F.count(F.lit(1))).alias("full")).collect()
    fits = lambda v: None if v is None or v >= 2**63 else v
    inertia = {r["cluster"]: int(r["s"]) if r["full"] else None for r in per}
    total = None if None in inertia.values() else fits(sum(inertia.values()))
    sha = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c]
    told = spark.createDataFrame([(j, fits(v), total, sha[j]) for j, v in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
