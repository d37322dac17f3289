"""Nearest neighbours by cross-polytope hashing."""

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tarnscape.session import cut


@cache
def _hadamard_matrix(n: int) -> np.ndarray:
    h = np.ones((1, 1), np.float32)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two, scaled to keep lengths.

    In two steps of half the digits each, which are products with small matrices."""
    n = x.shape[1]
    a = 1 << (n.bit_length() // 2)
    b = n // a
    y = (x.reshape(-1, b) @ _hadamard_matrix(b)).reshape(-1, a, b).transpose(0, 2, 1).reshape(-1, a) @ _hadamard_matrix(a)
    return y.reshape(-1, b, a).transpose(0, 2, 1).reshape(-1, n) / np.float32(np.sqrt(n))


def rotated(unit: np.ndarray, turn: int, seed: int) -> np.ndarray:
    """Three rounds of random signs and a Hadamard transform, after padding to a power of two."""
    size = 1 << max(0, int(unit.shape[1] - 1).bit_length())
    x = np.zeros((len(unit), size), np.float32)
    x[:, : unit.shape[1]] = unit
    rng = np.random.default_rng([seed, turn])
    for _ in range(3):
        x = hadamard(x * rng.choice(np.array([-1, 1], np.float32), size))
    return x.astype(np.float32)


class Hashes:
    """Tables of cells: a cell is a signed axis for each of ``turns`` pseudo-rotations.

    A row x of a band of lengths up to M gets one more coordinate, sqrt(M^2 - |x|^2), and a
    query 0 there, so that in a band the nearest direction is the largest inner product."""

    def __init__(self, dim: int, rows: int, tables: int, seed: int):
        self.tables, self.seed = tables, seed
        self.axes = 2 << int(dim).bit_length()
        self.turns = max(1, round(np.log(max(rows, 2)) / np.log(self.axes)))

    def scores(self, unit: np.ndarray, table: int) -> np.ndarray:
        """(row, turn, signed axis): the coordinates after each turn, and their negatives."""
        y = np.stack([rotated(unit, table * self.turns + j, self.seed) for j in range(self.turns)], 1)
        return np.concatenate([y, -y], 2)

    def cells(self, v: np.ndarray, share: np.ndarray) -> np.ndarray:
        """(row, table, turn): nearest signed axes of rows whose length is ``share`` of the largest in their band."""
        unit = v / np.abs(v).max(axis=1, keepdims=True)
        unit *= (share / np.linalg.norm(unit, axis=1))[:, None]
        unit = np.concatenate([unit, np.sqrt(np.maximum(0, 1 - share**2))[:, None]], 1).astype(np.float32)
        return np.stack([self.scores(unit, t).argmax(2) for t in range(self.tables)], 1).astype(np.int32)

    def asked(self, v: np.ndarray, table: int) -> np.ndarray:
        unit = v / np.abs(v).max(axis=1, keepdims=True)
        unit = np.concatenate([unit / np.linalg.norm(unit, axis=1)[:, None], np.zeros((len(v), 1))], 1).astype(np.float32)
        return self.scores(unit, table)

    def least(self, y: np.ndarray, probes: int | None) -> np.ndarray:
        """The score of the last of a query's ``probes`` best cells, of all there are (None: any score): a cell's score is the sum of its axes' scores.

        Turn by turn: a cell is among the best only if its first axes are among the best, and
        the i-th best of these with the j-th best next axis has i * j cells at or above it."""
        if probes is None:
            return np.full(len(y), -np.inf, np.float32)
        probes = min(probes, self.axes**self.turns)
        best = -np.sort(-y[:, 0], axis=1)[:, :probes]
        for j in range(1, self.turns):
            i, axis = _pairs(best.shape[1], self.axes, probes)
            sums = best[:, i] + (-np.sort(-y[:, j], axis=1))[:, axis]
            many = min(probes, sums.shape[1])
            best = -np.sort(np.partition(-sums, many - 1, axis=1)[:, :many], axis=1)
        return best[:, -1]

    def ranks(self, y: np.ndarray, own: np.ndarray) -> np.ndarray:
        """For one query's scores (turn, axis), how many cells of all are better than each of ``own``, by meeting in the middle."""
        half = self.turns // 2
        left, right = (np.sort(_all_sums(part)) for part in (y[:half], y[half:]))
        return np.array([(len(left) - np.searchsorted(left, o + 1e-6 - right, "right")).sum() for o in own.tolist()])

    def group(self, axes: np.ndarray, groups: int | np.ndarray) -> np.ndarray:
        """The group of a cell: cells by their first axes, in equal shares."""
        first = axes[..., 0].astype(np.int64)
        if self.turns > 1:
            return (first * self.axes + axes[..., 1]) * groups // self.axes**2
        return first * groups // self.axes

    def reached(self, y: np.ndarray, least: np.ndarray, groups: int) -> np.ndarray:
        """(query, group): whether a group may have a cell of at least that score."""
        if self.turns > 1:
            s = (y[:, 0, :, None] + y[:, 1, None, :]).reshape(len(y), -1) if groups > self.axes else y[:, 0] + y[:, 1].max(1)[:, None]
        else:
            s = y[:, 0]
        s = s + y[:, 2:].max(2).sum(1)[:, None]
        of = np.arange(s.shape[1]) * groups // s.shape[1]
        at = np.nonzero(np.diff(of, prepend=-1))[0]
        out = np.zeros((len(y), groups), bool)
        out[:, of[at]] = np.maximum.reduceat(s, at, axis=1) >= least[:, None] - 1e-5
        return out


@cache
def _pairs(many: int, axes: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i and j, from 0, with (i + 1)(j + 1) at most ``probes``."""
    per = np.minimum(axes, probes // np.arange(1, many + 1))
    i = np.repeat(np.arange(many), per)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(per) - per, per)


def _all_sums(y: np.ndarray) -> np.ndarray:
    out = np.zeros(1)
    for row in y.astype(np.float64):
        out = (out[:, None] + row).ravel()
    return out


def _vectors(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)


def _tops(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best ids (ties: smaller id); a repeated id counts once, by its largest score."""
    one, first = np.unique(ids, return_index=True)
    if len(one) < len(ids):
        order = np.argsort(ids, kind="stable")
        score = np.maximum.reduceat(score[order], np.searchsorted(ids[order], one))
    else:
        score = score[first]
    best = np.lexsort((one, -score))[:k]
    return one[best], score[best]


def _near(av: np.ndarray, aid: np.ndarray, qv: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k rows of largest inner product, all rows with ties at the end summed alike in every block."""
    s = av @ qv
    s[aid == own] = -np.inf
    at = np.arange(len(s))
    if len(s) > 4 * k:
        floor = np.partition(s, len(s) - 2 * k)[len(s) - 2 * k]
        at = np.nonzero(s >= floor - 1e-9 * (1 + abs(floor)))[0] if np.isfinite(floor) else at
        if len(np.unique(aid[at])) < min(k, len(at)):  # copies of an id may crowd out others
            at = np.arange(len(s))
    at = at[s[at] > -np.inf]
    return _tops(aid[at], (av[at] * qv).sum(1), k)


def _found(query: list, ids: list, scores: list) -> pd.DataFrame:
    many = [len(x) for x in ids]
    cat = lambda v, kind: np.concatenate([*v, np.empty(0, kind)]).astype(kind)
    return pd.DataFrame({"query_id": np.repeat(np.array(query, np.int64), many), "vec_id": cat(ids, np.int64), "score": cat(scores, np.float64)})


FOUND = "query_id long, vec_id long, score double"


def exact(base: DataFrame, ids: np.ndarray, asked: np.ndarray, k: int, kind: str) -> DataFrame:
    """(query_id, vec_id, score, v): the k nearest rows of a few queries by brute force; each task keeps k for each query."""
    shared = base.sparkSession.sparkContext.broadcast((ids, asked))

    def scan(batches):
        ids, asked = shared.value
        kept: list = [(np.empty(0, np.int64), np.empty(0), {}) for _ in ids]
        for b in batches:
            if not len(b):
                continue
            av, aid, raw = _vectors(b["v"], kind), b["vec_id"].to_numpy(), b["v"].to_numpy()
            for n, (q, v) in enumerate(zip(ids, asked, strict=True)):
                best, score = _near(av, aid, v, q, k)
                i, s, of = kept[n]
                of |= dict(zip(aid[np.isin(aid, best)].tolist(), raw[np.isin(aid, best)], strict=True)) if len(best) else {}
                i, s = _tops(np.concatenate([i, best]), np.concatenate([s, score]), k)
                kept[n] = (i, s, {x: of[x] for x in i.tolist()})
        rows = [(int(q), x, y, of[x]) for q, (i, s, of) in zip(ids, kept, strict=True) for x, y in zip(i.tolist(), s.tolist(), strict=True)]
        yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score", "v"])

    got = base.select("vec_id", "v").mapInPandas(scan, f"{FOUND}, v binary")
    return _first(got, k).drop("rank")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def probes_for(base: DataFrame, ask: DataFrame, hashes: Hashes, top: dict, k: int, kind: str, recall: float, sample: int) -> int:
    """So many probes of each table that a sample of queries finds ``recall`` of its true nearest.

    The sample are the first queries by a hash of vec_id, ``sample`` at most; their nearest
    rows come from one pass of brute force over all rows."""
    some = ask.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    if not len(some):
        return 1
    ids, asked = some["vec_id"].to_numpy(), _vectors(some["v"], kind)
    near = exact(base, ids, asked, k, kind).join(base.select(F.col("vec_id").alias("i"), F.col("v").alias("w"), "band", "length"), F.expr("i = vec_id AND w = v")).select("query_id", "vec_id", "v", "band", "length").toPandas()
    if not len(near):
        return 1
    near = near.drop_duplicates(["query_id", "vec_id"])
    cells = hashes.cells(_vectors(near["v"], kind), np.exp2(near["length"].to_numpy() - [top[x] for x in near["band"]]))
    place = pd.Series(np.arange(len(ids)), ids)
    row = place[~place.index.duplicated()].loc[near["query_id"]].to_numpy()
    ranks = np.full(len(near), np.iinfo(np.int64).max)
    for t in range(hashes.tables):
        y = hashes.asked(asked, t).astype(np.float64)
        own = sum(y[row, j, cells[:, t, j]] for j in range(hashes.turns))
        for q in np.unique(row):
            mine = np.nonzero(row == q)[0]
            ranks[mine] = np.minimum(ranks[mine], hashes.ranks(y[q], own[mine]))
    return int(np.quantile(ranks, recall, method="higher")) + 1


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = 4, recall: float = 0.96, sample: int = 64, block: int = 32_768, seed: int = 5
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each query.

    ``vectors`` and ``queries`` have vec_id and embedding. Rows are parted into bands of
    length, each within a factor of two (see Hashes). In each of ``tables`` tables a row is in
    one cell: its nearest signed axes after as many pseudo-rotations as cells shall be about
    as many as rows, so cells get finer as the table grows. A query looks into its best cells
    of each table, in every band; how many is measured by brute force on ``sample`` queries
    for ``recall`` of their nearest rows, the same way at every size.

    Cells go together in groups of about ``block`` rows by their first axes, and a query's
    vector goes once to each group that may have one of its cells. A group with more rows is
    dealt out in parts, so a cell with a third of all rows is split and nothing is dropped.
    A part gives k rows at most for each query, and the k best of all are kept by a limited
    window. Candidates are scored on the original vectors in double precision, and ties go to
    the smaller vec_id; a query's own row is no candidate. A query that finds fewer than k
    rows looks into all cells.

    Takes no part: null or empty vectors, zero vectors, null or non-finite components, null
    ids, and vectors of another length than most. Repeated vec_ids count once, by their
    largest score. Other columns aren't read."""
    spark = vectors.sparkSession
    single = all(isinstance(d.schema["embedding"].dataType.elementType, FloatType) for d in (vectors, queries))
    kind = "<f4" if single else "<f8"
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("e", lambda v: v != 0)
    tidy = lambda d: d.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("e")).where(fine)
    base, ask = tidy(vectors), tidy(queries)
    sizes = base.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, rows = sizes[0]["d"], sizes[0]["count"]

    def packed(d: DataFrame) -> DataFrame:
        def go(batches):
            for b in batches:
                e = b.pop("e")
                yield b.assign(v=[np.asarray(r, kind).tobytes() for r in e])

        # the binary logarithm of the length, which no length overflows
        most = F.array_max(F.transform("e", F.abs))
        length = F.log2("most") + F.log2(F.aggregate("e", F.lit(0.0), lambda t, v: t + v / F.col("most") * (v / F.col("most")))) / 2
        d = d.where(F.size("e") == dim).withColumn("most", most).withColumn("length", length).withColumn("band", F.rint("length").cast("int")).drop("most")
        return cut(d.mapInPandas(go, "vec_id long, length double, band int, v binary"), "vectors")

    base, ask = packed(base), packed(ask)
    # a row for each power of two that is the length of a vector, 2,200 at most
    bands = {r["band"]: r for r in base.groupBy("band").agg(F.max("length").alias("top"), F.count(F.lit(1)).alias("rows")).collect()}
    top = {b: r["top"] for b, r in bands.items()}
    hashes = Hashes(dim, rows, tables, seed)
    groups = {b: min(hashes.axes ** min(2, hashes.turns), 1 + r["rows"] // block) for b, r in bands.items()}
    probes = probes_for(base, ask, hashes, top, k, kind, recall, sample)

    def code(batches):
        for b in batches:
            if len(b):
                band = b["band"].to_numpy()
                cells = hashes.cells(_vectors(b["v"], kind), np.exp2(b["length"].to_numpy() - [top[i] for i in band]))
                g = hashes.group(cells, np.array([groups[i] for i in band])[:, None])
                yield pd.DataFrame({"vec_id": b["vec_id"], "band": band, "v": b["v"], "cells": [c.tobytes() for c in cells], "groups": list(g.astype(np.int32))})

    coded = cut(base.mapInPandas(code, "vec_id long, band int, v binary, cells binary, groups array<int>"), "coded")
    placed = coded.select("band", "vec_id", "v", "cells", F.posexplode("groups").alias("t", "g"))
    share = placed.groupBy("band", "t", "g").agg(F.ceil(F.count(F.lit(1)) / (2 * block)).cast("int").alias("parts"))
    share = cut(share, "share")
    key = ["band", "t", "g", "part"]
    stored = placed.join(share, ["band", "t", "g"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")

    def search(a: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        query, ids, scores = [], [], []
        if len(a) and len(q):
            t = int(a["t"].iloc[0])
            axes = np.frombuffer(b"".join(a["cells"]), np.int32).reshape(len(a), hashes.tables, hashes.turns)[:, t]
            cell = axes[:, 0].astype(np.int64)
            for j in range(1, hashes.turns):
                cell = cell * hashes.axes + axes[:, j]
            order = np.lexsort((a["vec_id"].to_numpy(), cell))
            axes, cell, aid, av = axes[order], cell[order], a["vec_id"].to_numpy()[order], _vectors(a["v"], kind)[order]
            first = np.nonzero(np.diff(cell, prepend=-1))[0]
            size = np.diff(np.append(first, len(cell)))
            for at in range(0, len(q), 64):
                part = q.iloc[at : at + 64]
                qv = _vectors(part["v"], kind)
                y = hashes.asked(qv, t)
                s = sum(y[:, j][:, axes[first, j]] for j in range(hashes.turns))
                for i, (own, least) in enumerate(zip(part["vec_id"].tolist(), part["least"].tolist(), strict=True)):
                    hit = np.nonzero(s[i] >= least - 1e-5)[0]
                    if not len(hit):
                        continue
                    n = size[hit]
                    rows = np.repeat(first[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    one, best = _near(av[rows], aid[rows], qv[i], own, k)
                    query.append(own)
                    ids.append(one)
                    scores.append(best)
        return _found(query, ids, scores)

    def look(who: DataFrame, probes: int | None) -> DataFrame:
        def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for at in range(0, len(whole), 256):
                    b = whole.iloc[at : at + 256]
                    qv = _vectors(b["v"], kind)
                    for t in range(hashes.tables if probes is not None else 1):
                        y = hashes.asked(qv, t)
                        least = hashes.least(y, probes)
                        for band, many in groups.items():
                            q, g = np.nonzero(hashes.reached(y, least, many))
                            yield pd.DataFrame({"vec_id": b["vec_id"].to_numpy()[q], "band": band, "t": t, "g": g, "least": least[q], "v": b["v"].to_numpy()[q]})

        asked = who.select("vec_id", "v").mapInPandas(go, "vec_id long, band int, t int, g int, least float, v binary")
        wanted = asked.join(share, ["band", "t", "g"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        names = {c: f"q_{c}" for c in key}
        found = stored.groupBy(*key).cogroup(wanted.withColumnsRenamed(names).groupBy(*names.values())).applyInPandas(search, FOUND)
        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    found = cut(_first(look(ask, probes), k), "found")
    others = min(k, base.select("vec_id").distinct().count() - 1)
    full = found.groupBy(F.col("query_id").alias("q")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= others)
    short = cut(ask.join(full, F.col("vec_id") == F.col("q"), "left_anti"), "short")
    if others > 0 and not short.isEmpty():
        again = _first(look(short, None), k)
        found = found.join(short.select(F.col("vec_id").alias("q")).distinct(), F.col("query_id") == F.col("q"), "left_anti").unionByName(again)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
