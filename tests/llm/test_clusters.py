"""Centroid clustering against plain k-means in Python's integers."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tarnscape.llm import clusters, queries
from verify_oracle import canon

SF = "/root/testdata/sf0.001"


def brute(rows, k=16, rounds=3, dim=64, scale=64):
    use = [(i, [clusters.whole(v, scale) for v in x], x) for i, x in rows if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    name = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    c = [q for _, q, _ in sorted(use, key=lambda r: (r[0] is None, "" if r[0] is None else name(r[0]), r[2]))[:k]]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda q: min(range(len(c)), key=lambda j: (d2(q, c[j]), j))
    for _ in range(rounds):
        groups = {}
        for _, q, _ in use:
            groups.setdefault(nearest(q), []).append(q)
        c = [[sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)] if j in groups else c[j] for j in range(len(c))]
    found = [(i, j := nearest(q), d2(q, c[j])) for i, q, _ in use]
    per = {}
    for _, j, d in found:
        per[j] = per.get(j, 0) + d
    fits = lambda v: v if v < 2**63 else None
    return sorted(((i, j, fits(d), fits(per[j]), fits(sum(per.values())), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in found), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def test_equals_brute_force_on_hard_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(i % 5, 1) for _ in range(6)]) for i in range(300)]
    rows += [(i % 7, rows[i][1]) for i in range(40)] + [(None, rows[3][1]), (None, [0.0] * 6)]
    rows += [(400, None), (401, []), (402, [1.0] * 5), (403, [1.0] * 5 + [None]), (404, [float("nan")] * 6), (405, [float("inf")] + [0.0] * 5), (406, [1.0] * 7)]
    rows += [(500 + i, [float(i % 3)] * 6) for i in range(60)]  # ties
    df = frame(spark, rows).selectExpr("*", "1 AS cluster", "2 AS distance", "'a' AS x").repartition(5)
    for rounds in (0, 1, 3, 6):
        assert got(clusters.clustered(df, 7, rounds, 6)) == brute(rows, 7, rounds, 6)
    assert got(clusters.clustered(frame(spark, rows[:4]), 7, 3, 6)) == brute(rows[:4], 7, 3, 6)
    assert got(clusters.clustered(frame(spark, rows[:1]), 1, 3, 6)) == brute(rows[:1], 1, 3, 6)
    assert got(clusters.clustered(frame(spark, []), 7, 3, 6)) == []
    one = clusters.clustered(frame(spark, []), 7, 3, 6)
    assert one.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_large_components_are_exact(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) * 10.0 ** rng.choice([0, 4, 7, 12, 40, 300]) for _ in range(3)]) for i in range(120)]
    rows += [(200 + i, [1.7e308, -1.7e308, 0.5]) for i in range(3)] + [(300 + i, [float(2**21 + i), 0.0, 1.0]) for i in range(30)]
    assert got(clusters.clustered(frame(spark, rows), 5, 3, 3)) == brute(rows, 5, 3, 3)


def test_only_expired_vectors_are_scanned():
    rng = np.random.default_rng(1)
    centres = [[0] * 4, [1000] * 4, [0, 0, 1000, 0]]
    x = np.concatenate([rng.normal(0, 5, (500, 4)) + c for c in centres])
    block = next(clusters.Block.made(__import__("pyarrow").array(range(1500)), x, 1))
    block.first(centres)
    assert block.expire(centres, [10.0] * 3) == 0
    before = block.cluster.copy()
    moved = [[1, 0, 0, 0], [400] * 4, [0, 0, 1000, 0]]
    n = block.expire(moved, [1200.0 + 1, 1201.0, 1200.0])
    assert n == 1000
    exact = clusters.squared(block.x, moved).argmin(1)
    assert (block.cluster == exact).all() and (before == np.repeat([0, 1, 2], 500)).all()


def test_query_and_sql(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    q = queries.op11_clusters(spark, SF)
    assert dict(q.dtypes) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
    assert got(q) == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    cur = con.execute(queries.ORACLE["op11_clusters"])
    want = pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description], dtype=object)
    assert canon(q.toPandas()) == canon(want)
    assert q.select(F.countDistinct("vec_id")).first()[0] == len(rows)
