"""Properties and brute force for the operators, on small fixtures."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnscape.functions import scalars as fn
from tarnscape.operators import joins, raster
from tarnscape.operators.graph import components
from tarnscape.operators.joins import envelope_join
from tarnscape.streaming import state


def grid(spark, z):
    rows = [(0, r, c, float(z[r][c])) for r in range(len(z)) for c in range(len(z[0]))]
    return spark.createDataFrame(rows, "grid_id long, r int, c int, z double")


def heap_flood(z):
    n, m = z.shape
    out, heap = np.full((n, m), np.inf), []
    for r in range(n):
        for c in range(m):
            if r in (0, n - 1) or c in (0, m - 1):
                out[r, c] = z[r, c]
                heapq.heappush(heap, (z[r, c], r, c))
    while heap:
        v, r, c = heapq.heappop(heap)
        for a, b in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
            if 0 <= a < n and 0 <= b < m and max(v, z[a, b]) < out[a, b]:
                out[a, b] = max(v, z[a, b])
                heapq.heappush(heap, (out[a, b], a, b))
    return out


def test_flood_equals_priority_flood(spark):
    z = np.random.default_rng(1).integers(0, 30, (21, 18)).astype(float)
    got = raster.sea_connectivity(grid(spark, z), tile=8).collect()
    want = heap_flood(z)
    assert len(got) == z.size
    assert all(x["connect"] == want[x["r"], x["c"]] for x in got)


def test_flood_takes_nulls_and_empty_tables(spark):
    rows = [(0, 0, 0, 1.0), (0, 0, 1, None), (0, 1, 0, 2.0)]
    df = spark.createDataFrame(rows, "grid_id long, r int, c int, z double")
    assert raster.sea_connectivity(df, tile=4).count() == 2
    assert raster.sea_connectivity(df.where("r > 9"), tile=4).count() == 0


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_draws_equal_the_sequential_generator(spark):
    def stream(seed, n):
        a, out = seed & 0xFFFFFFFF, []
        for _ in range(n):
            a = (a + 0x6D2B79F5) & 0xFFFFFFFF
            t = (a ^ (a >> 15)) * (a | 1) & 0xFFFFFFFF
            t ^= (t + ((t ^ (t >> 7)) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
            out.append((t ^ (t >> 14)) / 4294967296)
        return out

    df = spark.range(8).select(*[fn.draw(F.lit(s).cast("long"), F.col("id")).alias(f"s{s}") for s in (0, 7, 4294967295)])
    for s in (0, 7, 4294967295):
        assert [r[f"s{s}"] for r in df.collect()] == stream(s, 8)


def test_slugs(spark):
    df = spark.createDataFrame([("L1943:7827",), ("  A  b/c ",), ("---",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(fn.slug_for(F.col("s"))).collect()] == ["l1943-7827", "a-b-c", None, None, None]


def test_years(spark):
    df = spark.createDataFrame([(-1050.0,), (0.0,), (550.4,), (-0.5,)], "y double")
    assert [r[0] for r in df.select(fn.format_year(F.col("y"))).collect()] == ["1050 BCE", "1 BCE", "550 CE", "1 BCE"]


def test_projection_of_a_known_point(spark):
    e, n = fn.sweref_expressions("15.0D", "60.0D")
    row = spark.range(1).select(F.expr(e).alias("e"), F.expr(n).alias("n")).first()
    assert abs(row["e"] - 500000) < 1e-6 and abs(row["n"] - 6651411.19) < 0.1

def test_envelope_join_equals_brute_force(spark):
    rng = random.Random(2)

    def boxes(n):
        out = []
        for i in range(n):
            x, y = rng.randint(-50, 50), rng.randint(-50, 50)
            w = rng.choice([0, 1, 30, 300])
            out.append((i, x, x + rng.randint(0, w), y, y + rng.randint(0, w)))
        return out + [(n, None, 1, 2, 3), *out[:3]]

    a, b = boxes(40), boxes(60)
    s = "id long, min_e long, max_e long, min_n long, max_n long"
    want = sorted((p[0], q[0]) for p in a for q in b if None not in (*p, *q) and p[2] >= q[1] and p[1] <= q[2] and p[4] >= q[3] and p[3] <= q[4])
    for bound in (4, 16, 4096):
        df = envelope_join(spark.createDataFrame(a, s), spark.createDataFrame(b, s).withColumn("__leaf_note", F.lit(1)), bound)
        assert df.columns[:6] == ["id", "min_e", "max_e", "min_n", "max_n", "id_b"]
        assert sorted((r["id"], r["id_b"]) for r in df.collect()) == want
    assert envelope_join(spark.createDataFrame(a, s).limit(0), spark.createDataFrame(b, s)).count() == 0


def test_no_block_is_over_the_bound_with_all_on_one_spot(spark):
    spot = "id", "5.0D AS min_e", "6.0D AS max_e", "7.0D AS min_n", "7.0D AS max_n"
    a = spark.range(1500).selectExpr(*spot)
    b = spark.range(300).selectExpr(*spot).unionByName(spark.range(300, 1000).selectExpr("id", "id * 1.0D AS min_e", "id + 0.5D AS max_e", "id % 7 * 1.0D AS min_n", "id % 7 + 1.0D AS max_n"))
    bound = 200
    for side in joins.assigned(joins._numbered(a, "a"), joins._numbered(b, "b"), bound):
        assert side.groupBy("__leaf", "__i", "__j").count().agg(F.max("count")).first()[0] <= bound
    j = envelope_join(a, b, bound)
    assert j.count() == 1500 * 300 and j.select("id", "id_b").distinct().count() == 1500 * 300


def test_leaves_part_a_crowd(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(10, 0.01, (500, 2)), rng.uniform(0, 1000, (500, 2))])
    boxes = np.stack([x[:, 0], x[:, 0] + 0.001, x[:, 1], x[:, 1] + 0.001], axis=1)
    tree = joins.Quadtree((-1.0, 1001.0, -1.0, 1001.0), boxes, 20)
    rows, leaves = tree.leaves_of(boxes)
    assert set(rows) == set(range(1000)) and np.bincount(leaves).max() <= 20
    wide = np.array([[-1.0, 1000.0, -1.0, 1000.0]])
    assert len(tree.leaves_of(wide)[1]) == (tree.child < 0).sum()


def test_records_take_their_best_kind(spark):
    rows = [(1, "a", 2, 1, "x", "L1"), (1, "a", 1, 9, "y", "P2"), (1, "a", 1, 3, "z", "P1"), (1, "b", 3, 1, "w", "Q"), (1, "b", 1, 1, "w", None), (None, "c", 1, 1, "w", "P"), (2, "a", 3, 5, None, "Q1"), (2, "a", 3, 6, "v", "Q2")]
    df = spark.createDataFrame(rows, "site long, id string, kind int, seq int, name string, g string")
    got = joins.best_records(df, ["site", "id"], F.col("kind"), F.col("seq"), ["name"], "g")
    assert sorted((r.site, r.id, r.rank, r.name, tuple(r.geometries)) for r in got.collect()) == [(1, "a", 1, "z", ("P1", "P2")), (1, "b", 3, "w", ("Q",)), (2, "a", 3, None, ("Q1", "Q2"))]


def test_nearest_evidence_equals_brute_force(spark):
    rng = random.Random(3)
    cells = grid(spark, np.zeros((15, 15)))
    ev = {(rng.randrange(15), rng.randrange(15)) for _ in range(6)}
    e = spark.createDataFrame([(0, r, c, 1) for r, c in ev], "grid_id long, r int, c int, v int")
    got = {(x["r"], x["c"]): x["d2"] for x in raster.nearest_evidence(cells, e, 6).collect()}
    want = {(r, c): min((r - a) ** 2 + (c - b) ** 2 for a, b in ev) for r in range(15) for c in range(15)}
    assert got == {k: v for k, v in want.items() if v <= 36}


def test_stream_gives_the_batch_state_after_every_batch(spark, tmp_path):
    """Late, replayed and null events; a restart for each batch; past files are gone by then; a torn batch doesn't count."""
    rng = random.Random(5)
    rows = [(rng.choice([*range(9), None]), i, rng.choice(["build", "upload", "failure"]), rng.random() < 0.7, float(i)) for i in range(240)]
    schema = "slug long, at long, kind string, ok boolean, bytes double"
    log = spark.createDataFrame(rows, schema)
    parts = [rows[k::4] for k in range(4)] + [rows[:30], rows[200:]]  # the last two are replays
    seen = []
    for k, part in enumerate(parts):
        seen += part
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        state.stream_state(spark, f"{tmp_path}/log", log.schema, f"{tmp_path}/state", f"{tmp_path}/cp", buckets=4).awaitTermination()
        for f in (tmp_path / "log").glob("*.parquet"):
            f.unlink()
        want = sorted(map(tuple, state.fold_state(spark.createDataFrame(seen, schema)).collect()), key=str)
        assert sorted(map(tuple, state.latest_state(spark, f"{tmp_path}/state").collect()), key=str) == want, k
    # a repeated batch, and one that never came to its end
    state._merge(state.fold_state(log.limit(3)), 1, f"{tmp_path}/state", 4)
    state.fold_state(log.limit(3)).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{tmp_path}/state/batch=99")
    (tmp_path / "state/batch=99/_SUCCESS").unlink()
    assert sorted(map(tuple, state.latest_state(spark, f"{tmp_path}/state").collect()), key=str) == want
    with pytest.raises(FileNotFoundError):
        state.latest_state(spark, f"{tmp_path}/nothing")


def test_envelopes_over_everything_are_not_repeated(spark):
    wide = spark.range(400).selectExpr("id", "id % 9 * 1.0D AS min_e", "990 + id % 9 * 1.0D AS max_e", "id % 7 * 1.0D AS min_n", "980 + id % 11 * 1.0D AS max_n")
    small = spark.range(400).selectExpr("id", "id * 2.0D AS min_e", "id * 2.0D + 1 AS max_e", "id * 2.0D AS min_n", "id * 2.0D + 1 AS max_n")
    a, b = joins.assigned(joins._numbered(small, "a"), joins._numbered(wide, "b"), 64)
    blocks = a.select("__leaf", "__i", "__j").distinct().count()
    assert b.select("__id", "__leaf").distinct().count() <= 400 * 16 and blocks < 1000
    assert "BroadcastHashJoin [__leaf" not in joins.envelope_join(small, wide, 64)._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[0]
    assert joins.envelope_join(small, wide, 64).count() == sum(1 for i in range(400) for k in range(400) if 2 * i + 1 >= k % 9 and 2 * i <= 990 + k % 9 and 2 * i + 1 >= k % 7 and 2 * i <= 980 + k % 11)
