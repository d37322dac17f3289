"""Tables that explode makes large aren't sent through the driver."""

import re

from pyspark.sql import functions as F

from tarnscape.operators import terrain, vegetation


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _cells(spark):
    one = spark.range(2).select(F.col("id").alias("grid_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("r"))
    return one.select("grid_id", "r", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("c")).select("*", (F.col("r") + F.col("c")).alias("z"), (F.col("c") % 3).alias("class"))


def test_places_meet_cells_without_a_broadcast(spark):
    places = spark.range(1).select(F.lit(0).cast("long").alias("grid_id"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("x")).withColumn("y", F.lit(3.0))
    got = vegetation.at_cells(places, _cells(spark), 2.0, "z")
    assert "BroadcastHashJoin" not in _plan(got) and "SortMergeJoin" in _plan(got)
    assert sorted((r.x, r.cell_z) for r in got.collect()) == [(float(x), 1 + x // 2) for x in range(8)]


def test_heights_between_cells_need_no_broadcast(spark):
    points = spark.range(4).select(F.lit(1).cast("long").alias("grid_id"), "id", (F.col("id") * 0.5).alias("fr"), F.lit(1.25).alias("fc"))
    got = terrain.bilinear(points, _cells(spark), "id")
    assert "BroadcastHashJoin" not in _plan(got) and "SortMergeJoin" in _plan(got)
    assert sorted((r.id, r.h) for r in got.collect()) == [(i, i * 0.5 + 1.25) for i in range(4)]


def test_shore_points_are_counted_by_height(spark):
    from tarnscape.operators import series

    cells = spark.range(8).select(F.lit(0).cast("long").alias("grid_id"), F.col("id").cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("c")).withColumn("z", F.lit(3))
    ring = [(1, 0, False, i, True, x, y, 0, 800) for i, (x, y) in enumerate([(2.0, 2.0), (5.0, 2.0), (5.0, 5.0), (2.0, 5.0)])]
    v = spark.createDataFrame(ring, "feature_id long, ring int, hole boolean, seq int, closed boolean, x double, y double, slug long, bp int")
    got = series.shore_samples(v, cells)
    assert [tuple(r) for r in got.select("slug", "bp", "z", "n").collect()] == [(0, 800, 3, 16)]
    assert [(r.level, r.samples) for r in series.century_levels(v, got, 16).collect()] == [(3.0, 16)]


def test_cells_draw_the_places_that_lie_in_them(spark):
    """Every place of the lattices, by their definition, in its cell; none is drawn for other cells, so none is joined with cells."""
    from math import ceil, floor, sqrt

    def drawn(seed, n):
        a = (seed + (n + 1) * 0x6D2B79F5) % 2**32
        t = (a ^ a >> 15) * (a | 1) % 2**32
        t ^= (t + (t ^ t >> 7) * (t | 61) % 2**32) % 2**32
        return (t ^ t >> 14) / 2**32

    side, res, rows = 9, 2.0, [(0, "conifer", 2500.0), (1, "broadleaf", 1111.0), (2, "conifer", 100.0)]
    label = lambda r, c: (r * 5 + c * 3) % 4
    cells = spark.createDataFrame([(0, r, c, label(r, c) if label(r, c) < 3 else None) for r in range(side) for c in range(side)], "grid_id long, r int, c int, class int")
    extents = spark.createDataFrame([(0, 21.0, 17.5)], "grid_id long, width double, height double")  # wider than the cells, and not as high
    want = set()
    for k, _, density in rows:
        spacing = sqrt(10000.0 / density)
        cols, seed = ceil(21.0 / spacing), ((k + 1) * 0x9E3779B1 % 2**32) ^ 1
        for lr in range(ceil(17.5 / spacing)):
            for lc in range(cols):
                n = 2 * (lr * cols + lc)
                x, y = (lc + drawn(seed, n)) * spacing, (lr + drawn(seed, n + 1)) * spacing
                r, c = min(floor(y / res), side - 1), min(floor(x / res), side - 1)
                if x <= 21.0 and y <= 17.5 and label(r, c) == k:
                    want.add((k, lr, lc, x, y, r, c))
    got = vegetation.sampled(cells, extents, spark.createDataFrame(rows, "class int, form string, density double"), res)
    assert not re.search(r"Join \[grid_id#\d+L?, r#", _plan(got))
    found = [(p["class"], p.lr, p.lc, p.x, p.y, p.r, p.c) for p in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 20


def test_capacity_counts_heights_once(spark):
    heights = [(g, (i * i * 7 % 23) / 4 + g) for g in range(2) for i in range(60)]
    got = vegetation.capacity(spark.createDataFrame(heights, "grid_id long, connect double"), 1.0)
    assert "RangeFrame" not in _plan(got)  # a sliding frame is summed anew for each row
    assert {r.grid_id: r.capacity for r in got.collect()} == {g: max(sum(a <= b <= a + 1.0 for h, b in heights if h == g) for h, a in heights if h == g) for g in range(2)}


def test_repair_ends_with_its_windows(spark):
    """Cells that interpolation has gone over aren't joined with themselves."""
    cells = _cells(spark).withColumn("z", F.when((F.col("r") != 1) | (F.col("c") != 2), F.col("z"))).withColumn("c", F.col("c").cast("int")).withColumn("r", F.col("r").cast("int"))
    got = terrain.repaired(cells, 3.0)
    plan = _plan(got)
    assert plan.index("Window") < plan.index("SortMergeJoin")
    assert {(x.r, x.c): (x.z, x.repair) for x in got.where("grid_id = 0").collect()} == {(r, c): (float(r + c), "interpolated" if (r, c) == (1, 2) else None) for r in range(4) for c in range(4)}
