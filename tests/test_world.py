"""Rasters by bounds in metres, and scans that count."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnscape.sources import scan, world
from test_operators import grid


@pytest.fixture(scope="module")
def rasters(spark, tmp_path_factory):
    z = np.round(np.random.default_rng(2).normal(30, 20, (70, 90)), 1)
    cells = grid(spark, z).withColumn("z", F.when(F.expr("(r + c) % 7 > 0 AND NOT (r < 20 AND c < 20)"), F.col("z")))
    places = spark.createDataFrame([(0, 1000.0, 5000.0, 2.0, "EPSG:3006")], "grid_id long, e0 double, n0 double, res double, crs string")
    paths = {}
    for layout in world.LAYOUTS:
        paths[layout] = f"{tmp_path_factory.mktemp('world')}/{layout}"
        world.write_raster(cells, places, paths[layout], 0.1, layout, 16)
    return z, cells, paths


@pytest.mark.parametrize("bounds", [None, (1000, 1030, 4900, 4990), (1041, 1043, 4959, 4961), (0, 10, 0, 10), (1179, 2000, 4000, 4861)])
def test_layouts_agree_on_a_window_in_metres(spark, rasters, bounds):
    z, cells, paths = rasters
    e, n = F.expr("1000 + (c + 0.5) * 2.0"), F.expr("5000 - (r + 0.5) * 2.0")
    want = cells.where("z IS NOT NULL").select("grid_id", "r", "c", e.cast("double").alias("e"), n.cast("double").alias("n"), "z")
    if bounds:
        want = want.where(F.col("e").between(*bounds[:2]) & F.col("n").between(*bounds[2:]))
    want = sorted((r.r, r.c, r.e, r.n, round(r.z, 1)) for r in want.collect())
    for path in paths.values():
        got = world.read_raster(spark, path, bounds)
        assert sorted((r.r, r.c, r.e, r.n, round(r.z, 1)) for r in got.collect()) == want
        if bounds:
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert re.search(r"PushedFilters: \[[^\]]*max_e", plan)


def test_blocks_without_a_height_another_system_and_overflow(spark, rasters, tmp_path):
    z, cells, paths = rasters
    blocks = spark.read.parquet(paths["tiles"])
    assert blocks.where("r0 < 16 AND c0 < 16").isEmpty() and blocks.count() == 5 * 6 - 1
    assert spark.read.parquet(paths["strips"]).count() == 5
    with pytest.raises(ValueError, match="EPSG:3006, not in EPSG:4326"):
        world.read_raster(spark, paths["tiles"], crs="EPSG:4326")
    place = spark.createDataFrame([(0, 0.0, 0.0, 1.0, "EPSG:3006")], "grid_id long, e0 double, n0 double, res double, crs string")
    for bad, places in ((cells.withColumn("z", F.lit(9e6)), place), (cells, place.limit(0))):
        with pytest.raises(Exception, match="16 bits|no place"):
            world.write_raster(bad, places, f"{tmp_path}/{bad is cells}", 0.1)
    with pytest.raises(ValueError, match="layout"):
        world.write_raster(cells, place, f"{tmp_path}/x", 0.1, "rows")


def test_a_scan_counts_in_one_pass(spark, tmp_path):
    rows = [(i, "fort" if i % 3 else "road", None if i % 5 == 0 else i % 7 > 0, i % 2 == 0 if i % 11 else None) for i in range(600)]
    spark.createDataFrame(rows, "id long, type string, geometry boolean, near boolean").write.parquet(f"{tmp_path}/f")
    got, seen = scan.counted_scan(spark.read.parquet(f"{tmp_path}/f"), F.col("type") == "fort", F.col("geometry"), F.col("near"))
    assert "EqualTo(type,fort)" in got._jdf.queryExecution().executedPlan().toString()
    forts = [r for r in rows if r[1] == "fort"]
    kept = sorted(r[0] for r in forts if r[2] and r[3])
    assert sorted(r.id for r in got.collect()) == kept
    assert seen.get == {"scanned": sum(bool(r[2]) for r in forts), "unusable": sum(not r[2] for r in forts), "kept": len(kept)}
