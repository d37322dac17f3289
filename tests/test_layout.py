"""Window scans over features along a curve."""

import random

import pytest
from pyspark.sql import functions as F

from tarnscape.sources import layout


def test_hilbert_visits_each_cell_once_and_steps_to_a_neighbour(spark):
    n = 16
    df = spark.range(n * n).select((F.col("id") % n).alias("x"), F.expr(f"id div {n}").alias("y"))
    got = {r.d: (r.x, r.y) for r in df.select("x", "y", layout.hilbert(F.col("x"), F.col("y"), 4).alias("d")).collect()}
    assert sorted(got) == list(range(n * n))
    assert all(abs(got[i][0] - got[i + 1][0]) + abs(got[i][1] - got[i + 1][1]) == 1 for i in range(n * n - 1))


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    rng = random.Random(8)
    rows = []
    for i in range(20_000):
        e, n = (rng.gauss(300, 5), rng.gauss(700, 5)) if i % 3 == 0 else (rng.uniform(0, 1000), rng.uniform(0, 1000))  # a third on one spot
        w = 600.0 if i % 997 == 0 else rng.random()
        rows.append((i, rng.choice("abc"), e - w, e + w, n - w, n + w))
    rows += [(90_000 + i, "a", None, None, None, None) for i in range(50)] + [(95_000, "b", 1.0, None, 2.0, 3.0)]
    path = str(tmp_path_factory.mktemp("layout"))
    layout.write_features(spark.createDataFrame(rows, "id long, type string, min_e double, max_e double, min_n double, max_n double"), path, per_file=100)
    return path, rows


@pytest.mark.parametrize("window", [(100, 130, 100, 130), (299, 301, 699, 701), (2000, 2100, 0, 10), (500.0, 500.0, 500.0, 500.0)])
def test_window_gives_the_same_rows_from_few_files(spark, written, window):
    path, rows = written
    e0, e1, n0, n1 = window
    want = {(i, t) for i, t, a, b, c, d in rows if None not in (a, b, c, d) and b >= e0 and a <= e1 and d >= n0 and c <= n1}
    got = layout.scan_window(spark, path, window)
    assert {(r.id, r.type) for r in got.collect()} == want and got.count() == len(want)
    everything = spark.read.parquet(f"{path}/features")
    files = {r[0] for r in everything.select("_metadata.file_path").distinct().collect()}
    name = lambda files: {f.rsplit("/", 1)[-1] for f in files}
    read = name(got.inputFiles() if want else [])
    assert read == (name(layout.files_of(spark, path, window)) if want else set())
    if window[0] != 299:  # the spot itself holds a third of all
        assert len(layout.files_of(spark, path, window)) < 0.1 * len(files)
    only = layout.scan_window(spark, path, window, F.col("type") == "a")
    assert {r.id for r in only.collect()} == {i for i, t in want if t == "a"}


def test_everything_is_kept_and_pushed_down(spark, written):
    path, rows = written
    assert spark.read.parquet(f"{path}/features").count() == len(rows)
    plan = layout.scan_window(spark, path, (100, 130, 100, 130))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(max_e" in plan
    counts = [r.features for r in spark.read.parquet(f"{path}/files").collect()]
    assert sum(counts) == len(rows) and max(counts) < 400


def test_empty_and_single_spot(spark, tmp_path):
    schema = "id long, min_e int, max_e int, min_n int, max_n int"
    layout.write_features(spark.createDataFrame([], schema), f"{tmp_path}/none")
    assert layout.scan_window(spark, f"{tmp_path}/none", (0, 1, 0, 1)).count() == 0
    layout.write_features(spark.createDataFrame([(i, 5, 5, 5, 5) for i in range(500)], schema), f"{tmp_path}/spot", per_file=50)
    assert layout.scan_window(spark, f"{tmp_path}/spot", (5, 6, 4, 5)).count() == 500
    assert max(r.features for r in spark.read.parquet(f"{tmp_path}/spot/files").collect()) < 250
