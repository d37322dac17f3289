"""Radix selection against percentile()."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnscape.operators import order

WANTED = {"low": 0.0, "p5": 0.05, "mid": 0.5, "p90": 0.9, "high": 1.0}


def test_equals_percentile_on_ties_and_nulls(spark):
    rng = random.Random(1)
    rows = []
    for g in [*range(8), None]:
        for _ in range(rng.choice([1, 2, 7, 400])):
            rows.append((g, rng.choice("ab"), rng.choice([None, 0.0, -0.0, 1.5, -1.5, rng.gauss(0, 1), 1e300, -1e-300, 5e-324, float(rng.randrange(3))])))
    rows += [(77, "a", None), (78, "b", 4.25)] + [(79, "a", 1 + k * 2.0**-52) for k in range(900)]  # one bucket but for the last bits
    df = spark.createDataFrame(rows, "g long, k string, v double")
    got = {(r.g, r.k): r for r in order.exact_percentiles(df, ["g", "k"], "v", WANTED).collect()}
    want = df.groupBy("g", "k").agg(*[F.percentile("v", p).alias(n) for n, p in WANTED.items()]).where("mid IS NOT NULL").collect()
    assert set(got) == {(r.g, r.k) for r in want}
    for r in want:
        for n in WANTED:
            assert math.isclose(got[r.g, r.k][n], r[n], rel_tol=1e-12, abs_tol=1e-300), (r, n)


def test_whole_table_integers_and_nan(spark):
    df = spark.range(10_001).selectExpr("int(id * 7919 % 10001) AS v")
    r = order.exact_percentiles(df, [], "v", {"a": 0.25, "b": 0.99995}).first()
    assert r.a == 2500 and r.b == pytest.approx(9999.5)
    r = order.exact_percentiles(spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "v double"), [], "v", WANTED).first()
    assert (r.low, r.mid, r.high) == (1, 1.5, 2)
    assert order.exact_percentiles(df.limit(0), [], "v", WANTED).where("mid IS NOT NULL").count() == 0


def test_no_pass_holds_a_group(spark):
    """A million rows of one group: every shuffle carries counters, as many as there are buckets, not rows."""
    df = spark.range(1_000_000).selectExpr("1L AS g", "rand(3) * 100 AS v")
    r = order.exact_percentiles(df, ["g"], "v", {"mid": 0.5}).first()
    assert abs(r.mid - 50) < 0.5
    v = np.sort(df.toPandas()["v"].to_numpy())
    assert r.mid == pytest.approx(np.median(v), abs=1e-12)
