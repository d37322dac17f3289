"""Shares in legends are printed as the SQL prints them."""

from tarnscape.functions import scalars as fn


def test_a_tenth_goes_by_the_exact_value_and_ties_to_even(spark):
    values = [6.25, 18.75, 0.15, 0.05, 100.0, 0.0]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(fn.one_place("x").alias("s"))
    assert [r.s for r in got.collect()] == ["6.2", "18.8", "0.1", "0.1", "100.0", "0.0"]
