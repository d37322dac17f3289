"""A sample of registered queries against their SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from verify_oracle import TABLES, canon

SF = "/root/testdata/sf0.001"
SAMPLE = "f1_slug f4_registry_projection f23_random_draws g2_centroid g9_resample j1_range_join j7_level_at_year j12_nearest_fill a1_register_summary w1_monotone_clamp i1_sea_share_at_year i2_components q9_report t1_site_state".split()


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    want = pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description], dtype=object)
    got = entry.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
