"""Every registered query of the subpackage on the smallest tables: shape by contract, and SQL where there is some."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnscape.llm import queries
from verify_oracle import TABLES, canon

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": ("documents", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}), "op2_license_scan": ("pages", {"page_id": "bigint", "licence": "string", "cosine": "double", "inherited": "boolean"}),
    "op3_warc": ("pages", {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"}), "op4_line_dedup": (None, {"doc_id": "bigint", "line_no": "int", "of_doc_id": "bigint", "edits": "int"}),
    "op5_decontamination": (None, {"doc_id": "bigint", "item_id": "bigint", "edits": "bigint"}), "op6_mixing": ("documents", {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}),
    "op7_language_id": ("documents", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}), "op8_nearest": (None, {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}),
    "op9_near_duplicates": ("documents", {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}), "op10_pii": ("documents", {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"}),
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query_has_its_rows_and_columns(spark, name):
    source, columns = COLUMNS[name]
    got = queries.QUERIES[name](spark, SF).toPandas()
    types = dict(queries.QUERIES[name](spark, SF).dtypes) if name in ("op7_language_id", "op10_pii") else None
    assert set(columns) <= set(got.columns)
    if types:
        assert columns.items() <= types.items()
    if source:
        ids = spark.read.parquet(f"{SF}/{source}.parquet").toPandas().iloc[:, 0].tolist()
        assert sorted(got.iloc[:, list(got.columns).index(next(iter(columns)))]) == sorted(ids)
    for c in ("score", "cosine"):
        if c in got and name != "op8_nearest":
            assert got[c].between(0, 1 + 1e-9).all()
    if name in queries.ORACLE:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        cur = con.execute(queries.ORACLE[name])
        want = pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description], dtype=object)
        assert sorted(got.columns) == sorted(want.columns) and canon(got) == canon(want)


def test_nearest_query_asks_every_twentieth(spark):
    got = queries.op8_nearest(spark, SF)
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    n = e.where("vec_id % 20 = 0").count()
    assert got.count() == 20 * n and got.groupBy("query_id").agg(F.max("rank").alias("r")).where("r = 20").count() == n
    assert got.where("query_id = vec_id").isEmpty()
