"""The pipeline's stages against brute force on the smallest tables."""

from pyspark.sql import functions as F

import corpus_pipeline as cp
from tarnscape.llm import line_dedup
from test_llm import brute_lines, brute_near, brute_targets

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(cp.STAGES)
    a = stages["language ID"](spark, docs, SF).cache()
    assert a.columns == docs.columns and a.count() >= 0.98 * docs.count()
    junk = docs.withColumn("text", F.lit("12 34 !!"))
    assert stages["language ID"](spark, junk, SF).count() == 0

    rows = [(r.doc_id, r.text) for r in a.select("doc_id", "text").collect()]
    gone = brute_lines(rows)
    want = {}
    for d, t in rows:
        kept = "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)
        if kept.strip() or kept == t:
            want[d] = kept
    b = stages["line dedup"](spark, a, SF).cache()
    assert {r.doc_id: r.text for r in b.collect()} == want and b.columns == docs.columns
    assert line_dedup.BLANKS

    near = brute_near(list(want.items()))
    c = stages["near-duplicates"](spark, b, SF).cache()
    assert {r.doc_id for r in c.collect()} == {d for d, k in near.items() if d == k} and c.columns == docs.columns

    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    d = stages["decontamination"](spark, c, SF).cache()
    left = {r.doc_id for r in d.collect()}
    for r in c.collect():
        if any(i in " ".join(r.text.lower().split()) for i in items):
            assert r.doc_id not in left
    assert d.count() >= 0.9 * c.count() and d.columns == docs.columns

    e = stages["source mix"](spark, d, SF).collect()
    size = {}
    for r in d.collect():
        size[r.source] = size.get(r.source, 0) + len(r.text.split())
    want_t = brute_targets(size)
    for s in size:
        assert abs(sum(r.taken for r in e if r.source == s) - want_t[s]) <= max(1, want_t[s] / 100) + 1
