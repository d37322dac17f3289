"""Hard tables with the rows that must come out, not only their number."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tarnscape.llm import decontaminate, minhash, mixing
from test_llm import DOC, HARD, brute_near, docs_of

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_texts_of_one_id_stay_unless_they_are_copies(spark):
    a, b, c = prose(1), prose(2), prose(3)
    near = c.replace("alpha", "alfa", 1)
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 2), (2, b, "en", "s", 3), (1, a, "en", "t", 4), (1, a, "en", "t", 4), (3, c, "en", "s", 5), (4, near, "en", "s", 6), (None, a, "en", "s", 7), (None, a, "en", "s", 7), (5, "", "en", "s", 8), (5, None, "en", "s", 9), (6, "", None, "s", 8)]
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", "1 AS __d", "2 AS rep", "3 AS row")
    got = [tuple(r)[:5] for r in minhash.keep_one(docs).collect()]
    texts = sorted(((r[0], r[1]) for r in got), key=str)
    assert texts == sorted([(1, a), (1, b), (3, c), (None, a), (None, a), (5, ""), (5, None), (6, "")], key=str)
    assert len({r for r in got if r[0] == 1 and r[1] == a}) == 1
    again = sorted((tuple(r)[:5] for r in minhash.keep_one(docs.repartition(7)).collect()), key=str)
    assert again == sorted(got, key=str)


def test_unique_ids_keep_the_smallest(spark):
    texts = [*HARD, prose(7), prose(7) + " more", prose(8)]
    docs = docs_of(spark, texts, 3)
    near = brute_near([(3 + i, t) for i, t in enumerate(texts)])
    assert sorted(r.doc_id for r in minhash.keep_one(docs).collect()) == sorted(d for d, k in near.items() if d == k)


def test_many_sources_share_out_the_edge(spark, monkeypatch):
    """Most of 2,000 sources have a packet at virtual time 1; no task gets them all, and sums are those of one list."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('w ', int(1 + id % 3)) AS text", "concat('s', id % 2000) AS source")
    seen = []
    plain = mixing.running

    def watched(rows, order, **sums):
        out = plain(rows, order, **sums)
        seen.append((list(sums), rows.count()))
        return out

    monkeypatch.setattr(mixing, "running", watched)
    got = mixing.queued(docs, rows_per_bucket=500).toPandas()
    assert [n for names, n in seen if names == ["__ahead"]][0] >= 1000
    assert got["taken"].sum() == got["size"].sum()
    per = got.groupby("source_size")["taken"].sum()
    assert (got["taken"] <= 3 * got["size"]).all() and per.sum() == got["size"].sum()


def test_only_the_contaminated_text_of_an_id_goes(spark):
    item = prose(50, 30)
    rows = [(1, prose(51), "en", "s", 1), (1, f"{prose(52)} {item} end", "en", "s", 2), (None, prose(53), "en", "s", 3), (None, f"so {item}", "en", "s", 4), (2, None, "en", "s", 5), (3, "", "en", None, 6), (1, prose(51), "en", "s", 7)]
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", "1 AS h", "2 AS __bad", "3 AS told")
    items = spark.createDataFrame([(9, item), (10, None), (11, "")], "item_id long, text string")
    got = decontaminate.clean_documents(docs, items)
    assert got.columns == docs.columns
    assert sorted((r.n_chars for r in got.collect())) == [1, 3, 5, 6, 7]
    assert decontaminate.clean_documents(docs, items.limit(0)).count() == 7


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_hard_and_empty_tables(spark, tmp_path, empty):
    clean = [prose(20 + i, 80) for i in range(12)]
    item = prose(99, 30)
    texts = [*clean, clean[0], HARD[7], None, "", "12 34 !!", clean[1] + "\n" + item, prose(77, 4000)]
    docs = docs_of(spark, texts).withColumns({c: F.lit(1) for c in ("toxic_score", "lang_pred", "lang_score", "spans", "__h")})
    docs = docs.limit(0) if empty else docs
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = cp.run(spark, str(tmp_path))
    got = out.collect()
    assert {"taken", "target", "lang_pred", "spans"} <= set(out.columns)
    if empty:
        assert got == []
        return
    left = {r.doc_id: r.text for r in got}
    assert len(left) == len(got) and not {12, 14, 15, 16, 17} & set(left)
    assert all(left[d] == texts[d] for d in left if d < 12) and all(r[c] == 1 for r in got for c in ("toxic_score", "lang_pred", "lang_score", "spans", "__h"))
