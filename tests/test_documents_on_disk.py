"""Document sets and pages in storage: round trips, aborted writes, broken pages."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tarnscape.operators import documents
from tarnscape.sources import document_set, pages


def state(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, files in os.walk(path) for f in files)


def test_a_set_is_visible_at_once_and_an_aborted_write_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/set"
    rows = [(f"site-{i}/{kind}.json", json.dumps({"schemaVersion": 1, "é": i})) for i in range(40) for kind in documents.DOCUMENTS]
    df = spark.createDataFrame(rows, "name string, doc string").repartition(5)
    document_set.write_documents(df, path)
    read = lambda: sorted(tuple(r) for r in document_set.read_documents(spark, path).collect())
    assert read() == sorted(rows)
    before = state(path)
    for bad in [(None, "{}"), ("../x", "{}"), ("a.json", None)]:
        with pytest.raises(Exception, match="no document"):
            document_set.write_documents(df.union(spark.createDataFrame([bad], df.schema)), path)
        assert state(path) == before and read() == sorted(rows)
    with pytest.raises(Exception, match="one name"):
        document_set.write_documents(df.union(df.limit(1)), path)
    assert state(path) == before and read() == sorted(rows)
    document_set.write_documents(df.limit(3), "file://" + path)
    assert len(read()) == 3
    assert document_set.prune(path) == 1 and len(read()) == 3
    document_set.write_documents(df.limit(0), path)
    assert read() == []


def test_pages_come_back_in_order_and_broken_ones_apart(spark, tmp_path):
    path = f"{tmp_path}/pages"
    rows = [(p, s, f"f{(p * 3 + s * 5) % 11}" if s else None, (p * 10 + s, None if s == 2 else "å\n"), ("Point", [float(p), float(s)])) for p in (12, 2, 9, 100) for s in range(4)]
    schema = "page long, seq int, id string, properties struct<n: int, name: string>, geometry struct<type: string, coordinates: array<double>>"
    df = spark.createDataFrame(rows, schema)
    pages.write_pages(df, path)
    for name, text in {"3": '{"type": "FeatureCollection",\n "features": [{"id": "f1"}, {"id": ', "4": '{"error": "busy"}', "5": " \n", "6": '{\n "features": [],\n "more": 1}'}.items():
        os.makedirs(f"{path}/page={name}")
        with open(f"{path}/page={name}/p.json", "w") as f:
            f.write(text)
    got, bad = pages.read_pages(spark, path, "struct<n: int, name: string>")
    plain = lambda d: sorted(((r.page, r.seq, r.id, tuple(r.properties), (r.geometry.type, r.geometry.coordinates)) for r in d.collect()), key=str)
    assert plain(got) == sorted(rows, key=str)
    assert sorted(r.page for r in bad.collect()) == [3, 4, 5]
    first = {}
    for p, s, i, *rest in sorted(rows, key=lambda r: r[:2]):
        if i is not None:
            first.setdefault(i, (p, s, *rest))
    assert {r.id: (r.page, r.seq, tuple(r.properties), (r.geometry.type, r.geometry.coordinates)) for r in pages.first_by_id(got).collect()} == first


def test_numbers_of_plain_files(spark, tmp_path):
    for n in (1, 20, 3):
        with open(f"{tmp_path}/items_{n}.geojson", "w") as f:
            json.dump({"features": [{"id": "x", "properties": {"n": n}}]}, f, indent=1)
    got, bad = pages.read_pages(spark, str(tmp_path), "struct<n: int>")
    assert sorted(r.page for r in got.collect()) == [1, 3, 20] and bad.isEmpty()
    assert pages.first_by_id(got).select(F.col("properties.n")).first()[0] == 1


@pytest.mark.parametrize("kind", sorted(documents.DOCUMENTS))
def test_every_kind_has_the_version_and_keeps_to_its_schema(spark, kind):
    names = {f.name for f in spark.sql(f"SELECT from_json('{{}}', '{documents.DOCUMENTS[kind]}') AS d").schema[0].dataType.fields}
    assert "schemaVersion" in names and len(names) >= 4


def test_names_are_listed_by_tasks_and_not_by_the_commit(spark, tmp_path):
    path = f"{tmp_path}/set"
    rows = [(f"site-{i}/{kind}.json", f"{i} ") for i in range(30) for kind in ("a", "b")]
    df = spark.createDataFrame(rows, "name string, doc string")
    document_set.write_documents(df, path)
    with open(f"{path}/current") as f, open(f"{path}/sets/{f.read()}/_documents") as index:
        assert "site-" not in index.read()
    got = spark.read.format(document_set.FORMAT).option("per_task", 7).load(path)
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    # frames that aren't dealt out by name have their lists merged
    direct = lambda d: d.write.format(document_set.FORMAT).mode("append").save(path)
    with pytest.raises(Exception, match="one name"):
        direct(df.repartition(3).union(df.limit(1)))
    direct(df.repartition(3))
    assert sorted(map(tuple, document_set.read_documents(spark, path).collect())) == sorted(rows)


def test_all_kinds_are_read_in_one_pass(spark):
    from tarnscape.plans import documents as plans

    plan = plans.s10_documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RelationV2") == 1
