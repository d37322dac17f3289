"""Feature collections that came in pages, one JSON file a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def write_pages(features: DataFrame, path: str) -> None:
    """Writes (page, seq, id, properties, geometry) as FeatureCollections, one file for each page, in folders page=N."""
    one = F.struct(F.lit("Feature").alias("type"), "id", "properties", "geometry")
    # a page holds what a server gave at once
    each = features.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("seq", one.alias("f")))).alias("all"))
    body = F.struct(F.lit("FeatureCollection").alias("type"), F.size("all").alias("numberReturned"), F.transform("all", lambda x: x["f"]).alias("features"))
    each.select("page", F.to_json(body, {"ignoreNullFields": "false"}).alias("value")).repartition("page").write.partitionBy("page").text(path)


def read_pages(spark: SparkSession, path: str, properties: str, geometry: str = "struct<type: string, coordinates: array<double>>") -> tuple[DataFrame, DataFrame]:
    """The features of all pages, (page, seq, id, properties, geometry), and the broken pages, (page, file, text).

    ``properties`` and ``geometry`` are DDL types; unknown keys are passed over. A page is a
    JSON text over any number of lines; its number is the last one in the file's path. A page
    that doesn't parse, or has no array of features, is broken: it is reported and gives no
    features, not even those before the error. Files without a byte aren't listed by Spark."""
    schema = f"type string, features array<struct<id: string, properties: {properties}, geometry: {geometry}>>, broken string"
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    number = F.regexp_extract(F.regexp_replace("path", r"/part-[^/]*$", ""), r"(\d+)\D*$", 1)
    pages = raw.select(F.nullif(number, F.lit("")).cast("long").alias("page"), F.col("path").alias("file"), F.col("value").alias("text"))
    pages = pages.withColumn("d", F.from_json("text", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}))
    whole = F.col("d.broken").isNull() & F.col("d.features").isNotNull()
    good = pages.where(F.coalesce(whole, F.lit(False))).select("page", F.posexplode("d.features").alias("seq", "f"))
    bad = pages.where(~F.coalesce(whole, F.lit(False))).select("page", "file", "text")
    return good.select("page", "seq", "f.id", "f.properties", "f.geometry"), bad


def first_by_id(features: DataFrame) -> DataFrame:
    """Of features with one id that of the first page, and there the first; an aggregate, so a hot id is combined before the shuffle. Null ids are left out."""
    rest = [c for c in features.columns if c != "id"]
    one = features.where("id IS NOT NULL").groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("page", "seq")).alias("f"))
    return one.select("id", "f.*")
