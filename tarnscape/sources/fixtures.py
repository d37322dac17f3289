"""Views over the test tables that stand in for grids, registers, outlines and logs; in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnscape.operators.raster import SUNS
from tarnscape.session import table

SIDE = 64


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """(grid_id, r, c, z, label): 64 x 64 grids, one embedding a row; rows that the last grid lacks have null heights."""
    e = table(spark, sf, "embeddings").select(F.expr("vec_id div 64").alias("grid_id"), (F.col("vec_id") % SIDE).cast("int").alias("r"), "label", "embedding")
    some = e.groupBy("grid_id").agg(F.collect_set("r").alias("have"))  # 64 numbers at most
    every = F.array_except(F.sequence(F.lit(0), F.lit(SIDE - 1)), "have")
    lacking = some.select("grid_id", F.explode(every).alias("r"), F.lit(None).cast("int").alias("label"), F.array_repeat(F.lit(None).cast("float"), SIDE).alias("embedding"))
    x = e.unionByName(lacking).select("grid_id", "r", "label", F.posexplode("embedding").alias("c", "v"))
    return x.select("grid_id", "r", "c", F.floor((F.col("v").cast("double") + 0.6) * 20).cast("int").alias("z"), "label")


CELLS = """cells AS (SELECT g AS grid_id, k::INT AS r, (t.i - 1)::INT AS c, floor((embedding[t.i]::DOUBLE + 0.6) * 20)::INT AS z, label
  FROM (SELECT g, k FROM (SELECT DISTINCT (vec_id // 64)::BIGINT AS g FROM embeddings), range(64) q(k)) LEFT JOIN embeddings ON vec_id = g * 64 + k, range(1, 65) t(i))"""

FLOOD = CELLS + """, reach(grid_id, r, c, l) AS (
  SELECT grid_id, r, c, l FROM cells, (SELECT DISTINCT z AS l FROM cells) WHERE z <= l AND (r = 0 OR r = 63 OR c = 0 OR c = 63)
  UNION SELECT n.grid_id, n.r, n.c, x.l FROM reach x, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(dr, dc), cells n WHERE n.grid_id = x.grid_id AND n.r = x.r + d.dr AND n.c = x.c + d.dc AND n.z <= x.l),
  flood AS (SELECT grid_id, r, c, min(l)::DOUBLE AS connect FROM reach GROUP BY 1, 2, 3)"""

HOLE = "(r * 7 + c * 13 + grid_id) % 11 = 0 OR (r BETWEEN 20 AND 27 AND c BETWEEN 30 AND 45) OR (c < 6 AND r > 40)"


def holed(spark: SparkSession, sf: str) -> DataFrame:
    """cells with z null where no source covers them."""
    return cells(spark, sf).withColumn("z", F.expr(f"CASE WHEN {HOLE} THEN NULL ELSE z END"))


HOLED = CELLS + f", holed AS (SELECT grid_id, r, c, CASE WHEN {HOLE} THEN NULL ELSE z END AS z FROM cells)"

BLOCKS = "(r BETWEEN 20 AND 27 AND c BETWEEN 30 AND 45) OR (c < 6 AND r > 40)"


def masked(spark: SparkSession, sf: str) -> DataFrame:
    """(grid_id, r, c, z, covered): two blocks and missing rows aren't covered; other holes are covered, without a height."""
    c = cells(spark, sf)
    return c.select("grid_id", "r", "c", F.expr(f"CASE WHEN {HOLE} THEN NULL ELSE z END").alias("z"), F.expr(f"z IS NOT NULL AND NOT ({BLOCKS})").alias("covered"))


MASKED = CELLS + f", masked AS (SELECT grid_id, r, c, CASE WHEN {HOLE} THEN NULL ELSE z END AS z, z IS NOT NULL AND NOT ({BLOCKS}) AS covered FROM cells)"

GRADIENT = CELLS + """, grad AS (SELECT *, CASE WHEN lag(z) OVER v IS NULL THEN (lead(z) OVER v - z) / 2.0 WHEN lead(z) OVER v IS NULL THEN (z - lag(z) OVER v) / 2.0 ELSE (lead(z) OVER v - lag(z) OVER v) / 4.0 END AS dr,
  CASE WHEN lag(z) OVER h IS NULL THEN (lead(z) OVER h - z) / 2.0 WHEN lead(z) OVER h IS NULL THEN (z - lag(z) OVER h) / 2.0 ELSE (lead(z) OVER h - lag(z) OVER h) / 4.0 END AS dc
  FROM cells WINDOW v AS (PARTITION BY grid_id, c ORDER BY r), h AS (PARTITION BY grid_id, r ORDER BY c))"""

SHADE = " + ".join(
    f"{w} * greatest(0.0, least(1.0, (-dc * cos(radians(35)) * sin(radians({a})) + dr * cos(radians(35)) * cos(radians({a})) + sin(radians(35))) / sqrt(dc * dc + dr * dr + 1)))" for a, w in SUNS
)

FAMILY = {"purchase": "settlement", "signup": "monument", "click": "cultivation", "view": "road"}


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """(grid_id, r, c, family): cells with recorded remains."""
    n = table(spark, sf, "embeddings").agg(F.count_distinct(F.expr("vec_id div 64")).alias("n"))
    f = F.expr("CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FAMILY.items()) + " END")
    e = table(spark, sf, "events").crossJoin(F.broadcast(n))  # one row
    return e.where("n > 0").select(F.expr("user_id % n").alias("grid_id"), F.expr("int(event_id % 64)").alias("r"), F.expr("int((event_id div 64) % 64)").alias("c"), f.alias("family")).where("family IS NOT NULL").distinct()


EVIDENCE = """evidence AS (SELECT DISTINCT user_id % n AS grid_id, (event_id % 64)::INT AS r, ((event_id // 64) % 64)::INT AS c,
  CASE event_type WHEN 'purchase' THEN 'settlement' WHEN 'signup' THEN 'monument' WHEN 'click' THEN 'cultivation' WHEN 'view' THEN 'road' END AS family
  FROM events, (SELECT count(DISTINCT vec_id // 64) AS n FROM embeddings) WHERE n > 0 AND event_type IN ('purchase', 'signup', 'click', 'view'))"""


def sites(spark: SparkSession, sf: str) -> DataFrame:
    """(slug, name, e, n, half, county, region)."""
    s, na, re = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    j = s.join(F.broadcast(na), s["s_nationkey"] == na["n_nationkey"]).join(F.broadcast(re), na["n_regionkey"] == re["r_regionkey"])
    return j.select("s_suppkey", F.col("s_name").alias("name"), F.expr("(s_suppkey * 37) % 1000").alias("e"), F.expr("(s_suppkey * 91) % 1000").alias("n"), F.expr("50 + s_suppkey % 50").alias("half"), F.col("n_name").alias("county"), F.col("r_name").alias("region"))


SITES = """sites AS (SELECT s_suppkey, s_name AS name, (s_suppkey * 37) % 1000 AS e, (s_suppkey * 91) % 1000 AS n, 50 + s_suppkey % 50 AS half, n_name AS county, r_name AS region
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def features(spark: SparkSession, sf: str) -> DataFrame:
    """(id, name, type, min_e, max_e, min_n, max_n): registered remains with their envelopes."""
    x, y, w, h = "(c_custkey * 53) % 1000", "(c_custkey * 29) % 1000", "1 + c_nationkey", "1 + c_custkey % 7"
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), F.expr(f"{x} - ({w})").alias("min_e"), F.expr(f"{x} + {w}").alias("max_e"), F.expr(f"{y} - ({h})").alias("min_n"), F.expr(f"{y} + {h}").alias("max_n"))


FEATURES = """features AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS type, (c_custkey * 53) % 1000 - (1 + c_nationkey) AS min_e, (c_custkey * 53) % 1000 + 1 + c_nationkey AS max_e,
  (c_custkey * 29) % 1000 - (1 + c_custkey % 7) AS min_n, (c_custkey * 29) % 1000 + 1 + c_custkey % 7 AS max_n FROM customer)"""


def vertices(spark: SparkSession, sf: str) -> DataFrame:
    """(feature_id, seq, x, y, closed): an outline through all orders of a customer; those of even features are closed rings."""
    o = table(spark, sf, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    v = o.select(F.col("o_custkey").alias("feature_id"), F.row_number().over(w).alias("seq"), F.expr("o_orderkey % 997").alias("x"), F.expr("(o_orderkey * 31) % 991").alias("y"))
    return v.withColumn("closed", F.col("feature_id") % 2 == 0)


VERTICES = """vertices AS (SELECT o_custkey AS feature_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq,
  o_orderkey % 997 AS x, (o_orderkey * 31) % 991 AS y, o_custkey % 2 = 0 AS closed FROM orders)"""


def rings(spark: SparkSession, sf: str) -> DataFrame:
    """(feature_id, ring, seq, x, y, closed, hole): the first five points of an outline, and the rest as a second ring (a hole) or a second line."""
    v = vertices(spark, sf).withColumn("ring", (F.col("seq") > 5).cast("int"))
    return v.select("feature_id", "ring", F.when(F.col("seq") > 5, F.col("seq") - 5).otherwise(F.col("seq")).alias("seq"), "x", "y", "closed", (F.col("closed") & (F.col("seq") > 5)).alias("hole"))


RINGS = VERTICES + """, rings AS (SELECT feature_id, (seq > 5)::INT AS ring, CASE WHEN seq > 5 THEN seq - 5 ELSE seq END AS seq, x, y, closed, closed AND seq > 5 AS hole FROM vertices)"""


def level_samples(spark: SparkSession, sf: str) -> DataFrame:
    """(slug, bp, value): boundary heights by site and century."""
    return table(spark, sf, "events").select(F.col("user_id").alias("slug"), (800 + 100 * F.dayofmonth("ts")).alias("bp"), "value")


LEVELS = "samples AS (SELECT user_id AS slug, (800 + 100 * day(ts))::INT AS bp, value FROM events)"


def observers(spark: SparkSession, sf: str) -> DataFrame:
    """(obs_id, grid_id, row, col, height): an observer for each site, at tenths of a cell."""
    n = table(spark, sf, "embeddings").agg(F.count_distinct(F.expr("vec_id div 64")).alias("n"))
    s = table(spark, sf, "supplier").crossJoin(F.broadcast(n)).where("n > 0")  # one row
    return s.selectExpr("s_suppkey AS obs_id", "s_suppkey % n AS grid_id", "((s_suppkey * 91) % 500) / 10.0D AS row", "((s_suppkey * 37) % 630) / 10.0D AS col", "1.7D AS height")


OBSERVERS = """observers AS (SELECT s_suppkey AS obs_id, s_suppkey % n AS grid_id, ((s_suppkey * 91) % 500) / 10.0 AS row, ((s_suppkey * 37) % 630) / 10.0 AS col, 1.7 AS height
  FROM supplier, (SELECT count(DISTINCT vec_id // 64) AS n FROM embeddings))"""


def rays(spark: SparkSession, sf: str) -> DataFrame:
    """(ray_id, grid_id, r, c, h, dr, dc, dh): a ray for each site, downwards from above a grid."""
    n = table(spark, sf, "embeddings").agg(F.count_distinct(F.expr("vec_id div 64")).alias("n"))
    s = table(spark, sf, "supplier").crossJoin(F.broadcast(n))  # one row
    return s.selectExpr("s_suppkey AS ray_id", "s_suppkey % n AS grid_id", "CAST(s_suppkey * 7 % 50 AS DOUBLE) AS r", "CAST(s_suppkey * 11 % 50 AS DOUBLE) AS c", "24.0D AS h", "(s_suppkey % 7) / 10.0D AS dr", "(s_suppkey % 5) / 10.0D AS dc", "-0.3D AS dh")


def build_log(spark: SparkSession, sf: str) -> DataFrame:
    """(slug, at, kind, ok, bytes): what happened to each site, in order of at."""
    kind = "CASE o_orderstatus WHEN 'O' THEN 'build' WHEN 'F' THEN 'upload' ELSE 'failure' END"
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("slug"), F.struct(F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("k")).alias("at"), F.expr(kind).alias("kind"), (F.col("o_orderkey") % 5 != 0).alias("ok"), F.col("o_totalprice").alias("bytes"))


BUILD_LOG = """build_log AS (SELECT o_custkey AS slug, (o_orderdate, o_orderkey) AS "at", CASE o_orderstatus WHEN 'O' THEN 'build' WHEN 'F' THEN 'upload' ELSE 'failure' END AS kind,
  o_orderkey % 5 <> 0 AS ok, o_totalprice AS bytes FROM orders)"""


def inventory(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(slug, name, digest) of local and of published files."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("slug"), F.col("l_linenumber").alias("name"), "l_partkey", "l_suppkey", "l_returnflag")
    local = li.select("slug", "name", F.md5(F.col("l_partkey").cast("string")).alias("digest"))
    changed = F.when(F.col("l_suppkey") % 10 == 0, F.concat(F.col("l_partkey").cast("string"), F.lit("x"))).otherwise(F.col("l_partkey").cast("string"))
    return local, li.where("l_returnflag <> 'A'").select("slug", "name", F.md5(changed).alias("digest"))


INVENTORY = """loc AS (SELECT l_orderkey AS slug, l_linenumber AS name, md5(l_partkey::VARCHAR) AS digest FROM lineitem),
  rem AS (SELECT l_orderkey AS slug, l_linenumber AS name, md5(l_partkey::VARCHAR || CASE WHEN l_suppkey % 10 = 0 THEN 'x' ELSE '' END) AS digest FROM lineitem WHERE l_returnflag <> 'A')"""
