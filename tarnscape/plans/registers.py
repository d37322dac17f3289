"""Queries over registers: scans, joins, aggregates, ordered windows and site state (S, J, A, W, T)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnscape.operators.joins import envelope_join, records_touching
from tarnscape.plans.base import query
from tarnscape.session import cut, large, new_path, table
from tarnscape.sources import fixtures as fx
from tarnscape.sources import layout, pages, scan
from tarnscape.streaming import state

BOX = {"e": (200, 400), "n": (300, 500)}


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def s1_filtered_scan(spark, sf):
    return table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name", "c_nationkey")


@query("""WITH b AS (SELECT *, coalesce(c_acctbal > 0, FALSE) AS usable, c_custkey % 4 <> 1 AS wanted FROM customer WHERE c_mktsegment = 'BUILDING'),
  n AS (SELECT count(*) FILTER (usable) AS scanned, count(*) FILTER (NOT usable) AS unusable, count(*) FILTER (usable AND wanted) AS kept FROM b)
  SELECT c_nationkey, count(*) AS n, any_value(scanned) AS scanned, any_value(unusable) AS unusable, any_value(kept) AS kept FROM b, n WHERE usable AND wanted GROUP BY 1""")
def s1_scan_counts(spark, sf):
    """What a filtered scan keeps, by nation, with the numbers of rows that it scanned, couldn't use and kept."""
    got, seen = scan.counted_scan(table(spark, sf, "customer"), F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") > 0, F.col("c_custkey") % 4 != 1)
    per = cut(got.groupBy("c_nationkey").agg(F.count("*").alias("n")), "scan")
    return per.select("*", *[F.lit(seen.get[k]).cast("long").alias(k) for k in ("scanned", "unusable", "kept")])


@query(f"WITH {fx.FEATURES} SELECT id, type FROM features WHERE max_e >= 200 AND min_e <= 400 AND max_n >= 300 AND min_n <= 500")
def s2_envelope_scan(spark, sf):
    """The features are written along the curve, and the window opens the files that it touches."""
    path = new_path(spark, "features")
    layout.write_features(fx.features(spark, sf), path, per_file=500)
    return layout.scan_window(spark, path, (*BOX["e"], *BOX["n"])).select("id", "type")


@query("SELECT c_custkey AS id, coalesce(c_name, '?') AS name FROM customer")
def s4_column_variants(spark, sf):
    """Canonical columns from whichever spelling exists, whatever its case."""
    df = table(spark, sf, "customer")
    found = {c.lower(): c for c in df.columns}
    pick = lambda *names: F.coalesce(*[F.col(found[n]) for n in names if n in found])
    return df.select(pick("lamningsnummer", "c_custkey").alias("id"), F.coalesce(pick("lamningsnamn", "c_name"), F.lit("?")).alias("name"))


@query("""WITH f AS (SELECT *, (event_id * 7) % 23 AS page FROM events WHERE (event_id * 7) % 23 <> 5)
  SELECT 'u' || user_id AS id, arg_min(page, page * 10000000000 + event_id) AS page, arg_min(event_id, page * 10000000000 + event_id) AS event_id, arg_min(event_type, page * 10000000000 + event_id) AS event_type, arg_min(round(value, 6), page * 10000000000 + event_id) AS x,
    (SELECT count(*) FROM (SELECT 5 AS page UNION SELECT page FROM f) WHERE page = 5)::BIGINT AS broken FROM f GROUP BY user_id""")
def s6_first_by_id(spark, sf):
    """Events as pages of features on disk, one of them torn; read back in page order, the first of each id kept."""
    f = table(spark, sf, "events").select(
        F.expr("(event_id * 7) % 23").alias("page"), F.col("event_id").alias("seq"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"),
        F.struct("event_id", "event_type").alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(F.round("value", 6), F.lit(0.0)).alias("coordinates")).alias("geometry"),
    )
    path = new_path(spark, "pages")
    pages.write_pages(f.where("page <> 5"), path)
    torn = spark.range(1).select(F.lit(5).alias("page"), F.lit('{"type": "FeatureCollection", "features": [{"id": "u1"}').alias("value"))
    torn.write.mode("append").partitionBy("page").text(path)
    good, bad = pages.read_pages(spark, path, "struct<event_id: long, event_type: string>")
    n = bad.agg(F.count("*").alias("broken"))
    one = pages.first_by_id(good).select("id", "page", "properties.event_id", "properties.event_type", F.col("geometry.coordinates")[0].alias("x"))
    return one.crossJoin(F.broadcast(n))  # one row


@query("""SELECT event_id, lo, hi FROM (SELECT event_id, regexp_extract(name, 'bp([0-9]+)-([0-9]+)', 1)::INT AS lo, regexp_extract(name, 'bp([0-9]+)-([0-9]+)', 2)::INT AS hi
  FROM (SELECT event_id, 'shore_bp' || event_id % 3000 || '-' || (event_id % 3000 + 400) AS name FROM events)) WHERE lo <= 1500 AND hi >= 900""")
def s7_collections(spark, sf):
    name = F.concat(F.lit("shore_bp"), (F.col("event_id") % 3000).cast("string"), F.lit("-"), (F.col("event_id") % 3000 + 400).cast("string"))
    part = lambda i: F.regexp_extract("name", "bp([0-9]+)-([0-9]+)", i).cast("int")
    e = table(spark, sf, "events").select("event_id", name.alias("name"))
    return e.select("event_id", part(1).alias("lo"), part(2).alias("hi")).where("lo <= 1500 AND hi >= 900")


@query(f"WITH {fx.CELLS} SELECT grid_id, r, c, CASE WHEN label % 3 = 0 THEN z + label WHEN label % 3 = 1 THEN z + 5 END AS connect, coalesce(label % 3 = 2, TRUE) OR z IS NULL AS missing FROM cells")
def s9_connect_precedence(spark, sf):
    """The delta form before the absolute one; cells with neither are violations."""
    c = fx.cells(spark, sf)
    delta, absolute = c.where("label % 3 = 0").select("grid_id", "r", "c", F.col("label").alias("delta")), c.where("label % 3 = 1").select("grid_id", "r", "c", (F.col("z") + 5).alias("abs"))
    key = ["grid_id", "r", "c"]
    j = c.join(large(delta), key, "left").join(large(absolute), key, "left")
    v = F.coalesce(F.col("z") + F.col("delta"), "abs")
    return j.select(*key, v.alias("connect"), v.isNull().alias("missing"))


@query(f"WITH {fx.SITES}, {fx.FEATURES} SELECT s_suppkey, id, type FROM sites JOIN features ON max_e >= e - half AND min_e <= e + half AND max_n >= n - half AND min_n <= n + half")
def j1_range_join(spark, sf):
    s = fx.sites(spark, sf).selectExpr("s_suppkey", "e - half AS min_e", "e + half AS max_e", "n - half AS min_n", "n + half AS max_n")
    return envelope_join(s, fx.features(spark, sf)).select("s_suppkey", F.col("id_b").alias("id"), F.col("type_b").alias("type"))


#: Types that a site's map shows.
SHOWN = ("BUILDING", "MACHINERY", "AUTOMOBILE")


@query(f"""WITH {fx.SITES}, {fx.FEATURES}, p AS (SELECT s_suppkey, id // 4 AS record, (id * 7) % 3 AS kind, id, features.name, type, (min_e + max_e) / 2.0 AS x, (min_n + max_n) / 2.0 AS y FROM sites JOIN features ON max_e >= e - half AND min_e <= e + half AND max_n >= n - half AND min_n <= n + half WHERE type IN {SHOWN}),
  b AS (SELECT *, min(kind) OVER (PARTITION BY s_suppkey, record) AS best FROM p)
  SELECT s_suppkey, record, best AS kind, min_by(name, id) AS name, min_by(type, id) AS type, count(*)::INT AS parts, round(min_by(x, id), 2) AS x, round(sum(y) / count(*), 2) AS y FROM b WHERE kind = best GROUP BY s_suppkey, record, best""")
def j1_site_records(spark, sf):
    """What each site's map shows: one record an id, from its polygons, else lines, else points, named by the first of these."""
    s = fx.sites(spark, sf).selectExpr("s_suppkey", "e - half AS min_e", "e + half AS max_e", "n - half AS min_n", "n + half AS max_n")
    f = fx.features(spark, sf).where(F.col("type").isin(*SHOWN))
    middle = F.struct(((F.col("min_e") + F.col("max_e")) / 2.0).alias("x"), ((F.col("min_n") + F.col("max_n")) / 2.0).alias("y"))
    r = records_touching(s, f, F.expr("id div 4"), F.expr("(id * 7) % 3"), F.col("id"), ["name", "type"], middle, ["s_suppkey"])
    total = F.aggregate("geometries", F.lit(0.0), lambda a, g: a + g["y"])
    shown = r.select("record", F.col("rank").alias("kind"), "name", "type", F.size("geometries").alias("parts"), F.round(F.col("geometries")[0]["x"], 2).alias("x"), F.round(total / F.size("geometries"), 2).alias("y"), "near")
    return shown.withColumn("near", F.explode("near")).select("near.s_suppkey", *shown.columns[:-1])


@query(f"WITH {fx.SITES}, {fx.FEATURES}, p AS (SELECT DISTINCT s_suppkey, type FROM sites JOIN features ON max_e >= e - 30 AND min_e <= e + 30 AND max_n >= n - 30 AND min_n <= n + 30) SELECT type, count(*) AS sites, round(count(*) / (SELECT count(*) FROM sites)::DOUBLE, 6) AS share FROM p GROUP BY 1")
def j2_neighbourhood_survey(spark, sf):
    """Share of sites with each type of remain near them."""
    s = fx.sites(spark, sf)
    box = s.selectExpr("s_suppkey", "e - 30 AS min_e", "e + 30 AS max_e", "n - 30 AS min_n", "n + 30 AS max_n")
    p = envelope_join(box, fx.features(spark, sf)).select("s_suppkey", F.col("type_b").alias("type")).distinct()
    total = s.agg(F.count("*").alias("total"))
    return p.groupBy("type").agg(F.count("*").alias("sites")).crossJoin(F.broadcast(total)).select("type", "sites", F.round(F.col("sites") / F.col("total"), 6).alias("share"))


STATE = fx.BUILD_LOG + """, st AS (SELECT slug, bool_or(kind = 'build') AS built, arg_max(ok, "at") FILTER (kind = 'build') AS qa_passed, arg_max(bytes, "at") FILTER (kind = 'build') AS bytes,
  max("at") FILTER (kind = 'upload') AS up, max("at") FILTER (kind = 'build' AND NOT ok) AS bad, max("at") FILTER (kind = 'failure') AS fail, max("at") FILTER (kind IN ('build', 'upload')) AS fine FROM build_log GROUP BY slug),
  state AS (SELECT slug, built, qa_passed, bytes, up IS NOT NULL AND (bad IS NULL OR up > bad) AS uploaded, fail IS NOT NULL AND (fine IS NULL OR fail > fine) AS error FROM st)"""


@query(f"WITH {STATE} SELECT * FROM state")
def t1_site_state(spark, sf):
    return state.fold_state(fx.build_log(spark, sf))


@query(f"WITH {STATE} SELECT c_custkey AS slug, CASE WHEN uploaded AND qa_passed AND c_custkey % 3 = 0 THEN 'evicted' WHEN uploaded AND qa_passed AND c_acctbal > 0 THEN 'unchanged' ELSE 'build' END AS decision FROM customer LEFT JOIN state ON slug = c_custkey")
def t2_skip_decision(spark, sf):
    s = state.fold_state(fx.build_log(spark, sf))
    done = F.col("uploaded") & F.col("qa_passed")
    d = F.when(done & (F.col("slug") % 3 == 0), "evicted").when(done & (F.col("c_acctbal") > 0), "unchanged").otherwise("build")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("slug"), "c_acctbal").join(s, "slug", "left").select("slug", d.alias("decision"))


@query(f"WITH {STATE} SELECT c_custkey AS slug, c_name AS name, n_name AS county, bytes FROM state JOIN customer ON slug = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE uploaded AND qa_passed")
def j8_published_index(spark, sf):
    s = state.fold_state(fx.build_log(spark, sf)).where("uploaded AND qa_passed")
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return s.join(c, s["slug"] == c["c_custkey"]).select("slug", F.col("c_name").alias("name"), F.col("n_name").alias("county"), "bytes")


@query(f"WITH {fx.INVENTORY} SELECT slug, name FROM loc ANTI JOIN rem USING (slug, name)")
def j9_missing_files(spark, sf):
    local, remote = fx.inventory(spark, sf)
    return local.join(remote, ["slug", "name"], "left_anti").select("slug", "name")


@query(f"WITH {fx.INVENTORY} SELECT coalesce(l.slug, r.slug) AS slug, coalesce(l.name, r.name) AS name, CASE WHEN r.digest IS NULL THEN 'new' WHEN l.digest IS NULL THEN 'gone' WHEN l.digest = r.digest THEN 'unchanged' ELSE 'changed' END AS action FROM loc l FULL JOIN rem r ON l.slug = r.slug AND l.name = r.name")
def j10_sync_plan(spark, sf):
    return state.sync_plan(*fx.inventory(spark, sf))


@query(f"WITH {fx.SITES} SELECT region, county, CASE WHEN half >= 80 THEN 'large' ELSE 'standard' END AS preset, count(*) AS n, grouping(region, county, CASE WHEN half >= 80 THEN 'large' ELSE 'standard' END) AS level FROM sites GROUP BY GROUPING SETS ((region), (county), (CASE WHEN half >= 80 THEN 'large' ELSE 'standard' END), ())")
def a1_register_summary(spark, sf):
    s = fx.sites(spark, sf).withColumn("preset", F.when(F.col("half") >= 80, "large").otherwise("standard"))
    r, c, p = F.col("region"), F.col("county"), F.col("preset")
    return s.groupingSets([[r], [c], [p], []], r, c, p).agg(F.count("*").alias("n"), F.grouping_id("region", "county", "preset").alias("level"))


@query("""WITH r AS (SELECT p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
  SELECT p_brand, max(p_retailprice) FILTER (i = least(n - 1, floor(n * 0.5)::INT) + 1) AS p50, max(p_retailprice) FILTER (i = least(n - 1, floor(n * 0.9)::INT) + 1) AS p90, max(p_retailprice) AS top FROM r GROUP BY 1""")
def a2_nearest_rank(spark, sf):
    """Percentiles by nearest rank: the element at min(n - 1, int(n * p))."""
    w = Window.partitionBy("p_brand").orderBy("p_retailprice")
    r = table(spark, sf, "part").withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("p_brand")))
    at = lambda p: F.max(F.when(F.col("i") == F.least(F.col("n") - 1, F.floor(F.col("n") * p)) + 1, F.col("p_retailprice")))
    return r.groupBy("p_brand").agg(at(0.5).alias("p50"), at(0.9).alias("p90"), F.max("p_retailprice").alias("top"))


@query("SELECT event_type, count(*) AS scanned, count(*) FILTER (value > 0) AS kept, count(*) - count(DISTINCT user_id) AS duplicates, count(*) FILTER (value IS NULL) AS unusable FROM events GROUP BY GROUPING SETS ((event_type), ())")
def a3_build_statistics(spark, sf):
    e = table(spark, sf, "events")
    m = [F.count("*").alias("scanned"), F.count_if(F.col("value") > 0).alias("kept"), (F.count("*") - F.count_distinct("user_id")).alias("duplicates"), F.count_if(F.col("value").isNull()).alias("unusable")]
    return e.groupBy("event_type").agg(*m).unionByName(e.agg(*m).withColumn("event_type", F.lit(None).cast("string")))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) AS i FROM events) WHERE i = 1")
def a4_keep_best(spark, sf):
    """One row per id: the first by layer, then by key. An aggregate, so a hot id is combined before the shuffle."""
    g = table(spark, sf, "events").groupBy("user_id").agg(F.min(F.struct("event_type", "event_id")).alias("m"))
    return g.select("user_id", "m.event_type", "m.event_id")


@query(f"WITH {fx.LEVELS} SELECT slug, bp, round(median(value), 6) AS level_m, count(value) AS samples FROM samples GROUP BY 1, 2 HAVING count(value) >= 3")
def a5_century_median(spark, sf):
    g = fx.level_samples(spark, sf).groupBy("slug", "bp").agg(F.round(F.median("value"), 6).alias("level_m"), F.count("value").alias("samples"))
    return g.where("samples >= 3")


@query(f"""WITH {fx.LEVELS}, m AS (SELECT slug, bp, median(value) AS v FROM samples GROUP BY 1, 2), t AS (SELECT slug, regr_slope(v, bp) AS a, regr_intercept(v, bp) AS b, count(*) AS n FROM m GROUP BY 1)
  SELECT m.slug, round(a, 6) AS slope, round(b, 4) AS intercept, round(sqrt(avg((v - (a * bp + b)) * (v - (a * bp + b)))), 4) AS rms FROM m JOIN t USING (slug) WHERE n > 2 GROUP BY m.slug, a, b""")
def a6_trend(spark, sf):
    m = fx.level_samples(spark, sf).groupBy("slug", "bp").agg(F.median("value").alias("v"))
    t = m.groupBy("slug").agg(F.regr_slope("v", F.col("bp")).alias("a"), F.regr_intercept("v", F.col("bp")).alias("b"), F.count("*").alias("n")).where("n > 2")
    miss = F.col("v") - (F.col("a") * F.col("bp") + F.col("b"))
    return m.join(t, "slug").groupBy("slug", "a", "b").agg(F.round(F.sqrt(F.avg(miss * miss)), 4).alias("rms")).select("slug", F.round("a", 6).alias("slope"), F.round("b", 4).alias("intercept"), "rms")


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def a16_census(spark, sf):
    return table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n"))


@query(f"WITH {fx.HOLED} SELECT grid_id, round(avg((z IS NOT NULL)::INT), 6) AS covered, count(*) FILTER (z IS NULL) AS missing FROM holed GROUP BY 1")
def a17_coverage(spark, sf):
    return fx.holed(spark, sf).groupBy("grid_id").agg(F.round(F.avg(F.col("z").isNotNull().cast("int")), 6).alias("covered"), F.count_if(F.col("z").isNull()).alias("missing"))


CLAMP = fx.LEVELS + """, lv AS (SELECT slug, bp, median(value) AS v FROM samples GROUP BY 1, 2), cl AS (SELECT slug, bp, v, min(v) OVER (PARTITION BY slug ORDER BY bp DESC ROWS UNBOUNDED PRECEDING) AS level FROM lv)"""


@query(f"WITH {CLAMP} SELECT slug, bp, round(level, 6) AS level, round(v - level, 6) AS moved, v - level > 1.5 AS broken FROM cl")
def w1_monotone_clamp(spark, sf):
    """Levels that never rise towards the present; a clamp of over 1.5 m is a violation."""
    v = fx.level_samples(spark, sf).groupBy("slug", "bp").agg(F.median("value").alias("v"))
    level = F.min("v").over(Window.partitionBy("slug").orderBy(F.desc("bp")).rowsBetween(Window.unboundedPreceding, 0))
    moved = F.col("v") - F.col("level")
    return v.withColumn("level", level).select("slug", "bp", F.round("level", 6).alias("level"), F.round(moved, 6).alias("moved"), (moved > 1.5).alias("broken"))


@query(f"WITH {fx.CELLS} SELECT grid_id, r, c, z FROM cells WHERE z > 8 AND z <= 10")
def w9_level_slice(spark, sf):
    return fx.cells(spark, sf).where("z > 8 AND z <= 10").select("grid_id", "r", "c", "z")


@query(f"WITH {fx.SITES} SELECT s_suppkey, CASE WHEN lower(name) = 'supplier#000000001' THEN 0 WHEN starts_with(lower(name), 'supplier#00000000') THEN 1 WHEN contains(lower(name), '7') THEN 2 ELSE 3 END AS score FROM sites ORDER BY 2, county, name, s_suppkey LIMIT 200")
def w10_search_ranking(spark, sf):
    """The best 200 matches: exact, prefix, contained, other; then county and name in Swedish order."""
    name = F.lower("name")
    score = F.when(name == "supplier#000000001", 0).when(name.startswith("supplier#00000000"), 1).when(name.contains("7"), 2).otherwise(3)
    s = fx.sites(spark, sf).withColumn("score", score)
    return s.orderBy("score", F.expr("county COLLATE sv"), F.expr("name COLLATE sv"), "s_suppkey").limit(200).select("s_suppkey", "score")


@query(f"""WITH {fx.SITES}, ring(k, half_m) AS (VALUES (3, 4000), (4, 8000), (5, 16000), (6, 32000), (7, 64000)), x AS (SELECT s_suppkey, k, half_m, 3830.0 * sqrt(half) AS d, row_number() OVER (PARTITION BY s_suppkey ORDER BY half_m) AS i, lag(half_m) OVER (PARTITION BY s_suppkey ORDER BY half_m) AS p FROM sites, ring WHERE half_m > 2000)
  SELECT s_suppkey, k FROM x WHERE i <= 2 OR p < d""")
def w12_ring_ladder(spark, sf):
    """The first two rings, and more while the last one is nearer than the horizon."""
    ring = F.broadcast(spark.createDataFrame([(3, 4000), (4, 8000), (5, 16000), (6, 32000), (7, 64000)], "k int, half_m int"))  # five rows
    w = Window.partitionBy("s_suppkey").orderBy("half_m")
    x = fx.sites(spark, sf).crossJoin(ring).where("half_m > 2000").withColumn("i", F.row_number().over(w)).withColumn("p", F.lag("half_m").over(w))
    return x.where((F.col("i") <= 2) | (F.col("p") < 3830.0 * F.sqrt("half"))).select("s_suppkey", "k")
