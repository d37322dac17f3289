"""Queries for projections, filters and scalar functions (F)."""

from pyspark.sql import functions as F

from tarnscape.functions import scalars as fn
from tarnscape.plans.base import query
from tarnscape.session import table
from tarnscape.sources import fixtures as fx


@query("""SELECT c_custkey, CASE WHEN regexp_matches(s, '^[a-z0-9][a-z0-9._-]*$') THEN s END AS slug FROM (SELECT c_custkey,
  regexp_replace(regexp_replace(replace(lower(trim(' ' || c_mktsegment || ':' || c_name || ' /' || c_nationkey || '/ ')), ':', '-'), '[^a-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM customer)""")
def f1_slug(spark, sf):
    c = table(spark, sf, "customer")
    raw = F.concat(F.lit(" "), "c_mktsegment", F.lit(":"), "c_name", F.lit(" /"), F.col("c_nationkey").cast("string"), F.lit("/ "))
    return c.select("c_custkey", fn.slug_for(raw).alias("slug"))


@query("""SELECT s_suppkey, 'supplier-' || s_suppkey AS slug FROM supplier WHERE regexp_matches('supplier-' || s_suppkey, '^[A-Za-z0-9][A-Za-z0-9._-]*$') AND s_acctbal IS NOT NULL AND s_acctbal > 0""")
def f2_valid_entries(spark, sf):
    s = table(spark, sf, "supplier").withColumn("slug", F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")))
    return s.where(F.col("slug").rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$") & (F.col("s_acctbal") > 0)).select("s_suppkey", "slug")


@query(f"""WITH {fx.FEATURES} SELECT id, coalesce(nullif(trim(name), ''), id::VARCHAR) AS name, round_even((min_e + max_e) / 2.0, -1)::BIGINT AS center_e,
  round_even((min_n + max_n) / 2.0, -1)::BIGINT AS center_n, CASE WHEN greatest(max_e - min_e, max_n - min_n) * 40 > 1000 THEN 'large' ELSE 'standard' END AS preset, 'https://example.org/id/' || id AS link FROM features""")
def f4_registry_projection(spark, sf):
    f = fx.features(spark, sf)
    middle = lambda a, b: F.bround((F.col(a) + F.col(b)) / 2, -1).cast("long")
    span = F.greatest(F.col("max_e") - F.col("min_e"), F.col("max_n") - F.col("min_n")) * 40
    return f.select("id", F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.col("id").cast("string")).alias("name"), middle("min_e", "max_e").alias("center_e"), middle("min_n", "max_n").alias("center_n"), fn.preset_for(span).alias("preset"), F.concat(F.lit("https://example.org/id/"), F.col("id").cast("string")).alias("link"))


@query("SELECT conv_id, turn FROM conversations WHERE contains(strip_accents(lower(text)), 'ele') OR contains(strip_accents(lower(role)), 'ele')")
def f5_fold_search(spark, sf):
    c = table(spark, sf, "conversations")
    hit = lambda name: F.expr(f"contains({name} COLLATE UNICODE_CI_AI, 'ele' COLLATE UNICODE_CI_AI)")
    return c.where(hit("text") | hit("role")).select("conv_id", "turn")


@query(f"""WITH {fx.SITES}, spec(grid, half_m, res) AS (VALUES ('core', 100, 1), ('context', 2000, 2), ('ring3', 4000, 4)) SELECT s_suppkey, grid, e - half_m AS min_e, e + half_m AS max_e, n - half_m AS min_n,
  n + half_m AS max_n, (2 * half_m) // res AS size, (2 * half_m) % res = 0 AS integral FROM sites, spec""")
def f7_grid_bounds(spark, sf):
    spec = F.broadcast(spark.createDataFrame([("core", 100, 1), ("context", 2000, 2), ("ring3", 4000, 4)], "grid string, half_m int, res int"))  # three rows
    return fx.sites(spark, sf).crossJoin(spec).selectExpr("s_suppkey", "grid", "e - half_m AS min_e", "e + half_m AS max_e", "n - half_m AS min_n", "n + half_m AS max_n", "(2 * half_m) div res AS size", "(2 * half_m) % res = 0 AS integral")


@query(f"""WITH {fx.CELLS} SELECT grid_id, r, c, (-64.0 + (c + 0.5) * 2)::DOUBLE AS x, (-64.0 + (r + 0.5) * 2)::DOUBLE AS zz, least(greatest(floor((-64.0 + (c + 0.5) * 2 + 64.0) / 2), 0), 63)::INT AS c_back FROM cells""")
def f8_cell_centres(spark, sf):
    x = -64.0 + (F.col("c") + 0.5) * 2
    back = F.least(F.greatest(F.floor((x + 64.0) / 2), F.lit(0)), F.lit(63)).cast("int")
    return fx.cells(spark, sf).select("grid_id", "r", "c", x.alias("x"), (-64.0 + (F.col("r") + 0.5) * 2).alias("zz"), back.alias("c_back"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN q BETWEEN -32768 AND 32767 THEN q::INT END AS raw, ceil(h / 0.5 - 1e-3)::INT AS up, ceil(h / 0.5 - 1e-3)::INT - q::INT AS delta FROM
  (SELECT *, round_even(h / 0.5, 0) AS q FROM (SELECT l_orderkey, l_linenumber, l_extendedprice / 4 AS h FROM lineitem))""")
def f9_quantize(spark, sf):
    h = F.col("l_extendedprice") / 4
    up = fn.quantize_up(h, 0.5)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", fn.quantize(h, 0.5).alias("raw"), up.alias("up"), (up - F.rint(h / 0.5).cast("int")).alias("delta"))


@query(f"WITH {fx.FEATURES} SELECT id, CASE WHEN greatest(max_e - min_e, max_n - min_n) * 40 > 1000 THEN 'large' ELSE 'standard' END AS preset FROM features")
def f3_extent_preset(spark, sf):
    span = F.greatest(F.col("max_e") - F.col("min_e"), F.col("max_n") - F.col("min_n")) * 40
    return fx.features(spark, sf).select("id", fn.preset_for(span).alias("preset"))


@query("SELECT event_id, CASE WHEN value IS NOT NULL THEN ceil(value / 0.1::DOUBLE - 1e-3)::INT END AS up FROM events")
def f10_quantize_up(spark, sf):
    """Heights to steps, rounded up, so that water never ends below them."""
    return table(spark, sf, "events").select("event_id", fn.quantize_up(F.col("value"), 0.1).alias("up"))


@query("SELECT p_partkey, round(3.83 * sqrt(greatest(p_retailprice - 1000, 0.0)) * 1000.0, 4) AS horizon_m, round(p_size * p_size * 1000000.0 * 0.87 / (2 * 6371000), 6) AS drop_m FROM part")
def f12_horizon(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.round(fn.horizon_m(F.col("p_retailprice") - 1000), 4).alias("horizon_m"), F.round(fn.refracted_drop_m(F.col("p_size") * F.col("p_size") * 1000000.0), 6).alias("drop_m"))


_E, _N = fn.sweref_expressions("(11e0 + c_custkey % 130 / 10e0)", "(55e0 + c_custkey % 137 / 10e0)")


@query(f"SELECT c_custkey, round({_E}, 3) AS e, round({_N}, 3) AS n FROM customer")
def f13_projection(spark, sf):
    lon, lat = "(11.0D + c_custkey % 130 / 10.0D)", "(55.0D + c_custkey % 137 / 10.0D)"
    e, n = fn.sweref_expressions(lon, lat)
    return table(spark, sf, "customer").select("c_custkey", F.round(F.expr(e), 3).alias("e"), F.round(F.expr(n), 3).alias("n"))


@query(f"WITH {fx.FEATURES} SELECT id, min_n || ',' || min_e || ',' || max_n || ',' || max_e AS bbox FROM features")
def f14_bbox_text(spark, sf):
    return fx.features(spark, sf).select("id", F.concat_ws(",", "min_n", "min_e", "max_n", "max_e").alias("bbox"))


_GROUPS = [("ECONOMY", 1), ("PROMO", 2), ("STANDARD", 3), ("MEDIUM", 4)]


@query("""SELECT p_partkey, coalesce(g, 8) AS grp, g IS NULL AS other FROM part LEFT JOIN (VALUES ('ECONOMY', 1), ('PROMO', 2), ('STANDARD', 3), ('MEDIUM', 4)) v(t, g) ON split_part(p_type, ' ', 1) = t""")
def f15_soil_groups(spark, sf):
    dim = F.broadcast(spark.createDataFrame(_GROUPS, "t string, g int"))  # fixed table
    p = table(spark, sf, "part")
    return p.join(dim, F.split("p_type", " ")[0] == dim["t"], "left").select("p_partkey", F.coalesce("g", F.lit(8)).alias("grp"), F.col("g").isNull().alias("other"))


@query(f"WITH {fx.FEATURES} SELECT id, type FROM features WHERE type IN ('BUILDING', 'MACHINERY')")
def f16_type_family(spark, sf):
    family = spark.createDataFrame([("settlement", "BUILDING"), ("settlement", "MACHINERY"), ("road", "AUTOMOBILE")], "family string, type string").where("family = 'settlement'")
    return fx.features(spark, sf).join(F.broadcast(family), "type", "left_semi").select("id", "type")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'no-cache' WHEN l_returnflag IN ('A', 'R') THEN 'immutable' ELSE 'max-age=3600' END AS policy, l_returnflag || ' · ' || l_linestatus AS badge FROM lineitem""")
def f17_lookups(spark, sf):
    dim = F.broadcast(spark.createDataFrame([("A", "immutable"), ("R", "immutable")], "k string, policy string"))  # fixed table
    li = table(spark, sf, "lineitem").join(dim, F.col("l_returnflag") == F.col("k"), "left")
    return li.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, "no-cache").otherwise(F.coalesce("policy", F.lit("max-age=3600"))).alias("policy"), F.concat_ws(" · ", "l_returnflag", "l_linestatus").alias("badge"))


@query(f"WITH {fx.SITES} SELECT s_suppkey, round((e * 1000 + 200000 - 200000) / 750000.0 * 220, 6) AS x, round((7700000 - (n * 1000 + 6200000)) / 1600000.0 * 469, 6) AS y FROM sites")
def f18_map_dots(spark, sf):
    return fx.sites(spark, sf).select("s_suppkey", F.round((F.col("e") * 1000) / 750000.0 * 220, 6).alias("x"), F.round((7700000 - (F.col("n") * 1000 + 6200000)) / 1600000.0 * 469, 6).alias("y"))


@query("""SELECT event_id, CASE WHEN y > 0 THEN y || ' CE' WHEN y = 0 THEN '1 BCE' ELSE (-y) || ' BCE' END AS year, CASE WHEN l >= 0 THEN '+' ELSE '' END || printf('%d.%d', l // 10, l % 10) || ' m above present sea' AS level
  FROM (SELECT event_id, floor((event_id % 4001 - 2000) + 0.5)::BIGINT AS y, event_id % 997 AS l FROM events)""")
def f19_year_text(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", fn.format_year(F.col("event_id") % 4001 - 2000).alias("year"), fn.format_level((F.col("event_id") % 997) / 10.0).alias("level"))


@query("""SELECT event_id, regexp_extract(line, '(ring[0-9]+): ([0-9]+) cells', 1) AS ring, regexp_extract(line, '(ring[0-9]+): ([0-9]+) cells', 2)::BIGINT AS cells
  FROM (SELECT event_id, 'ring' || event_id % 6 || ': ' || user_id || ' cells were sea-filled' AS line FROM events WHERE event_type = 'view')""")
def f20_parse_counts(spark, sf):
    line = F.concat(F.lit("ring"), (F.col("event_id") % 6).cast("string"), F.lit(": "), F.col("user_id").cast("string"), F.lit(" cells were sea-filled"))
    p = r"(ring[0-9]+): ([0-9]+) cells"
    e = table(spark, sf, "events").where("event_type = 'view'").withColumn("line", line)
    return e.select("event_id", F.regexp_extract("line", p, 1).alias("ring"), F.regexp_extract("line", p, 2).cast("long").alias("cells"))


@query(f"WITH {fx.CELLS} SELECT grid_id, r, c, CASE WHEN z <= 9 THEN 0 WHEN z > 9 AND z <= 9 + 2 THEN 8 ELSE label END AS class FROM cells")
def f22_hydro_class(spark, sf):
    return fx.cells(spark, sf).select("grid_id", "r", "c", fn.hydro_class(F.col("z"), F.lit(9), 2, F.col("label"), 0, 8).alias("class"))




@query("""WITH a0 AS (SELECT event_id, n, ((event_id % 4294967296)::HUGEINT + (n + 1) * 1831565813::HUGEINT) % 4294967296 AS a FROM events, range(0, 3) t(n)),
  t1 AS (SELECT *, (xor(a::BIGINT, (a::BIGINT >> 15))::HUGEINT * (a::BIGINT | 1)::HUGEINT) % 4294967296 AS t FROM a0),
  t2 AS (SELECT *, (t + (xor(t::BIGINT, t::BIGINT >> 7)::HUGEINT * (t::BIGINT | 61)::HUGEINT) % 4294967296) % 4294967296 AS u FROM t1),
  t3 AS (SELECT *, xor(t::BIGINT, u::BIGINT) AS v FROM t2)
  SELECT event_id, n, xor(v, v >> 14) / 4294967296.0::DOUBLE AS draw FROM t3""")
def f23_random_draws(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("n"))
    return e.select("event_id", "n", fn.draw(F.col("event_id"), F.col("n")).alias("draw"))


@query("SELECT DISTINCT label, label % 3 = 0 AS vegetated, label IN (0, 8) AS dynamic FROM embeddings WHERE label NOT IN (8)")
def f25_legend_classes(spark, sf):
    e = table(spark, sf, "embeddings").where("label <> 8").select("label").distinct()
    return e.select("label", (F.col("label") % 3 == 0).alias("vegetated"), F.col("label").isin(0, 8).alias("dynamic"))
