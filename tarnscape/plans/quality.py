"""Quality gates as constraint queries, and documents put together (Q, M)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnscape.operators.terrain import verdict
from tarnscape.plans.base import query
from tarnscape.plans.registers import CLAMP, STATE
from tarnscape.session import table
from tarnscape.sources import fixtures as fx
from tarnscape.streaming import state


@query(f"WITH {fx.CELLS} SELECT grid_id, CASE WHEN min(z) < 1 OR max(z) > 19 THEN 'fail' ELSE 'pass' END AS severity, min(z) AS low, max(z) AS high FROM cells GROUP BY 1")
def q1_elevation_band(spark, sf):
    g = fx.cells(spark, sf).groupBy("grid_id").agg(F.min("z").alias("low"), F.max("z").alias("high"))
    return g.select("grid_id", F.when((F.col("low") < 1) | (F.col("high") > 19), "fail").otherwise("pass").alias("severity"), "low", "high")


@query(f"WITH {fx.HOLED}, s AS (SELECT grid_id, avg((z IS NULL)::INT) AS share FROM holed GROUP BY 1) SELECT grid_id, round(share, 6) AS share, CASE WHEN share >= 0.05 THEN 'fail' WHEN share >= 0.01 THEN 'warn' ELSE 'pass' END AS severity FROM s")
def q2_nodata_share(spark, sf):
    s = fx.holed(spark, sf).groupBy("grid_id").agg(F.avg(F.col("z").isNull().cast("int")).alias("share"))
    return s.select("grid_id", F.round("share", 6).alias("share"), F.when(F.col("share") >= 0.05, "fail").when(F.col("share") >= 0.01, "warn").otherwise("pass").alias("severity"))


@query(f"""WITH {fx.SITES}, l AS (SELECT s_suppkey, 3830.0 * sqrt(half) AS d, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 4000 * power(2, s_suppkey % 5) END AS reach FROM sites)
  SELECT s_suppkey, CASE WHEN reach IS NULL THEN 'warn' WHEN d > 64001 THEN 'fail' WHEN reach + 1 < d THEN 'fail' ELSE 'pass' END AS severity FROM l""")
def q3_ladder(spark, sf):
    l = fx.sites(spark, sf).select("s_suppkey", (3830.0 * F.sqrt("half")).alias("d"), F.expr("CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 4000 * power(2, s_suppkey % 5) END").alias("reach"))  # noqa: E741
    return l.select("s_suppkey", F.when(F.col("reach").isNull(), "warn").when((F.col("d") > 64001) | (F.col("reach") + 1 < F.col("d")), "fail").otherwise("pass").alias("severity"))


@query("""SELECT c_custkey, CASE WHEN NOT edge THEN 'gap' WHEN share IS NOT NULL AND share <= 0.10 THEN 'sea' WHEN med IS NULL THEN CASE WHEN share IS NOT NULL THEN 'sea' ELSE 'foreign-land' END WHEN med <= 20 THEN 'sea' ELSE 'foreign-land' END AS verdict
  FROM (SELECT c_custkey, c_custkey % 3 <> 0 AS edge, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 10) / 10.0 END AS share, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 41 END AS med FROM customer)""")
def i4_region_verdict(spark, sf):
    r = table(spark, sf, "customer").selectExpr("c_custkey", "c_custkey % 3 <> 0 AS edge", "CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 10) / 10.0 END AS share", "CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 41 END AS med")
    return r.select("c_custkey", verdict(F.col("edge"), F.col("share"), F.col("med")).alias("verdict"))


@query("SELECT o_custkey AS slug, bool_or(o_orderpriority LIKE '1%') <> bool_or(o_orderpriority LIKE '2%') AS broken FROM orders GROUP BY 1")
def q6_pair_gate(spark, sf):
    """Two assets ship together or not at all."""
    has = lambda p: F.bool_or(F.col("o_orderpriority").startswith(p))
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("slug")).agg((has("1") != has("2")).alias("broken"))


@query(f"WITH {fx.BUILD_LOG} SELECT slug, CASE WHEN count(*) FILTER (NOT ok AND kind = 'build') > 0 THEN 'fail' WHEN count(*) FILTER (NOT ok) > 0 THEN 'warn' ELSE 'pass' END AS severity FROM build_log GROUP BY 1")
def q7_step_gate(spark, sf):
    bad = ~F.col("ok")
    g = fx.build_log(spark, sf).groupBy("slug").agg(F.count_if(bad & (F.col("kind") == "build")).alias("hard"), F.count_if(bad).alias("soft"))
    return g.select("slug", F.when(F.col("hard") > 0, "fail").when(F.col("soft") > 0, "warn").otherwise("pass").alias("severity"))


@query(f"""WITH {STATE}, chk AS (SELECT slug, 'qa' AS id, CASE WHEN qa_passed THEN 'pass' ELSE 'fail' END AS sev FROM state UNION ALL SELECT slug, 'upload', CASE WHEN uploaded THEN 'pass' ELSE 'warn' END FROM state UNION ALL SELECT slug, 'steps', CASE WHEN error THEN 'fail' ELSE 'pass' END FROM state)
  SELECT slug, count(*) FILTER (sev = 'fail') AS fails, count(*) FILTER (sev = 'warn') AS warns, count(*) FILTER (sev = 'fail') = 0 AS passed, string_agg(id || '=' || sev, ' ' ORDER BY id) AS summary FROM chk GROUP BY 1""")
def q9_report(spark, sf):
    """Gates put together: passed means that none failed."""
    s = state.fold_state(fx.build_log(spark, sf))
    check = lambda name, sev: F.struct(F.lit(name).alias("id"), sev.alias("sev"))
    all_ = s.select("slug", F.inline(F.array(check("qa", F.when(F.col("qa_passed"), "pass").otherwise("fail")), check("upload", F.when(F.col("uploaded"), "pass").otherwise("warn")), check("steps", F.when(F.col("error"), "fail").otherwise("pass")))))
    text = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "id", "sev"))), " ")
    fails = F.count_if(F.col("sev") == "fail")
    return all_.groupBy("slug").agg(fails.alias("fails"), F.count_if(F.col("sev") == "warn").alias("warns"), (fails == 0).alias("passed"), text.alias("summary"))


@query(f"WITH {CLAMP}, y AS (SELECT slug, bp, 1950 - bp AS year, level, lag(level) OVER w AS before, lag(1950 - bp) OVER w AS y0 FROM cl WINDOW w AS (PARTITION BY slug ORDER BY bp DESC)) SELECT slug, count(*) AS steps, count(*) < 2 OR bool_or(y0 >= year) IS TRUE OR bool_or(level > before) IS TRUE AS broken FROM y GROUP BY 1")
def q10_level_rules(spark, sf):
    """At least two steps, years that rise, levels that don't."""
    v = fx.level_samples(spark, sf).groupBy("slug", "bp").agg(F.median("value").alias("v"))
    w = Window.partitionBy("slug").orderBy(F.desc("bp"))
    y = v.withColumn("level", F.min("v").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("year", 1950 - F.col("bp"))
    y = y.withColumn("before", F.lag("level").over(w)).withColumn("y0", F.lag("year").over(w))
    wrong = F.coalesce(F.bool_or(F.col("y0") >= F.col("year")), F.lit(False)) | F.coalesce(F.bool_or(F.col("level") > F.col("before")), F.lit(False))
    return y.groupBy("slug").agg(F.count("*").alias("steps"), ((F.count("*") < 2) | wrong).alias("broken"))


@query("SELECT c_custkey, coalesce(nullif(c_mktsegment, 'MACHINERY'), 'standard') AS preset, c_acctbal FROM customer WHERE c_acctbal IS NOT NULL AND c_acctbal >= 0")
def q17_index_defaults(spark, sf):
    return table(spark, sf, "customer").where("c_acctbal IS NOT NULL AND c_acctbal >= 0").select("c_custkey", F.coalesce(F.nullif("c_mktsegment", F.lit("MACHINERY")), F.lit("standard")).alias("preset"), "c_acctbal")


@query("SELECT l_orderkey, sum(l_quantity) AS length, CASE WHEN sum(l_quantity) BETWEEN 50 AND 200 THEN 'ok' ELSE 'CHECK' END AS verdict FROM lineitem GROUP BY 1")
def q18_reference_band(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("length"))
    return g.withColumn("verdict", F.when(F.col("length").between(50, 200), "ok").otherwise("CHECK"))


@query(f"WITH {fx.CELLS} SELECT grid_id, min(z) < 0 OR max(z) > 25 AS out_of_band, coalesce(max(z) FILTER (r = 32 AND c = 32) NOT BETWEEN 4 AND 18, FALSE) AS centre_shifted FROM cells GROUP BY 1")
def q19_vertical_shift(spark, sf):
    centre = F.max(F.when((F.col("r") == 32) & (F.col("c") == 32), F.col("z")))
    return fx.cells(spark, sf).groupBy("grid_id").agg(((F.min("z") < 0) | (F.max("z") > 25)).alias("out_of_band"), F.coalesce(~centre.between(4, 18), F.lit(False)).alias("centre_shifted"))
