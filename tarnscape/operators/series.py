"""Water levels by century: samples along shorelines, a trend for what is missing, a monotone table, and its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnscape.operators import vectors
from tarnscape.session import cut, large


def shore_samples(outlines: DataFrame, cells: DataFrame, margin: int = 2) -> DataFrame:
    """(slug, bp, z, n): how many points a cell apart along the shores of each site and century have a height.

    ``outlines`` are vertices in cell units with slug and bp for each feature. Segments keep
    both ends, so shared vertices count twice. Points within ``margin`` cells of the edge go:
    there an outline follows the clip, not a shore. A point takes the cell that it lies in."""
    size = cells.groupBy(F.col("grid_id").alias("slug")).agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    p = vectors.densified(outlines.join(size, "slug"), 1.0, more=("slug", "bp", "h", "w"))
    p = p.where((F.col("x").between(margin, F.col("w") - margin)) & (F.col("y").between(margin, F.col("h") - margin)))
    p = p.groupBy("slug", "bp", F.floor("y").cast("int").alias("r"), F.floor("x").cast("int").alias("c")).agg(F.count("*").alias("n"))
    j = p.join(large(cells.where("z IS NOT NULL").select(F.col("grid_id").alias("slug"), "r", "c", "z")), ["slug", "r", "c"])
    return j.groupBy("slug", "bp", "z").agg(F.sum("n").alias("n"))


def century_levels(present: DataFrame, samples: DataFrame, least: int = 50) -> DataFrame:
    """(slug, bp, year, level, samples, raw, trend_rms): from heights (slug, bp, z, and n where a row is many) a level for every (slug, bp) in ``present``, oldest first never rising.

    Measured is the median of at least ``least`` samples, to 0.1; what lacks them takes the
    site's linear trend through its measured centuries. A site with fewer than two measured
    centuries has no trend, and unmeasured centuries of it no level."""
    samples = samples if "n" in samples.columns else samples.withColumn("n", F.lit(1))
    m = samples.where("z IS NOT NULL").groupBy("slug", "bp").agg(F.percentile("z", 0.5, F.col("n")).alias("z"), F.sum("n").alias("samples")).where(F.col("samples") >= least).select("slug", "bp", F.bround("z", 1).alias("z"), "samples")
    y = (1950 - F.col("bp")).cast("double")
    fit = m.groupBy("slug").agg(F.regr_slope("z", y).alias("a"), F.regr_intercept("z", y).alias("b"), F.count("*").alias("n")).where("n > 1")
    miss = F.col("z") - (F.col("a") * y + F.col("b"))
    rms = m.join(fit, "slug").groupBy("slug").agg(F.sqrt(F.avg(miss * miss)).alias("trend_rms"))
    j = present.select("slug", "bp").distinct().join(m, ["slug", "bp"], "left").join(fit, "slug", "left").join(rms, "slug", "left")
    raw = F.coalesce("z", F.bround(F.col("a") * y + F.col("b"), 1))
    w = Window.partitionBy("slug").orderBy(F.desc("bp")).rowsBetween(Window.unboundedPreceding, 0)
    t = j.select("slug", "bp", (1950 - F.col("bp")).alias("year"), F.coalesce("samples", F.lit(0)).alias("samples"), raw.alias("raw"), "trend_rms")
    return t.withColumn("level", F.bround(F.min("raw").over(w), 1)).select("slug", "bp", "year", "level", "samples", "raw", "trend_rms")


def levels_at(steps: DataFrame, questions: DataFrame) -> DataFrame:
    """All columns of ``questions`` (slug, year, ...) with level: that of the site's table ``steps`` (slug, year, level) at any year.

    Linear between the two steps around the year, and the first or last level beyond the
    table. Steps without a slug, year or level don't count; of several at one year the lowest
    does. A question without a slug or year, or of a site without steps, has a null level. A
    column named level in ``questions`` is replaced.

    An as-of merge: steps and questions are sorted together by ranges of (slug, year), so a
    site that most questions ask about spreads over many tasks. Within a range the step before
    and after is a running last and first; a table with a row for each slug and range has the
    steps that come from the ranges around it."""
    asked = [c for c in questions.columns if c != "level"]
    step = F.struct(F.col("year").cast("double").alias("y"), F.col("level").cast("double").alias("l"))
    s = steps.where("slug IS NOT NULL AND year IS NOT NULL AND level IS NOT NULL").groupBy("slug", "year").agg(F.min("level").alias("level"))
    s = s.select(F.col("slug").alias("__s"), F.col("year").cast("double").alias("__y"), F.lit(0).cast("long").alias("__k"), step.alias("__step"), F.lit(None).cast(questions.select(F.struct(*asked)).schema[0].dataType).alias("__q"))
    q = questions.select(F.col("slug").alias("__s"), F.col("year").cast("double").alias("__y"), F.monotonically_increasing_id().alias("__k") + 1, F.lit(None).cast("struct<y: double, l: double>").alias("__step"), F.struct(*asked).alias("__q")).toDF(*s.columns)
    ranged = cut(s.unionByName(q).repartitionByRange("__s", "__y", "__k").withColumn("__p", F.spark_partition_id()), "ranges")
    per = ranged.groupBy("__s", "__p").agg(F.max("__step").alias("__high"), F.min("__step").alias("__low"))
    # what comes next is the last in falling order: a frame that grows is summed once, one that shrinks anew for each row
    grown = lambda keys, order, to: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, to)
    around = per.select(
        F.col("__s").alias("__t"), F.col("__p").alias("__r"),
        F.last("__high", True).over(grown(["__s"], ["__p"], -1)).alias("__back"), F.last("__low", True).over(grown(["__s"], [F.desc("__p")], -1)).alias("__ahead"),
    )
    last, after = F.last("__step", True).over(grown(["__s", "__p"], ["__y", "__k"], 0)), F.last("__step", True).over(grown(["__s", "__p"], [F.desc("__y"), F.desc("__k")], 0))
    both = ranged.select("*", last.alias("__last"), after.alias("__next")).where("__q IS NOT NULL")
    both = both.join(around, F.expr("__s = __t AND __p = __r"), "left")
    a, b, y = F.coalesce("__last", "__back"), F.coalesce("__next", "__ahead"), F.col("__y")
    between = a["l"] + (b["l"] - a["l"]) * ((y - a["y"]) / (b["y"] - a["y"]))
    level = F.when(y.isNull(), None).when(a.isNull(), b["l"]).when(b.isNull() | (a["y"] == y), a["l"]).otherwise(between)
    return both.select(*[F.col("__q")[c].alias(c) for c in asked], level.alias("level"))


def missing_centuries(levels: DataFrame, youngest: int = 800, oldest: int = 3000) -> DataFrame:
    """(slug, bp): centuries of the range that a site has no entry for."""
    every = levels.select("slug").distinct().select("slug", F.explode(F.sequence(F.lit(youngest), F.lit(oldest), F.lit(100))).alias("bp"))
    return every.join(levels, ["slug", "bp"], "left_anti")


def implausible(levels: DataFrame, terrain: DataFrame, envelope: tuple[float, float] = (-10.0, 150.0), margin: float = 5.0) -> DataFrame:
    """(slug, bp, level, rule): levels outside what is possible anywhere, or outside the site's own terrain (slug, low, high)."""
    j = levels.join(terrain, "slug")
    rule = F.when(~F.col("level").between(*envelope), "envelope").when(~F.col("level").between(F.col("low") - margin, F.col("high") + margin), "terrain")
    return j.select("slug", "bp", "level", rule.alias("rule")).where("rule IS NOT NULL")


def method_text(levels: DataFrame, missing: DataFrame, checked: Column) -> DataFrame:
    """(slug, text): how a site's table was made, from its own numbers; only what happened is said.

    ``checked`` is true for sites whose table was held against published estimates."""
    measured, filled = F.col("samples") > 0, F.col("samples") == 0
    g = levels.groupBy("slug").agg(F.count_if(measured).alias("n"), F.sum("samples").alias("points"), F.count_if(filled).alias("filled"), F.min(F.when(filled, F.col("year"))).alias("y0"), F.max(F.when(filled, F.col("year"))).alias("y1"), F.max("trend_rms").alias("rms"), F.sum(F.col("raw") - F.col("level")).alias("moved"))
    gone = missing.groupBy("slug").agg(F.count("*").alias("gone"))
    g = g.join(gone, "slug", "left")
    parts = [
        F.format_string("Levels of %d centuries are medians of %d heights along the modelled shore.", "n", "points"),
        F.when(F.col("filled") > 0, F.format_string("%d centuries (%d to %d) have no shore in frame and follow a linear trend (RMS %.2f m).", "filled", "y0", "y1", F.coalesce("rms", F.lit(0.0)))),
        F.when(F.col("gone") > 0, F.format_string("%d centuries are absent from the source.", "gone")),
        F.when(F.col("moved") > 0.05, F.format_string("The table was lowered by %.1f m in all so that it never rises.", "moved")),
        F.when(checked, "It was held against published estimates.").otherwise("It was held against the site's own terrain."),
    ]
    return g.select("slug", F.concat_ws(" ", *parts).alias("text"))
