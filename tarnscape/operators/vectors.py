"""Geometry over vertex tables (feature_id, ring, seq, x, y, closed, hole): one row a vertex, no repeated last one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = ["feature_id", "ring"]


def _order() -> Window:
    return Window.partitionBy(*PART).orderBy("seq")


def segments(v: DataFrame) -> DataFrame:
    """Adds x2, y2 and len: the next vertex of the ring or line, and the way to it. A closed ring's last meets its first; an open line's last goes."""
    nxt = lambda c: F.coalesce(F.lead(c).over(_order()), F.when(F.col("closed"), F.first(c).over(_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    s = v.withColumn("x2", nxt("x")).withColumn("y2", nxt("y")).where("x2 IS NOT NULL")
    return s.withColumn("len", F.sqrt((F.col("x2") - F.col("x")) ** 2 + (F.col("y2") - F.col("y")) ** 2))


def at_length(seg: DataFrame, along: Column) -> tuple[Column, Column]:
    """x and y at ``along`` on a segment whose ``done`` length lies before it."""
    t = (along - F.col("done")) / F.col("len")
    return F.col("x") + (F.col("x2") - F.col("x")) * t, F.col("y") + (F.col("y2") - F.col("y")) * t


def walked(v: DataFrame, by: list[str] = PART) -> DataFrame:
    """Segments that have a length, with done and total: the length before each and of all, over the parts of ``by`` in order."""
    s = segments(v).where("len > 0")
    w = Window.partitionBy(*by).orderBy("ring", "seq")
    s = s.withColumn("done", F.coalesce(F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return s.withColumn("total", F.sum("len").over(Window.partitionBy(*by)))


def centroids(v: DataFrame, least: int = 4) -> DataFrame:
    """(feature_id, x, y, area): area-weighted centroid of closed rings, holes taken off, whichever way a ring winds.

    Rings of fewer than ``least`` vertices don't count; features whose area is under 1e-9 are absent."""
    k = F.col("x") * F.col("y2") - F.col("x2") * F.col("y")
    r = segments(v.where("closed")).groupBy(*PART).agg(F.count("*").alias("n"), F.bool_or("hole").alias("hole"), F.sum(k).alias("a2"), F.sum((F.col("x") + F.col("x2")) * k).alias("cx"), F.sum((F.col("y") + F.col("y2")) * k).alias("cy"))
    sign = F.signum("a2") * F.when(F.col("hole"), -1).otherwise(1)
    f = r.where(F.col("n") >= least).groupBy("feature_id").agg(F.sum(F.col("a2") * sign / 2.0).alias("area"), F.sum(F.col("cx") * sign / 6.0).alias("mx"), F.sum(F.col("cy") * sign / 6.0).alias("my"))
    return f.where("abs(area) >= 1e-9").select("feature_id", (F.col("mx") / F.col("area")).alias("x"), (F.col("my") / F.col("area")).alias("y"), "area")


def midpoints(v: DataFrame) -> DataFrame:
    """(feature_id, x, y): half way along open lines by length, parts in order."""
    s = walked(v.where("NOT closed"), ["feature_id"])
    half = s.where("done + len >= total / 2").groupBy("feature_id").agg(F.min(F.struct("ring", "seq", "x", "y", "x2", "y2", "len", "done", "total")).alias("s")).select("feature_id", "s.*")
    x, y = at_length(half, F.col("total") / 2)
    return half.select("feature_id", x.alias("x"), y.alias("y"))


def representative_points(v: DataFrame) -> DataFrame:
    """(feature_id, x, y, rule): the centroid of polygons, else the midpoint of lines, else the mean of the vertices.

    Of a feature of several kinds the richest counts: polygons before lines."""
    mean = v.groupBy("feature_id").agg(F.bool_or("closed").alias("polygon"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    c = centroids(v).select("feature_id", F.struct("x", "y", F.lit("centroid").alias("rule")).alias("c"))
    m = midpoints(v).select("feature_id", F.struct("x", "y", F.lit("midpoint").alias("rule")).alias("m"))
    j = mean.join(c, "feature_id", "left").join(m, "feature_id", "left")
    best = F.coalesce(F.when(F.col("polygon"), F.col("c")).otherwise(F.col("m")), F.struct(F.col("mx").alias("x"), F.col("my").alias("y"), F.lit("mean").alias("rule")))
    return j.select("feature_id", best.alias("p")).select("feature_id", "p.*")


def resampled(v: DataFrame, step: float) -> DataFrame:
    """(feature_id, ring, i, x, y): points at even lengths of closed rings, about ``step`` apart and three at least."""
    s = walked(v.where("closed")).withColumn("m", F.greatest(F.lit(3.0), F.rint(F.col("total") / step))).withColumn("by", F.col("total") / F.col("m"))
    return _targets(s, F.col("m") - 1)


def _targets(s: DataFrame, last: Column, *more: Column) -> DataFrame:
    """Points at i * by for i from 0 to ``last``: a segment knows which fall on it, so no join is needed."""
    first, end = F.greatest(F.lit(0), F.floor(F.col("done") / F.col("by")) - 1), F.least(last, F.ceil((F.col("done") + F.col("len")) / F.col("by")) + 1)
    s = s.withColumn("i", F.explode(F.when(end >= first, F.sequence(first.cast("long"), end.cast("long")))))
    along = F.col("i") * F.col("by")
    s = s.where((F.col("i") <= last) & (along >= F.col("done")) & (along < F.col("done") + F.col("len")))
    x, y = at_length(s, along)
    return s.select(*PART, "i", x.alias("x"), y.alias("y"), *more)


def densified(v: DataFrame, step: float, shared: bool = True, window: tuple[float, float, float, float] | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """(feature_id, ring, seq, k, x, y, more): points at most ``step`` apart along each segment.

    With ``shared`` both ends of a segment are points, so vertices come twice and weigh twice
    in a median. Without, a segment has no last point, but the last of an open line has.
    Segments that can't reach the ``window`` (x0, y0, x1, y1) are dropped before."""
    s = segments(v)
    if window:
        x0, y0, x1, y1 = window
        s = s.where((F.greatest("x", "x2") >= x0) & (F.least("x", "x2") <= x1) & (F.greatest("y", "y2") >= y0) & (F.least("y", "y2") <= y1))
    last = F.lit(True) if shared else (~F.col("closed") & (F.col("seq") == F.max("seq").over(Window.partitionBy(*PART))))
    s = s.withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("len") / step)).cast("long")).withColumn("end", F.col("n") - F.when(last, 0).otherwise(1))
    s = s.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("end"))))
    at = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * F.col("k") / F.col("n")
    return s.select(*PART, "seq", "k", at("x", "x2").alias("x"), at("y", "y2").alias("y"), *more)


def posts(v: DataFrame, spacing: float) -> DataFrame:
    """(feature_id, ring, i, x, y, heading): a post every ``spacing`` along each line or ring.

    A closed ring has two posts at least and its spacing is changed to divide its length."""
    s = walked(v).withColumn("m", F.greatest(F.lit(2.0), F.floor(F.col("total") / spacing + 0.5)))
    s = s.withColumn("by", F.when(F.col("closed"), F.col("total") / F.col("m")).otherwise(F.lit(float(spacing))))
    last = F.when(F.col("closed"), F.col("m") - 1).otherwise(F.floor(F.col("total") / spacing).cast("double"))
    return _targets(s, last, F.atan2(F.col("y2") - F.col("y"), F.col("x2") - F.col("x")).alias("heading"))


def inward_normals(points: DataFrame, least_area: float = 1e-3) -> DataFrame:
    """(feature_id, ring, i, x, y, nx, ny): unit normals of closed rings of points, towards the inside.

    From the points before and after each; the side is that of the ring's signed area. Rings
    of an area under ``least_area``, and points with no direction, have null normals."""
    w = Window.partitionBy(*PART).orderBy("i")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    prev = lambda c: F.coalesce(F.lag(c).over(w), F.last(c).over(whole))
    p = points.withColumn("xn", nxt("x")).withColumn("yn", nxt("y")).withColumn("xp", prev("x")).withColumn("yp", prev("y"))
    area = F.sum(F.col("x") * F.col("yn") - F.col("xn") * F.col("y")).over(Window.partitionBy(*PART))
    tx, ty = F.col("xn") - F.col("xp"), F.col("yn") - F.col("yp")
    size = F.sqrt(tx * tx + ty * ty)
    side = F.when((F.abs(area) > least_area) & (size > 1e-6), F.signum(area))
    return p.withColumn("side", side).withColumn("size", size).select(*PART, "i", "x", "y", (-F.col("side") * ty / F.col("size")).alias("nx"), (F.col("side") * tx / F.col("size")).alias("ny"))


def circular(points: DataFrame, half: int, value: str, out: str, how: str = "avg") -> DataFrame:
    """Adds ``out``: mean or median of ``value`` over ``half`` points on each side, around a closed ring (i from 0)."""
    n = F.max("i").over(Window.partitionBy(*PART)) + 1
    i, m = F.col("i"), F.col("__n")
    ends = F.array_compact(F.array(i, F.when(i < half, i + m), F.when(i >= m - half, i - m)))
    wrapped = points.withColumn("__n", n).withColumn("__i", F.explode(ends)).drop("__n")
    frame = f"OVER (PARTITION BY feature_id, ring ORDER BY __i ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    f = f"avg({value})" if how == "avg" else f"percentile({value}, 0.5)"
    return wrapped.withColumn(out, F.expr(f"{f} {frame}")).where("__i = i").drop("__i")


def _spans(v: DataFrame, res: float) -> DataFrame:
    """(feature_id, r, c0, c1): runs of cells of a lattice of ``res`` whose centres lie in the closed rings of a feature: even-odd, half-open in y; no run is empty.

    Each edge gives its crossing of every row in its reach, crossings pair up in order, and
    the cells between the two of a pair are inside."""
    s = segments(v.where("closed")).where("y != y2")
    low, high = F.least("y", "y2"), F.greatest("y", "y2")
    first, last = F.ceil(low / res - 0.5).cast("long"), (F.ceil(high / res - 0.5) - 1).cast("long")
    s = s.withColumn("r", F.explode(F.when(last >= first, F.sequence(first, last))))
    cross = F.col("x") + ((F.col("r") + 0.5) * res - F.col("y")) * (F.col("x2") - F.col("x")) / (F.col("y2") - F.col("y"))
    # the first cell at or after a crossing: rounding keeps the order of crossings
    k = s.select("feature_id", F.col("r").cast("int").alias("r"), F.ceil(cross / res - 0.5).cast("int").alias("c0"))
    w = Window.partitionBy("feature_id", "r").orderBy("c0")
    k = k.withColumn("c1", F.lead("c0").over(w) - 1).withColumn("odd", F.row_number().over(w) % 2 == 1)
    return k.where("odd AND c1 >= c0").drop("odd")


def cells_in_rings(v: DataFrame, res: float) -> DataFrame:
    """(feature_id, r, c): cells of a lattice of ``res`` whose centres lie in the closed rings of a feature (see _spans): work grows with what is covered."""
    return _spans(v, res).select("feature_id", "r", F.explode(F.sequence("c0", "c1")).alias("c"))


def _touched(s: DataFrame, res: float, *kept: str) -> DataFrame:
    """(feature_id, r, c, kept): cells that segments touch, at steps of half a cell at most; a cell may come several times."""
    s = s.withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("len") / (res / 2))).cast("long"))
    s = s.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    at = lambda a, b: F.floor((F.col(a) + (F.col(b) - F.col(a)) * F.col("k") / F.col("n")) / res).cast("int")
    return s.select("feature_id", at("y", "y2").alias("r"), at("x", "x2").alias("c"), *kept)


def cells_on_lines(v: DataFrame, res: float) -> DataFrame:
    """(feature_id, r, c): cells that lines touch, at steps of half a cell at most."""
    return _touched(segments(v), res).distinct()


def burned(v: DataFrame, values: DataFrame, res: float) -> DataFrame:
    """(r, c, value, feature_id): of all features that cover a cell, the value of the one with the smallest area (ties: the larger feature_id, burned last).

    Closed rings cover the cells whose centres they hold; open lines and single points cover
    the cells they touch, and have no area. ``values`` has feature_id and value. Areas go to
    runs of cells and to segments, and each batch of runs is brought to one row a cell, so
    no single cell of a feature is sorted or shuffled, and one that comes twice does no harm."""
    area = centroids(v, 3).select("feature_id", "area")
    value = values.groupBy("feature_id").agg(F.min("value").alias("value"))
    of = value.join(area, "feature_id", "left").select("feature_id", F.coalesce("area", F.lit(0.0)).alias("area"))
    lines = v.where("NOT closed")
    runs = _spans(v, res).join(of, "feature_id").withColumn("c0", F.explode(F.sequence("c0", "c1", F.lit(RUN)))).withColumn("c1", F.least("c1", F.col("c0") + RUN - 1))
    dots = lines.join(of, "feature_id").select("feature_id", "area", F.floor(F.col("y") / res).cast("int").alias("r"), F.floor(F.col("x") / res).cast("int").alias("c"))
    cells = _touched(segments(lines).join(of, "feature_id"), res, "area").unionByName(dots)
    every = runs.select("feature_id", "area", "r", "c0", "c1").unionByName(cells.select("feature_id", "area", "r", F.col("c").alias("c0"), F.col("c").alias("c1")))
    best = F.min(F.struct("area", (-F.col("feature_id")).alias("last"))).alias("b")
    won = every.mapInPandas(_best, "r int, c int, area double, feature_id long").groupBy("r", "c").agg(best)
    return won.select("r", "c", (-F.col("b.last")).alias("feature_id")).join(value, "feature_id").select("r", "c", "value", "feature_id")


#: Cells of a run at most, so a batch of runs has a bounded number.
RUN = 256


def _best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each batch of runs the smallest area in each cell (ties: the larger feature_id): Spark would sort all cells for the least of a struct."""
    for b in batches:
        b = b.iloc[np.lexsort((-b["feature_id"].to_numpy(), b["area"].to_numpy()))]
        many = (b["c1"] - b["c0"] + 1).to_numpy(np.int64)
        at = np.repeat(np.arange(len(b)), many)
        r, c = b["r"].to_numpy(np.int64)[at], b["c0"].to_numpy(np.int64)[at] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        _, first = np.unique(r * 2**32 + (c + 2**31), return_index=True)
        own = at[first]
        yield pd.DataFrame({"r": r[first], "c": c[first], "area": b["area"].to_numpy()[own], "feature_id": b["feature_id"].to_numpy()[own]})


def merged_kinds(members: DataFrame) -> DataFrame:
    """(grp, member, kind): rows of one group become one geometry; ``members`` has grp, member, kind.

    Single geometries of a kind make a multi one, whose parts are in the order of member; of
    several multi ones only the first stays. One row a member, so a group of any size is
    never in one row or task."""
    per = members.groupBy("grp", "kind").agg(F.count("*").alias("n"), F.min("member").alias("first"))
    j = members.join(per, ["grp", "kind"])
    many = F.col("kind").startswith("multi")
    j = j.where(~many | (F.col("member") == F.col("first")))
    kind = F.when(~many & (F.col("n") > 1), F.concat(F.lit("multi"), "kind")).otherwise(F.col("kind"))
    return j.select("grp", "member", kind.alias("kind"))


def clamped(x: Column, low: Column, high: Column, margin: float = 0.0) -> Column:
    """x, moved inside [low, high] with a margin."""
    return F.least(F.greatest(x, low + margin), high - margin)
