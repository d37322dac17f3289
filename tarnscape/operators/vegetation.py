"""Plants drawn on lattices over class grids: per class, along the shore, and under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnscape.functions import scalars as fn
from tarnscape.session import cut, large

M2_PER_HA = 10_000.0
#: Number of the shore band's stream, before its class.
BAND_STREAM = 200


def lattice(cells: DataFrame, extents: DataFrame, res: float, draws: int, stream: Column, seed: int, scale: Column, *kept: str) -> DataFrame:
    """(grid_id, class, form, lr, lc, x, y, r, c, seed, first, kept): the jittered places of each class's lattice that lie in the cells given, and where their ``draws`` draws begin.

    ``extents`` has grid_id, width and height in metres, mr and mc; ``cells`` has grid_id, r, c
    and class, form and density per hectare of a lattice. A lattice cell is one plant's worth of
    ground. Draws are numbered by lattice cell, so any of them is found without those before:
    the place takes the first two. Places beyond the extent are left out, those beyond the last
    cell lie in it. A cell draws only the lattice cells that reach it, so places aren't joined."""
    # few files hold many cells: without a number of its own Spark would leave them to as few tasks
    e = cells.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), "grid_id", "r", "c").join(extents, "grid_id")
    e = e.withColumn("density", F.col("density") * scale).where("density > 0").withColumn("spacing", F.sqrt(M2_PER_HA / F.col("density")))
    count = lambda x: F.greatest(F.lit(1), F.ceil(F.col(x) / F.col("spacing"))).cast("long")
    e = e.withColumn("cols", count("width")).withColumn("rows", count("height")).withColumn("seed", fn.stream_seed(F.lit(seed).cast("long"), stream))
    for at, edge, many, name in (("r", "mr", "rows", "lr"), ("c", "mc", "cols", "lc")):
        # a draw is a multiple of 2^-32 below 1; 2^-50 is more than rounding moves
        first = F.ceil(F.col(at) * res / F.col("spacing") * (1 - 2.0**-50) - 1 + 2.0**-32)
        last = F.when(F.col(at) < F.col(edge), F.ceil((F.col(at) + 1) * res / F.col("spacing") * (1 + 2.0**-50)) - 1)
        first, last = F.greatest(F.lit(0), first).cast("long"), F.least(last, F.col(many) - 1).cast("long")
        e = e.withColumn(name, F.explode(F.when(first <= last, F.sequence(first, last))))
    e = e.withColumn("first", draws * (F.col("lr") * F.col("cols") + F.col("lc")))
    # exploded, as Spark would work draws out anew for each condition on them
    e = e.withColumn("w", F.explode(F.array(fn.draws(F.col("seed"), F.col("first"), 2))))
    for axis, drawn, side, at, edge, line in (("x", 0, "width", "c", "mc", "lc"), ("y", 1, "height", "r", "mr", "lr")):
        e = e.withColumn(axis, (F.col(line) + F.col("w")[drawn]) * F.col("spacing"))
        cell = F.least(F.greatest(F.floor(F.col(axis) / res), F.lit(0)), F.col(edge))
        e = e.where((F.col(axis) <= F.col(side)) & (cell == F.col(at)))
    return e.select("grid_id", "class", "form", "lr", "lc", "x", "y", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "seed", "first", *kept)


def _sized(extents: DataFrame, cells: DataFrame) -> DataFrame:
    """Extents with mr and mc: the last row and column of each grid."""
    if {"mr", "mc"} <= set(extents.columns):
        return extents
    return extents.join(cells.groupBy("grid_id").agg(F.max("r").alias("mr"), F.max("c").alias("mc")), "grid_id")


def at_cells(places: DataFrame, cells: DataFrame, res: float, *columns: str) -> DataFrame:
    """Places with columns of the cell that they lie in, clamped at the edges."""
    p = places if {"mr", "mc"} <= set(places.columns) else _sized(large(places), cells)
    at = lambda v, m: F.least(F.greatest(F.floor(F.col(v) / res), F.lit(0)), F.col(m)).cast("int")
    p = p.withColumn("r", at("y", "mr")).withColumn("c", at("x", "mc")).drop("mr", "mc")
    return p.join(large(cells.select("grid_id", "r", "c", *[F.col(x).alias(f"cell_{x}") for x in columns])), ["grid_id", "r", "c"])


def sampled(cells: DataFrame, extents: DataFrame, legend: DataFrame, res: float, seed: int = 1, scale: Column | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """(grid_id, class, form, lr, lc, x, y, r, c, more): plants of each class, kept where the grid has that class; ``more`` are columns of the cell."""
    own = cells.select("grid_id", "r", "c", "class", *more).join(F.broadcast(legend), "class")  # a few rows
    p = lattice(own, _sized(extents, cells), res, 2, F.col("class"), seed, scale if scale is not None else F.lit(1.0), *more)
    return p.drop("seed", "first")


def appearance(plants: DataFrame, forms: DataFrame, seed: int = 1, stream: int = 100) -> DataFrame:
    """Plants with height, width, yaw, lean_x and lean_z: five draws for each plant of a form, in the order of class and lattice.

    ``forms`` has form, number (of its stream), height, ratio, jitter and lean, a few rows. A
    plant's draws depend on its place among those of its form in the grid."""
    w = Window.partitionBy("grid_id", "form").orderBy("class", "lr", "lc")
    p = plants.join(F.broadcast(forms), "form").withColumn("i", (F.row_number().over(w) - 1).cast("long"))
    p = p.withColumn("w", fn.draws(fn.stream_seed(F.lit(seed).cast("long"), F.col("number") + stream), 5 * F.col("i"), 5))
    side = lambda k: F.col("w")[k] * 2 - 1
    p = p.withColumn("tall", F.col("height") * (1 + side(0) * F.col("jitter")))
    made = [F.col("tall").alias("height"), (F.col("tall") * F.col("ratio") * (1 + side(1) * F.col("jitter"))).alias("width"), (F.col("w")[2] * 2 * 3.141592653589793).alias("yaw"), (side(3) * F.col("lean")).alias("lean_x"), (side(4) * F.col("lean")).alias("lean_z")]
    return p.select(*plants.columns, *made)


def shore_band(cells: DataFrame, extents: DataFrame, legend: DataFrame, excluded: list[int], res: float, levels: tuple[float, float], band: float, height: float, jitter: float = 0.2, seed: int = 1, scale: Column | None = None) -> DataFrame:
    """(grid_id, class, lr, lc, x, y, connect, height, yaw): candidates for plants along the water at any level of ``levels``.

    Seven draws for each lattice cell settle place and look, so the level only selects
    members. Kept are those with min(levels) < connect <= max(levels) + band on a class that
    isn't excluded; ``legend`` has the band's class, form and density. The order is that of
    connect, then of the lattice."""
    fits = (F.col("connect") > min(levels)) & (F.col("connect") <= max(levels) + band) & ~F.coalesce(F.col("class").isin(excluded), F.lit(False))
    wet = cells.where(fits).select("grid_id", "r", "c", "connect").crossJoin(F.broadcast(legend))  # a few rows
    p = lattice(wet, _sized(extents, cells), res, 7, F.col("class") + BAND_STREAM, seed, scale if scale is not None else F.lit(1.0), "connect")
    p = p.withColumn("w", fn.draws(F.col("seed"), F.col("first") + 2, 3))  # the third to the fifth
    tall = height * (1 + (F.col("w")[0] * 2 - 1) * jitter)
    return p.select("grid_id", "class", "lr", "lc", "x", "y", "connect", tall.alias("height"), (F.col("w")[2] * 2 * 3.141592653589793).alias("yaw"))


def capacity(candidates: DataFrame, band: float) -> DataFrame:
    """(grid_id, capacity): the most candidates in any window [connect, connect + band]."""
    own = Window.partitionBy("grid_id").orderBy("connect").rowsBetween(Window.unboundedPreceding, -1)
    n = candidates.groupBy("grid_id", "connect").agg(F.count("*").alias("n"))
    n = n.withColumn("before", F.coalesce(F.sum("n").over(own), F.lit(0)))
    # a window's end comes after all that it holds; frames that only grow are summed once, a sliding one anew for each row
    ends = F.inline(F.array(F.struct(F.col("connect").alias("at"), F.lit(0).alias("end"), F.col("n").alias("here")), F.struct((F.col("connect") + float(band)).alias("at"), F.lit(1).alias("end"), F.lit(0).cast("long").alias("here"))))
    upto = F.sum("here").over(Window.partitionBy("grid_id").orderBy("at", "end").rowsBetween(Window.unboundedPreceding, 0))
    n = n.select("grid_id", "before", ends).withColumn("upto", upto).where("end = 1")
    return n.groupBy("grid_id").agg(F.max(F.col("upto") - F.col("before")).alias("capacity"))


def trimmed(rows: DataFrame, budget: Column, order: list[Column]) -> DataFrame:
    """The first ``budget`` rows of each grid, over all classes in order."""
    return rows.withColumn("__i", F.row_number().over(Window.partitionBy("grid_id").orderBy(*order))).where(F.col("__i") <= budget).drop("__i")


def budgeted(cells: DataFrame, extents: DataFrame, legend: DataFrame, band_legend: DataFrame, excluded: list[int], res: float, levels: tuple[float, float], band: float, height: float, budget: int, seed: int = 1) -> DataFrame:
    """(grid_id, class, lr, lc, x, y, scale): plants of all classes under one budget a grid, with the shore band counted at its capacity.

    Where a grid has more, all its densities shrink by the same factor and all lattices are
    drawn anew; what rounding leaves over is trimmed from the last classes."""

    def drawn(ext: DataFrame) -> tuple[DataFrame, DataFrame]:
        scale = F.col("scale")
        own = sampled(cells, ext, legend, res, seed, scale)
        most = capacity(shore_band(cells, ext, band_legend, excluded, res, levels, band, height, seed=seed, scale=scale), band)
        return own, most

    extents = cut(_sized(extents, cells), "extents")  # a row a grid, for all four lattices
    once, most = drawn(extents.withColumn("scale", F.lit(1.0)))
    total = extents.select("grid_id").join(once.groupBy("grid_id").count(), "grid_id", "left").join(most, "grid_id", "left")
    n = F.coalesce("count", F.lit(0)) + F.coalesce("capacity", F.lit(0))
    scales = cut(total.select("grid_id", F.when(n > budget, budget / n).otherwise(1.0).alias("scale")), "scales")
    again, most = drawn(extents.join(scales, "grid_id"))
    left = again.join(scales, "grid_id").join(most, "grid_id", "left").withColumn("__left", F.greatest(F.lit(0), budget - F.coalesce("capacity", F.lit(0))))
    return trimmed(left, F.col("__left"), [F.col("class"), F.col("lr"), F.col("lc")]).select("grid_id", "class", "lr", "lc", "x", "y", "scale")


def visible(plants: DataFrame, levels: DataFrame, band: float) -> DataFrame:
    """(grid_id, level, form, visible): plants (grid_id, form, connect) that stand at each level: reeds above the water, trees above the band over it."""
    j = plants.crossJoin(F.broadcast(levels))  # a few levels
    floor = F.when(F.col("form") == "reeds", F.col("level")).otherwise(F.col("level") + band)
    return j.groupBy("grid_id", "level", "form").agg(F.count_if(F.col("connect") > floor).alias("visible"))
