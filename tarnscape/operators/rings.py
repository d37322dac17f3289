"""Ring ladders: ever wider and coarser windows around sites, out to the horizon, from one pyramid of sums and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnscape.functions import scalars as fn
from tarnscape.operators import order, raster, terrain
from tarnscape.session import cut

EYE_M = 2.0


def pyramid(cells: DataFrame, factors: list[int]) -> DataFrame:
    """(grid_id, factor, r, c, total, n): sums and counts of blocks of ``factor`` x ``factor`` cells, for each factor.

    Each level comes from the one below, so every cell is read once; a factor must be a
    multiple of the one before. Blocks without a height have n 0 and a null total; blocks
    without a cell are absent."""
    level, out, last = cells.select("grid_id", "r", "c", F.col("z").cast("double").alias("total"), F.col("z").isNotNull().cast("long").alias("n")), None, 1
    for f in sorted(factors):
        if f % last:
            raise ValueError(f"blocks of {f} cells aren't made of blocks of {last}")
        if f > last:
            step = f // last
            level = level.groupBy("grid_id", F.expr(f"int(r div {step})").alias("r"), F.expr(f"int(c div {step})").alias("c")).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        level = cut(level, "level")
        one = level.select("grid_id", F.lit(f).alias("factor"), "r", "c", "total", "n")
        out, last = one if out is None else out.unionByName(one), f
    return out


def ring_windows(sites: DataFrame, ladder: DataFrame) -> DataFrame:
    """(site, grid_id, ring, half, factor, i, before, r0, c0, side): the windows of each site's rings, in blocks of their factor.

    ``sites`` has site, grid_id, r, c (its middle, in cells) and context (half the side of its
    own grid); ``ladder`` ring, half and factor. Only rings wider than the context count; i
    numbers them from 1, and before is the half of the one before. Middles are moved down to
    a multiple of the factor."""
    w = Window.partitionBy("site").orderBy("half")  # a row a ring
    j = sites.join(F.broadcast(ladder), F.col("half") > F.col("context"))  # a ladder has a few rows
    low = lambda x: F.expr(f"int(floor({x} / factor) - half div factor)")
    return j.select("site", "grid_id", "ring", "half", "factor", F.row_number().over(w).alias("i"), F.lag("half").over(w).alias("before"), low("r").alias("r0"), low("c").alias("c0"), F.expr("int(2 * half div factor)").alias("side"))


def built_rings(levels: DataFrame, windows: DataFrame, tile: int = 256) -> DataFrame:
    """(site, ring, r, c, z): every cell of the windows with its block mean; null outside the ground.

    Windows and levels meet by tiles, and a block comes once for each window that holds it."""
    span = lambda x: F.sequence(F.expr(f"int(floor({x} / {tile}))"), F.expr(f"int(floor(({x} + side - 1) / {tile}))"))
    at = windows.select("*", F.explode(span("r0")).alias("tr")).select("*", F.explode(span("c0")).alias("tc"))
    some = levels.where("n > 0").select("grid_id", "factor", F.expr(f"int(floor(r / {tile}))").alias("tr"), F.expr(f"int(floor(c / {tile}))").alias("tc"), F.col("r").alias("br"), F.col("c").alias("bc"), (F.col("total") / F.col("n")).alias("z"))
    j = at.join(some, ["grid_id", "factor", "tr", "tc"]).where("br >= r0 AND br < r0 + side AND bc >= c0 AND bc < c0 + side")
    have = j.select("site", "ring", (F.col("br") - F.col("r0")).alias("r"), (F.col("bc") - F.col("c0")).alias("c"), "z")
    side = lambda: F.explode(F.sequence(F.lit(0), F.col("side") - 1))
    every = windows.select("site", "ring", "side", side().alias("r")).select("site", "ring", "r", side().alias("c"))
    return every.join(have, ["site", "ring", "r", "c"], "left")


def horizons(rings: DataFrame, windows: DataFrame, crowns: DataFrame, floor_half: int, eye: float = EYE_M) -> DataFrame:
    """(site, crown, floor_m, horizon_m): how far an eye above the crown sees over the floor of its surroundings.

    The floor is the 5th percentile of the ring whose half is ``floor_half``, else of the
    widest there is, and 0 at least; ``crowns`` has site and crown. Distances are refracted."""
    first = F.max_by(F.struct("ring"), F.struct((F.col("half") == floor_half).alias("it"), "half"))["ring"]
    box = windows.groupBy("site").agg(first.alias("ring"))
    low = order.exact_percentiles(rings.join(box, ["site", "ring"]), ["site"], "z", {"p5": 0.05})
    floor_m = F.greatest(F.lit(0.0), F.coalesce("p5", F.lit(0.0)))
    h = crowns.join(low, "site", "left").select("site", "crown", floor_m.alias("floor_m"))
    return h.withColumn("horizon_m", fn.horizon_m(F.col("crown") + eye - F.col("floor_m")))


def ring_ladder(ground: DataFrame, sites: DataFrame, ladder: DataFrame, crowns: DataFrame, res: float, floor_half: int, eye: float = EYE_M, repair: float | None = 200.0, sea_m: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The rings of every site and what became of them: (site, ring, r, c, z, repair) and (site, ring, horizon_m, cells, filled, low, high, line).

    ``ground`` (grid_id, r, c, z) is a lattice of cells of ``res`` metres, a mosaic for
    instance (terrain.mosaic); see ring_windows for ``sites`` and ``ladder``, horizons for
    ``crowns``. A site gets its first two rings, and more while the last one is nearer than
    the horizon that these two give.

    Blocks come from one pyramid, so a cell of the ground is read once for all rings and
    sites. Each ring's holes are repaired as a grid of its own (terrain.repaired, up to
    ``repair`` blocks); without that, or where repair refuses, they are sea at ``sea_m``, and
    the line of provenance counts them. Sites on grids without cells get rings of sea."""
    factors = [r["factor"] for r in ladder.select("factor").distinct().collect()]
    levels = pyramid(ground, factors)
    windows = cut(ring_windows(sites, ladder), "windows")

    def finished(chosen: DataFrame) -> DataFrame:
        raw = cut(built_rings(levels, chosen), "rings")
        if repair is None:
            told = raw.select("site", "ring", "r", "c", "z", F.lit(None).cast("string").alias("repair"))
        else:
            names = cut(raw.select("site", "ring").distinct().withColumn("grid_id", F.monotonically_increasing_id()), "names")
            fixed = terrain.repaired(raw.join(names, ["site", "ring"]).select("grid_id", "r", "c", "z"), repair, sea_m)
            told = fixed.join(names, "grid_id").select("site", "ring", "r", "c", "z", "repair")
        how = F.when(F.col("z").isNull(), "sea").otherwise(F.col("repair"))
        return cut(told.select("site", "ring", "r", "c", F.coalesce("z", F.lit(float(sea_m))).alias("z"), how.alias("repair")), "rings")

    near = finished(windows.where("i <= 2"))
    seen = cut(horizons(near, windows.where("i <= 2"), crowns, floor_half, eye), "horizons")
    more = windows.where("i > 2").join(seen, "site").where(F.col("before") * res < F.col("horizon_m")).select(*windows.columns)
    # a ring counts only if all before it do, as halves rise
    rings = near.unionByName(finished(cut(more, "windows")))
    sea = F.col("repair") == "sea"
    g = rings.groupBy("site", "ring").agg(F.count("*").alias("cells"), F.count_if(sea).alias("sea"), F.count("repair").alias("filled"), F.min("z").alias("low"), F.max("z").alias("high"))
    return rings, g.join(seen, "site").select("site", "ring", "horizon_m", "cells", "filled", "low", "high", provenance(F.col("ring"), F.col("sea")).alias("line"))


def provenance(ring: Column, sea: Column) -> Column:
    """ "ringN: M cells were sea-filled", which scalars can read back."""
    return F.concat(F.lit("ring"), ring.cast("string"), F.lit(": "), sea.cast("string"), F.lit(" cells were sea-filled"))
