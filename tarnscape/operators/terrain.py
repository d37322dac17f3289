"""Composite grid operators: regions and repair of uncovered cells, grid and ring building, blending, sampling along rays and transects."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnscape.functions import scalars as fn
from tarnscape.operators import raster, vectors
from tarnscape.session import cut, large

CELL = ["grid_id", "r", "c"]


# ---- regions without cover -------------------------------------------------------------------


def regions(cells: DataFrame) -> DataFrame:
    """(grid_id, area, cells, touches_edge, boundary, valid, share, median, p90): each connected area of cells that aren't covered.

    ``cells`` has covered and z; a covered cell without z is water, as ground data has no
    returns there. The boundary are the covered cells next to the area, each once: how many
    there are, how many have a height, their share (3 places), median and 90th percentile (1)."""
    return _regions(cells, cut(raster.connected_areas(cells.where("NOT covered")), "regions"))


def _regions(cells: DataFrame, area: DataFrame) -> DataFrame:
    size = cells.groupBy("grid_id").agg(F.max("r").alias("mr"), F.max("c").alias("mc"))
    own = area.join(size, "grid_id").groupBy("grid_id", "area").agg(F.count("*").alias("cells"), F.bool_or(F.expr("r = 0 OR c = 0 OR r = mr OR c = mc")).alias("touches_edge"))
    near = F.array(*[F.struct((F.col("r") + a).alias("r"), (F.col("c") + b).alias("c")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    ring = area.select("grid_id", "area", F.inline(near)).distinct().join(large(cells.where("covered").select(*CELL, "z")), CELL)
    edge = ring.groupBy("grid_id", "area").agg(F.count("*").alias("boundary"), F.count("z").alias("valid"), F.bround(F.median("z"), 1).alias("median"), F.bround(F.percentile("z", 0.9), 1).alias("p90"))
    j = own.join(edge, ["grid_id", "area"], "left").fillna(0, ["boundary", "valid"])
    share = F.when(F.col("boundary") > 0, F.bround(F.col("valid") / F.col("boundary"), 3)).otherwise(0.0)
    return j.select("grid_id", "area", "cells", "touches_edge", "boundary", "valid", share.alias("share"), "median", "p90")


def verdict(edge: Column, share: Column, median: Column, least_share: float = 0.10, shore_m: float = 20.0) -> Column:
    """gap, sea or foreign-land for an area that isn't covered."""
    judged = F.when(share <= least_share, "sea").when(median.isNull(), F.when(share.isNotNull(), "sea").otherwise("foreign-land"))
    return F.when(~edge, "gap").otherwise(F.coalesce(judged, F.when(median <= shore_m, "sea").otherwise("foreign-land")))


def interpolated(cells: DataFrame, reach: int = 200, *kept: str) -> DataFrame:
    """(grid_id, r, c, z, filled, kept): cells without z take the mean of the nearest valid cells up, down, left and right, weighted by nearness.

    A direction counts as far as ``reach`` cells; a cell with none within reach stays null."""
    for part, order in (("c", "r"), ("r", "c")):
        w = Window.partitionBy("grid_id", part).orderBy(order)
        have = F.when(F.col("z").isNotNull(), F.struct(F.col(order).alias("at"), F.col("z").alias("z")))
        # the next one as the last in falling order: a frame that grows is summed once, one that shrinks anew for each row
        fall = Window.partitionBy("grid_id", part).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
        back, on = F.last(have, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.last(have, True).over(fall)
        cells = cells.withColumn(f"{order}_a", back).withColumn(f"{order}_b", on)
    total = weight = F.lit(0.0)
    for order in ("r", "c"):
        for side in ("a", "b"):
            s = F.col(f"{order}_{side}")
            d = F.abs(s["at"] - F.col(order))
            ok = s.isNotNull() & (d <= reach)
            total, weight = total + F.when(ok, s["z"] / d).otherwise(0.0), weight + F.when(ok, 1.0 / d).otherwise(0.0)
    made = F.when(weight > 0, total / F.nullif(weight, F.lit(0.0)))
    return cells.select(*CELL, F.coalesce(F.col("z").cast("double"), made).alias("z"), F.col("z").isNull().alias("filled"), *kept)


def repaired(cells: DataFrame, reach: float = 200.0, sea_level: float = 0.0, shore_m: float = 20.0) -> DataFrame:
    """(grid_id, r, c, z, repair): every cell without z repaired by the area that it is in, or refused.

    An area whose every cell is within ``reach`` of a valid one is interpolated. Of the
    others, one enclosed by land is still water at the median of its boundary, one at the
    edge with a low boundary is sea at ``sea_level``, and one at the edge with a high
    boundary is foreign land: refused, without z. repair is null for cells that had z."""
    src = cells.select(*CELL, "z", F.col("z").isNotNull().alias("covered"))
    area = cut(raster.connected_areas(src.where("z IS NULL")), "areas")
    found = _regions(src, area)
    far = raster.nearest_evidence(src.where("z IS NULL"), src.where("z IS NOT NULL").withColumn("v", F.lit(0.0))).select(*CELL, "d2")
    wide = area.join(large(far), CELL, "left").groupBy("grid_id", "area").agg(F.max(F.coalesce("d2", F.lit(2**40))).alias("d2"))
    told = found.join(wide, ["grid_id", "area"]).withColumn("verdict", verdict(F.col("touches_edge"), F.col("share"), F.col("median"), shore_m=shore_m))
    how = (
        F.when(F.col("d2") <= reach * reach, "interpolated").when(F.col("verdict") == "sea", "sea")
        .when((F.col("verdict") == "gap") & F.col("median").isNotNull(), "still").when(F.col("verdict") == "gap", "interpolated").otherwise("refused")
    )
    told = told.select("grid_id", "area", how.alias("repair"), "median")
    plan = area.join(told, ["grid_id", "area"]).select(*CELL, "repair", "median")
    mid = src.join(large(plan), CELL, "left").withColumn("z", F.when(F.col("repair") == "sea", F.lit(float(sea_level))).when(F.col("repair") == "still", F.col("median")).otherwise(F.col("z").cast("double")))
    done = interpolated(mid.select(*CELL, "z", "repair"), int(reach), "repair")
    z = F.when((F.col("repair") == "interpolated") | ~F.col("filled"), F.col("z"))
    return done.select(*CELL, z.alias("z"), "repair")


# ---- grids and rings -------------------------------------------------------------------------


def built_grid(cells: DataFrame, first: int, size: int, factor: int, scale: float) -> DataFrame:
    """(grid_id, r, c, raw): a square window of ``size`` source cells from (first, first), block means, quantized; null blocks are absent.

    ``size`` must be a multiple of ``factor``, or the window wouldn't line up."""
    if size % factor:
        raise ValueError(f"a window of {size} cells isn't a multiple of {factor}")
    inside = cells.where(F.col("r").between(first, first + size - 1) & F.col("c").between(first, first + size - 1))
    moved = inside.select("grid_id", (F.col("r") - first).alias("r"), (F.col("c") - first).alias("c"), "z")
    return raster.block_mean(moved, factor).where("mean IS NOT NULL").select(*CELL, fn.quantize(F.col("mean"), scale).alias("raw"))


def grid_gates(built: DataFrame, size: int, scale: float, band: tuple[float, float], centre: tuple[float, float]) -> DataFrame:
    """(grid_id, gate, value): violations of a built grid: incomplete, overflow, below or above the band, centre out of its band."""
    h = F.col("raw") * scale
    mid = (F.col("r") == size // 2) & (F.col("c") == size // 2)
    g = built.groupBy("grid_id").agg(F.count("*").alias("n"), F.count_if(F.col("raw").isNull()).alias("over"), F.min(h).alias("low"), F.max(h).alias("high"), F.max(F.when(mid, h)).alias("mid"))
    gate = lambda name, bad, value: F.when(bad, F.struct(F.lit(name).alias("gate"), value.cast("double").alias("value")))
    all_ = [gate("incomplete", F.col("n") < size * size, F.col("n")), gate("overflow", F.col("over") > 0, F.col("over")), gate("low", F.col("low") < band[0], F.col("low")), gate("high", F.col("high") > band[1], F.col("high")), gate("centre", ~F.col("mid").between(*centre), F.col("mid"))]
    return g.select("grid_id", F.explode(F.array_compact(F.array(*all_))).alias("g")).select("grid_id", "g.gate", "g.value")


def mosaic(tiles: DataFrame, earlier_wins: bool = True, by: list[str] | None = None) -> DataFrame:
    """(by, r, c, z, covered, tile): tiles (tile, row0, col0, r, c, z) placed on one lattice, or one for each value of ``by``, each window at its own place.

    Where windows overlap, the first tile with a height wins (or the last); a cell is covered
    if any window reaches it, also without a height."""
    by = by or []
    placed = tiles.select(*by, "tile", (F.col("row0") + F.col("r")).alias("r"), (F.col("col0") + F.col("c")).alias("c"), "z")
    rank = F.when(F.col("z").isNotNull(), F.col("tile") if earlier_wins else -F.col("tile"))
    best = F.min(F.struct(rank.isNull().alias("none"), rank.alias("rank"), "z", "tile"))
    m = placed.groupBy(*by, "r", "c").agg(best.alias("m"))
    return m.select(*by, "r", "c", "m.z", F.lit(True).alias("covered"), F.when(~F.col("m.none"), F.col("m.tile")).alias("tile"))


def bilinear(points: DataFrame, cells: DataFrame, *keys: str) -> DataFrame:
    """(keys, h): heights at fractional places (grid_id, fr, fc) between cell centres, clamped at the edges; null next to a cell without z."""
    size = cells.groupBy("grid_id").agg(F.max("r").alias("__mr"), F.max("c").alias("__mc"))
    # keys may have the names of a cell's own columns
    own = {k: f"__key_{k}" for k in keys}
    p = large(points.select("grid_id", "fr", "fc", *[F.col(k).alias(v) for k, v in own.items()])).join(size, "grid_id")
    for f, m, i in (("fr", "__mr", "__r0"), ("fc", "__mc", "__c0")):
        p = p.withColumn(f, F.least(F.greatest(F.col(f), F.lit(0.0)), F.col(m).cast("double"))).withColumn(i, F.greatest(F.lit(0), F.least(F.floor(f), F.col(m) - 1)).cast("int"))
    wr, wc = F.col("fr") - F.col("__r0"), F.col("fc") - F.col("__c0")
    corner = lambda a, b: F.struct((F.col("__r0") + a).alias("r"), (F.col("__c0") + b).alias("c"), ((wr if a else 1 - wr) * (wc if b else 1 - wc)).alias("__w"))
    four = p.select("grid_id", *own.values(), F.inline(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])))
    j = four.join(large(cells.select(*CELL, "z")), CELL).where("__w > 0")
    h = j.groupBy(*own.values()).agg(F.when(F.count("z") == F.count("*"), F.sum(F.col("z") * F.col("__w"))).alias("h"))
    return h.withColumnsRenamed({v: k for k, v in own.items()})


def feathered(core: DataFrame, context: DataFrame, factor: int, band: int) -> DataFrame:
    """(grid_id, r, c, z): the outer ``band`` cells of a core grid blended onto the coarser context grid, which they meet at the edge.

    A context cell is ``factor`` core cells wide and both begin at the same corner."""
    size = core.groupBy("grid_id").agg(F.max("r").alias("mr"), F.max("c").alias("mc"))
    edge = F.least(F.col("r"), F.col("c"), F.col("mr") - F.col("r"), F.col("mc") - F.col("c"))
    c = core.join(size, "grid_id").withColumn("edge", edge)
    at = lambda x: (F.col(x) + 0.5) / factor - 0.5
    outer = c.where(F.col("edge") < band).withColumn("fr", at("r")).withColumn("fc", at("c"))
    far = bilinear(outer, context, *CELL)
    t = F.col("edge") / band
    z = F.when(F.col("edge") >= band, F.col("z").cast("double")).otherwise(F.col("h") * (1 - t) + F.col("z") * t)
    return c.join(large(far), CELL, "left").select(*CELL, z.alias("z"))


def lowered(cells: DataFrame, res: float, row0: float, col0: float, k: float = fn.REFRACTION_K) -> DataFrame:
    """Cells with z lowered by the refracted drop of the earth at their distance from (row0, col0)."""
    d2 = ((F.col("r") + 0.5 - row0) ** 2 + (F.col("c") + 0.5 - col0) ** 2) * res * res
    return cells.withColumn("z", F.col("z") - fn.refracted_drop_m(d2, k))


def decimated(cells: DataFrame, stride: int) -> DataFrame:
    """Every ``stride``-th row and column, and always the last ones."""
    size = cells.groupBy("grid_id").agg(F.max("r").alias("__mr"), F.max("c").alias("__mc"))
    keep = lambda x, m: (F.col(x) % stride == 0) | (F.col(x) == F.col(m))
    return cells.join(size, "grid_id").where(keep("r", "__mr") & keep("c", "__mc")).drop("__mr", "__mc")


def annulus(cells: DataFrame, inner_share: float = 0.5) -> DataFrame:
    """Cells outside the centred square that the next finer grid covers, whose side is ``inner_share`` of the grid's."""
    size = cells.groupBy("grid_id").agg((F.max("r") + 1).alias("__n"), (F.max("c") + 1).alias("__m"))
    out = lambda x, n: (F.col(x) + 0.5 < F.col(n) * (1 - inner_share) / 2) | (F.col(x) + 0.5 > F.col(n) * (1 + inner_share) / 2)
    return cells.join(size, "grid_id").where(out("r", "__n") | out("c", "__m")).drop("__n", "__m")


def thumbnail(cells: DataFrame, wet: Column, res: float, factor: int) -> DataFrame:
    """(grid_id, r, c, red, green, blue): block means of the relief, washed with blue by 0.65 of the share of wet cells."""
    g = raster.gradient(cells, res)
    shade = cells.join(large(g), CELL).where("d_row IS NOT NULL AND d_col IS NOT NULL").select(*CELL, raster.relief(F.col("d_row"), F.col("d_col")).alias("shade"), wet.cast("int").alias("wet"))
    b = shade.groupBy("grid_id", F.expr(f"int(r div {factor})").alias("r"), F.expr(f"int(c div {factor})").alias("c")).agg(F.avg("shade").alias("s"), F.avg("wet").alias("w"))
    grey, alpha = F.floor(F.least(F.greatest(F.col("s") * 255, F.lit(0)), F.lit(255))), F.coalesce("w", F.lit(0.0)) * 0.65
    tint = lambda x: F.floor(grey * (1 - alpha) + x * alpha).cast("int")
    return b.select(*CELL, tint(40.0).alias("red"), tint(90.0).alias("green"), tint(140.0).alias("blue"))


# ---- rays ------------------------------------------------------------------------------------


def first_hits(rays: DataFrame, cells: DataFrame, step: float, steps: int) -> DataFrame:
    """(ray_id, grid_id, step): the first of ``steps`` samples of a ray that isn't above the ground.

    Rays have ray_id, grid_id, r, c, h (where they begin) and dr, dc, dh (per unit). Samples
    outside the grid, or next to cells without z, are passed over."""
    at = rays.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    along = lambda a, b: F.col(a) + F.col(b) * F.col("step") * step
    at = at.select("ray_id", "grid_id", "step", along("r", "dr").alias("fr"), along("c", "dc").alias("fc"), along("h", "dh").alias("y"))
    size = cells.groupBy("grid_id").agg(F.max("r").alias("mr"), F.max("c").alias("mc"))
    at = large(at).join(size, "grid_id").where("fr BETWEEN 0 AND mr AND fc BETWEEN 0 AND mc").drop("mr", "mc")
    ground = bilinear(at, cells, "ray_id", "grid_id", "step", "y")
    return ground.where("y <= h + 1e-9").groupBy("ray_id", "grid_id").agg(F.min("step").alias("step"))


def picked(rays: DataFrame, cells: DataFrame, step: float = 1.0, steps: int = 128, tile: int = 512) -> DataFrame:
    """(ray_id, r, c): where each ray meets the ground: the first sample below it, then 24 halvings between it and the one before.

    The halvings run in a tile with the cells that the last step can touch."""
    hit = first_hits(rays, cells, step, steps).join(rays, ["ray_id", "grid_id"])
    spot = lambda a, b: F.col(a) + F.col(b) * F.col("step") * step
    hit = hit.withColumn("tr", F.floor(spot("r", "dr") / tile).cast("int")).withColumn("tc", F.floor(spot("c", "dc") / tile).cast("int"))
    halo = int(np.ceil(step)) + 2
    ground = raster.tiles(cells.where("z IS NOT NULL").select(*CELL, F.col("z").cast("double").alias("z")), tile, halo)

    def refine(key, z: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(z):
            return pd.DataFrame({"ray_id": [], "r": [], "c": []}).astype({"ray_id": "int64", "r": "float64", "c": "float64"})
        r0, c0 = int(key[1]) * tile - halo, int(key[2]) * tile - halo
        h = np.full((tile + 2 * halo, tile + 2 * halo), np.nan)
        h[z["r"].to_numpy() - r0, z["c"].to_numpy() - c0] = z["z"]
        rows, cols = np.nonzero(~np.isnan(h).all(1))[0], np.nonzero(~np.isnan(h).all(0))[0]
        begin = np.stack([q[x].to_numpy(float) for x in ("r", "c", "h")])
        way = np.stack([q[x].to_numpy(float) for x in ("dr", "dc", "dh")])

        def above(t: np.ndarray) -> np.ndarray:
            fr, fc, y = begin + way * t
            fr, fc = np.clip(fr - r0, rows[0], rows[-1]), np.clip(fc - c0, cols[0], cols[-1])
            a, b = np.minimum(fr.astype(int), max(rows[-1] - 1, rows[0])), np.minimum(fc.astype(int), max(cols[-1] - 1, cols[0]))
            u, v = fr - a, fc - b
            a1, b1 = np.minimum(a + 1, rows[-1]), np.minimum(b + 1, cols[-1])
            return y > (h[a, b] * (1 - v) + h[a, b1] * v) * (1 - u) + (h[a1, b] * (1 - v) + h[a1, b1] * v) * u

        high = q["step"].to_numpy(float) * step
        low = np.maximum(high - step, 0)
        for _ in range(24):
            mid = (low + high) / 2
            up = above(mid)
            low, high = np.where(up, mid, low), np.where(up, high, mid)
        r, c, _ = begin + way * (low + high) / 2
        return pd.DataFrame({"ray_id": q["ray_id"].to_numpy(), "r": r, "c": c})

    at = ["grid_id", "tr", "tc"]
    return ground.groupBy(*at).cogroup(hit.groupBy(*at)).applyInPandas(refine, "ray_id long, r double, c double")


# ---- ridges ----------------------------------------------------------------------------------


def ridge_pick(profiles: DataFrame, keys: list[str], step: float, low: str | None = None, high: str | None = None) -> DataFrame:
    """(keys, inset, prominence): the sample k with the largest value on each transect (ties: the first), moved by a parabola through its neighbours.

    Profiles have k, offset and value. With ``low`` and ``high`` (columns, per transect) only
    offsets between them count, and the place found is held inside them."""
    p = profiles if low is None else profiles.where(F.col("offset").between(F.col(low), F.col(high)))
    w = Window.partitionBy(*keys).orderBy("k")
    p = p.withColumn("a", F.lag("value").over(w)).withColumn("b", F.lead("value").over(w))
    extra = [] if low is None else [low, high]
    m = p.groupBy(*keys).agg(F.max_by(F.struct("offset", "value", "a", "b", *extra), F.struct("value", -F.col("k"))).alias("m")).select(*keys, "m.*")
    bend = F.col("a") - 2 * F.col("value") + F.col("b")
    move = F.when(bend != 0, F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (F.col("a") - F.col("b")) / F.nullif(bend, F.lit(0.0)))))
    at = F.col("offset") + F.coalesce(move, F.lit(0.0)) * step
    return m.select(*keys, (at if low is None else F.least(F.greatest(at, F.col(low)), F.col(high))).alias("inset"), F.col("value").alias("prominence"))


def samples(length: float, step: float) -> int:
    """Half of an odd window of ``length``: the samples on each side."""
    n = max(1, round(length / step))
    return (n if n % 2 else n + 1) // 2


def crest(cells: DataFrame, outline: DataFrame, step: float = 1.0, smooth: float = 5.0, outer: float = 5.0, inner: float = 25.0, sample: float = 0.25, background: float = 15.0, guide: float = 15.0, reject: float = 5.0, least: float = 0.3, crest_smooth: float = 5.0) -> dict[str, DataFrame]:
    """The crest line of a bank inside closed outlines, in grid units (x = column, y = row); feature_id is the grid_id.

    Outlines are resampled and smoothed; transects run inwards along their normals; each
    transect's heights less their moving mean give a residual. The largest residual of each
    transect, as a circular median, guides a second pick near it; a transect whose pick
    stands out less than ``least`` takes the guide. ``line`` has the crest's points and
    ``picks`` the inset, prominence and rejection of each transect. A feature of which every
    transect is rejected, or whose corridor leaves the grid, is in neither, but in ``refused``."""
    base = vectors.circular(vectors.circular(vectors.resampled(outline, step), samples(smooth, step), "x", "sx"), samples(smooth, step), "y", "sy")
    base = cut(vectors.inward_normals(base.select("feature_id", "ring", "i", F.col("sx").alias("x"), F.col("sy").alias("y"))), "base")
    keys = ["feature_id", "ring", "i"]
    many = int(np.floor((inner + outer) / sample + 0.5)) + 1
    t = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("k")).withColumn("offset", F.col("k") * sample - outer)
    t = t.withColumn("fc", F.col("x") + F.col("nx") * F.col("offset")).withColumn("fr", F.col("y") + F.col("ny") * F.col("offset")).withColumn("grid_id", F.col("feature_id"))
    size = cells.groupBy(F.col("grid_id").alias("feature_id")).agg(F.max("r").alias("mr"), F.max("c").alias("mc"))
    out = large(t).join(size, "feature_id").where("fr < -0.5 OR fc < -0.5 OR fr > mr + 0.5 OR fc > mc + 0.5 OR nx IS NULL").select("feature_id").distinct()
    h = bilinear(t, cells, *keys, "k", "offset")
    half = samples(background, sample)
    # a moving mean with padded edges: the ends count as often as they are missing
    w = Window.partitionBy(*keys).orderBy("k")
    mean = F.sum("h").over(w.rowsBetween(-half, half))
    ends = F.first("h").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last("h").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before, after = F.greatest(F.lit(0), half - F.col("k")), F.greatest(F.lit(0), half - (many - 1 - F.col("k")))
    p = h.withColumn("value", F.col("h") - (mean + ends[0] * before + ends[1] * after) / (2 * half + 1)).where("value IS NOT NULL")
    p = cut(p.join(out, "feature_id", "left_anti").select(*keys, "k", "offset", "value"), "profiles")
    first = vectors.circular(ridge_pick(p, keys, sample), samples(guide, step), "inset", "guide", "median").select(*keys, "guide")
    near = large(p).join(first, keys).withColumn("low", F.col("guide") - reject).withColumn("high", F.col("guide") + reject)
    second = ridge_pick(near, keys, sample, "low", "high").join(large(first), keys)
    weak = F.col("prominence") < least
    picks = cut(second.select(*keys, F.when(weak, F.col("guide")).otherwise(F.col("inset")).alias("inset"), "prominence", weak.alias("rejected")), "picks")
    hopeless = picks.groupBy("feature_id").agg(F.bool_and("rejected").alias("all")).where("all").select("feature_id")
    picks = picks.join(hopeless, "feature_id", "left_anti")
    line = vectors.circular(picks, samples(crest_smooth, step), "inset", "deep").join(large(base), keys)
    line = line.select("feature_id", "ring", F.col("i").alias("seq"), (F.col("x") + F.col("nx") * F.col("deep")).alias("x"), (F.col("y") + F.col("ny") * F.col("deep")).alias("y"), F.lit(True).alias("closed"), F.lit(False).alias("hole"))
    points = vectors.resampled(line, step).select("feature_id", "ring", "i", F.bround("x", 2).alias("x"), F.bround("y", 2).alias("y"))
    return {"line": points, "picks": picks, "refused": out.unionByName(hopeless)}


def crest_statistics(line: DataFrame, picks: DataFrame) -> DataFrame:
    """(feature_id, points, length, spacing, inset_median, inset_min, inset_max, radius_min, radius_max, prominence, rejected) of crest lines."""
    v = line.withColumn("seq", F.col("i")).withColumn("closed", F.lit(True)).withColumn("hole", F.lit(False))
    way = vectors.segments(v).groupBy("feature_id").agg(F.count("*").alias("points"), F.bround(F.sum("len"), 1).alias("length"), F.bround(F.max("len"), 3).alias("spacing"))
    mid = line.groupBy("feature_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    d = F.sqrt((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2)
    radius = line.join(mid, "feature_id").groupBy("feature_id").agg(F.bround(F.min(d), 1).alias("radius_min"), F.bround(F.max(d), 1).alias("radius_max"))
    inset = picks.groupBy("feature_id").agg(F.bround(F.median("inset"), 2).alias("inset_median"), F.bround(F.min("inset"), 2).alias("inset_min"), F.bround(F.max("inset"), 2).alias("inset_max"), F.bround(F.median("prominence"), 2).alias("prominence"), F.count_if("rejected").alias("rejected"))
    return way.join(radius, "feature_id").join(inset, "feature_id")
