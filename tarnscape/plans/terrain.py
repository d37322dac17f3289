"""Queries over regions, repair, grid building, vegetation, water levels and crests (A, I, J, Q, W)."""

import re

from pyspark.sql import functions as F

from tarnscape.functions import scalars as fn
from tarnscape.operators import order, raster, rings, series, terrain, vectors, vegetation
from tarnscape.plans.base import query
from tarnscape.plans.geometry import OUTLINE
from tarnscape.plans.grids import FLOOD, LANDCOVER, fixture_ground, land_cover
from tarnscape.session import cut, large, table
from tarnscape.sources import fixtures as fx

# ---- regions and repair ----------------------------------------------------------------------

AREAS = fx.MASKED + """, bad AS (SELECT grid_id * 4096 + r * 64 + c AS id, grid_id, r, c FROM masked WHERE NOT covered),
  lab(id, root) AS (SELECT id, id FROM bad UNION SELECT n.id, l.root FROM lab l JOIN bad o ON o.id = l.id, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(dr, dc), bad n WHERE n.grid_id = o.grid_id AND n.r = o.r + d.dr AND n.c = o.c + d.dc AND l.root < n.id),
  area AS (SELECT bad.*, m.root FROM bad JOIN (SELECT id, min(root) AS root FROM lab GROUP BY 1) m USING (id)),
  own AS (SELECT grid_id, root, count(*) AS cells, bool_or(r = 0 OR c = 0 OR r = 63 OR c = 63) AS touches_edge FROM area GROUP BY 1, 2),
  rim AS (SELECT DISTINCT a.grid_id, a.root, m.r, m.c, m.z FROM area a, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(dr, dc), masked m WHERE m.grid_id = a.grid_id AND m.r = a.r + d.dr AND m.c = a.c + d.dc AND m.covered),
  edge AS (SELECT grid_id, root, count(*) AS boundary, count(z) AS valid, round_even(median(z), 1) AS median, round_even(quantile_cont(z, 0.9), 1) AS p90 FROM rim GROUP BY 1, 2),
  region AS (SELECT own.*, coalesce(boundary, 0) AS boundary, coalesce(valid, 0) AS valid, CASE WHEN boundary > 0 THEN round_even(valid / boundary::DOUBLE, 3) ELSE 0 END AS share, median, p90 FROM own LEFT JOIN edge USING (grid_id, root)),
  judged AS (SELECT *, CASE WHEN NOT touches_edge THEN 'gap' WHEN share <= 0.10 THEN 'sea' WHEN median IS NULL THEN 'sea' WHEN median <= 12 THEN 'sea' ELSE 'foreign-land' END AS verdict FROM region)"""


@query(f"WITH RECURSIVE {AREAS} SELECT grid_id, root, cells, touches_edge, boundary, valid, share, median, p90 FROM region")
def i3_regions(spark, sf):
    """What stands around each area without cover."""
    return terrain.regions(fx.masked(spark, sf)).withColumn("root", F.expr("grid_id * 4096 + area.r * 64 + area.c")).drop("area")


@query(f"""WITH RECURSIVE {AREAS}, g AS (SELECT DISTINCT grid_id FROM masked), n AS (SELECT grid_id, sum(cells) AS total, coalesce(sum(cells) FILTER (verdict = 'foreign-land'), 0) AS foreign_cells, coalesce(sum(cells) FILTER (verdict = 'gap'), 0) AS gap_cells FROM judged GROUP BY 1)
  SELECT grid_id, CASE WHEN grid_id % 5 = 4 AND total > 0 THEN 'fail' WHEN total IS NULL THEN 'pass' WHEN foreign_cells > 0 OR gap_cells > 0 THEN 'fail' ELSE 'warn' END AS severity,
    CASE WHEN grid_id % 5 = 4 AND total > 0 THEN 'unclassified' WHEN total IS NULL THEN 'covered' WHEN foreign_cells > 0 THEN 'foreign-land' WHEN gap_cells > 0 THEN 'gap' ELSE 'sea' END AS reason, coalesce(total, 0)::BIGINT AS cells FROM g LEFT JOIN n USING (grid_id)""")
def q4_uncovered_gate(spark, sf):
    """Missing evidence fails first, then foreign land, then gaps; sea only warns. Every fifth grid has no evidence recorded."""
    m = fx.masked(spark, sf)
    r = terrain.regions(m).withColumn("verdict", terrain.verdict(F.col("touches_edge"), F.col("share"), F.col("median"), shore_m=12.0))
    of = lambda v: F.sum(F.when(F.col("verdict") == v, F.col("cells")).otherwise(0))
    n = r.groupBy("grid_id").agg(F.sum("cells").alias("total"), of("foreign-land").alias("foreign"), of("gap").alias("gap"))
    j = m.select("grid_id").distinct().join(n, "grid_id", "left")
    reason = F.when((F.col("grid_id") % 5 == 4) & (F.col("total") > 0), "unclassified").when(F.col("total").isNull(), "covered").when(F.col("foreign") > 0, "foreign-land").when(F.col("gap") > 0, "gap").otherwise("sea")
    severity = F.when(F.col("reason") == "covered", "pass").when(F.col("reason") == "sea", "warn").otherwise("fail")
    return j.withColumn("reason", reason).select("grid_id", severity.alias("severity"), "reason", F.coalesce("total", F.lit(0)).cast("long").alias("cells"))


FILL = """way AS (SELECT *, last_value(CASE WHEN z IS NOT NULL THEN r END IGNORE NULLS) OVER n AS ra, last_value(z IGNORE NULLS) OVER n AS za, first_value(CASE WHEN z IS NOT NULL THEN r END IGNORE NULLS) OVER s AS rb, first_value(z IGNORE NULLS) OVER s AS zb,
    last_value(CASE WHEN z IS NOT NULL THEN c END IGNORE NULLS) OVER w AS ca, last_value(z IGNORE NULLS) OVER w AS zc, first_value(CASE WHEN z IS NOT NULL THEN c END IGNORE NULLS) OVER e AS cb, first_value(z IGNORE NULLS) OVER e AS zd FROM src
    WINDOW n AS (PARTITION BY grid_id, c ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s AS (PARTITION BY grid_id, c ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
      w AS (PARTITION BY grid_id, r ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), e AS (PARTITION BY grid_id, r ORDER BY c ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
  near AS (SELECT grid_id, r, c, z, list_filter([{'d': r - ra, 'z': za}, {'d': rb - r, 'z': zb}, {'d': c - ca, 'z': zc}, {'d': cb - c, 'z': zd}], lambda x : x.d IS NOT NULL AND x.d <= REACH) AS l FROM way),
  filled AS (SELECT grid_id, r, c, coalesce(z::DOUBLE, list_sum(list_transform(l, lambda x : x.z / x.d::DOUBLE)) / list_sum(list_transform(l, lambda x : 1.0::DOUBLE / x.d))) AS z, z IS NULL AS filled FROM near)"""


@query(f"WITH {fx.HOLED}, src AS (SELECT * FROM holed), {FILL.replace('REACH', '200')} SELECT grid_id, r, c, round(z, 6) AS z, filled FROM filled")
def i6_interpolation(spark, sf):
    return terrain.interpolated(fx.holed(spark, sf)).withColumn("z", F.round("z", 6))


@query(f"""WITH RECURSIVE {AREAS.replace(fx.MASKED, fx.HOLED + ", masked AS (SELECT grid_id, r, c, z, z IS NOT NULL AS covered FROM holed)")}, far AS (SELECT a.grid_id, a.root, max(d2) AS d2 FROM area a JOIN (
    SELECT a.grid_id, a.r, a.c, min((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) AS d2 FROM masked a JOIN masked b ON a.grid_id = b.grid_id AND b.z IS NOT NULL WHERE a.z IS NULL GROUP BY 1, 2, 3) x ON x.grid_id = a.grid_id AND x.r = a.r AND x.c = a.c GROUP BY 1, 2),
  how AS (SELECT grid_id, root, median, CASE WHEN d2 <= 9 THEN 'interpolated' WHEN verdict = 'sea' THEN 'sea' WHEN verdict = 'gap' AND median IS NOT NULL THEN 'still' WHEN verdict = 'gap' THEN 'interpolated' ELSE 'refused' END AS repair FROM judged JOIN far USING (grid_id, root)),
  src AS (SELECT m.grid_id, m.r, m.c, CASE repair WHEN 'sea' THEN 0 WHEN 'still' THEN median ELSE z::DOUBLE END AS z, repair FROM masked m LEFT JOIN area a ON a.grid_id = m.grid_id AND a.r = m.r AND a.c = m.c LEFT JOIN how h ON h.grid_id = a.grid_id AND h.root = a.root),
  {FILL.replace('REACH', '3')} SELECT s.grid_id, s.r, s.c, round(CASE WHEN repair = 'interpolated' THEN f.z ELSE s.z END, 6) AS z, repair FROM src s JOIN filled f ON f.grid_id = s.grid_id AND f.r = s.r AND f.c = s.c""")
def i5_repair(spark, sf):
    """Narrow holes interpolated, wide ones judged: still water, sea, or refused."""
    return terrain.repaired(fx.holed(spark, sf), 3.0, 0.0, 12.0).withColumn("z", F.round("z", 6))


# ---- grids -----------------------------------------------------------------------------------

BUILT = fx.CELLS + ", built AS (SELECT grid_id, (r - 8) // 4 AS r, (c - 8) // 4 AS c, round_even(avg(z) / 0.5, 0)::INT AS raw FROM cells WHERE r BETWEEN 8 AND 55 AND c BETWEEN 8 AND 55 GROUP BY 1, 2, 3 HAVING avg(z) IS NOT NULL)"


@query(f"WITH {BUILT} SELECT * FROM built")
def i7_grid_build(spark, sf):
    return terrain.built_grid(fx.cells(spark, sf), 8, 48, 4, 0.5)


@query(f"""WITH {BUILT}, g AS (SELECT grid_id, count(*) AS n, min(raw) * 0.5 AS low, max(raw) * 0.5 AS high, max(raw) FILTER (r = 6 AND c = 6) * 0.5 AS mid FROM built GROUP BY 1)
  SELECT grid_id, 'incomplete' AS gate, n::DOUBLE AS value FROM g WHERE n < 144 UNION ALL SELECT grid_id, 'low', low FROM g WHERE low < 10 UNION ALL SELECT grid_id, 'high', high FROM g WHERE high > 14 UNION ALL SELECT grid_id, 'centre', mid FROM g WHERE mid NOT BETWEEN 11 AND 12""")
def i7_grid_gates(spark, sf):
    return terrain.grid_gates(terrain.built_grid(fx.cells(spark, sf), 8, 48, 4, 0.5), 12, 0.5, (10, 14), (11, 12))


# four grids to a row of a lattice, where the first with a height wins; sites stand at tenths of it
LATTICE = fx.HOLED + """, ground AS (SELECT (grid_id // 8)::BIGINT AS grid_id, ((grid_id // 4) % 2 * 60 + r)::INT AS r, (grid_id % 4 * 60 + c)::INT AS c, arg_min(z, grid_id) FILTER (z IS NOT NULL) AS z FROM holed GROUP BY 1, 2, 3),
  site AS (SELECT s_suppkey AS site, s_suppkey % (SELECT max(grid_id) + 1 FROM ground) AS grid_id, (s_suppkey * 91 % 124)::INT AS r, (s_suppkey * 37 % 244)::INT AS c, CASE WHEN s_suppkey % 5 = 0 THEN 8 ELSE 4 END AS context, s_suppkey % 3 * 11 AS crown FROM supplier WHERE s_suppkey % 10 < 3)"""
STEPS = ((3, 8, 1), (4, 16, 2), (5, 32, 4), (6, 64, 8))


def lattice(spark, sf):
    """Ground, sites and a ladder over the test grids, placed four to a row."""
    h = fx.holed(spark, sf)
    tiles = h.selectExpr("grid_id AS tile", "int(grid_id div 4 % 2 * 60) AS row0", "int(grid_id % 4 * 60) AS col0", "r", "c", "z", "grid_id div 8 AS lattice")
    ground = terrain.mosaic(tiles, by=["lattice"]).select(F.col("lattice").alias("grid_id"), "r", "c", "z")
    n = h.agg((F.expr("max(grid_id) div 8") + 1).alias("n"))
    s = table(spark, sf, "supplier").where("s_suppkey % 10 < 3").crossJoin(F.broadcast(n)).where("n IS NOT NULL")  # one row
    sites = s.selectExpr("s_suppkey AS site", "s_suppkey % n AS grid_id", "int(s_suppkey * 91 % 124) AS r", "int(s_suppkey * 37 % 244) AS c", "CASE WHEN s_suppkey % 5 = 0 THEN 8 ELSE 4 END AS context", "double(s_suppkey % 3 * 11) AS crown")
    return ground, sites, spark.createDataFrame(STEPS, "ring int, half int, factor int")


@query(f"""WITH {LATTICE}, step(ring, half, factor) AS (VALUES {", ".join(map(str, STEPS))}),
  w AS (SELECT site, grid_id, crown, ring, half, factor, row_number() OVER o AS i, lag(half) OVER o AS before, r // factor - half // factor AS r0, c // factor - half // factor AS c0, 2 * half // factor AS side FROM site JOIN step ON half > context WINDOW o AS (PARTITION BY site ORDER BY half)),
  b AS (SELECT grid_id, factor, r // factor AS r, c // factor AS c, avg(z) AS z FROM ground, (SELECT DISTINCT factor FROM step) GROUP BY 1, 2, 3, 4),
  e AS (SELECT w.*, x.i AS wr, y.i AS wc FROM w, range(16) x(i), range(16) y(i) WHERE x.i < side AND y.i < side),
  k AS (SELECT e.*, b.z IS NULL AS sea, coalesce(b.z, 0) AS z FROM e LEFT JOIN b ON b.grid_id = e.grid_id AND b.factor = e.factor AND b.r = r0 + wr AND b.c = c0 + wc),
  box AS (SELECT site, arg_max(ring, (half = 32)::INT * 1000 + half) AS ring FROM w WHERE i <= 2 GROUP BY site),
  hz AS (SELECT k.site, 3.83 * sqrt(greatest(any_value(crown) + 2 - greatest(0, quantile_cont(z, 0.05)), 0)) * 1000 AS d FROM k JOIN box USING (site, ring) GROUP BY k.site)
  SELECT site, ring, round(d, 3) AS horizon_m, count(*) AS cells, count(*) FILTER (sea) AS filled, round(min(z), 6) AS low, round(max(z), 6) AS high, 'ring' || ring || ': ' || count(*) FILTER (sea) || ' cells were sea-filled' AS line
  FROM k JOIN hz USING (site) WHERE i <= 2 OR before * 400 < d GROUP BY site, ring, d""")
def i8_ring_ladder(spark, sf):
    """Rings of each site on mosaics out to its horizon, holes as sea: range, count and the line of provenance."""
    ground, sites, steps = lattice(spark, sf)
    _, told = rings.ring_ladder(ground, sites, steps, sites.select("site", "crown"), 400.0, 32, repair=None)
    return told.select("site", "ring", F.round("horizon_m", 3).alias("horizon_m"), "cells", "filled", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "line")


@query(f"""WITH RECURSIVE {FLOOD.replace("cells AS (", "fine AS (", 1)}""".replace(", reach(", """, cells AS (SELECT grid_id, r // 2 AS r, c // 2 AS c, sum(z) AS z FROM fine WHERE grid_id IN (SELECT user_id FROM events) GROUP BY 1, 2, 3 HAVING count(z) = 4), reach(""", 1).replace("r = 63", "r = 31").replace("c = 63", "c = 31") + """
  SELECT grid_id, r::INT AS r, c::INT AS c, ceil(connect / 4 / 0.5 - 1e-3)::INT AS raw FROM flood""")
def i9_far_water(spark, sf):
    """The flood on the second, coarser ring, for grids that have a table of levels; rounded up to its steps."""
    c = fx.cells(spark, sf).join(table(spark, sf, "events").select(F.col("user_id").alias("grid_id")).distinct(), "grid_id", "left_semi")
    far = raster.block_mean(c, 2).where("n = 4").select("grid_id", "r", "c", F.col("mean").alias("z"))
    edge = fx.cells(spark, sf).where("r % 2 = 0 AND c % 2 = 0").select("grid_id", F.expr("int(r div 2)").alias("r"), F.expr("int(c div 2)").alias("c")).join(large(far), ["grid_id", "r", "c"], "left")
    return raster.sea_connectivity(edge).select("grid_id", "r", "c", fn.quantize_up(F.col("connect"), 0.5).alias("raw"))


@query(f"""WITH {fx.HOLED}, t AS (SELECT grid_id AS tile, (grid_id * 40 % 100 + r)::INT AS r, (grid_id * 24 % 90 + c)::INT AS c, z FROM holed)
  SELECT r, c, TRUE AS covered, arg_min(z, tile) FILTER (z IS NOT NULL) AS z, min(tile) FILTER (z IS NOT NULL) AS tile FROM t GROUP BY 1, 2""")
def j5_mosaic(spark, sf):
    """Grids placed as windows on one lattice: the first with a height wins, and any window covers."""
    t = fx.holed(spark, sf).selectExpr("grid_id AS tile", "int(grid_id * 40 % 100) AS row0", "int(grid_id * 24 % 90) AS col0", "r", "c", "z")
    return terrain.mosaic(t)


@query(f"""WITH {fx.CELLS}, p AS (SELECT event_id, user_id % (SELECT count(DISTINCT grid_id) FROM cells) AS grid_id, (event_id % 630) / 10.0 AS fr, (event_id % 611) / 10.0 AS fc FROM events),
  q AS (SELECT *, least(floor(fr), 62)::INT AS r0, least(floor(fc), 62)::INT AS c0 FROM p), w AS (SELECT event_id, z, (CASE WHEN c.r = r0 THEN 1 - (fr - r0) ELSE fr - r0 END) * (CASE WHEN c.c = c0 THEN 1 - (fc - c0) ELSE fc - c0 END) AS w FROM q JOIN cells c ON c.grid_id = q.grid_id AND c.r IN (r0, r0 + 1) AND c.c IN (c0, c0 + 1))
  SELECT event_id, round(CASE WHEN count(z) = count(*) THEN sum(z * w) END, 6) AS h FROM w WHERE w > 0 GROUP BY 1""")
def j4_bilinear(spark, sf):
    """Heights at points between cell centres: four corners with weights, joined by cell."""
    c = fx.cells(spark, sf)
    n = c.agg(F.count_distinct("grid_id").alias("n"))
    p = table(spark, sf, "events").crossJoin(F.broadcast(n)).selectExpr("event_id", "user_id % n AS grid_id", "(event_id % 630) / 10.0D AS fr", "(event_id % 611) / 10.0D AS fc")  # one row
    return terrain.bilinear(p, c, "event_id").withColumn("h", F.round("h", 6))


@query(f"""WITH {fx.CELLS}, ring AS (SELECT grid_id, r // 4 AS r, c // 4 AS c, avg(z) AS m FROM cells GROUP BY 1, 2, 3), o AS (SELECT x.grid_id, median(ring.m - x.z) AS off FROM ring JOIN cells x ON ring.grid_id = x.grid_id AND x.r = ring.r * 4 + 2 AND x.c = ring.c * 4 + 2 GROUP BY 1)
  SELECT grid_id % 3 AS site, arg_max(grid_id, abs(off) * 1000000 - grid_id) AS worst, round(max(abs(off)), 6) AS off, CASE WHEN max(abs(off)) > 0.1 THEN 'fail' ELSE 'pass' END AS severity FROM o WHERE off IS NOT NULL GROUP BY 1""")
def q5_ring_agreement(spark, sf):
    """The grid of each site whose ring is furthest off, and whether that is too far."""
    c = fx.cells(spark, sf)
    ring = raster.block_mean(c, 4).select("grid_id", (F.col("r") * 4 + 2).alias("r"), (F.col("c") * 4 + 2).alias("c"), "mean")
    apart = ring.join(large(c), ["grid_id", "r", "c"]).select("grid_id", (F.col("mean") - F.col("z")).alias("d"))
    o = order.exact_percentiles(apart, ["grid_id"], "d", {"off": 0.5})
    top = F.max(F.abs("off"))
    return o.groupBy((F.col("grid_id") % 3).alias("site")).agg(F.max_by("grid_id", F.struct(F.abs("off"), -F.col("grid_id"))).alias("worst"), F.round(top, 6).alias("off"), F.when(top > 0.1, "fail").otherwise("pass").alias("severity"))


@query(f"""WITH {fx.CELLS}, far AS (SELECT grid_id, r // 4 AS r, c // 4 AS c, avg(z) AS z FROM cells GROUP BY 1, 2, 3), k AS (SELECT grid_id, r, c, z, least(r, c, 63 - r, 63 - c) AS edge, least(greatest((r + 0.5) / 4 - 0.5, 0), 15) AS fr, least(greatest((c + 0.5) / 4 - 0.5, 0), 15) AS fc FROM cells),
  q AS (SELECT *, least(floor(fr), 14)::INT AS r0, least(floor(fc), 14)::INT AS c0 FROM k WHERE edge < 4),
  w AS (SELECT q.grid_id, q.r, q.c, f.z, (CASE WHEN f.r = r0 THEN 1 - (fr - r0) ELSE fr - r0 END) * (CASE WHEN f.c = c0 THEN 1 - (fc - c0) ELSE fc - c0 END) AS w FROM q JOIN far f ON f.grid_id = q.grid_id AND f.r IN (r0, r0 + 1) AND f.c IN (c0, c0 + 1)),
  h AS (SELECT grid_id, r, c, CASE WHEN count(z) = count(*) THEN sum(z * w) END AS h FROM w WHERE w > 0 GROUP BY 1, 2, 3)
  SELECT k.grid_id, k.r, k.c, round(CASE WHEN edge >= 4 THEN z ELSE h * (1 - edge / 4.0) + z * (edge / 4.0) END, 5) AS z FROM k LEFT JOIN h ON h.grid_id = k.grid_id AND h.r = k.r AND h.c = k.c""")
def i20_feather(spark, sf):
    c = fx.cells(spark, sf)
    far = raster.block_mean(c, 4).select("grid_id", "r", "c", F.col("mean").alias("z"))
    return terrain.feathered(c, far, 4, 4).withColumn("z", F.round("z", 5))


@query(f"""WITH {fx.CELLS} SELECT grid_id, r, c, round(z - (((r + 0.5 - 32) * (r + 0.5 - 32) + (c + 0.5 - 32) * (c + 0.5 - 32)) * 1000000.0) * 0.87 / (2 * 6371000), 6) AS z FROM cells
  WHERE (r % 5 = 0 OR r = 63) AND (c % 5 = 0 OR c = 63) AND (r + 0.5 < 16 OR r + 0.5 > 48 OR c + 0.5 < 16 OR c + 0.5 > 48)""")
def i21_far_ring(spark, sf):
    """Every fifth cell of a far ring outside the next finer grid, lowered by the earth's curve."""
    return terrain.annulus(terrain.decimated(terrain.lowered(fx.cells(spark, sf), 1000.0, 32, 32), 5)).select("grid_id", "r", "c", F.round("z", 6).alias("z"))


_GREY = "floor(least(greatest(s * 255, 0), 255))"


@query(f"""WITH {fx.GRADIENT}, b AS (SELECT grid_id, r // 8 AS r, c // 8 AS c, avg({fx.SHADE}) AS s, avg((z <= 9)::INT) AS w FROM grad WHERE dr IS NOT NULL AND dc IS NOT NULL GROUP BY 1, 2, 3)
  SELECT grid_id, r::INT AS r, c::INT AS c, floor({_GREY} * (1 - w * 0.65) + 40 * (w * 0.65))::INT AS red, floor({_GREY} * (1 - w * 0.65) + 90 * (w * 0.65))::INT AS green, floor({_GREY} * (1 - w * 0.65) + 140 * (w * 0.65))::INT AS blue FROM b""")
def i22_thumbnail(spark, sf):
    return terrain.thumbnail(fx.cells(spark, sf), F.col("z") <= 9, 2.0, 8)


HIT = f"""{fx.CELLS}, ray AS (SELECT s_suppkey AS ray_id, s_suppkey % (SELECT count(DISTINCT grid_id) FROM cells) AS grid_id, (s_suppkey * 7 % 50)::DOUBLE AS r, (s_suppkey * 11 % 50)::DOUBLE AS c, 24.0 AS h, (s_suppkey % 7) / 10.0 AS dr, (s_suppkey % 5) / 10.0 AS dc, -0.3 AS dh FROM supplier),
  st AS (SELECT ray_id, grid_id, k AS step, r + dr * k AS fr, c + dc * k AS fc, h + dh * k AS y FROM ray, range(0, 101) q(k)), q AS (SELECT *, least(floor(fr), 62)::INT AS r0, least(floor(fc), 62)::INT AS c0 FROM st WHERE fr BETWEEN 0 AND 63 AND fc BETWEEN 0 AND 63),
  w AS (SELECT ray_id, q.grid_id, step, y, z, (CASE WHEN x.r = r0 THEN 1 - (fr - r0) ELSE fr - r0 END) * (CASE WHEN x.c = c0 THEN 1 - (fc - c0) ELSE fc - c0 END) AS w FROM q JOIN cells x ON x.grid_id = q.grid_id AND x.r IN (r0, r0 + 1) AND x.c IN (c0, c0 + 1)),
  g AS (SELECT ray_id, grid_id, step, y, CASE WHEN count(z) = count(*) THEN sum(z * w) END AS h FROM w WHERE w > 1e-12 GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {HIT} SELECT ray_id, grid_id, min(step)::INT AS step FROM g WHERE y <= h + 1e-9 GROUP BY 1, 2")
def i19_first_hit(spark, sf):
    """The first sample of each ray that lies below the ground."""
    return terrain.first_hits(fx.rays(spark, sf), fx.cells(spark, sf), 1.0, 100)


# the same halvings in a recursion over all rays
@query(f"""WITH RECURSIVE {HIT}, hit AS (SELECT ray_id, min(step)::INT AS step FROM g WHERE y <= h + 1e-9 GROUP BY ray_id), gl AS (SELECT grid_id, list(z::DOUBLE ORDER BY r, c) AS zs FROM cells GROUP BY grid_id),
  b AS (SELECT grid_id, min(r) AS ra, max(r) AS rb, min(c) AS ca, max(c) AS cb FROM cells WHERE z IS NOT NULL GROUP BY grid_id),
  one AS (SELECT ray_id, r, c, h::DOUBLE AS h, dr::DOUBLE AS dr, dc::DOUBLE AS dc, dh::DOUBLE AS dh, step, zs, ra, rb, ca, cb FROM ray JOIN hit USING (ray_id) JOIN gl USING (grid_id) JOIN b USING (grid_id)),
  s(i, ray_id, lo, hi) AS (SELECT 0, ray_id, greatest(step - 1, 0)::DOUBLE, step::DOUBLE FROM one UNION ALL
    SELECT i + 1, ray_id, CASE WHEN up THEN (lo + hi) / 2 ELSE lo END, CASE WHEN up THEN hi ELSE (lo + hi) / 2 END FROM (
      SELECT *, coalesce(y > (zs[a * 64 + k + 1] * (1 - (fc - k)) + zs[a * 64 + least(k + 1, cb) + 1] * (fc - k)) * (1 - (fr - a)) + (zs[least(a + 1, rb) * 64 + k + 1] * (1 - (fc - k)) + zs[least(a + 1, rb) * 64 + least(k + 1, cb) + 1] * (fc - k)) * (fr - a), FALSE) AS up FROM (
        SELECT *, least(floor(fr)::INT, greatest(rb - 1, ra)) AS a, least(floor(fc)::INT, greatest(cb - 1, ca)) AS k FROM (
          SELECT s.i, s.ray_id, s.lo, s.hi, one.zs, ra, rb, ca, cb, least(greatest(one.r + dr * ((lo + hi) / 2), ra), rb) AS fr, least(greatest(one.c + dc * ((lo + hi) / 2), ca), cb) AS fc, one.h + dh * ((lo + hi) / 2) AS y FROM s JOIN one USING (ray_id) WHERE i < 24))))
  SELECT ray_id, round(r + dr * (lo + hi) / 2, 4) AS r, round(c + dc * (lo + hi) / 2, 4) AS c FROM s JOIN one USING (ray_id) WHERE i = 24""")
def i19_pick(spark, sf):
    """Where each ray meets the ground, refined by halvings."""
    return terrain.picked(fx.rays(spark, sf), fx.cells(spark, sf), 1.0, 100, tile=16).select("ray_id", F.round("r", 4).alias("r"), F.round("c", 4).alias("c"))


# ---- land cover and plants -------------------------------------------------------------------


@query(f"""WITH {LANDCOVER}, f AS (SELECT grid_id, count(*) AS n, avg((class IN (7, 8))::INT) AS forest, avg((class = 6)::INT) AS pasture, avg((class IN (2, 3, 4, 5))::INT) AS open_land FROM landcover GROUP BY 1)
  SELECT grid_id, round(100 * forest, 4) AS forest, round(100 * pasture, 4) AS pasture, round(100 * open_land, 4) AS open_land, CASE WHEN forest + pasture + open_land > 0 THEN round_even(100 * forest / (forest + pasture + open_land), 0)::INT ELSE 0 END AS forest_share FROM f""")
def a13_calibration(spark, sf):
    """Forest, wooded pasture and open land of each grid in per cent, and forest of all dry land."""
    share = lambda *k: F.avg(F.col("class").isin(*k).cast("int"))
    g = land_cover(fixture_ground(spark, sf), fx.evidence(spark, sf), 2.0).groupBy("grid_id").agg(share(7, 8).alias("f"), share(6).alias("p"), share(2, 3, 4, 5).alias("o"))
    dry = F.col("f") + F.col("p") + F.col("o")
    return g.select("grid_id", F.round(F.col("f") * 100, 4).alias("forest"), F.round(F.col("p") * 100, 4).alias("pasture"), F.round(F.col("o") * 100, 4).alias("open_land"), F.when(dry > 0, F.rint(100 * F.col("f") / F.nullif(dry, F.lit(0.0)))).otherwise(0).cast("int").alias("forest_share"))


@query(f"WITH RECURSIVE {FLOOD} SELECT grid_id, round(avg((connect <= 9)::INT), 6) AS sea, round(avg((connect > 9 AND connect <= 11)::INT), 6) AS reeds FROM flood GROUP BY 1")
def a12_dynamic_fractions(spark, sf):
    """Shares of sea and of the reed band above it at a level."""
    f = raster.sea_connectivity(fx.cells(spark, sf))
    sea = F.col("connect") <= 9
    return f.groupBy("grid_id").agg(F.round(F.avg(sea.cast("int")), 6).alias("sea"), F.round(F.avg((~sea & (F.col("connect") <= 11)).cast("int")), 6).alias("reeds"))


#: Class, name, colour, rule.
LEGEND = [(0, "water", "#4a7ba6", "mapped water"), (1, "fen", "#7d8f5a", "peat or a peat veneer"), (2, "cleared", "#c9b48a", "within 2 m of a monument"), (3, "open", "#d6cbb0", "roads, esker and beach gravels"), (4, "farmland", "#d9c66b", "field remains, or arable ground near a settlement"),
          (5, "meadow", "#a9bf7a", "other fine or clay ground"), (6, "pasture", "#8aa35c", "till within 4 m of a settlement"), (7, "broadleaf", "#5d7f45", "other gentle till"), (8, "conifer", "#3f5d3a", "everything else")]


@query(f"""WITH {LANDCOVER}, n AS (SELECT grid_id, class, count(*) AS n FROM landcover GROUP BY 1, 2), t AS (SELECT grid_id, count(*) AS total FROM landcover GROUP BY 1),
  l(class, id, color, rule) AS (VALUES {", ".join(f"({a}, '{b}', '{c}', '{d}')" for a, b, c, d in LEGEND)})
  SELECT t.grid_id, l.class, l.id, l.color, l.id || ': ' || l.rule || ' (' || printf('%.1f', 100.0 * coalesce(n, 0) / total) || ' % of the grid)' AS text, round(coalesce(n, 0) / total::DOUBLE, 6) AS fraction FROM t CROSS JOIN l LEFT JOIN n ON n.grid_id = t.grid_id AND n.class = l.class""")
def i13_legend(spark, sf):
    """A legend row for each class, with its rule and its share of the grid."""
    n = land_cover(fixture_ground(spark, sf), fx.evidence(spark, sf), 2.0).groupBy("grid_id", "class").count()
    total = n.groupBy("grid_id").agg(F.sum("count").alias("total"))
    j = total.crossJoin(F.broadcast(spark.createDataFrame(LEGEND, "class int, id string, color string, rule string"))).join(n, ["grid_id", "class"], "left")  # nine rows
    n = F.coalesce("count", F.lit(0))
    text = F.format_string("%s: %s (%s %% of the grid)", "id", "rule", fn.one_place(100.0 * n / F.col("total")))
    return j.select("grid_id", "class", "id", "color", text.alias("text"), F.round(n / F.col("total"), 6).alias("fraction"))


#: Class, form and density of the test legend, and the band's.
PLANTS = [(0, "conifer", 2500.0), (3, "broadleaf", 1111.0), (6, "conifer", 625.0)]
BAND = [(8, "reeds", 2500.0)]


def _drawn(seed: str, first: str, k: int) -> str:
    """SQL for the next CTEs: draws 0 to k - 1 after ``first`` of ``seed`` as columns w0, w1, ... of d."""
    return f"""a0 AS (SELECT *, (({seed}) + (({first}) + k + 1)::HUGEINT * 1831565813) % 4294967296 AS a FROM lat, range(0, {k}) q(k)),
  a1 AS (SELECT *, (xor(a::BIGINT, (a::BIGINT >> 15))::HUGEINT * (a::BIGINT | 1)::HUGEINT) % 4294967296 AS t FROM a0),
  a2 AS (SELECT *, (t + (xor(t::BIGINT, t::BIGINT >> 7)::HUGEINT * (t::BIGINT | 61)::HUGEINT) % 4294967296) % 4294967296 AS u FROM a1),
  d AS (SELECT grid_id, class, lr, lc, spacing, {", ".join(f"max(xor(xor(t::BIGINT, u::BIGINT), xor(t::BIGINT, u::BIGINT) >> 14) / 4294967296.0::DOUBLE) FILTER (k = {i}) AS w{i}" for i in range(k))} FROM a2 GROUP BY 1, 2, 3, 4, 5)"""


def _lattice(rows: list, stream: str) -> str:
    return fx.CELLS + f""", leg(class, form, density) AS (VALUES {", ".join(f"({a}, '{b}', {c}::DOUBLE)" for a, b, c in rows)}), sp AS (SELECT *, sqrt(10000.0 / density) AS spacing FROM leg), ct AS (SELECT *, ceil(128.0 / spacing)::BIGINT AS cols FROM sp),
  lat AS (SELECT grid_id, class, spacing, cols, lr, lc, xor(((({stream}) + 1)::HUGEINT * 2654435761 % 4294967296)::BIGINT, 1) AS seed FROM (SELECT DISTINCT grid_id FROM cells), ct, range(0, 128) p(lr), range(0, 128) q(lc) WHERE lr < cols AND lc < cols)"""


SAMPLE = _lattice(PLANTS, "class") + ", " + _drawn("seed", "2 * (lr * cols + lc)", 2) + """, pl AS (SELECT d.*, (lc + w0) * spacing AS x, (lr + w1) * spacing AS y FROM d),
  plant AS (SELECT pl.grid_id, pl.class, pl.lr, pl.lc, x, y, c.r, c.c, c.z FROM pl JOIN cells c ON c.grid_id = pl.grid_id AND c.r = least(floor(y / 2), 63) AND c.c = least(floor(x / 2), 63) WHERE x <= 128 AND y <= 128 AND c.label = pl.class)"""


def _ground(spark, sf):
    c = fx.cells(spark, sf).withColumnRenamed("label", "class").withColumn("connect", F.col("z").cast("double"))
    extents = c.select("grid_id").distinct().select("grid_id", F.lit(128.0).alias("width"), F.lit(128.0).alias("height"))
    return c, extents


def _rows(spark, rows):
    return spark.createDataFrame(rows, "class int, form string, density double")


@query(f"WITH {SAMPLE} SELECT grid_id, class, lr, lc, r, c FROM plant")
def i14_stratified_sampling(spark, sf):
    """Jittered plants of three classes, each on a lattice of its own density, kept where the grid has the class."""
    c, ext = _ground(spark, sf)
    return vegetation.sampled(c, ext, _rows(spark, PLANTS), 2.0).select("grid_id", "class", "lr", "lc", "r", "c")


#: Form, number of its stream, height, ratio of width, jitter, lean.
FORM_ROWS = [("conifer", 0, 12.0, 0.35, 0.25, 0.05), ("broadleaf", 1, 9.0, 0.8, 0.3, 0.08)]


@query(f"""WITH {SAMPLE}, fm(form, number, height, ratio, jitter, lean) AS (VALUES {", ".join(f"('{a}', {b}, {c}::DOUBLE, {d}::DOUBLE, {e}::DOUBLE, {g}::DOUBLE)" for a, b, c, d, e, g in FORM_ROWS)}),
  pf AS (SELECT *, row_number() OVER (PARTITION BY grid_id, form ORDER BY class, lr, lc) - 1 AS i FROM (SELECT *, CASE class WHEN 3 THEN 'broadleaf' ELSE 'conifer' END AS form FROM plant) JOIN fm USING (form)),
  b0 AS (SELECT pf.*, k, ((xor(((number + 100 + 1)::HUGEINT * 2654435761 % 4294967296)::BIGINT, 1)) + (5 * i + k + 1)::HUGEINT * 1831565813) % 4294967296 AS a FROM pf, range(0, 5) q(k)),
  b1 AS (SELECT *, (xor(a::BIGINT, (a::BIGINT >> 15))::HUGEINT * (a::BIGINT | 1)::HUGEINT) % 4294967296 AS t FROM b0), b2 AS (SELECT *, (t + (xor(t::BIGINT, t::BIGINT >> 7)::HUGEINT * (t::BIGINT | 61)::HUGEINT) % 4294967296) % 4294967296 AS u FROM b1),
  w AS (SELECT grid_id, class, lr, lc, height, ratio, jitter, lean, {", ".join(f"max(xor(xor(t::BIGINT, u::BIGINT), xor(t::BIGINT, u::BIGINT) >> 14) / 4294967296.0::DOUBLE) FILTER (k = {i}) AS w{i}" for i in range(5))} FROM b2 GROUP BY ALL)
  SELECT grid_id, class, lr, lc, round(height * (1 + (w0 * 2 - 1) * jitter), 6) AS height, round(height * (1 + (w0 * 2 - 1) * jitter) * ratio * (1 + (w1 * 2 - 1) * jitter), 6) AS width, round(w2 * 2 * pi(), 6) AS yaw, round((w3 * 2 - 1) * lean, 6) AS lean_x, round((w4 * 2 - 1) * lean, 6) AS lean_z FROM w""")
def i14_appearance(spark, sf):
    """Height, width, turn and lean of each plant, drawn in order within its form."""
    c, ext = _ground(spark, sf)
    forms = spark.createDataFrame(FORM_ROWS, "form string, number int, height double, ratio double, jitter double, lean double")
    p = vegetation.appearance(vegetation.sampled(c, ext, _rows(spark, PLANTS), 2.0).select("grid_id", "class", "form", "lr", "lc"), forms)
    return p.select("grid_id", "class", "lr", "lc", *[F.round(x, 6).alias(x) for x in ("height", "width", "yaw", "lean_x", "lean_z")])


@query("WITH " + _lattice(BAND, "class + 200") + ", " + _drawn("seed", "7 * (lr * cols + lc)", 5) + """
  SELECT d.grid_id, d.lr, d.lc, z::DOUBLE AS connect, round(1.8 * (1 + (w2 * 2 - 1) * 0.2), 6) AS height, round(w4 * 2 * pi(), 6) AS yaw FROM d JOIN cells c ON c.grid_id = d.grid_id AND c.r = least(floor((lr + w1) * spacing / 2), 63) AND c.c = least(floor((lc + w0) * spacing / 2), 63)
  WHERE (lc + w0) * spacing <= 128 AND (lr + w1) * spacing <= 128 AND z > 8 AND z <= 12 AND (label IS NULL OR label NOT IN (0, 5))""")
def i15_shore_band(spark, sf):
    """Candidates for reeds between the lowest and the highest level."""
    c, ext = _ground(spark, sf)
    b = vegetation.shore_band(c, ext, _rows(spark, BAND), [0, 5], 2.0, (8.0, 11.0), 1.0, 1.8)
    return b.select("grid_id", "lr", "lc", "connect", F.round("height", 6).alias("height"), F.round("yaw", 6).alias("yaw"))


def _scaled(name: str, rows: list, stream: str, draws: int, scale: str) -> str:
    """SQL for CTEs that end in ``name``: the places of lattices whose densities a table of scales has changed, with the cells they lie in."""
    lat = f"""lat AS (SELECT grid_id, class, spacing, ceil(128.0 / spacing)::BIGINT AS cols, lr, lc, xor(((({stream}) + 1)::HUGEINT * 2654435761 % 4294967296)::BIGINT, 1) AS seed FROM (
    SELECT grid_id, class, sqrt(10000.0 / (density * scale)) AS spacing FROM {scale}, (VALUES {", ".join(f"({a}, {c}::DOUBLE)" for a, _, c in rows)}) leg(class, density)), range(0, 128) p(lr), range(0, 128) q(lc) WHERE lr < ceil(128.0 / spacing) AND lc < ceil(128.0 / spacing))"""
    every = f"{lat}, {_drawn('seed', f'{draws} * (lr * cols + lc)', 2)}, {name} AS (SELECT p.grid_id, p.class, p.lr, p.lc, c.z, c.label FROM (SELECT d.*, (lc + w0) * spacing AS x, (lr + w1) * spacing AS y FROM d) p JOIN cells c ON c.grid_id = p.grid_id AND c.r = least(floor(y / 2), 63) AND c.c = least(floor(x / 2), 63) WHERE x <= 128 AND y <= 128)"
    return re.sub(r"\b(lat|a0|a1|a2|a3|d)\b(?!\()", lambda m: f"{name}_{m[1]}", every)


_CAPACITY = "(SELECT grid_id, max(n) AS capacity FROM (SELECT grid_id, count(*) OVER (PARTITION BY grid_id ORDER BY z RANGE BETWEEN CURRENT ROW AND 1 FOLLOWING) AS n FROM {} WHERE z > 8 AND z <= 10 AND NOT coalesce(label IN (0, 5), FALSE)) GROUP BY grid_id)"


@query(f"""WITH {fx.CELLS}, one AS (SELECT DISTINCT grid_id, 1.0::DOUBLE AS scale FROM cells), {_scaled("own", PLANTS, "class", 2, "one")}, {_scaled("band", BAND, "class + 200", 7, "one")},
  n AS (SELECT one.grid_id, coalesce(k.n, 0) + coalesce(m.capacity, 0) AS n FROM one LEFT JOIN (SELECT grid_id, count(*) AS n FROM own WHERE label = class GROUP BY grid_id) k USING (grid_id) LEFT JOIN {_CAPACITY.format("band")} m USING (grid_id)),
  less AS (SELECT grid_id, CASE WHEN n > 300 THEN 300 / n::DOUBLE ELSE 1.0 END AS scale FROM n), {_scaled("own2", PLANTS, "class", 2, "less")}, {_scaled("band2", BAND, "class + 200", 7, "less")},
  t AS (SELECT own2.*, row_number() OVER (PARTITION BY own2.grid_id ORDER BY class, lr, lc) AS i, greatest(0, 300 - coalesce(capacity, 0)) AS budget FROM own2 LEFT JOIN {_CAPACITY.format("band2")} m USING (grid_id) WHERE label = class)
  SELECT grid_id, class, count(*) AS n, round(max(scale), 9) AS scale FROM t JOIN less USING (grid_id) WHERE i <= budget GROUP BY grid_id, class""")
def i16_budget(spark, sf):
    """Plants of all classes under a budget of 300 a grid."""
    c, ext = _ground(spark, sf)
    p = vegetation.budgeted(c, ext, _rows(spark, PLANTS), _rows(spark, BAND), [0, 5], 2.0, (8.0, 9.0), 1.0, 1.8, 300)
    return p.groupBy("grid_id", "class").agg(F.count("*").alias("n"), F.round(F.max("scale"), 9).alias("scale"))


@query(f"""WITH {SAMPLE}, lv(level) AS (VALUES (8.0::DOUBLE), (10.0), (12.0)) SELECT grid_id, level, CASE class WHEN 3 THEN 'broadleaf' WHEN 8 THEN 'reeds' ELSE 'conifer' END AS form, count(*) FILTER (z > level + 1) AS visible FROM plant, lv GROUP BY 1, 2, 3""")
def i17_visible_plants(spark, sf):
    c, ext = _ground(spark, sf)
    p = vegetation.sampled(c, ext, _rows(spark, PLANTS), 2.0, more=("connect",))
    return vegetation.visible(p, spark.createDataFrame([(8.0,), (10.0,), (12.0,)], "level double"), 1.0)


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, sum(1) OVER (PARTITION BY user_id ORDER BY event_type, event_id ROWS UNBOUNDED PRECEDING) AS i FROM events) WHERE i <= 20 + user_id % 10")
def w11_budget_trim(spark, sf):
    """The first so many rows of each user over all types in order; the budget is the user's own."""
    e = table(spark, sf, "events").withColumnRenamed("user_id", "grid_id")
    return vegetation.trimmed(e, 20 + F.col("grid_id") % 10, [F.col("event_type"), F.col("event_id")]).select(F.col("grid_id").alias("user_id"), "event_id")


# ---- water levels ----------------------------------------------------------------------------

LEVELS = OUTLINE + "," + fx.CELLS + """, ng AS (SELECT count(DISTINCT grid_id) AS n FROM cells), ft AS (SELECT DISTINCT feature_id, feature_id % n AS slug, (800 + 100 * (feature_id // n % 23))::INT AS bp FROM vertices, ng WHERE closed),
  sg AS (SELECT feature_id, x / 1000.0 * 64 AS x, y / 1000.0 * 64 AS y, x2 / 1000.0 * 64 AS x2, y2 / 1000.0 * 64 AS y2 FROM seg WHERE closed), dn AS (SELECT *, greatest(1, ceil(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))))::BIGINT AS n FROM sg),
  pt AS (SELECT feature_id, x + (x2 - x) * k / n::DOUBLE AS px, y + (y2 - y) * k / n::DOUBLE AS py FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM dn)),
  sm AS (SELECT slug, bp, z FROM pt JOIN ft USING (feature_id) JOIN cells c ON c.grid_id = slug AND c.r = floor(py) AND c.c = floor(px) WHERE px BETWEEN 2 AND 62 AND py BETWEEN 2 AND 62 AND z IS NOT NULL),
  ms AS (SELECT slug, bp, round_even(median(z), 1) AS z, count(*) AS samples FROM sm GROUP BY 1, 2 HAVING count(*) >= 500), fit AS (SELECT slug, regr_slope(z, 1950.0 - bp) AS a, regr_intercept(z, 1950.0 - bp) AS b FROM ms GROUP BY 1 HAVING count(*) > 1),
  pr AS (SELECT DISTINCT slug, bp FROM ft), rw AS (SELECT slug, bp, 1950 - bp AS year, coalesce(samples, 0) AS samples, coalesce(z, round_even(a * (1950.0 - bp) + b, 1)) AS raw FROM pr LEFT JOIN ms USING (slug, bp) LEFT JOIN fit USING (slug)),
  levels AS (SELECT *, round_even(min(raw) OVER (PARTITION BY slug ORDER BY bp DESC ROWS UNBOUNDED PRECEDING), 1) AS level FROM rw)"""


def _levels(spark, sf):
    cells = fx.cells(spark, sf)
    n = cells.agg(F.count_distinct("grid_id").alias("n"))
    v = fx.vertices(spark, sf).where("closed").crossJoin(F.broadcast(n))  # one row
    v = v.select("feature_id", F.lit(0).alias("ring"), F.lit(False).alias("hole"), "seq", "closed", (F.col("x") / 1000.0 * 64).alias("x"), (F.col("y") / 1000.0 * 64).alias("y"), F.expr("feature_id % n").alias("slug"), F.expr("int(800 + 100 * (feature_id div n % 23))").alias("bp"))
    return series.century_levels(v, series.shore_samples(v, cells), 500)


@query(f"WITH {LEVELS} SELECT slug, bp, year, level, samples, raw FROM levels")
def i10_century_table(spark, sf):
    """Levels by century: medians along the shores, a trend for the rest, never rising."""
    return _levels(spark, sf).drop("trend_rms")


@query(f"WITH {LEVELS} SELECT s.slug, t.bp::INT AS bp FROM (SELECT DISTINCT slug FROM levels) s, range(800, 3001, 100) t(bp) WHERE NOT EXISTS (SELECT 1 FROM levels l WHERE l.slug = s.slug AND l.bp = t.bp)")
def i10_missing_centuries(spark, sf):
    return series.missing_centuries(_levels(spark, sf))


@query(f"""WITH {LEVELS}, tr AS (SELECT grid_id AS slug, min(z) AS low, max(z) AS high FROM cells GROUP BY 1)
  SELECT slug, bp, level, CASE WHEN level < -10 OR level > 11 THEN 'envelope' ELSE 'terrain' END AS rule FROM levels JOIN tr USING (slug) WHERE level < -10 OR level > 11 OR level < low - 5 OR level > high - 9""")
def q11_level_plausible(spark, sf):
    """Levels outside a physical envelope, or outside the site's own terrain."""
    t = fx.cells(spark, sf).groupBy(F.col("grid_id").alias("slug")).agg(F.min("z").alias("low"), (F.max("z") - 14).alias("high"))
    return series.implausible(_levels(spark, sf), t, (-10.0, 11.0), 5.0)


@query(f"""WITH {LEVELS}, fr AS (SELECT m.slug, sqrt(avg((z - (a * (1950.0 - bp) + b)) ** 2)) AS rms FROM ms m JOIN fit f ON m.slug = f.slug GROUP BY 1),
  g AS (SELECT slug, count(*) FILTER (samples > 0) AS n, sum(samples)::BIGINT AS points, count(*) FILTER (samples = 0) AS filled, min(year) FILTER (samples = 0) AS y0, max(year) FILTER (samples = 0) AS y1, sum(raw - level) AS moved FROM levels GROUP BY 1),
  gone AS (SELECT slug, 23 - count(*) AS gone FROM levels GROUP BY 1)
  SELECT slug, printf('Levels of %d centuries are medians of %d heights along the modelled shore.', n, points) || CASE WHEN filled > 0 THEN printf(' %d centuries (%d to %d) have no shore in frame and follow a linear trend (RMS %.2f m).', filled, y0, y1, coalesce(rms, 0)) ELSE '' END
    || CASE WHEN gone > 0 THEN printf(' %d centuries are absent from the source.', gone) ELSE '' END || CASE WHEN moved > 0.05 THEN printf(' The table was lowered by %.1f m in all so that it never rises.', moved) ELSE '' END
    || CASE WHEN slug % 4 = 0 THEN ' It was held against published estimates.' ELSE ' It was held against the site''s own terrain.' END AS text FROM g JOIN gone USING (slug) LEFT JOIN fr USING (slug)""")
def f24_method_text(spark, sf):
    """How each site's table was made, from its own numbers."""
    t = cut(_levels(spark, sf), "levels")
    return series.method_text(t, series.missing_centuries(t), F.col("slug") % 4 == 0)


# ---- crests ----------------------------------------------------------------------------------


def _crest(spark, sf):
    """A bank-like ring in each grid: an outline around its middle."""
    cells = fx.cells(spark, sf)
    turn = F.explode(F.sequence(F.lit(0), F.lit(23))).alias("seq")
    v = cells.where("z IS NOT NULL").groupBy("grid_id").agg(F.max("r").alias("mr")).where("mr = 63").select("grid_id", turn)
    at = lambda f: 31.5 + 18 * f(F.col("seq") * (2 * 3.141592653589793 / 24))
    v = v.select(F.col("grid_id").alias("feature_id"), F.lit(0).alias("ring"), "seq", at(F.cos).alias("x"), at(F.sin).alias("y"), F.lit(True).alias("closed"), F.lit(False).alias("hole"))
    return terrain.crest(cells, v, step=1.0, smooth=3.0, outer=4.0, inner=8.0, sample=0.5, background=6.0, guide=7.0, reject=2.0, least=0.3, crest_smooth=3.0)


@query()
def i11_crest(spark, sf):
    """The ridge along a ring of each grid; tests hold it against a bank of known place."""
    return _crest(spark, sf)["line"]


@query()
def a18_crest_statistics(spark, sf):
    c = _crest(spark, sf)
    return terrain.crest_statistics(c["line"], c["picks"])


@query(f"""WITH {fx.CELLS}, k AS (SELECT *, lag(z) OVER h AS a, lead(z) OVER h AS b FROM (SELECT *, 20 + (r * 7 + grid_id) % 20 AS low FROM cells) WHERE z IS NOT NULL AND c BETWEEN low AND low + 15 WINDOW h AS (PARTITION BY grid_id, r ORDER BY c)),
  p AS (SELECT *, row_number() OVER (PARTITION BY grid_id, r ORDER BY z DESC, c) AS i FROM k)
  SELECT grid_id, r, z::DOUBLE AS prominence, round(least(greatest(c + coalesce(CASE WHEN a - 2 * z + b <> 0 THEN greatest(-0.5, least(0.5, 0.5 * (a - b) / (a - 2 * z + b))) END, 0), low), low + 15), 6) AS inset FROM p WHERE i = 1""")
def w5_ridge_pick(spark, sf):
    """The highest cell of each row inside a guide, moved by a parabola and held inside the guide."""
    p = fx.cells(spark, sf).where("z IS NOT NULL").selectExpr("grid_id", "r", "c AS k", "CAST(c AS DOUBLE) AS offset", "CAST(z AS DOUBLE) AS value", "CAST(20 + (r * 7 + grid_id) % 20 AS DOUBLE) AS low").withColumn("high", F.col("low") + 15)
    return terrain.ridge_pick(p, ["grid_id", "r"], 1.0, "low", "high").withColumn("inset", F.round("inset", 6))
