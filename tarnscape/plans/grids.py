"""Queries over grids: aggregates, windows, joins and composite raster operators (A, W, J, I)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnscape.operators import order, raster, series, sight
from tarnscape.plans.base import query
from tarnscape.session import cut, large, table
from tarnscape.sources import fixtures as fx

FLOOD = fx.FLOOD


def basin_stats(flood, levels):
    """(grid_id, level, wet, excluded, largest): cells the sea reaches at each level, those below it that it doesn't, and their largest area."""
    lv = F.broadcast(flood.sparkSession.createDataFrame([(x,) for x in levels], "level int"))  # a few levels
    f = flood.crossJoin(lv)
    dry = (F.col("z") <= F.col("level")) & (F.col("connect") > F.col("level"))
    k = f.groupBy("grid_id", "level").agg(F.count_if(F.col("connect") <= F.col("level")).alias("wet"), F.count_if(dry).alias("excluded"))
    # areas of all levels at once: a level is a grid of its own
    own = f.where(dry).select((F.col("grid_id") * 1000 + F.col("level")).alias("grid_id"), "r", "c")
    area = raster.connected_areas(own).groupBy("grid_id", "area").count().groupBy("grid_id").agg(F.max("count").alias("largest"))
    area = area.select(F.expr("grid_id div 1000").alias("grid_id"), F.expr("int(grid_id % 1000)").alias("level"), "largest")
    return k.join(area, ["grid_id", "level"], "left").withColumn("largest", F.coalesce("largest", F.lit(0).cast("long")))


@query(f"WITH RECURSIVE {FLOOD} SELECT grid_id, r, c, z::DOUBLE AS z, connect FROM cells JOIN flood USING (grid_id, r, c)")
def i1_sea_connectivity(spark, sf):
    return raster.sea_connectivity(fx.cells(spark, sf), tile=16, blocks=2)  # tiles and blocks with seams


_STEPS = [(-1000, 14.0), (-500, 11.0), (0, 9.0), (500, 7.0), (1000, 5.0)]


def level_at(spark, years):
    """Level at any year: linear between the steps around it, clamped at the ends. Steps are a dimension table."""
    steps = spark.createDataFrame(_STEPS, "y0 int, l0 double")
    w = Window.orderBy("y0")  # five rows
    iv = F.broadcast(steps.withColumn("y1", F.lead("y0").over(w)).withColumn("l1", F.lead("l0").over(w)).withColumn("first", F.lag("y0").over(w).isNull()))
    inside = (F.col("year") >= F.col("y0")) & (F.col("y1").isNull() | (F.col("year") < F.col("y1"))) | (F.col("first") & (F.col("year") < F.col("y0")))
    level = F.when(F.col("y1").isNull() | (F.col("year") < F.col("y0")), F.col("l0")).otherwise(F.col("l0") + (F.col("l1") - F.col("l0")) * (F.col("year") - F.col("y0")) / (F.col("y1") - F.col("y0")))
    return years.join(iv, inside).withColumn("level", level).drop("y0", "l0", "y1", "l1", "first")


LEVEL_AT = """steps(y0, l0) AS (VALUES (-1000, 14.0::DOUBLE), (-500, 11.0), (0, 9.0), (500, 7.0), (1000, 5.0)),
  iv AS (SELECT *, lead(y0) OVER (ORDER BY y0) AS y1, lead(l0) OVER (ORDER BY y0) AS l1, lag(y0) OVER (ORDER BY y0) IS NULL AS f FROM steps)"""


@query(f"""WITH {fx.LEVELS}, st AS (SELECT slug, (1950 - bp)::DOUBLE AS y, round(median(value), 6) AS l FROM samples GROUP BY slug, bp HAVING count(value) >= 3),
  iv AS (SELECT *, lead(y) OVER w AS y1, lead(l) OVER w AS l1, lag(y) OVER w IS NULL AS f FROM st WINDOW w AS (PARTITION BY slug ORDER BY y)),
  q AS (SELECT event_id, user_id AS slug, (event_id % 4001 - 2200)::INT AS year FROM events)
  SELECT event_id, q.slug, year, round(CASE WHEN y1 IS NULL OR year < y THEN l ELSE l + (l1 - l) * ((year - y) / (y1 - y)) END, 6) AS level FROM q LEFT JOIN iv ON iv.slug = q.slug AND ((year >= y AND (y1 IS NULL OR year < y1)) OR (f AND year < y))""")
def j7_level_at_year(spark, sf):
    """Levels at any year from each site's own table of centuries."""
    s = fx.level_samples(spark, sf).groupBy("slug", "bp").agg(F.round(F.median("value"), 6).alias("level"), F.count("value").alias("n")).where("n >= 3")
    q = table(spark, sf, "events").select("event_id", F.col("user_id").alias("slug"), F.expr("int(event_id % 4001 - 2200)").alias("year"))
    return series.levels_at(s.select("slug", (1950 - F.col("bp")).alias("year"), "level"), q).withColumn("level", F.round("level", 6))


@query(f"""WITH RECURSIVE {FLOOD}, {LEVEL_AT}, y(year) AS (VALUES (-800), (-200), (350), (900)),
  lv AS (SELECT year, l0 + (l1 - l0) * (year - y0) / (y1 - y0) AS level FROM y JOIN iv ON year >= y0 AND year < y1)
  SELECT grid_id, year, round(level, 6) AS level, count(*) FILTER (connect <= level) AS wet, round(avg((connect <= level)::INT), 6) AS share FROM flood, lv GROUP BY 1, 2, 3""")
def i1_sea_share_at_year(spark, sf):
    """Which cells the sea reaches at a year, and the share of each grid: flood, as-of join, filter, aggregate."""
    years = spark.createDataFrame([(-800,), (-200,), (350,), (900,)], "year int")
    flood = raster.sea_connectivity(fx.cells(spark, sf)).crossJoin(F.broadcast(level_at(spark, years)))  # four years
    wet = F.col("connect") <= F.col("level")
    return flood.groupBy("grid_id", "year", F.round("level", 6).alias("level")).agg(F.count_if(wet).alias("wet"), F.round(F.avg(wet.cast("int")), 6).alias("share"))


@query(f"""WITH RECURSIVE {fx.CELLS}, w AS (SELECT grid_id * 4096 + r * 64 + c AS id, grid_id, r, c FROM cells WHERE z <= 8),
  lab(id, root) AS (SELECT id, id FROM w UNION SELECT n.id, l.root FROM lab l JOIN w x ON x.id = l.id, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(dr, dc), w n WHERE n.grid_id = x.grid_id AND n.r = x.r + d.dr AND n.c = x.c + d.dc AND l.root < n.id),
  m AS (SELECT id, min(root) AS component FROM lab GROUP BY id)
  SELECT grid_id, component, count(*) AS size, bool_or(r = 0 OR r = 63 OR c = 0 OR c = 63) AS edge FROM w JOIN m USING (id) GROUP BY 1, 2""")
def i2_components(spark, sf):
    """Connected areas below a height, with size and whether they touch the edge."""
    area = raster.connected_areas(fx.cells(spark, sf).where("z <= 8"), tile=16)
    edge = F.col("r").isin(0, 63) | F.col("c").isin(0, 63)
    name = F.expr("grid_id * 4096 + area.r * 64 + area.c")
    return area.groupBy("grid_id", name.alias("component")).agg(F.count("*").alias("size"), F.bool_or(edge).alias("edge"))


@query(f"""WITH RECURSIVE {FLOOD}, lv(level) AS (VALUES (8), (10), (12)), x AS (SELECT grid_id * 4096 + r * 64 + c AS id, grid_id, level, r, c FROM cells JOIN flood USING (grid_id, r, c), lv WHERE z <= level AND connect > level),
  lab(id, level, root) AS (SELECT id, level, id FROM x UNION SELECT n.id, l.level, l.root FROM lab l JOIN x o ON o.id = l.id AND o.level = l.level, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(dr, dc), x n WHERE n.grid_id = o.grid_id AND n.level = o.level AND n.r = o.r + d.dr AND n.c = o.c + d.dc AND l.root < n.id),
  big AS (SELECT grid_id, level, max(n) AS largest FROM (SELECT id // 4096 AS grid_id, level, root, count(*) AS n FROM (SELECT id, level, min(root) AS root FROM lab GROUP BY 1, 2) GROUP BY 1, 2, 3) GROUP BY 1, 2),
  k AS (SELECT grid_id, level, count(*) FILTER (connect <= level) AS wet, count(*) FILTER (z <= level AND connect > level) AS excluded FROM cells JOIN flood USING (grid_id, r, c), lv GROUP BY 1, 2)
  SELECT k.grid_id, k.level, wet, excluded, coalesce(largest, 0) AS largest FROM k LEFT JOIN big USING (grid_id, level)""")
def a14_false_basins(spark, sf):
    """Cells under a level that the sea doesn't reach, and the largest connected area of them."""
    return basin_stats(cut(raster.sea_connectivity(fx.cells(spark, sf)), "flood"), [8, 10, 12])


@query(f"""WITH RECURSIVE {FLOOD} SELECT grid_id, min(z)::DOUBLE AS low, max(z)::DOUBLE AS high, round(avg((connect > z)::INT), 6) AS raised, max(connect - z) AS lift FROM cells JOIN flood USING (grid_id, r, c) GROUP BY 1""")
def a15_lift(spark, sf):
    f = raster.sea_connectivity(fx.cells(spark, sf))
    return f.groupBy("grid_id").agg(F.min("z").alias("low"), F.max("z").alias("high"), F.round(F.avg((F.col("connect") > F.col("z")).cast("int")), 6).alias("raised"), F.max(F.col("connect") - F.col("z")).alias("lift"))


@query(f"WITH {fx.HOLED} SELECT grid_id, r // 4 AS r, c // 4 AS c, round(avg(z), 6) AS mean, count(z) AS n FROM holed GROUP BY 1, 2, 3")
def a8_valid_block_mean(spark, sf):
    return raster.block_mean(fx.holed(spark, sf), 4).withColumn("mean", F.round("mean", 6))


@query(f"WITH {fx.CELLS} SELECT grid_id, r // 8 AS r, c // 8 AS c, round(avg(z), 6) AS mean, count(z) AS n FROM cells GROUP BY 1, 2, 3")
def a7_block_mean(spark, sf):
    return raster.block_mean(fx.cells(spark, sf), 8).withColumn("mean", F.round("mean", 6))


@query(f"""WITH {fx.CELLS} SELECT grid_id, coalesce(max(z) FILTER ((r - 32) * (r - 32) + (c - 32) * (c - 32) < 100), max(z)) AS crown, greatest(0, quantile_cont(z, 0.05))::DOUBLE AS floor_m, median(z) AS mid FROM cells GROUP BY 1""")
def a9_crown_and_floor(spark, sf):
    inside = F.expr("(r - 32) * (r - 32) + (c - 32) * (c - 32) < 100")
    c = fx.cells(spark, sf)
    crown = c.groupBy("grid_id").agg(F.coalesce(F.max(F.when(inside, F.col("z"))), F.max("z")).alias("crown"))
    p = order.exact_percentiles(c, ["grid_id"], "z", {"p5": 0.05, "mid": 0.5})
    return crown.join(p, "grid_id", "left").select("grid_id", "crown", F.when(F.col("p5").isNotNull(), F.greatest(F.lit(0.0), F.col("p5"))).otherwise(0.0).alias("floor_m"), "mid")


@query(f"""WITH {fx.CELLS}, g AS (SELECT grid_id, k FROM (SELECT DISTINCT grid_id FROM cells), range(0, 10) t(k)) SELECT g.grid_id, g.k::INT AS class, count(c.label) AS n, round(count(c.label) / 4096.0, 6) AS share FROM g LEFT JOIN cells c ON g.grid_id = c.grid_id AND g.k = c.label GROUP BY 1, 2""")
def a11_class_shares(spark, sf):
    c = fx.cells(spark, sf).groupBy("grid_id", F.col("label").alias("class")).count()
    every = c.select("grid_id").distinct().select("grid_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("class"))
    n = F.coalesce("count", F.lit(0)).cast("long")
    return every.join(c, ["grid_id", "class"], "left").select("grid_id", "class", n.alias("n"), F.round(n / 4096.0, 6).alias("share"))


GRADIENT = fx.GRADIENT


@query(f"WITH {GRADIENT} SELECT grid_id, r, c, round(degrees(atan(sqrt(dr * dr + dc * dc))), 5) AS slope FROM grad")
def w6_slope(spark, sf):
    g = raster.gradient(fx.cells(spark, sf), 2.0)
    return g.select("grid_id", "r", "c", F.round(raster.slope_degrees(F.col("d_row"), F.col("d_col")), 5).alias("slope"))


@query(f"WITH {GRADIENT} SELECT grid_id, r, c, round({fx.SHADE}, 5) AS shade FROM grad WHERE dr IS NOT NULL AND dc IS NOT NULL")
def w7_relief(spark, sf):
    g = raster.gradient(fx.cells(spark, sf), 2.0).where("d_row IS NOT NULL AND d_col IS NOT NULL")
    return g.select("grid_id", "r", "c", F.round(raster.relief(F.col("d_row"), F.col("d_col")), 5).alias("shade"))


@query(f"WITH {fx.CELLS}, {fx.EVIDENCE} SELECT x.grid_id, x.r, x.c, min((x.r - e.r) * (x.r - e.r) + (x.c - e.c) * (x.c - e.c)) AS d2 FROM cells x JOIN evidence e ON x.grid_id = e.grid_id AND e.family = 'settlement' WHERE (x.r - e.r) * (x.r - e.r) + (x.c - e.c) * (x.c - e.c) <= 400 GROUP BY 1, 2, 3")
def j11_evidence_distance(spark, sf):
    e = fx.evidence(spark, sf).where("family = 'settlement'").withColumn("v", F.lit(1))
    return raster.nearest_evidence(fx.cells(spark, sf), e, 20, strip=16).select("grid_id", "r", "c", "d2")


# down the columns, then along the rows: a distance and the value there as one number, least first
@query(f"""WITH {fx.HOLED}, u AS (SELECT grid_id, r, c, z, max(CASE WHEN z IS NOT NULL THEN r END) OVER up AS a, arg_max(z, r) FILTER (z IS NOT NULL) OVER up AS za, min(CASE WHEN z IS NOT NULL THEN r END) OVER down AS b, arg_min(z, r) FILTER (z IS NOT NULL) OVER down AS zb
    FROM holed WINDOW up AS (PARTITION BY grid_id, c ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), down AS (PARTITION BY grid_id, c ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  col AS (SELECT grid_id, r, c, z, least(coalesce((r - a) * (r - a) * 1000 + za, 100000000), coalesce((b - r) * (b - r) * 1000 + zb, 100000000)) AS near FROM u),
  k AS (SELECT x.grid_id, x.r, x.c, min(y.near + (x.c - y.c) * (x.c - y.c) * 1000) AS best FROM col x JOIN col y ON x.grid_id = y.grid_id AND x.r = y.r WHERE x.z IS NULL AND y.near < 100000000 GROUP BY 1, 2, 3)
  SELECT grid_id, r, c, (best % 1000)::DOUBLE AS z, TRUE AS filled FROM k UNION ALL SELECT grid_id, r, c, z, FALSE FROM holed WHERE z IS NOT NULL""")
def j12_nearest_fill(spark, sf):
    """An uncovered cell takes the value of the nearest covered one, however far (ties: the lowest value)."""
    return raster.nearest_fill(fx.holed(spark, sf), strip=16)


@query(f"""WITH {fx.CELLS}, p AS (SELECT event_id, user_id % (SELECT greatest(1, count(DISTINCT grid_id)) FROM cells) AS grid_id, least(greatest(floor((event_id % 150 - 10) / 2.0), 0), 63)::INT AS r, least(greatest(floor((event_id % 139 - 5) / 2.0), 0), 63)::INT AS c FROM events)
  SELECT event_id, z, label FROM p JOIN cells USING (grid_id, r, c)""")
def j3_nearest_cell(spark, sf):
    cells = fx.cells(spark, sf)
    n = cells.agg(F.greatest(F.lit(1), F.count_distinct("grid_id")).alias("n"))
    at = lambda m, o: F.expr(f"int(least(greatest(floor((event_id % {m} - {o}) / 2.0D), 0), 63))")
    p = table(spark, sf, "events").crossJoin(F.broadcast(n)).select("event_id", F.expr("user_id % n").alias("grid_id"), at(150, 10).alias("r"), at(139, 5).alias("c"))
    return p.join(large(cells), ["grid_id", "r", "c"]).select("event_id", "z", "label")


@query(f"""WITH {fx.CELLS}, ring AS (SELECT grid_id, r // 4 AS r, c // 4 AS c, avg(z) AS m FROM cells GROUP BY 1, 2, 3) SELECT x.grid_id, round(median(ring.m - x.z), 6) AS "offset", count(*) AS n FROM ring JOIN cells x ON ring.grid_id = x.grid_id AND x.r = ring.r * 4 + 2 AND x.c = ring.c * 4 + 2 GROUP BY 1""")
def j6_ring_offset(spark, sf):
    c = fx.cells(spark, sf)
    ring = raster.block_mean(c, 4).select("grid_id", (F.col("r") * 4 + 2).alias("r"), (F.col("c") * 4 + 2).alias("c"), "mean")
    both = ring.join(large(c), ["grid_id", "r", "c"]).select("grid_id", (F.col("mean") - F.col("z")).alias("d"))
    mid = order.exact_percentiles(both, ["grid_id"], "d", {"mid": 0.5})
    return both.groupBy("grid_id").agg(F.count("*").alias("n")).join(mid, "grid_id", "left").select("grid_id", F.round("mid", 6).alias("offset"), "n")


@query(f"""WITH {fx.CELLS}, {fx.OBSERVERS}, o AS (SELECT obs_id, x.grid_id, r, c, z + 1.7 AS eye FROM observers b JOIN cells x ON x.grid_id = b.grid_id AND x.r = floor(row) AND x.c = floor(col) WHERE z IS NOT NULL),
  p AS (SELECT obs_id, o.grid_id, ray, step, eye, (r - round(step * cos(ray * (2 * pi() / 16)) + 1e-9))::INT AS r, (c + round(step * sin(ray * (2 * pi() / 16)) + 1e-9))::INT AS c FROM o, range(0, 16) a(ray), range(1, 41) b(step)),
  q AS (SELECT p.*, (z - (step * 2.0) * (step * 2.0) * 0.87 / (2 * 6371000.0) - eye) / (step * 2.0) AS angle FROM p JOIN cells x ON x.grid_id = p.grid_id AND x.r = p.r AND x.c = p.c WHERE z IS NOT NULL),
  b AS (SELECT *, max(angle) OVER (PARTITION BY obs_id, ray ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS near FROM q)
  SELECT obs_id, ray::INT AS ray, step::INT AS step, near IS NULL OR angle >= near AS visible FROM b""")
def i18_sight_lines(spark, sf):
    """Sixteen rays from each site."""
    c = fx.cells(spark, sf)
    o = fx.observers(spark, sf).select("obs_id", "grid_id", F.floor("row").cast("int").alias("r"), F.floor("col").cast("int").alias("c"))
    return raster.sight_lines(c, o.join(large(c.where("z IS NOT NULL")), ["grid_id", "r", "c"]).select("obs_id", "grid_id", "r", "c", (F.col("z") + 1.7).alias("eye")))


_CURVE = f"{(1 - 0.13) / (2 * raster.EARTH_RADIUS_M)!r}::DOUBLE"
_ROWS = "list_transform(range(64), lambda y : {})"
_WINDOW = "greatest(CASE WHEN s.d IN ('E', 'W') THEN ceil(s.oy - {0}) ELSE floor(s.oy - {0}) + 1 END - 2, 0)", "least(CASE WHEN s.d IN ('E', 'W') THEN floor(s.oy + {0}) ELSE ceil(s.oy + {0}) - 1 END + 2, 63)"
_AWAY = "CASE WHEN s.d IN ('E', 'S') THEN {0} - s.o ELSE s.o - (63 - ({0})) END"
_D2 = "((((y - s.oy) * (y - s.oy) + s.away * s.away) * 2.0::DOUBLE) * 2.0::DOUBLE)"
# a sweep's column: angles of the ground (a), the highest angles before it (lim), what is held for the next column (v) and what is seen
_COLUMN = f"""SELECT obs_id, d, x, o, oy, level, away, {_ROWS.format("CASE WHEN y < lo OR y > hi THEN -1e30::DOUBLE ELSE greatest(coalesce(a[y + 1], -1e30::DOUBLE), lim[y + 1]) END")} AS v,
    {_ROWS.format("(abs(y - oy) < away OR (d IN ('E', 'W') AND abs(y - oy) = away)) AND a[y + 1] IS NOT NULL AND a[y + 1] >= lim[y + 1]")} AS seen FROM (
    SELECT *, {_ROWS.format(f"(zs[y + 1] - {_CURVE} * {_D2} - s.level) / sqrt({_D2})")} AS a, {_WINDOW[0].format("s.away")} AS lo, {_WINDOW[1].format("s.away")} AS hi FROM ({{}}) AS s)"""
_AT = "(s.oy + (y - s.oy) * (s.pa / s.away))"
_BEFORE = [f"s.v[(greatest(s.plo, least(floor({_AT}) + {k}, s.phi)))::INT + 1]" for k in (0, 1)]
VIEWSHED = f"""WITH RECURSIVE {fx.CELLS}, {fx.OBSERVERS}, o AS (SELECT obs_id, grid_id, least(greatest(row::DOUBLE, 0), 63) AS row, least(greatest(col::DOUBLE, 0), 63) AS col, height::DOUBLE AS height FROM observers),
  q AS (SELECT o.*, row - floor(row) AS fr, col - floor(col) AS fc FROM o),
  g AS (SELECT q.*, ((z00.z * (1 - fc) + CASE WHEN fc <> 0 THEN z01.z ELSE 0 END * fc) * (1 - fr) + (CASE WHEN fr <> 0 THEN z10.z ELSE 0 END * (1 - fc) + CASE WHEN fr * fc <> 0 THEN z11.z ELSE 0 END * fc) * fr) + height AS level FROM q
    LEFT JOIN cells z00 ON z00.grid_id = q.grid_id AND z00.r = floor(row) AND z00.c = floor(col) LEFT JOIN cells z01 ON z01.grid_id = q.grid_id AND z01.r = floor(row) AND z01.c = floor(col) + 1
    LEFT JOIN cells z10 ON z10.grid_id = q.grid_id AND z10.r = floor(row) + 1 AND z10.c = floor(col) LEFT JOIN cells z11 ON z11.grid_id = q.grid_id AND z11.r = floor(row) + 1 AND z11.c = floor(col) + 1),
  line AS (SELECT grid_id, 'E' AS d, c AS x, list(z::DOUBLE ORDER BY r) AS zs FROM cells GROUP BY grid_id, c UNION ALL SELECT grid_id, 'W', 63 - c, list(z::DOUBLE ORDER BY r) FROM cells GROUP BY grid_id, c
    UNION ALL SELECT grid_id, 'S', r, list(z::DOUBLE ORDER BY c) FROM cells GROUP BY grid_id, r UNION ALL SELECT grid_id, 'N', 63 - r, list(z::DOUBLE ORDER BY c) FROM cells GROUP BY grid_id, r),
  eye AS (SELECT obs_id, grid_id, level, 'E' AS d, col AS o, row AS oy, floor(col) + 1 AS x FROM g UNION ALL SELECT obs_id, grid_id, level, 'W', col, row, 64 - ceil(col) FROM g
    UNION ALL SELECT obs_id, grid_id, level, 'S', row, col, floor(row) + 1 FROM g UNION ALL SELECT obs_id, grid_id, level, 'N', row, col, 64 - ceil(row) FROM g),
  s AS ({_COLUMN.format(f"SELECT s.*, zs, {_AWAY.format('s.x')} AS away, list_transform(range(64), lambda y : -1e30::DOUBLE) AS lim FROM (SELECT e.obs_id, e.d, l.x, e.o, e.oy, e.level, l.zs FROM eye e JOIN line l ON l.grid_id = e.grid_id AND l.d = e.d AND l.x = e.x WHERE level IS NOT NULL) AS s")}
    UNION ALL {_COLUMN.format(f"SELECT s.*, {_ROWS.format(f'{_BEFORE[0]} + ({_BEFORE[1]} - {_BEFORE[0]}) * ({_AT} - floor({_AT}))')} AS lim FROM (SELECT s.obs_id, s.d, l.x, s.o, s.oy, s.level, s.v, l.zs, s.away AS pa, {_AWAY.format('s.x + 1')} AS away, {_WINDOW[0].format('s.away')} AS plo, {_WINDOW[1].format('s.away')} AS phi FROM s JOIN eye e ON e.obs_id = s.obs_id AND e.d = s.d JOIN line l ON l.grid_id = e.grid_id AND l.d = s.d AND l.x = s.x + 1) AS s")}),
  u AS (SELECT obs_id, d, x, unnest(range(64)) AS y, unnest(seen) AS seen FROM s),
  found AS (SELECT obs_id, CASE d WHEN 'S' THEN x WHEN 'N' THEN 63 - x ELSE y END AS r, CASE d WHEN 'E' THEN x WHEN 'W' THEN 63 - x ELSE y END AS c FROM u WHERE seen
    UNION SELECT obs_id, least(floor(row + 0.5), 63), least(floor(col + 0.5), 63) FROM o)
  SELECT obs_id, grid_id, r::INT AS r, c::INT AS c FROM found JOIN o USING (obs_id)"""


@query(VIEWSHED)
def i18_viewshed(spark, sf):
    """All cells of the whole grid that each site sees, by the sweeps over tiles of 16 cells a side."""
    return sight.viewshed(fx.cells(spark, sf), fx.observers(spark, sf), 2.0, tile=16)


_APART = "(x.r - e.r) * (x.r - e.r) + (x.c - e.c) * (x.c - e.c)"
LANDCOVER = f"""{GRADIENT}, {fx.EVIDENCE}, s AS (SELECT grid_id, r, c, z, degrees(atan(sqrt(dr * dr + dc * dc))) AS slope, (z + label) % 9 AS g, z % 7 = 0 AS peat FROM grad),
  near AS (SELECT x.grid_id, x.r, x.c, min({_APART}) FILTER (family = 'monument') AS dm, min({_APART}) FILTER (family = 'road') AS dr2, min({_APART}) FILTER (family = 'cultivation') AS dc2, min({_APART}) FILTER (family = 'settlement') AS ds
    FROM cells x JOIN evidence e ON x.grid_id = e.grid_id WHERE {_APART} <= 100 GROUP BY 1, 2, 3),
  fine AS (SELECT x.grid_id, x.r, x.c, min({_APART}) AS df FROM s x JOIN s e ON x.grid_id = e.grid_id AND e.g = 2 AND abs(x.r - e.r) <= 1 AND abs(x.c - e.c) <= 1 GROUP BY 1, 2, 3),
  landcover AS (SELECT s.grid_id, s.r, s.c, CASE WHEN g = 0 THEN 0 WHEN g = 1 OR peat THEN 1 WHEN dm <= 1 THEN 2 WHEN dr2 <= 0 THEN 3 WHEN dc2 <= 1 AND slope <= 60 THEN 4
    WHEN (g = 2 OR (g = 5 AND df <= 1)) AND z > 9 + 2 - 0.0005 AND slope <= 60 AND ds <= 16 THEN 4 WHEN g IN (2, 3) THEN 5 WHEN g = 4 THEN 3 WHEN g = 5 AND slope <= 70 AND ds <= 4 THEN 6 WHEN g = 5 AND slope <= 70 THEN 7 ELSE 8 END AS class
  FROM s LEFT JOIN near n ON s.grid_id = n.grid_id AND s.r = n.r AND s.c = n.c LEFT JOIN fine f ON s.grid_id = f.grid_id AND s.r = f.r AND s.c = f.c)"""

#: Distances in metres, slopes in degrees, heights in metres: what the rules compare with.
RULES = {"monument_m": 2.0, "road_m": 0.0, "cultivation_m": 2.0, "farmland_m": 8.0, "pasture_m": 4.0, "margin_m": 2.0, "fresh_m": 2.0, "level_m": 9.0, "plough_deg": 60.0, "wood_deg": 70.0}


def land_cover(ground, evidence, res: float, rules: dict = RULES):
    """(grid_id, r, c, class): eleven rules, the first that holds wins; columns of ``ground``: connect, slope, g (soil group), peat.

    0 water, 1 fen, 2 cleared, 3 road or gravel, 4 farmland (mapped, then by nearness), 5
    meadow, 6 pasture, 7 broadleaf, 8 conifer. ``evidence`` has a family for each cell:
    monument, road, cultivation, settlement. Soil groups: 0 water, 1 peat, 2 fine, 3 clay,
    4 gravel, 5 till. All five distances come from one pass over the grid."""
    p = rules
    fine = ground.where("g = 2").select("grid_id", "r", "c", F.lit("fine").alias("kind"))
    marks = evidence.select("grid_id", "r", "c", F.col("family").alias("kind")).unionByName(fine)
    d = raster.distance_by_kind(ground, marks, ["monument", "road", "cultivation", "settlement", "fine"])
    d = d.select("grid_id", "r", "c", *[(F.sqrt(k) * res).alias(f"d_{k}") for k in d.columns[3:]])
    s = ground.join(large(d), ["grid_id", "r", "c"], "left")
    near = lambda name, key: F.col(name) <= p[key]
    g, slope = F.col("g"), F.col("slope")
    old = F.col("connect") > p["level_m"] + p["fresh_m"] - 0.0005
    arable = (g == 2) | ((g == 5) & near("d_fine", "margin_m"))
    cascade = (
        F.when(g == 0, 0).when((g == 1) | F.col("peat"), 1).when(near("d_monument", "monument_m"), 2).when(near("d_road", "road_m"), 3)
        .when(near("d_cultivation", "cultivation_m") & (slope <= p["plough_deg"]), 4)
        .when(arable & old & (slope <= p["plough_deg"]) & near("d_settlement", "farmland_m"), 4)
        .when(g.isin(2, 3), 5).when(g == 4, 3).when((g == 5) & (slope <= p["wood_deg"]) & near("d_settlement", "pasture_m"), 6).when((g == 5) & (slope <= p["wood_deg"]), 7).otherwise(8)
    )
    return s.select("grid_id", "r", "c", cascade.alias("class"))


def fixture_ground(spark, sf):
    """Connect, slope, soil group and peat of the test grids."""
    c = fx.cells(spark, sf)
    g = raster.gradient(c, 2.0).select("grid_id", "r", "c", raster.slope_degrees(F.col("d_row"), F.col("d_col")).alias("slope"))
    return c.join(large(g), ["grid_id", "r", "c"]).select("grid_id", "r", "c", F.col("z").cast("double").alias("connect"), "slope", F.expr("(z + label) % 9").alias("g"), F.expr("z % 7 = 0").alias("peat"))


@query(f"WITH {LANDCOVER} SELECT * FROM landcover")
def i12_land_cover(spark, sf):
    return land_cover(fixture_ground(spark, sf), fx.evidence(spark, sf), 2.0)


@query(f"WITH {fx.CELLS} SELECT grid_id, r, c, z, count(*) OVER (PARTITION BY grid_id, label ORDER BY z RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING) AS band FROM cells WHERE z IS NOT NULL")
def w8_band_occupancy(spark, sf):
    w = Window.partitionBy("grid_id", "label").orderBy("z").rangeBetween(0, 2)
    return fx.cells(spark, sf).where("z IS NOT NULL").select("grid_id", "r", "c", "z", F.count("*").over(w).alias("band"))


@query(f"""WITH {fx.CELLS} SELECT grid_id, r, c, round(avg(z) OVER (PARTITION BY grid_id, r ORDER BY c ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smooth, median(z) OVER (PARTITION BY grid_id, r ORDER BY c ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS med FROM cells""")
def w4_moving_windows(spark, sf):
    w = Window.partitionBy("grid_id", "r").orderBy("c")
    return fx.cells(spark, sf).select("grid_id", "r", "c", F.round(F.avg("z").over(w.rowsBetween(-3, 3)), 6).alias("smooth"), F.expr("percentile(z, 0.5) OVER (PARTITION BY grid_id, r ORDER BY c ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)").alias("med"))


@query(f"""WITH {fx.CELLS}, w AS (SELECT grid_id, r, z, c + 64 * k AS cc FROM cells, range(-1, 2) t(k)), a AS (SELECT grid_id, r, cc, round(avg(z) OVER (PARTITION BY grid_id, r ORDER BY cc ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS smooth FROM w WHERE cc BETWEEN -4 AND 67) SELECT grid_id, r, cc::INT AS c, smooth FROM a WHERE cc BETWEEN 0 AND 63""")
def w2_circular_average(spark, sf):
    x = fx.cells(spark, sf)
    wrap = x.select("grid_id", "r", "z", F.explode(F.array(F.col("c") - 64, F.col("c"), F.col("c") + 64)).alias("c")).where("c BETWEEN -4 AND 67")
    w = Window.partitionBy("grid_id", "r").orderBy("c").rowsBetween(-4, 4)
    return wrap.withColumn("smooth", F.round(F.avg("z").over(w), 6)).where("c BETWEEN 0 AND 63").select("grid_id", "r", "c", "smooth")


