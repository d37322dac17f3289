"""Queries over vertex tables (G)."""

from pyspark.sql import functions as F

from tarnscape.functions import scalars as fn
from tarnscape.operators import vectors
from tarnscape.operators.joins import containing
from tarnscape.plans.base import query
from tarnscape.session import table
from tarnscape.sources import fixtures as fx


def outlines(spark, sf):
    """Vertices as rings of one part."""
    return fx.vertices(spark, sf).withColumn("ring", F.lit(0)).withColumn("hole", F.lit(False))


SEGMENTS = fx.RINGS + """, seg AS (SELECT *, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS len FROM (SELECT *, coalesce(lead(x) OVER w, CASE WHEN closed THEN first(x) OVER (PARTITION BY feature_id, ring ORDER BY seq) END) AS x2,
  coalesce(lead(y) OVER w, CASE WHEN closed THEN first(y) OVER (PARTITION BY feature_id, ring ORDER BY seq) END) AS y2 FROM rings WINDOW w AS (PARTITION BY feature_id, ring ORDER BY seq)) WHERE x2 IS NOT NULL)"""

OUTLINE = fx.VERTICES + """, seg AS (SELECT *, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS len FROM (SELECT *, coalesce(lead(x) OVER w, CASE WHEN closed THEN first(x) OVER (PARTITION BY feature_id ORDER BY seq) END) AS x2,
  coalesce(lead(y) OVER w, CASE WHEN closed THEN first(y) OVER (PARTITION BY feature_id ORDER BY seq) END) AS y2 FROM vertices WINDOW w AS (PARTITION BY feature_id ORDER BY seq)) WHERE x2 IS NOT NULL),
  wk AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY feature_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done, sum(len) OVER (PARTITION BY feature_id) AS total FROM seg WHERE len > 0)"""

CENTROID = SEGMENTS + """, rc AS (SELECT feature_id, ring, bool_or(hole) AS hole, count(*) AS n, sum(x * y2 - x2 * y) AS a2, sum((x + x2) * (x * y2 - x2 * y)) AS cx, sum((y + y2) * (x * y2 - x2 * y)) AS cy FROM seg WHERE closed GROUP BY 1, 2),
  fc AS (SELECT feature_id, sum(a2 * sign(a2) * sg / 2.0) AS area, sum(cx * sign(a2) * sg / 6.0) AS mx, sum(cy * sign(a2) * sg / 6.0) AS my FROM (SELECT *, CASE WHEN hole THEN -1 ELSE 1 END AS sg FROM rc WHERE n >= 4) GROUP BY 1),
  cent AS (SELECT feature_id, mx / area AS x, my / area AS y, area FROM fc WHERE abs(area) >= 1e-9)"""

MIDPOINT = """wl AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY feature_id ORDER BY ring, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done, sum(len) OVER (PARTITION BY feature_id) AS total FROM seg WHERE NOT closed AND len > 0),
  mid AS (SELECT feature_id, x + (x2 - x) * (total / 2 - done) / len AS x, y + (y2 - y) * (total / 2 - done) / len AS y FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY ring, seq) AS i FROM wl WHERE done + len >= total / 2) WHERE i = 1)"""


@query(f"WITH {fx.VERTICES} SELECT feature_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, greatest(max(x) - min(x), max(y) - min(y)) AS span FROM vertices GROUP BY 1")
def g1_envelope(spark, sf):
    g = fx.vertices(spark, sf).groupBy("feature_id").agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
    return g.withColumn("span", F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")))


@query(f"WITH {CENTROID} SELECT feature_id, round(x, 4) AS x, round(y, 4) AS y, area FROM cent")
def g2_centroid(spark, sf):
    """Area-weighted centroid of polygons with holes."""
    return vectors.centroids(fx.rings(spark, sf)).select("feature_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "area")


@query(f"WITH {SEGMENTS}, {MIDPOINT} SELECT feature_id, round(x, 4) AS x, round(y, 4) AS y FROM mid")
def g3_midpoint(spark, sf):
    """Midpoint of lines by length, parts in order."""
    return vectors.midpoints(fx.rings(spark, sf)).select("feature_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"""WITH {CENTROID}, {MIDPOINT}, mean AS (SELECT feature_id, bool_or(closed) AS polygon, avg(x) AS x, avg(y) AS y FROM rings GROUP BY 1)
  SELECT m.feature_id, CASE WHEN polygon AND c.x IS NOT NULL THEN 'centroid' WHEN NOT polygon AND d.x IS NOT NULL THEN 'midpoint' ELSE 'mean' END AS rule,
    round(coalesce(CASE WHEN polygon THEN c.x ELSE d.x END, m.x), 4) AS x, round(coalesce(CASE WHEN polygon THEN c.y ELSE d.y END, m.y), 4) AS y
  FROM mean m LEFT JOIN cent c ON c.feature_id = m.feature_id LEFT JOIN mid d ON d.feature_id = m.feature_id""")
def g4_representative_point(spark, sf):
    return vectors.representative_points(fx.rings(spark, sf)).select("feature_id", "rule", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"WITH {fx.VERTICES} SELECT feature_id, round_even(avg(x + 0.0), 2) AS x, round_even(avg(y + 0.0), 2) AS y FROM (SELECT feature_id, x, y FROM vertices UNION ALL SELECT feature_id, x, y FROM vertices WHERE closed AND seq = 1) GROUP BY 1")
def g5_anchor(spark, sf):
    """Mean of the ring's vertices with its first counted twice, as a closed ring repeats it."""
    v = fx.vertices(spark, sf)
    both = v.union(v.where("closed AND seq = 1"))
    return both.groupBy("feature_id").agg(F.bround(F.avg("x"), 2).alias("x"), F.bround(F.avg("y"), 2).alias("y"))


@query(f"""WITH {fx.VERTICES}, m AS (SELECT feature_id % 100 AS grp, feature_id AS member, CASE WHEN feature_id % 7 = 0 THEN 'multi' ELSE '' END || CASE WHEN closed THEN 'polygon' ELSE 'line' END AS kind FROM vertices WHERE seq = 1),
  k AS (SELECT *, count(*) OVER (PARTITION BY grp, kind) AS n, min(member) OVER (PARTITION BY grp, kind) AS low FROM m)
  SELECT grp, member, CASE WHEN NOT starts_with(kind, 'multi') AND n > 1 THEN 'multi' || kind ELSE kind END AS kind FROM k WHERE NOT starts_with(kind, 'multi') OR member = low""")
def g6_merge(spark, sf):
    """Outlines of one group put together by kind."""
    kind = F.concat(F.when(F.col("feature_id") % 7 == 0, "multi").otherwise(""), F.when(F.col("closed"), "polygon").otherwise("line"))
    v = fx.vertices(spark, sf).where("seq = 1")
    return vectors.merged_kinds(v.select((F.col("feature_id") % 100).alias("grp"), F.col("feature_id").alias("member"), kind.alias("kind")))


@query(f"WITH {SEGMENTS} SELECT feature_id, ring, round(sum(len), 4) AS length FROM seg GROUP BY 1, 2")
def g7_length(spark, sf):
    return vectors.segments(fx.rings(spark, sf)).groupBy("feature_id", "ring").agg(F.round(F.sum("len"), 4).alias("length"))


@query(f"""WITH {OUTLINE}, d AS (SELECT *, greatest(1, ceil(len / 100.0))::BIGINT AS n FROM seg)
  SELECT feature_id, seq, k, round(x + (x2 - x) * k / n::DOUBLE, 6) AS px, round(y + (y2 - y) * k / n::DOUBLE, 6) AS py FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM d)""")
def g8_densify(spark, sf):
    """Points at most 100 apart on each segment, both ends included, so shared vertices come twice."""
    return vectors.densified(outlines(spark, sf), 100.0).select("feature_id", "seq", "k", F.round("x", 6).alias("px"), F.round("y", 6).alias("py"))


@query(f"""WITH {OUTLINE}, g AS (SELECT *, max(seq) OVER (PARTITION BY feature_id) AS top FROM seg WHERE greatest(x, x2) >= 100 AND least(x, x2) <= 500 AND greatest(y, y2) >= 200 AND least(y, y2) <= 600), d AS (SELECT *, greatest(1, ceil(len / 100.0))::BIGINT AS n FROM g)
  SELECT feature_id, seq, k, round(x + (x2 - x) * k / n::DOUBLE, 6) AS px, round(y + (y2 - y) * k / n::DOUBLE, 6) AS py FROM (SELECT *, unnest(range(0, n + CASE WHEN NOT closed AND seq = top THEN 1 ELSE 0 END)) AS k FROM d)""")
def g8_drape(spark, sf):
    """Points along the segments that reach a window, shared vertices once."""
    p = vectors.densified(outlines(spark, sf), 100.0, False, (100, 200, 500, 600))
    return p.select("feature_id", "seq", "k", F.round("x", 6).alias("px"), F.round("y", 6).alias("py"))


@query(f"""WITH {OUTLINE}, n AS (SELECT feature_id, total, unnest(range(0, greatest(3, round_even(total / 200, 0))::BIGINT)) AS i, greatest(3, round_even(total / 200, 0)) AS m FROM (SELECT feature_id, max(total) AS total FROM wk WHERE closed GROUP BY 1))
  SELECT n.feature_id, i, round(x + (x2 - x) * (i * (n.total / m) - done) / len, 3) AS px, round(y + (y2 - y) * (i * (n.total / m) - done) / len, 3) AS py
  FROM n JOIN wk k ON n.feature_id = k.feature_id AND i * (n.total / m) >= done AND i * (n.total / m) < done + len""")
def g9_resample(spark, sf):
    """Points at even arc lengths on closed rings, about 200 apart and at least three."""
    return vectors.resampled(outlines(spark, sf), 200.0).select("feature_id", "i", F.round("x", 3).alias("px"), F.round("y", 3).alias("py"))


@query(f"""WITH {OUTLINE}, t AS (SELECT feature_id, any_value(closed) AS closed, max(total) AS total FROM wk GROUP BY 1), b AS (SELECT *, greatest(2, floor(total / 90 + 0.5)) AS m FROM t),
  n AS (SELECT feature_id, closed, CASE WHEN closed THEN total / m ELSE 90.0::DOUBLE END AS step, unnest(range(0, CASE WHEN closed THEN m ELSE floor(total / 90.0) + 1 END::BIGINT)) AS i FROM b)
  SELECT n.feature_id, i, round(x + (x2 - x) * (i * step - done) / len, 3) AS px, round(y + (y2 - y) * (i * step - done) / len, 3) AS py, round(atan2(y2 - y, x2 - x), 6) AS heading
  FROM n JOIN wk k ON n.feature_id = k.feature_id AND i * step >= done AND i * step < done + len""")
def g10_posts(spark, sf):
    """Posts about 90 apart with their headings."""
    return vectors.posts(outlines(spark, sf), 90.0).select("feature_id", "i", F.round("x", 3).alias("px"), F.round("y", 3).alias("py"), F.round("heading", 6).alias("heading"))


@query("""WITH a0 AS (SELECT o_orderkey, k, ((1 + (3 * o_orderkey + k + 1)::HUGEINT * 1831565813) % 4294967296) AS a FROM orders, range(0, 3) q(k)),
  t1 AS (SELECT *, (xor(a::BIGINT, (a::BIGINT >> 15))::HUGEINT * (a::BIGINT | 1)::HUGEINT) % 4294967296 AS t FROM a0),
  t2 AS (SELECT *, (t + (xor(t::BIGINT, t::BIGINT >> 7)::HUGEINT * (t::BIGINT | 61)::HUGEINT) % 4294967296) % 4294967296 AS u FROM t1),
  d AS (SELECT o_orderkey, k, xor(xor(t::BIGINT, u::BIGINT), xor(t::BIGINT, u::BIGINT) >> 14) / 4294967296.0::DOUBLE AS w FROM t2)
  SELECT o_orderkey, round(1 + (max(w) FILTER (k = 0) * 2 - 1) * 0.1, 9) AS height, round((max(w) FILTER (k = 1) * 2 - 1) * 3 * pi() / 180, 9) AS lean_x, round((max(w) FILTER (k = 2) * 2 - 1) * 3 * pi() / 180, 9) AS lean_z FROM d GROUP BY 1""")
def g10_post_jitter(spark, sf):
    """Height and lean of the n-th post: draws 3n, 3n + 1 and 3n + 2 of one stream."""
    o = table(spark, sf, "orders").select("o_orderkey", fn.draws(F.lit(1).cast("long"), 3 * F.col("o_orderkey"), 3).alias("w"))
    side = lambda k: F.col("w")[k] * 2 - 1
    lean = 3 * 3.141592653589793 / 180
    return o.select("o_orderkey", F.round(1 + side(0) * 0.1, 9).alias("height"), F.round(side(1) * lean, 9).alias("lean_x"), F.round(side(2) * lean, 9).alias("lean_z"))


INSIDE = """cell AS (SELECT p.i::INT AS c, q.i::INT AS r, (p.i + 0.5) * 50 AS px, (q.i + 0.5) * 50 AS py FROM range(0, 20) p(i), range(0, 20) q(i)),
  inside AS (SELECT feature_id, r, c FROM seg, cell WHERE closed AND ((y <= py AND py < y2) OR (y2 <= py AND py < y)) AND px < x + (py - y) * (x2 - x) / (y2 - y)::DOUBLE GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)"""


@query(f"WITH {SEGMENTS}, {INSIDE} SELECT * FROM inside")
def g11_cells_in_polygon(spark, sf):
    """Cells of a 50-unit lattice whose centres lie in a polygon, its holes left out: even-odd, half-open in y."""
    return vectors.cells_in_rings(fx.rings(spark, sf), 50.0)


@query(f"""WITH {SEGMENTS}, {INSIDE}, rc AS (SELECT feature_id, ring, bool_or(hole) AS hole, count(*) AS n, abs(sum(x * y2 - x2 * y)) AS a2 FROM seg WHERE closed GROUP BY 1, 2),
  ar AS (SELECT feature_id, sum(CASE WHEN hole THEN -a2 ELSE a2 END / 2.0) AS area FROM rc WHERE n >= 3 GROUP BY 1),
  d AS (SELECT *, greatest(1, ceil(len / 25.0))::BIGINT AS n FROM seg WHERE NOT closed),
  ln AS (SELECT DISTINCT feature_id, floor((y + (y2 - y) * k / n::DOUBLE) / 50.0)::INT AS r, floor((x + (x2 - x) * k / n::DOUBLE) / 50.0)::INT AS c FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM d)
    UNION SELECT feature_id, floor(y / 50.0)::INT, floor(x / 50.0)::INT FROM rings WHERE NOT closed),
  al AS (SELECT feature_id, r, c FROM inside UNION ALL SELECT * FROM ln), j AS (SELECT al.*, CASE WHEN area IS NULL OR abs(area) < 1e-9 THEN 0 ELSE area END AS area FROM al LEFT JOIN ar USING (feature_id))
  SELECT r, c, feature_id, feature_id % 9 AS value FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY area, feature_id DESC) AS i FROM j) WHERE i = 1""")
def g12_polygon_burn(spark, sf):
    """Every outline burned into a 50-unit lattice: the smallest area wins a cell."""
    v = fx.rings(spark, sf)
    return vectors.burned(v, v.select("feature_id", (F.col("feature_id") % 9).alias("value")).distinct(), 50.0)


@query(f"""WITH {OUTLINE}, n AS (SELECT feature_id, total, unnest(range(0, greatest(3, round_even(total / 200, 0))::BIGINT)) AS i, greatest(3, round_even(total / 200, 0)) AS m FROM (SELECT feature_id, max(total) AS total FROM wk WHERE closed GROUP BY 1)),
  p AS (SELECT n.feature_id, i, m, x + (x2 - x) * (i * (n.total / m) - done) / len AS x, y + (y2 - y) * (i * (n.total / m) - done) / len AS y FROM n JOIN wk k ON n.feature_id = k.feature_id AND i * (n.total / m) >= done AND i * (n.total / m) < done + len),
  q AS (SELECT a.feature_id, a.i, a.x, a.y, b.x AS xn, b.y AS yn, c.x AS xp, c.y AS yp FROM p a JOIN p b ON a.feature_id = b.feature_id AND b.i = (a.i + 1) % a.m JOIN p c ON a.feature_id = c.feature_id AND c.i = (a.i + a.m - 1) % a.m),
  s AS (SELECT *, sum(x * yn - xn * y) OVER (PARTITION BY feature_id) AS area, sqrt((xn - xp) * (xn - xp) + (yn - yp) * (yn - yp)) AS size FROM q)
  SELECT feature_id, i, round(-sign(area) * (yn - yp) / size, 5) AS nx, round(sign(area) * (xn - xp) / size, 5) AS ny FROM s WHERE abs(area) > 1e-3 AND size > 1e-6""")
def g13_inward_normals(spark, sf):
    n = vectors.inward_normals(vectors.resampled(outlines(spark, sf), 200.0))
    return n.where("nx IS NOT NULL").select("feature_id", "i", F.round("nx", 5).alias("nx"), F.round("ny", 5).alias("ny"))


@query(f"""WITH {fx.VERTICES}, e AS (SELECT feature_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM vertices GROUP BY 1)
  SELECT a.feature_id AS inner_id, b.feature_id AS outer_id, a.x0 > b.x0 AND a.x1 < b.x1 AND a.y0 > b.y0 AND a.y1 < b.y1 AS strict FROM e a JOIN e b ON a.x0 >= b.x0 AND a.x1 <= b.x1 AND a.y0 >= b.y0 AND a.y1 <= b.y1 AND a.feature_id <> b.feature_id
  WHERE a.x1 - a.x0 < 400 AND a.y1 - a.y0 < 400""")
def g14_containment(spark, sf):
    """Small outlines, and all outlines that contain them; strictly, or with a shared border."""
    e = fx.vertices(spark, sf).groupBy("feature_id").agg(F.min("x").alias("min_e"), F.max("x").alias("max_e"), F.min("y").alias("min_n"), F.max("y").alias("max_n"))
    j = containing(e.where("max_e - min_e < 400 AND max_n - min_n < 400"), e, "feature_id")
    return j.select(F.col("inner_feature_id").alias("inner_id"), F.col("outer_feature_id").alias("outer_id"), "strict")


@query(f"WITH {fx.SITES}, {fx.FEATURES} SELECT id, s_suppkey, least(greatest(min_e, e - half + 2), e + half - 2) AS ce, least(greatest(min_n, n - half + 2), n + half - 2) AS cn FROM features JOIN sites ON s_suppkey = id % (SELECT max(s_suppkey) FROM sites) + 1")
def g14_clamp(spark, sf):
    """A place of a feature moved inside its site's window, with a margin."""
    s = fx.sites(spark, sf)
    top = s.agg(F.max("s_suppkey").alias("top"))
    f = fx.features(spark, sf).crossJoin(F.broadcast(top)).withColumn("s_suppkey", F.expr("id % top + 1")).join(s.select("s_suppkey", "e", "n", "half"), "s_suppkey")  # one row
    at = lambda x, m: vectors.clamped(F.col(x), F.col(m) - F.col("half"), F.col(m) + F.col("half"), 2)
    return f.select("id", "s_suppkey", at("min_e", "e").alias("ce"), at("min_n", "n").alias("cn"))


@query(f"""WITH {fx.VERTICES} SELECT c_custkey AS feature_id, n FROM customer LEFT JOIN (SELECT feature_id, count(DISTINCT (x, y)) AS n FROM vertices WHERE closed GROUP BY 1 HAVING count(DISTINCT (x, y)) >= 3) v ON c_custkey = feature_id""")
def g15_extent_ring(spark, sf):
    """Each place with the number of distinct points of its ring; null where there is no usable ring."""
    v = fx.vertices(spark, sf).where("closed").groupBy("feature_id").agg(F.count_distinct(F.struct("x", "y")).alias("n")).where("n >= 3")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("feature_id")).join(v, "feature_id", "left")


@query(f"""WITH {OUTLINE}, n AS (SELECT feature_id, total, unnest(range(0, greatest(3, round_even(total / 200, 0))::BIGINT)) AS i, greatest(3, round_even(total / 200, 0))::BIGINT AS m FROM (SELECT feature_id, max(total) AS total FROM wk WHERE closed GROUP BY 1)),
  p AS (SELECT n.feature_id, i, m, x + (x2 - x) * (i * (n.total / m) - done) / len AS x FROM n JOIN wk k ON n.feature_id = k.feature_id AND i * (n.total / m) >= done AND i * (n.total / m) < done + len),
  w AS (SELECT feature_id, x, m, i + m * k AS j FROM p, range(-1, 2) q(k) WHERE i + m * k BETWEEN -2 AND m + 1)
  SELECT feature_id, j AS i, round(med, 3) AS med FROM (SELECT feature_id, j, m, median(x) OVER (PARTITION BY feature_id ORDER BY j ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS med FROM w) WHERE j BETWEEN 0 AND m - 1""")
def w3_circular_median(spark, sf):
    """Median over five points around each ring of resampled points."""
    p = vectors.circular(vectors.resampled(outlines(spark, sf), 200.0), 2, "x", "med", "median")
    return p.select("feature_id", "i", F.round("med", 3).alias("med"))
