"""Queries over layers, catalogues, documents and their rules (S, F, J, A, Q, M)."""

from pyspark.sql import functions as F

from tarnscape.functions import scalars as fn
from tarnscape.operators import documents as doc
from tarnscape.operators import order, raster, vectors
from tarnscape.plans.base import query
from tarnscape.plans.geometry import OUTLINE
from tarnscape.session import new_path, table
from tarnscape.sources import fixtures as fx
from tarnscape.sources import document_set, tiles, wkb, world

# ---- scans -----------------------------------------------------------------------------------


@query("""SELECT 'polygon_customer' AS layer, 1 AS layer_rank, c_custkey::VARCHAR AS id, c_mktsegment AS type, c_name, NULL AS p_name FROM customer
  UNION ALL SELECT 'part_table', 4, p_partkey::VARCHAR, p_type, NULL, p_name FROM part""")
def s3_layer_qualification(spark, sf):
    """Layers that have a type and an id; suppliers have no type and are left out."""
    layers = {"polygon_customer": table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_name"), "point_supplier": table(spark, sf, "supplier").select("s_suppkey", "s_name"), "part_table": table(spark, sf, "part").select("p_partkey", "p_type", "p_name")}
    return doc.qualified_layers(layers, ("C_MKTSEGMENT", "p_type"), ("C_CUSTKEY", "s_suppkey", "p_partkey"))


@query(f"""WITH {fx.RINGS} SELECT feature_id, CASE WHEN bool_or(closed) THEN 'polygon' ELSE 'line' END AS kind, count(DISTINCT ring) AS rings, count(*) AS points, sum(x)::DOUBLE AS sx, sum(y)::DOUBLE AS sy, count(*) FILTER (hole) > 0 AS hole FROM rings WHERE feature_id % 9 <> 0 GROUP BY 1
  UNION ALL SELECT DISTINCT feature_id, NULL, 0, 0, NULL::DOUBLE, NULL::DOUBLE, NULL FROM rings WHERE feature_id % 9 = 0""")
def s5_geometry_decode(spark, sf):
    """Outlines as blobs and back, every ninth cut short: those have an error and no geometry."""
    blobs = wkb.encoded_outlines(fx.rings(spark, sf))
    blobs = blobs.withColumn("geom", F.when(F.col("feature_id") % 9 == 0, F.substring("geom", 1, 20)).otherwise(F.col("geom")))
    d = wkb.decode_geometry(blobs)
    v = wkb.vertex_rows(d, "feature_id").groupBy("feature_id").agg(F.count_distinct("ring").alias("rings"), F.count("*").alias("points"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.bool_or("hole").alias("hole"))
    j = d.select("feature_id", "kind").join(v, "feature_id", "left")
    return j.select("feature_id", "kind", F.coalesce("rings", F.lit(0)).alias("rings"), F.coalesce("points", F.lit(0)).alias("points"), "sx", "sy", "hole")


@query(f"WITH {fx.HOLED} SELECT grid_id, r, c, round(round_even(z / 0.5, 0) * 0.5, 6) AS z FROM holed WHERE z IS NOT NULL AND r BETWEEN 10 AND 40 AND c BETWEEN 5 AND 50")
def s8_raster_round_trip(spark, sf):
    """Grids written as tiles of quantized heights; a window of them read back."""
    path = new_path(spark, "tiles")
    tiles.write_tiles(fx.holed(spark, sf), path, 0.5, 16)
    return tiles.read_tiles(spark, path, (10, 40, 5, 50), 16).withColumn("z", F.round("z", 6))


@query(f"""WITH {fx.HOLED}, w AS (SELECT grid_id, r, c, 1000 * grid_id + (c + 0.5) * 2.0 AS e, 5000 - (r + 0.5) * 2.0 AS n, z::DOUBLE AS z FROM holed WHERE z IS NOT NULL)
  SELECT layout, grid_id, r, c, e::DOUBLE AS e, n::DOUBLE AS n, z FROM w, (VALUES ('tiles'), ('strips')) t(layout) WHERE e BETWEEN 1020 AND 3070.5 AND n BETWEEN 4900 AND 4980""")
def s8_world_window(spark, sf):
    """Grids written in tiles and in strips with their places, and a window in metres read from both."""
    h = fx.holed(spark, sf)
    places = h.select("grid_id").distinct().selectExpr("grid_id", "grid_id * 1000D AS e0", "5000D AS n0", "2D AS res", "'EPSG:3006' AS crs")
    out = None
    for layout in world.LAYOUTS:
        path = new_path(spark, layout)
        world.write_raster(h, places, path, 0.5, layout, 16)
        part = world.read_raster(spark, path, (1020.0, 3070.5, 4900.0, 4980.0)).select(F.lit(layout).alias("layout"), "*")
        out = part if out is None else out.unionByName(part)
    return out


_KINDS = ", ".join(f"('{k}')" for k in sorted(doc.DOCUMENTS))


@query(f"""WITH {fx.SITES}, k(kind) AS (VALUES {_KINDS}) SELECT 'site-' || s_suppkey AS site, kind, CASE WHEN s_suppkey % 5 <> 0 THEN 1 + s_suppkey % 3 END AS items,
    CASE WHEN s_suppkey % 5 <> 0 THEN CASE kind WHEN 'registry' THEN e WHEN 'sites' THEN n WHEN 'shoreline' THEN half / 4 WHEN 'rampart' THEN half WHEN 'legend' THEN half / 100 WHEN 'manifest' THEN e - half WHEN 'index' THEN n WHEN 'report' THEN s_suppkey * 1000 END END::DOUBLE AS number
  FROM sites, k""")
def s10_documents(spark, sf):
    """All eight kinds of documents, by their whole contract, written as a set of files and read back; every fifth site's are of another version."""
    s = fx.sites(spark, sf).withColumn("site", F.concat(F.lit("site-"), F.col("s_suppkey").cast("string")))
    i = F.sequence(F.lit(0).cast("long"), F.col("s_suppkey") % 3)
    text = lambda x: F.concat(F.lit("x"), x.cast("string"))
    named = lambda **fields: F.struct(*[(v if hasattr(v, "alias") else F.lit(v)).alias(k) for k, v in fields.items()])
    d = lambda c: F.col(c).cast("double")
    box = named(minE=d("e") - d("half"), minN=d("n") - d("half"), maxE=d("e") + d("half"), maxN=d("n") + d("half"))
    grid = named(path="dem_core.tif", resolution=1.0, width=(F.col("half") * 2).cast("int"), height=(F.col("half") * 2).cast("int"), bounds3006=box, encoding=named(dtype="int16", scale=0.1, unit="m"))
    source = named(id="kmr", product="register", url="https://example.org", fetched="2024-01-01")
    bodies = {
        "registry": named(crs="EPSG:3006", source=source, sites=F.transform(i, lambda x: named(slug=text(x), name="n", county=F.col("county"), centerE=d("e"), centerN=d("n"), extent=box, extentPreset="standard"))),
        "sites": named(fetched="2024-01-01", sites=F.transform(i, lambda x: named(id=text(x), name=F.col("name"), lamningstyp="hillfort", provenance="measured", position=named(x=d("e"), z=d("n"))))),
        "shoreline": named(site=F.col("site"), source=source, steps=F.transform(i, lambda x: named(yearCE=x.cast("int"), bp=(1950 - x).cast("int"), levelM=d("half") / 4))),
        "rampart": named(site=F.col("site"), paths=F.transform(i, lambda x: named(id=text(x), name="Inner", closed=x % 2 == 0, lengthM=d("half"), points=F.array(F.array(d("e"), d("n")))))),
        "legend": named(site=F.col("site"), referenceYearCE=500, caveat="a model", classes=F.transform(i, lambda x: named(index=x.cast("int"), id=text(x), name="Water", color="#aabbcc", rule="r", dynamic=named(kind="water"), areaFraction=d("half") / 100))),
        "manifest": named(site=named(id=F.col("site"), name=F.col("name")), origin=named(e=d("e"), n=d("n")), grids=named(core=grid), assets=F.create_map(F.lit("sites"), F.lit("sites.json")), layers=F.transform(i, lambda x: named(id=text(x), name="Terrain", provenance="measured"))),
        "index": named(count=F.size(i), sites=F.transform(i, lambda x: named(slug=text(x), name="n", county=F.col("county"), centerE=d("e"), centerN=d("n"), bytes=x))),
        "report": named(slug=F.col("site"), built=True, bytes=F.col("s_suppkey") * 1000, steps=F.transform(i, lambda x: named(name=text(x), status="ok", message=""))),
    }
    late = F.when(F.col("s_suppkey") % 5 == 0, 2).otherwise(1)
    whole = lambda body: F.to_json(F.struct(late.alias("schemaVersion"), body.alias("b")))
    flat = lambda kind: F.regexp_replace(whole(bodies[kind]), r'^(\{"schemaVersion":\d+),"b":\{(.*)\}\}$', "$1,$2}")
    docs = s.select("site", F.explode(F.array(*[named(kind=k, doc=flat(k)) for k in bodies])).alias("x")).select(F.concat("site", F.lit("/"), "x.kind", F.lit(".json")).alias("name"), "x.doc")
    path = new_path(spark, "documents")
    document_set.write_documents(docs, path)
    back = document_set.read_documents(spark, path).select(F.substring_index("name", "/", 1).alias("site"), F.regexp_extract("name", r"/(\w+)\.json$", 1).alias("kind"), "doc")
    at = {
        "registry": ("sites", "registry.sites[0].centerE"), "sites": ("sites", "sites.sites[0].position.z"), "shoreline": ("steps", "shoreline.steps[0].levelM"), "rampart": ("paths", "rampart.paths[0].lengthM"),
        "legend": ("classes", "legend.classes[0].areaFraction"), "manifest": ("layers", "manifest.grids.core.bounds3006.minE"), "index": ("sites", "index.sites[0].centerN"), "report": ("steps", "double(report.bytes)"),
    }
    # every kind in one reading of the set
    items = F.coalesce(*[F.when(F.col(kind).isNotNull(), F.size(f"{kind}.{items}")) for kind, (items, _) in at.items()])
    number = F.coalesce(*[F.expr(number) for _, number in at.values()])
    return doc.read_back(back, list(at)).select("site", "kind", items.cast("long").alias("items"), number.alias("number"))


@query(f"""WITH {fx.SITES}, w AS (SELECT 'site-' || s_suppkey AS slug, g AS grid, s_suppkey FROM sites, (VALUES ('core'), ('context')) t(g))
  SELECT slug, grid FROM w WHERE s_suppkey % 4 = 3 OR (grid = 'core' AND s_suppkey % 5 = 1) OR (grid = 'context' AND s_suppkey % 6 = 2) OR s_suppkey % 7 = 4""")
def s11_work_list(spark, sf):
    """Wanted grids that the catalogue lacks, or has at another size, system or place."""
    s = fx.sites(spark, sf).withColumn("slug", F.concat(F.lit("site-"), F.col("s_suppkey").cast("string")))
    spec = F.inline(F.array(*[F.struct(F.lit(g).alias("grid"), F.lit(h).alias("half_m"), F.lit(r).alias("res")) for g, h, r in (("core", 100, 1), ("context", 2000, 2))]))
    w = s.select("slug", "s_suppkey", "e", "n", spec).withColumn("size", F.expr("2 * half_m div res")).withColumn("crs", F.lit("EPSG:3006")).withColumn("min_e", F.col("e") - F.col("half_m")).withColumn("max_n", F.col("n") + F.col("half_m"))
    k = F.col("s_suppkey")
    have = w.where(k % 4 != 3).withColumn("size", F.when((F.col("grid") == "core") & (k % 5 == 1), F.col("size") + 1).otherwise(F.col("size")))
    have = have.withColumn("crs", F.when((F.col("grid") == "context") & (k % 6 == 2), "EPSG:4326").otherwise(F.col("crs"))).withColumn("min_e", F.when(k % 7 == 4, F.col("min_e") + 1).otherwise(F.col("min_e")))
    return doc.work_list(w, have).select("slug", "grid")


# ---- scalars ---------------------------------------------------------------------------------


@query("""WITH q AS (SELECT l_orderkey, l_linenumber, round_even(l_extendedprice / 4 / 0.5, 0)::BIGINT AS dem, ceil(l_extendedprice / 4 / 0.5 - 1e-3)::BIGINT + (l_partkey % 7) * 6000 - 100 AS con FROM lineitem)
  SELECT l_orderkey, l_linenumber, CASE WHEN con - dem BETWEEN 0 AND 32767 THEN con - dem END AS delta, CASE WHEN con - dem BETWEEN 0 AND 32767 AND con BETWEEN -32768 AND 32767 THEN con END AS back, con - dem NOT BETWEEN 0 AND 32767 AS broken FROM q""")
def f11_delta(spark, sf):
    """Connect as a difference to the ground and back; differences and sums out of range are violations."""
    h = F.col("l_extendedprice") / 4
    q = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.rint(h / 0.5).cast("long").alias("dem"), (F.ceil(h / 0.5 - 1e-3) + (F.col("l_partkey") % 7) * 6000 - 100).alias("con"))
    q = q.withColumn("delta", fn.delta_of(F.col("dem"), F.col("con")))
    return q.select("l_orderkey", "l_linenumber", "delta", fn.undelta(F.col("dem"), F.col("delta")).alias("back"), F.col("delta").isNull().alias("broken"))


_INVERSE = fn.sweref_inverse("(200000e0 + c_custkey % 701 * 1000e0)", "(6200000e0 + c_custkey % 1301 * 1000e0)")


@query(f"SELECT c_custkey, round({_INVERSE[0]}, 7) AS lon, round({_INVERSE[1]}, 7) AS lat FROM customer")
def f13_inverse_projection(spark, sf):
    lon, lat = fn.sweref_inverse("(200000.0D + c_custkey % 701 * 1000.0D)", "(6200000.0D + c_custkey % 1301 * 1000.0D)")
    return table(spark, sf, "customer").select("c_custkey", F.round(F.expr(lon), 7).alias("lon"), F.round(F.expr(lat), 7).alias("lat"))


_EDGE = fn.sweref_inverse("pe", "pn")


@query(f"""WITH b AS (SELECT s_suppkey, 300000e0 + s_suppkey * 137 % 300000 AS e0, 6300000e0 + s_suppkey * 911 % 900000 AS n0 FROM supplier), p AS (SELECT s_suppkey, unnest([e0 + 40000e0 * k / 100, e0 + 40000e0 * k / 100, e0, e0 + 40000e0]) AS pe, unnest([n0, n0 + 40000e0, n0 + 40000e0 * k / 100, n0 + 40000e0 * k / 100]) AS pn FROM b, range(0, 101) q(k))
  SELECT s_suppkey, round(min({_EDGE[0]}), 6) AS west, round(min({_EDGE[1]}), 6) AS south, round(max({_EDGE[0]}), 6) AS east, round(max({_EDGE[1]}), 6) AS north FROM p GROUP BY 1""")
def f13_envelope(spark, sf):
    """Longitudes and latitudes that a square in the projection covers: 101 points along each edge."""
    s = table(spark, sf, "supplier").selectExpr("s_suppkey", "300000.0D + s_suppkey * 137 % 300000 AS min_e", "6300000.0D + s_suppkey * 911 % 900000 AS min_n")
    b = fn.geographic_envelope(s.withColumn("max_e", F.col("min_e") + 40000).withColumn("max_n", F.col("min_n") + 40000), "s_suppkey")
    return b.select("s_suppkey", *[F.round(c, 6).alias(c) for c in ("west", "south", "east", "north")])


@query(f"WITH {fx.SITES}, {fx.FEATURES}, k AS (SELECT *, id % (SELECT max(s_suppkey) FROM sites) + 1 AS site FROM features) SELECT s_suppkey, id, round_even(min_e + 0.04::DOUBLE - e, 1) AS x, round_even(-(min_n + 0.06::DOUBLE - n), 1) AS z, round_even(min_e + 0.04::DOUBLE - e, 1) + e AS e_back FROM k JOIN sites ON s_suppkey = site")
def f6_local_frame(spark, sf):
    """Features in the frame of their own site, to a tenth of a metre, and back."""
    s = fx.sites(spark, sf)
    top = s.agg(F.max("s_suppkey").alias("top"))
    j = fx.features(spark, sf).crossJoin(F.broadcast(top)).withColumn("s_suppkey", F.expr("id % top + 1")).join(s.select("s_suppkey", "e", "n"), "s_suppkey")  # one row
    x, z = fn.to_local(F.col("min_e") + F.lit(0.04), F.col("min_n") + F.lit(0.06), F.col("e"), F.col("n"))
    return j.select("s_suppkey", "id", x.alias("x"), z.alias("z"), (x + F.col("e")).alias("e_back"))


# ---- joins and aggregates --------------------------------------------------------------------


@query(f"""WITH {fx.SITES}, w AS (SELECT event_id, user_id FROM events), p(preset, grid, half_m) AS (VALUES ('large', 'core', 400), ('large', 'context', 2000), ('standard', 'core', 200), ('standard', 'context', 2000))
  SELECT event_id, s_suppkey IS NOT NULL AS known, s.county, p.grid, e - half_m AS min_e FROM w LEFT JOIN sites s ON s_suppkey = user_id LEFT JOIN p ON p.preset = CASE WHEN half >= 80 THEN 'large' WHEN half IS NOT NULL THEN 'standard' END""")
def j13_register_lookup(spark, sf):
    """The site of each event and the grids of its preset; unknown sites stay, without any."""
    r = fx.sites(spark, sf).select(F.col("s_suppkey").alias("slug"), "county", "e", F.when(F.col("half") >= 80, "large").otherwise("standard").alias("preset"))
    presets = spark.createDataFrame([("large",), ("standard",)], "preset string")
    specs = spark.createDataFrame([("large", "core", 400), ("large", "context", 2000), ("standard", "core", 200), ("standard", "context", 2000)], "preset string, grid string, half_m int")
    got = doc.looked_up(table(spark, sf, "events").select("event_id", F.col("user_id").alias("slug")), r, presets, specs)
    return got.select("event_id", "known", "county", "grid", (F.col("e") - F.col("half_m")).alias("min_e"))


@query(f"""WITH {fx.CELLS}, b AS (SELECT grid_id, half_m, r // f AS r, c // f AS c, avg(z) AS z FROM cells, (VALUES (4000, 2), (8000, 4), (16000, 8)) q(half_m, f) WHERE NOT (grid_id % 3 = 0 AND half_m = 8000) GROUP BY 1, 2, 3, 4),
  p AS (SELECT grid_id, coalesce(max(half_m) FILTER (half_m = 8000), max(half_m)) AS half_m FROM b GROUP BY 1) SELECT b.grid_id, b.half_m, round(greatest(0, quantile_cont(z, 0.05)), 6) AS floor_m FROM b JOIN p USING (grid_id, half_m) GROUP BY 1, 2""")
def a10_floor(spark, sf):
    """The 5th percentile of the box of half-extent 8000, or of the widest there is; never below 0."""
    f = fx.cells(spark, sf).withColumn("f", F.explode(F.array(F.lit(2), F.lit(4), F.lit(8)))).withColumn("half_m", F.col("f") * 2000).where("NOT (grid_id % 3 = 0 AND half_m = 8000)")
    b = f.groupBy("grid_id", "half_m", F.expr("r div f").alias("r"), F.expr("c div f").alias("c")).agg(F.avg("z").alias("z"))
    p = b.groupBy("grid_id").agg(F.coalesce(F.max(F.when(F.col("half_m") == 8000, F.col("half_m"))), F.max("half_m")).alias("half_m"))
    low = order.exact_percentiles(b.join(p, ["grid_id", "half_m"]), ["grid_id", "half_m"], "z", {"p5": 0.05})
    return low.select("grid_id", "half_m", F.round(F.greatest(F.lit(0.0), F.col("p5")), 6).alias("floor_m"))


@query(f"""WITH {fx.HOLED}, g AS (SELECT grid_id, round(avg((z IS NULL)::INT), 6) AS filled FROM holed GROUP BY 1), f AS (SELECT l_suppkey % (SELECT count(*) FROM g) AS grid_id, sum(l_extendedprice::BIGINT) AS bytes, count(*) AS files FROM lineitem GROUP BY 1)
  SELECT grid_id, filled, coalesce(bytes, 0)::BIGINT AS bytes, coalesce(files, 0) AS files FROM g LEFT JOIN f USING (grid_id)""")
def a19_bundles(spark, sf):
    """Filled share, bytes and files of each grid's bundle."""
    g = fx.holed(spark, sf).groupBy("grid_id").agg(F.round(F.avg(F.col("z").isNull().cast("int")), 6).alias("filled"))
    n = g.agg(F.count("*").alias("n"))
    f = table(spark, sf, "lineitem").crossJoin(F.broadcast(n)).groupBy(F.expr("l_suppkey % n").alias("grid_id")).agg(F.sum(F.rint("l_extendedprice").cast("long")).alias("bytes"), F.count("*").alias("files"))  # one row
    return g.join(f, "grid_id", "left").fillna(0, ["bytes", "files"])


@query(f"""WITH RECURSIVE {fx.FLOOD} SELECT grid_id, level, count(*) FILTER (connect <= level) AS wet, count(*) FILTER (z <= level) AS naive FROM cells JOIN flood USING (grid_id, r, c), (VALUES (8), (11)) q(level) GROUP BY 1, 2""")
def f21_wet_cells(spark, sf):
    """Cells that the sea reaches at a level, and those that only lie below it."""
    f = raster.sea_connectivity(fx.cells(spark, sf)).withColumn("level", F.explode(F.array(F.lit(8), F.lit(11))))
    return f.groupBy("grid_id", "level").agg(F.count_if(F.col("connect") <= F.col("level")).alias("wet"), F.count_if(F.col("z") <= F.col("level")).alias("naive"))


@query("SELECT o_orderkey AS slug, k::INT AS name FROM orders, range(1, 4) q(k) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = k AND l_returnflag <> 'A')")
def q8_referenced_files(spark, sf):
    """Files that a manifest names and the bundle lacks."""
    named = table(spark, sf, "orders").select(F.col("o_orderkey").alias("slug"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("name"))
    have = table(spark, sf, "lineitem").where("l_returnflag <> 'A'").select(F.col("l_orderkey").alias("slug"), F.col("l_linenumber").alias("name"))
    return named.join(have, ["slug", "name"], "left_anti")


# ---- rules -----------------------------------------------------------------------------------


@query("""WITH d AS (SELECT 'K' || c_custkey % 1400 AS id, CASE WHEN c_custkey % 13 <> 0 THEN c_name END AS name, c_mktsegment AS type, CASE WHEN c_custkey % 17 <> 0 THEN c_acctbal END AS x, c_acctbal AS z, CASE WHEN c_custkey % 11 = 0 THEN 'guessed' ELSE 'measured' END AS provenance FROM customer),
  k AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM d)
  SELECT DISTINCT id, rule FROM (SELECT id, unnest([CASE WHEN name IS NULL THEN 'key' END, CASE WHEN n > 1 THEN 'twice' END, CASE WHEN x IS NULL OR z IS NULL THEN 'position' END, CASE WHEN provenance <> 'measured' THEN 'provenance' END]) AS rule FROM k) WHERE rule IS NOT NULL""")
def q12_sites_document(spark, sf):
    k = F.col("c_custkey")
    d = table(spark, sf, "customer").select(F.concat(F.lit("K"), (k % 1400).cast("string")).alias("id"), F.when(k % 13 != 0, F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("type"), F.when(k % 17 != 0, F.col("c_acctbal")).alias("x"), F.col("c_acctbal").alias("z"), F.when(k % 11 == 0, "guessed").otherwise("measured").alias("provenance"))
    return doc.site_rules(d)


@query(f"""WITH {OUTLINE}, g AS (SELECT feature_id, count(*) AS n, bool_or(x < 5 OR x > 990 OR y < 5 OR y > 990) AS outside, bool_or(closed) AND min_by((x, y), seq) = max_by((x, y), seq) AND count(*) > 1 AS twice FROM vertices GROUP BY 1), w AS (SELECT feature_id, max(len) AS gap, sum(len) AS length FROM seg GROUP BY 1)
  SELECT feature_id, rule FROM (SELECT feature_id, unnest([CASE WHEN n < 3 THEN 'points' END, CASE WHEN outside THEN 'bounds' END, CASE WHEN gap > 900 THEN 'spacing' END, CASE WHEN twice THEN 'closed' END, CASE WHEN feature_id % 3 = 1 AND length IS NOT NULL THEN 'length' END]) AS rule FROM g LEFT JOIN w USING (feature_id)) WHERE rule IS NOT NULL""")
def q13_polyline_rules(spark, sf):
    """Outlines against their contract; every third states a wrong length."""
    v = fx.vertices(spark, sf).withColumn("ring", F.lit(0)).withColumn("hole", F.lit(False))
    stated = vectors.segments(v).groupBy("feature_id").agg(F.sum("len").alias("l")).select("feature_id", (F.col("l") + F.when(F.col("feature_id") % 3 == 1, 2.0).otherwise(0.1)).alias("stated"))
    return doc.polyline_rules(v, stated, (5, 5, 990, 990), 900.0)


@query("""WITH l AS (SELECT p_size % 20 AS site, row_number() OVER (PARTITION BY p_size % 20 ORDER BY p_partkey) - 1 + CASE WHEN p_partkey % 97 = 0 THEN 1 ELSE 0 END AS idx, p_name || p_partkey % 1500 AS id, CASE WHEN p_partkey % 211 = 0 THEN 'red' ELSE '#' || substr(md5(p_name), 1, 6) END AS color,
    CASE WHEN p_partkey % 3 = 0 THEN 'conifer' WHEN p_partkey % 401 = 0 THEN 'palm' END AS form, (p_partkey % 501)::DOUBLE AS density, CASE WHEN p_partkey % 200 = 0 THEN 'water' WHEN p_partkey % 701 = 0 THEN 'fog' END AS kind, count(*) OVER (PARTITION BY p_size % 20) AS m FROM part),
  g AS (SELECT site, count(*) AS n, count(DISTINCT idx) AS ids, min(idx) AS low, max(idx) AS high, count(DISTINCT id) AS names, bool_and(regexp_full_match(color, '#[0-9a-fA-F]{6}')) AS colors, bool_and(form IS NULL OR (form IN ('conifer', 'broadleaf', 'reeds', 'shrub') AND density > 0)) AS forms,
    count(kind) - count(DISTINCT kind) AS again, coalesce(bool_or(kind NOT IN ('water', 'shore-band')), FALSE) AS odd, sum(CASE WHEN site % 3 = 0 THEN 0.9 ELSE 1.0 END::DOUBLE / m) AS total FROM l GROUP BY 1)
  SELECT site, rule FROM (SELECT site, unnest([CASE WHEN ids <> n OR low <> 0 OR high <> n - 1 THEN 'indices' END, CASE WHEN names <> n THEN 'ids' END, CASE WHEN NOT colors THEN 'colors' END, CASE WHEN NOT forms THEN 'vegetation' END, CASE WHEN again > 0 OR odd THEN 'dynamic' END, CASE WHEN abs(total - 1) > 0.001 THEN 'fractions' END]) AS rule FROM g) WHERE rule IS NOT NULL""")
def q14_legend_rules(spark, sf):
    from pyspark.sql import Window

    p, k = table(spark, sf, "part"), F.col("p_partkey")
    site = F.col("p_size") % 20
    w = Window.partitionBy(site)
    rows = p.select(
        site.alias("site"), (F.row_number().over(w.orderBy("p_partkey")) - 1 + F.when(k % 97 == 0, 1).otherwise(0)).alias("idx"), F.concat("p_name", (k % 1500).cast("string")).alias("id"),
        F.when(k % 211 == 0, "red").otherwise(F.concat(F.lit("#"), F.substring(F.md5("p_name"), 1, 6))).alias("color"), F.when(k % 3 == 0, "conifer").when(k % 401 == 0, "palm").alias("form"), (k % 501).cast("double").alias("density"),
        F.when(k % 200 == 0, "water").when(k % 701 == 0, "fog").alias("kind"), (F.when(site % 3 == 0, 0.9).otherwise(1.0) / F.count("*").over(w)).alias("fraction"),
    )
    return doc.legend_rules(rows)


@query(f"""WITH {fx.SITES}, m AS (SELECT 'site-' || s_suppkey AS slug, s_suppkey AS k FROM sites) SELECT slug, rule FROM (SELECT slug, unnest([CASE WHEN k % 7 = 1 THEN 'size' END, CASE WHEN k % 9 = 2 THEN 'scale' END, CASE WHEN k % 10 = 3 THEN 'band' END, CASE WHEN k % 11 = 4 THEN 'containment' END, CASE WHEN k % 13 = 6 THEN 'coarser' END,
  CASE WHEN k % 8 IN (5, 6) THEN 'path' END, CASE WHEN k % 6 = 0 THEN 'pair' END, CASE WHEN k % 5 = 2 THEN 'provenance' END]) AS rule FROM m) WHERE rule IS NOT NULL""")
def q15_manifest_rules(spark, sf):
    """Manifests with one fault each by their number, and the rules that find them."""
    k = F.col("s_suppkey")
    half = F.when(k % 11 == 4, 100).otherwise(2000)
    size = lambda h, r: (2 * h / r + F.when(k % 7 == 1, 1).otherwise(0)).cast("double")
    path = F.when(k % 8 == 5, "/etc/context").when(k % 8 == 6, "a/../context").otherwise("grids/context")
    res = F.when(k % 13 == 6, 0.5).otherwise(2.0)
    grid = lambda n, h, r, p: F.struct(F.lit(n).alias("name"), h.cast("double").alias("half_m"), r.alias("res"), size(h, r).alias("size"), F.when(k % 9 == 2, 0.25).otherwise(0.5).alias("scale"), F.when(k % 10 == 3, 9.0).otherwise(1.0).alias("low"), F.lit(5.0).alias("high"), p.alias("path"))
    both = F.when(k % 6 == 0, F.create_map(F.lit("shoreline"), F.lit("s.json"))).otherwise(F.create_map(F.lit("shoreline"), F.lit("s.json"), F.lit("connect"), F.lit("c")))
    m = fx.sites(spark, sf).select(F.concat(F.lit("site-"), k.cast("string")).alias("slug"), F.array(grid("core", F.lit(100), F.lit(1.0), F.lit("grids/core")), grid("context", half, res, path)).alias("grids"), both.alias("assets"), F.when(k % 5 == 2, "rumour").otherwise("measured").alias("provenance"))
    return doc.manifest_rules(m)


@query(f"""WITH {fx.SITES} SELECT 'site-' || s_suppkey AS slug, field FROM (SELECT s_suppkey, unnest([CASE WHEN s_suppkey % 4 = 1 THEN 'size' END, CASE WHEN s_suppkey % 6 = 1 THEN 'crs' END, CASE WHEN s_suppkey % 5 = 3 THEN 'min_e' END]) AS field FROM sites) WHERE field IS NOT NULL""")
def q16_pair_geometry(spark, sf):
    """Where the two rasters of a site that must share their geometry don't."""
    s, k = fx.sites(spark, sf), F.col("s_suppkey")
    two = lambda ok, bad, when: F.when((F.col("asset") == "connect") & when, bad).otherwise(ok)
    c = s.withColumn("asset", F.explode(F.array(F.lit("dem"), F.lit("connect")))).select(
        F.concat(F.lit("site-"), k.cast("string")).alias("slug"), "asset", two(F.lit(200), F.lit(100), k % 4 == 1).alias("size"), two(F.lit("a"), F.lit("b"), k % 6 == 1).alias("crs"), F.lit(2).alias("res"), two(F.col("e"), F.col("e") + 2, k % 5 == 3).alias("min_e"), F.col("n").alias("max_n")
    )
    return doc.geometry_differences(c, "dem", "connect")


# ---- assembly --------------------------------------------------------------------------------


@query(f"""WITH {fx.SITES} SELECT s_suppkey AS slug, (e - half) || ',' || (n - half) || ',' || (e + half) || ',' || (n + half) AS bounds, CASE WHEN s_suppkey % 3 = 0 THEN 'core,context,ring3' ELSE 'core,context' END AS grids, CASE WHEN s_suppkey % 3 = 0 THEN 'dem,context,rings' ELSE 'dem,context' END AS layers,
  CASE WHEN s_suppkey % 2 = 0 THEN 'heights,registry' ELSE 'registry' END AS credits FROM sites""")
def m1_manifest(spark, sf):
    """Manifests put together from sites, grids and credits, read back from their JSON."""
    s = fx.sites(spark, sf).withColumnRenamed("s_suppkey", "slug")
    grid = lambda i, n, h, r: F.struct(F.lit(i).alias("ring"), F.lit(n).alias("name"), F.lit(h).alias("half_m"), F.lit(r).alias("res"), F.lit(0.0).alias("low"), F.lit(9.0).alias("high"))
    g = s.select("slug", F.inline(F.array_compact(F.array(F.when(F.col("slug") % 3 == 0, grid(2, "ring3", 4000, 4)), grid(1, "context", 2000, 2), grid(0, "core", 100, 1)))))
    c = s.select("slug", F.explode(F.array_compact(F.array(F.lit("registry"), F.when(F.col("slug") % 2 == 0, "heights"), F.lit("registry")))).alias("credit"))
    d = F.from_json("doc", "bounds array<long>, grids array<struct<name:string>>, layers array<string>, credits array<string>")
    m = doc.assembled_manifests(s, g, c).select("slug", d.alias("d"))
    return m.select("slug", F.array_join("d.bounds", ",").alias("bounds"), F.array_join("d.grids.name", ",").alias("grids"), F.array_join("d.layers", ",").alias("layers"), F.array_join("d.credits", ",").alias("credits"))


@query(f"""WITH {fx.SITES} SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'dem,connect,landcover' ELSE 'dem,landcover' END AS layers, 'land=new,soil=s' AS sources, CASE WHEN s_suppkey % 4 = 0 THEN 'clip,classify,fill' ELSE 'clip,fill,classify' END AS steps, 'agency' AS credits,
  CASE WHEN s_suppkey % 5 = 0 THEN 'dem' ELSE 'dem,legend' END AS assets FROM sites""")
def m2_idempotent_patch(spark, sf):
    """A patch made twice: layers in order, sources by id, only new steps, one credit, superseded and failed assets gone (also M3)."""
    k = F.col("s_suppkey")
    pair = lambda i, t: F.struct(F.lit(i).alias("id"), F.lit(t).alias("text"))
    start = F.struct(
        F.array_compact(F.array(F.when(k % 3 == 0, "connect"), F.lit("dem"))).alias("layers"), F.array(pair("soil", "s"), pair("land", "old")).alias("sources"), F.when(k % 4 == 0, F.array(F.lit("clip"), F.lit("classify"))).otherwise(F.array(F.lit("clip"))).alias("steps"),
        F.array(F.lit("agency")).alias("credits"), F.create_map(F.lit("dem"), F.lit("d"), F.lit("legend"), F.lit("l"), F.lit("tint"), F.lit("t")).alias("assets"),
    )
    s = fx.sites(spark, sf).select("s_suppkey", start.alias("doc"))
    for _ in range(2):
        s = s.withColumn("doc", doc.patched(F.col("doc"), "landcover", pair("land", "new"), F.array(F.lit("fill"), F.lit("classify")), "agency", ("tint",)))
    s = s.withColumn("assets", doc.without_failed(F.col("doc.assets"), F.array_compact(F.array(F.when(k % 5 == 0, "legend"), F.lit("walk")))))
    text = F.array_join(F.transform("doc.sources", lambda x: F.concat_ws("=", x["id"], x["text"])), ",")
    # new steps come after those that were there: 'clip,classify' gains 'fill'
    steps = F.array_join("doc.steps", ",")
    return s.select("s_suppkey", F.array_join("doc.layers", ",").alias("layers"), text.alias("sources"), steps.alias("steps"), F.array_join("doc.credits", ",").alias("credits"), F.array_join(F.array_sort(F.map_keys("assets")), ",").alias("assets"))


@query(f"""WITH {fx.SITES} SELECT s_suppkey, 'dem' || CASE WHEN s_suppkey % 3 <> 0 THEN ',landcover' ELSE '' END || CASE WHEN s_suppkey % 4 <> 1 THEN ',rampart' ELSE '' END AS assets FROM sites""")
def m3_drop_failed_assets(spark, sf):
    """Assets of a manifest without those whose step failed."""
    k = F.col("s_suppkey")
    assets = F.create_map(*[F.lit(x) for pair in (("dem", "d"), ("landcover", "l"), ("rampart", "r")) for x in pair])
    failed = F.array_compact(F.array(F.when(k % 3 == 0, "landcover"), F.when(k % 4 == 1, "rampart")))
    return fx.sites(spark, sf).select("s_suppkey", F.array_join(F.array_sort(F.map_keys(doc.without_failed(assets, failed))), ",").alias("assets"))


_STEPS = [("build", None, True), ("water", "shoreline", False), ("landcover", "soils", False), ("rampart", "outline", False)]


@query("""WITH st(step, needs, required) AS (VALUES ('build', NULL, TRUE), ('water', 'shoreline', FALSE), ('landcover', 'soils', FALSE), ('rampart', 'outline', FALSE)), i AS (SELECT c_custkey AS slug, unnest([CASE WHEN c_custkey % 2 = 0 THEN 'shoreline' END, CASE WHEN c_custkey % 3 = 0 THEN 'soils' END, CASE WHEN c_custkey % 5 = 0 THEN 'outline' END]) AS needs FROM customer),
  lg AS (SELECT o_custkey AS slug, CASE o_orderkey % 4 WHEN 0 THEN 'build' WHEN 1 THEN 'water' WHEN 2 THEN 'landcover' ELSE 'rampart' END AS step, bool_or(o_orderstatus <> 'P') AS ok FROM orders GROUP BY 1, 2)
  SELECT c_custkey AS slug, st.step, CASE WHEN st.needs IS NOT NULL AND i.slug IS NULL THEN 'skipped' WHEN coalesce(ok, FALSE) THEN 'done' ELSE 'failed' END AS status FROM customer CROSS JOIN st LEFT JOIN i ON i.slug = c_custkey AND i.needs = st.needs LEFT JOIN lg ON lg.slug = c_custkey AND lg.step = st.step""")
def m4_step_outcomes(spark, sf):
    """What became of each step of each site: a missing input turns a feature off."""
    return _outcomes(spark, sf).select("slug", "step", "status")


def _outcomes(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("slug"))
    k = F.col("slug")
    inputs = c.select("slug", F.explode(F.array_compact(F.array(F.when(k % 2 == 0, "shoreline"), F.when(k % 3 == 0, "soils"), F.when(k % 5 == 0, "outline")))).alias("input"))
    o = F.col("o_orderkey") % 4
    log = table(spark, sf, "orders").select(F.col("o_custkey").alias("slug"), F.when(o == 0, "build").when(o == 1, "water").when(o == 2, "landcover").otherwise("rampart").alias("step"), (F.col("o_orderstatus") != "P").alias("ok"))
    return doc.step_outcomes(c, spark.createDataFrame(_STEPS, "step string, needs string, required boolean"), inputs, log)


@query("""WITH s AS (SELECT c_custkey AS slug, step, required, CASE WHEN needs IS NOT NULL AND NOT has THEN 'skipped' WHEN ok THEN 'done' ELSE 'failed' END AS status FROM (SELECT c_custkey, st.*, CASE needs WHEN 'shoreline' THEN c_custkey % 2 = 0 WHEN 'soils' THEN c_custkey % 3 = 0 WHEN 'outline' THEN c_custkey % 5 = 0 ELSE TRUE END AS has,
    EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 4 = n AND o_orderstatus <> 'P') AS ok FROM customer CROSS JOIN (VALUES ('build', NULL, TRUE, 0), ('water', 'shoreline', FALSE, 1), ('landcover', 'soils', FALSE, 2), ('rampart', 'outline', FALSE, 3)) st(step, needs, required, n)))
  SELECT slug, CASE WHEN count(*) FILTER (status = 'failed' AND required) > 0 THEN 'fail' WHEN count(*) FILTER (status = 'failed') > 0 THEN 'warn' ELSE 'pass' END AS verdict, coalesce(string_agg(step, ',' ORDER BY step) FILTER (status <> 'done'), '') AS off FROM s GROUP BY 1""")
def m4_build_policy(spark, sf):
    return doc.build_policy(_outcomes(spark, sf))


@query(f"WITH {fx.SITES} SELECT (i // 7)::BIGINT AS page, i AS entry, s_suppkey AS slug FROM (SELECT s_suppkey, row_number() OVER (ORDER BY county, name, s_suppkey) - 1 AS i FROM sites)")
def m5_register_document(spark, sf):
    """The register in pages of seven entries."""
    e = fx.sites(spark, sf).select(F.col("s_suppkey").alias("slug"), "county", "name")
    d = doc.register_document(e, 7)
    return d.select(F.col("page").cast("long").alias("page"), "entry", F.get_json_object("doc", "$.slug").cast("long").alias("slug"))


@query(f"""WITH {fx.SITES} SELECT s_suppkey, 'Heights: measured.' || CASE WHEN s_suppkey % 2 = 0 THEN ' Water: modelled, within ' || half || ' m.' ELSE '' END || CASE WHEN s_suppkey % 3 = 0 THEN ' Land cover: rules over mapped soils; not observed.' ELSE '' END
  || CASE WHEN s_suppkey % 5 = 0 THEN ' Horizon: ' || printf('%.1f', 3.83 * sqrt(half)) || ' km.' ELSE '' END AS text FROM sites""")
def m6_disclosure(spark, sf):
    """What a site's page says of its sources: a sentence for each asset that it has."""
    k = F.col("s_suppkey")
    parts = [F.lit("Heights: measured."), F.when(k % 2 == 0, F.format_string("Water: modelled, within %d m.", "half")), F.when(k % 3 == 0, "Land cover: rules over mapped soils; not observed."), F.when(k % 5 == 0, F.format_string("Horizon: %.1f km.", fn.horizon_m(F.col("half")) / 1000))]
    return fx.sites(spark, sf).select("s_suppkey", F.concat_ws(" ", *parts).alias("text"))
