"""Site documents as tables: layers, catalogues, manifests and legends, their assembly and their rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Layers of a manifest, in the order of the contract.
LAYERS = ("dem", "context", "rings", "connect", "shoreline", "landcover", "rampart")
#: Steps of a height that grids may have.
SCALES = (0.1, 0.5, 1.0)
_BOX = "struct<minE: double, minN: double, maxE: double, maxN: double>"
_GRID = f"struct<path: string, resolution: double, width: int, height: int, bounds3006: {_BOX}, boundsLocal: struct<minX: double, minZ: double, maxX: double, maxZ: double>, encoding: struct<dtype: string, scale: double, unit: string>, minElevation: double, maxElevation: double>"
_SOURCE = "struct<id: string, product: string, url: string, fetched: string>"
#: Read schemas of the documents, by kind, with the fields of the contract; unknown keys are passed over.
DOCUMENTS = {
    "registry": f"schemaVersion int, generated string, crs string, source {_SOURCE}, stats map<string, string>, sites array<struct<slug: string, lamningsnummer: string, name: string, county: string, kommun: string, centerE: double, centerN: double, extent: {_BOX}, extentSpanM: double, geometryClass: string, antikvariskBedomning: string, extentPreset: string, uuid: string, raaNummer: string, fornsokUrl: string>>",
    "sites": "schemaVersion int, fetched string, site string, sites array<struct<id: string, name: string, lamningstyp: string, provenance: string, position: struct<x: double, z: double>, geometryLocal: struct<type: string, coordinates: string>, fornsokUrl: string, description: string>>",
    "shoreline": f"schemaVersion int, site string, method string, source {_SOURCE}, steps array<struct<yearCE: int, bp: int, levelM: double>>",
    "rampart": "schemaVersion int, site string, method string, paths array<struct<id: string, name: string, closed: boolean, lengthM: double, points: array<array<double>>>>",
    "legend": f"schemaVersion int, site string, referenceYearCE int, referenceLevelM double, method string, caveat string, calibration string, source {_SOURCE}, classes array<struct<index: int, id: string, name: string, color: string, rule: string, vegetation: struct<type: string, densityPerHa: double>, dynamic: struct<kind: string, bandM: double>, areaFraction: double>>",
    "manifest": f"schemaVersion int, site struct<id: string, name: string, raa: map<string, string>>, crs struct<horizontal: string, verticalDatum: string>, origin struct<e: double, n: double>, grids struct<core: {_GRID}, context: {_GRID}, rings: array<{_GRID}>>, assets map<string, string>, layers array<struct<id: string, name: string, provenance: string>>, attribution array<struct<text: string, license: string, url: string>>, provenance struct<generated: string, pipeline: string, sources: array<struct<id: string, product: string, fetched: string>>, processing: array<string>>",
    "index": "schemaVersion int, generated string, crs struct<horizontal: string>, registry struct<source: string, generated: string, totalRegistered: long>, count int, sites array<struct<slug: string, name: string, county: string, centerE: double, centerN: double, bytes: long>>",
    "report": "schemaVersion int, slug string, generated string, outDir string, built boolean, shippable boolean, bytes long, steps array<struct<name: string, status: string, message: string>>, qa struct<passed: boolean, checks: array<struct<id: string, severity: string, message: string>>>",
}


# ---- layers and catalogues -------------------------------------------------------------------


def qualified_layers(layers: dict[str, DataFrame], type_names: tuple[str, ...], id_names: tuple[str, ...], order: tuple[str, ...] = ("polygon", "line", "point")) -> DataFrame:
    """(layer, layer_rank, id, type, ...): the layers that have a type and an id column, put together; what one lacks is null.

    Names count in any case; the first that exists is taken. The rank is that of the kind in
    the layer's name, others last."""
    out = None
    for name, df in layers.items():
        found = {c.lower(): c for c in df.columns}
        pick = lambda names: next((found[n.lower()] for n in names if n.lower() in found), None)
        kind, ident = pick(type_names), pick(id_names)
        if kind is None or ident is None:
            continue
        rank = next((i + 1 for i, k in enumerate(order) if k in name.lower()), len(order) + 1)
        rest = [c for c in df.columns if c not in (kind, ident)]
        part = df.select(F.lit(name).alias("layer"), F.lit(rank).alias("layer_rank"), F.col(ident).cast("string").alias("id"), F.col(kind).alias("type"), *rest)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no layer has one of {type_names} and one of {id_names}")
    return out


def work_list(wanted: DataFrame, catalogue: DataFrame, keys: tuple[str, ...] = ("slug", "grid"), same: tuple[str, ...] = ("size", "crs", "res", "min_e", "max_n")) -> DataFrame:
    """The wanted assets that the catalogue lacks, or has with another size, system, cell or place."""
    have = catalogue.select(*keys, *same).withColumnsRenamed({c: f"have_{c}" for c in (*keys, *same)})
    on = F.expr(" AND ".join(f"{c} <=> have_{c}" for c in (*keys, *same)))
    return wanted.join(have, on, "left_anti")


def geometry_differences(catalogue: DataFrame, first: str, second: str, same: tuple[str, ...] = ("size", "crs", "res", "min_e", "max_n")) -> DataFrame:
    """(slug, field): where two assets of a site, which must share their geometry, don't."""
    a = catalogue.where(F.col("asset") == first).select("slug", *same)
    b = catalogue.where(F.col("asset") == second).select("slug", *[F.col(c).alias(f"{c}_b") for c in same])
    differ = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"{c}_b")), F.lit(c)) for c in same]))
    return a.join(b, "slug").select("slug", F.explode(differ).alias("field"))


# ---- documents -------------------------------------------------------------------------------


def written(rows: DataFrame, kind: str, items: Column, name: str) -> DataFrame:
    """(site, kind, doc): JSON documents of a kind, from a site column and an array of its items."""
    if kind not in DOCUMENTS:
        raise ValueError(f"no document of kind {kind}")
    body = F.struct(F.lit(1).alias("schemaVersion"), F.col("site"), items.alias(name), F.lit("kept by readers").alias("note"))
    return rows.select("site", F.lit(kind).alias("kind"), F.to_json(body).alias("doc"))


def read_back(docs: DataFrame, kinds: list[str]) -> DataFrame:
    """Documents (site, kind, doc) of all ``kinds`` in one reading: site, kind and a struct by the name of each kind, null for the others.

    A text that doesn't parse, or has another version, is null too."""
    parsed = docs.where(F.col("kind").isin(*kinds)).select("site", "kind", *[F.when(F.col("kind") == k, F.from_json("doc", DOCUMENTS[k], {"mode": "PERMISSIVE"})).alias(k) for k in kinds])
    return parsed.select("site", "kind", *[F.when(F.col(k)["schemaVersion"] == 1, F.col(k)).alias(k) for k in kinds])


def assembled_manifests(sites: DataFrame, grids: DataFrame, credits: DataFrame) -> DataFrame:
    """(slug, doc): a manifest for each site: bounds, its grids in the order of ring, layers in the contract's order, and credits.

    ``grids`` has slug, ring, name, half_m, res and low, high, a handful for each site."""
    g = grids.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("ring", "name", "half_m", "res", "low", "high"))).alias("grids"))
    c = credits.groupBy("slug").agg(F.array_sort(F.collect_set("credit")).alias("credits"))
    j = sites.join(g, "slug", "left").join(c, "slug", "left")
    bounds = F.array(F.col("e") - F.col("half"), F.col("n") - F.col("half"), F.col("e") + F.col("half"), F.col("n") + F.col("half"))
    have = F.transform("grids", lambda x: F.when(x["ring"] >= 2, "rings").when(x["ring"] == 1, "context").otherwise("dem"))
    layers = in_order(F.coalesce(have, F.array().cast("array<string>")))
    doc = F.to_json(F.struct(F.lit(1).alias("schemaVersion"), "slug", bounds.alias("bounds"), F.transform("grids", lambda x: x.dropFields("ring")).alias("grids"), layers.alias("layers"), "credits"))
    return j.select("slug", doc.alias("doc"))


def in_order(have: Column) -> Column:
    """Layers in the contract's order, each once; others are dropped."""
    return F.filter(F.array(*[F.lit(x) for x in LAYERS]), lambda x: F.array_contains(have, x))


def patched(doc: Column, layer: str, source: Column, steps: Column, credit: str, superseded: tuple[str, ...] = ()) -> Column:
    """A manifest with a layer added: doing it twice changes nothing.

    ``doc`` is a struct of layers, sources (array of id, text), steps (array), credits (array)
    and assets (map). The layer goes to its place once; a source of the same id is replaced;
    only new steps are added, at the end; a credit stands once; superseded assets go."""
    sources = F.concat(F.filter(doc["sources"], lambda s: s["id"] != source["id"]), F.array(source))
    fresh = F.filter(steps, lambda s: ~F.array_contains(doc["steps"], s))
    assets = F.map_filter(doc["assets"], lambda k, v: ~k.isin(*superseded)) if superseded else doc["assets"]
    return F.struct(
        in_order(F.concat(doc["layers"], F.array(F.lit(layer)))).alias("layers"), F.array_sort(sources).alias("sources"), F.concat(doc["steps"], F.array_distinct(fresh)).alias("steps"),
        F.array_distinct(F.concat(doc["credits"], F.array(F.lit(credit)))).alias("credits"), assets.alias("assets"),
    )


def without_failed(assets: Column, failed: Column) -> Column:
    """A map of assets without those whose step is in the array ``failed``."""
    return F.map_filter(assets, lambda k, v: ~F.array_contains(failed, k))


def step_outcomes(sites: DataFrame, steps: DataFrame, inputs: DataFrame, log: DataFrame) -> DataFrame:
    """(slug, step, status, required): each step of each site: done, failed, or skipped for a missing input.

    ``steps`` (step, needs, required) is a fixed table; ``inputs`` has slug, input; ``log`` has
    slug, step, ok. A missing input turns a feature off and is no failure; a step with its
    input but without a log has failed."""
    j = sites.select("slug").crossJoin(F.broadcast(steps))  # a few steps
    have = inputs.select("slug", F.col("input").alias("needs"), F.lit(True).alias("has")).distinct()
    done = log.groupBy("slug", "step").agg(F.bool_or("ok").alias("ok"))
    j = j.join(have, ["slug", "needs"], "left").join(done, ["slug", "step"], "left")
    status = F.when(F.col("needs").isNotNull() & F.col("has").isNull(), "skipped").when(F.coalesce("ok", F.lit(False)), "done").otherwise("failed")
    return j.select("slug", "step", status.alias("status"), "required")


def build_policy(outcomes: DataFrame) -> DataFrame:
    """(slug, verdict, off): a site is built unless a required step failed; ``off`` are the features that it goes without."""
    bad = F.col("status") == "failed"
    off = F.array_sort(F.collect_set(F.when(F.col("status") != "done", F.col("step"))))  # a handful of steps
    hard = F.count_if(bad & F.col("required"))
    return outcomes.groupBy("slug").agg(F.when(hard > 0, "fail").when(F.count_if(bad) > 0, "warn").otherwise("pass").alias("verdict"), F.array_join(off, ",").alias("off"))


# ---- rules -----------------------------------------------------------------------------------


def _broken(*rules: tuple[str, Column]) -> Column:
    return F.explode(F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules]))).alias("rule")


def site_rules(docs: DataFrame) -> DataFrame:
    """(id, rule): records of a sites document (id, name, type, x, z, provenance) that break its contract: a key missing, an id twice, a place without numbers, another provenance than measured."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    n = docs.groupBy(F.col("id").alias("__id")).agg(F.count("*").alias("__n"))
    j = docs.join(n, F.expr("id <=> __id"), "left")
    return j.select("id", _broken(("key", F.col("id").isNull() | F.col("name").isNull() | F.col("type").isNull()), ("twice", F.col("__n") > 1), ("position", ~(finite("x") & finite("z"))), ("provenance", ~F.col("provenance").eqNullSafe(F.lit("measured"))))).distinct()


def polyline_rules(v: DataFrame, stated: DataFrame, bounds: tuple[float, float, float, float], spacing: float, tolerance: float = 0.5) -> DataFrame:
    """(feature_id, rule): lines that break their contract: under three points, not finite, out of bounds, points too far apart, closed twice, or longer or shorter than stated."""
    from tarnscape.operators import vectors

    x0, y0, x1, y1 = bounds
    bad = F.isnan("x") | F.isnan("y") | (F.abs("x") == float("inf")) | (F.abs("y") == float("inf")) | F.col("x").isNull() | F.col("y").isNull()
    first, last = F.min_by(F.struct("x", "y"), "seq"), F.max_by(F.struct("x", "y"), "seq")
    g = v.groupBy("feature_id").agg(F.count("*").alias("n"), F.bool_or(bad).alias("bad"), F.bool_or((F.col("x") < x0) | (F.col("x") > x1) | (F.col("y") < y0) | (F.col("y") > y1)).alias("out"), (F.bool_or("closed") & (first == last) & (F.count("*") > 1)).alias("twice"))
    w = vectors.segments(v).groupBy("feature_id").agg(F.max("len").alias("gap"), F.sum("len").alias("length"))
    j = g.join(w, "feature_id", "left").join(stated, "feature_id", "left")
    return j.select("feature_id", _broken(("points", F.col("n") < 3), ("finite", F.col("bad")), ("bounds", F.col("out")), ("spacing", F.col("gap") > spacing), ("closed", F.col("twice")), ("length", F.abs(F.col("length") - F.col("stated")) > tolerance)))


#: Forms of plants and kinds of dynamic classes.
FORMS, KINDS = ("conifer", "broadleaf", "reeds", "shrub"), ("water", "shore-band")


def legend_rules(rows: DataFrame) -> DataFrame:
    """(site, rule): legends (site, idx, id, color, form, density, kind, fraction) that break their contract.

    Indices from 0 without gaps, ids once, colours as # and six hex digits, a form with its
    density, each dynamic kind once, fractions that sum to 1 within a thousandth."""
    color = F.col("color").rlike(r"^#[0-9a-fA-F]{6}$")
    form = F.when(F.col("form").isNotNull(), F.col("form").isin(*FORMS) & (F.col("density") > 0))
    g = rows.groupBy("site").agg(
        F.count("*").alias("n"), F.count_distinct("idx").alias("ids"), F.min("idx").alias("low"), F.max("idx").alias("high"), F.count_distinct("id").alias("names"), F.bool_and(F.coalesce(color, F.lit(False))).alias("colors"),
        F.bool_and(F.coalesce(form, F.col("form").isNull())).alias("forms"), (F.count("kind") - F.count_distinct("kind")).alias("again"), F.bool_or(~F.col("kind").isin(*KINDS)).alias("odd"), F.sum("fraction").alias("total"),
    )
    gap = (F.col("ids") != F.col("n")) | (F.col("low") != 0) | (F.col("high") != F.col("n") - 1)
    return g.select("site", _broken(("indices", gap), ("ids", F.col("names") != F.col("n")), ("colors", ~F.col("colors")), ("vegetation", ~F.col("forms")), ("dynamic", (F.col("again") > 0) | F.col("odd")), ("fractions", F.abs(F.col("total") - 1) > 0.001)))


def manifest_rules(manifests: DataFrame) -> DataFrame:
    """(slug, rule): manifests (slug, grids, assets, provenance) that break their contract.

    grids: array of (name, half_m, res, size, scale, low, high, path), from the finest. Sizes
    fit bounds and cells, scales are known, bands aren't upside down, each grid is wider and
    no finer than the one before, paths are relative and stay inside, shoreline and connect
    come together, provenance says measured, modelled or mixed."""
    each = lambda bad: F.exists("grids", bad)
    pairs = F.arrays_zip(F.slice(F.col("grids"), 1, F.greatest(F.lit(0), F.size("grids") - 1)).alias("a"), F.slice(F.col("grids"), 2, F.size("grids")).alias("b"))
    z = manifests.withColumn("__pairs", pairs)
    both = F.map_contains_key("assets", F.lit("shoreline")) != F.map_contains_key("assets", F.lit("connect"))
    unsafe = lambda p: p.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)|\\\\")
    return z.select("slug", _broken(
        ("size", each(lambda g: g["size"] * g["res"] != 2 * g["half_m"])), ("scale", each(lambda g: ~g["scale"].isin(*SCALES))), ("band", each(lambda g: g["low"] > g["high"])),
        ("containment", F.exists("__pairs", lambda p: p["b"]["half_m"] <= p["a"]["half_m"])), ("coarser", F.exists("__pairs", lambda p: p["b"]["res"] < p["a"]["res"])),
        ("path", each(lambda g: unsafe(g["path"]))), ("pair", both), ("provenance", ~F.coalesce(F.col("provenance").isin("measured", "modelled", "mixed"), F.lit(False))),
    ))


# ---- registers -------------------------------------------------------------------------------


def register_document(entries: DataFrame, page: int = 1000) -> DataFrame:
    """(page, entry, doc): a register as documents of its entries (slug, county, name, ...), a row each, with page and place in the order of county and name.

    Pages of a bounded size; a register of any size is never in one row. The order is dealt
    out by ranges, so no task holds all entries."""
    from tarnscape.session import cut

    order = [F.col("county"), F.col("name"), F.col("slug")]
    ranged = cut(entries.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "register")
    ahead = ranged.groupBy("__p").count().select(F.col("__p").alias("__q"), F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__a"))
    n = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    j = ranged.withColumn("__n", n).join(F.broadcast(ahead), F.col("__p") == F.col("__q")).withColumn("entry", F.col("__n") + F.col("__a"))
    return j.select(F.expr(f"entry div {page}").alias("page"), "entry", F.to_json(F.struct(*entries.columns)).alias("doc"))


def looked_up(wanted: DataFrame, register: DataFrame, presets: DataFrame, specs: DataFrame) -> DataFrame:
    """The configuration of wanted slugs, a row for each grid of the site's preset; ``known`` is false for slugs that the register lacks."""
    j = wanted.join(register.withColumn("known", F.lit(True)), "slug", "left").join(F.broadcast(presets), "preset", "left").join(F.broadcast(specs), "preset", "left")  # fixed tables
    return j.withColumn("known", F.coalesce("known", F.lit(False)))
