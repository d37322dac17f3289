"""Column expressions: ids, quantization, projection, formatting and random draws."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLUG = r"^[a-z0-9][a-z0-9._-]*$"
EARTH_RADIUS_M = 6_371_000
REFRACTION_K = 0.13
HORIZON_KM = 3.83


def slug_for(name: Column) -> Column:
    """A path-safe id: lower case, other characters as one hyphen; null if nothing usable is left."""
    s = F.regexp_replace(F.replace(F.lower(F.trim(name)), F.lit(":"), F.lit("-")), r"[^a-z0-9._-]+", "-")
    s = F.regexp_replace(s, r"^-+|-+$", "")
    return F.when(s.rlike(SLUG), s)


def preset_for(span_m: Column) -> Column:
    return F.when(span_m > 1000, "large").otherwise("standard")


def quantize(height: Column, scale: float) -> Column:
    """Steps of a height, half to even; null where a SMALLINT would overflow."""
    q = F.rint(height / scale)
    return F.when(q.between(-32768, 32767), q.cast("int"))


def quantize_up(height: Column, scale: float) -> Column:
    """Steps rounded up, with a guard of a thousandth of a step."""
    return F.ceil(height / scale - 1e-3).cast("int")


def horizon_m(height: Column) -> Column:
    return F.sqrt(F.greatest(height, F.lit(0.0))) * HORIZON_KM * 1000.0


def refracted_drop_m(distance_sq: Column, k: float = REFRACTION_K) -> Column:
    return distance_sq * (1 - k) / (2 * EARTH_RADIUS_M)


def format_year(year: Column) -> Column:
    """'1050 BCE', '550 CE'; there is no year zero. Rounds half up."""
    y = F.floor(year + 0.5)
    return F.when(y > 0, F.concat(y.cast("string"), F.lit(" CE"))).when(y == 0, "1 BCE").otherwise(F.concat((-y).cast("string"), F.lit(" BCE")))


def one_place(x: Column) -> Column:
    """A number to a tenth as C's printf has it: by its exact binary value, ties to even. Java's format rounds ties up."""

    @F.pandas_udf("string")
    def shown(values: pd.Series) -> pd.Series:
        return values.map(lambda v: f"{v:.1f}", na_action="ignore")

    return shown(x)


def format_level(level: Column) -> Column:
    return F.concat(F.when(level >= 0, "+").otherwise(""), F.format_string("%.1f", level), F.lit(" m above present sea"))


def hydro_class(connect: Column, level: Column, band_m: float, raster_class: Column, water: int, band: int) -> Column:
    """Class at a water level: sea, else the band above it, else the raster's class; a class of -1 is off."""
    out = raster_class
    if band >= 0 and band_m > 0:
        out = F.when((connect > level) & (connect <= level + band_m), F.lit(band)).otherwise(out)
    return F.when(connect <= level, F.lit(water)).otherwise(out) if water >= 0 else out


def _wrap(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def _times(a: Column, b: Column) -> Column:
    """Low 32 bits of a product of two 32-bit numbers, in halves so that no long overflows."""
    low, high = a.bitwiseAND(F.lit(0xFFFF)), F.shiftright(a, 16)
    return _wrap(low * b + F.shiftleft(_wrap(high * b).bitwiseAND(F.lit(0xFFFF)), 16))


def draw(seed: Column, n: Column) -> Column:
    """The n-th draw (from 0) of a counter-based 32-bit generator, in [0, 1): any draw without those before."""
    a = _wrap(seed + (n + 1) * F.lit(0x6D2B79F5))
    t = _times(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR(_wrap(t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))))
    return t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(4294967296.0)


def draws(seed: Column, first: Column, count: int) -> Column:
    """An array of ``count`` draws from the ``first`` on, each step a lambda over the one before, so no expression is written out twice."""
    step = lambda x, f: F.transform(x, f)
    a = F.transform(F.sequence(F.lit(1), F.lit(count)), lambda k: _wrap(seed + (first + k) * F.lit(0x6D2B79F5)))
    t = step(a, lambda x: _times(x.bitwiseXOR(F.shiftright(x, 15)), x.bitwiseOR(F.lit(1))))
    u = step(t, lambda x: F.struct(x.alias("t"), _wrap(x + _times(x.bitwiseXOR(F.shiftright(x, 7)), x.bitwiseOR(F.lit(61)))).alias("u")))
    v = step(u, lambda x: x["t"].bitwiseXOR(x["u"]))
    return step(v, lambda x: x.bitwiseXOR(F.shiftright(x, 14)) / F.lit(4294967296.0))


def stream_seed(seed: Column, stream: Column) -> Column:
    """An own seed for each numbered stream."""
    return _times(_wrap(stream + 1), F.lit(0x9E3779B1).cast("long")).bitwiseXOR(_wrap(seed))


def _double(x: float) -> str:
    """A literal that every SQL dialect takes for a double."""
    return f"{x!r}" if "e" in repr(x) else f"{x!r}e0"


def sweref_expressions(lon: str, lat: str) -> tuple[str, str]:
    """SQL for easting and northing in SWEREF 99 TM, by the series of Gauss-Krueger projection on GRS 80."""
    a, f = 6378137.0, 1 / 298.257222101
    n = f / (2 - f)
    e2 = f * (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    ca, cb = (5 * e2**2 - e2**3) / 6, (104 * e2**3 - 45 * e2**4) / 120
    beta = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    p, d = f"radians({lat})", f"radians({lon} - 15e0)"
    s = f"sin({p})"
    conf = f"({p} - {s} * cos({p}) * ({_double(e2)} + {_double(ca)} * power({s}, 2) + {_double(cb)} * power({s}, 4)))"
    xi, eta = f"atan(tan({conf}) / cos({d}))", f"atanh(cos({conf}) * sin({d}))"
    north, east = xi, eta
    for i, b in enumerate(beta, 1):
        north += f" + {_double(b)} * sin({2 * i} * {xi}) * cosh({2 * i} * {eta})"
        east += f" + {_double(b)} * cos({2 * i} * {xi}) * sinh({2 * i} * {eta})"
    return f"500000e0 + 0.9996e0 * {_double(big)} * ({east})", f"0.9996e0 * {_double(big)} * ({north})"


def sweref_inverse(east: str, north: str) -> tuple[str, str]:
    """SQL for longitude and latitude in degrees of a place in SWEREF 99 TM, by the same series the other way."""
    a, f = 6378137.0, 1 / 298.257222101
    n = f / (2 - f)
    e2 = f * (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    delta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    star = [e2 + e2**2 + e2**3 + e2**4, -(7 * e2**2 + 17 * e2**3 + 30 * e2**4) / 6, (224 * e2**3 + 889 * e2**4) / 120, -(4279 * e2**4) / 1260]
    xi, eta = f"({north} / (0.9996e0 * {_double(big)}))", f"(({east} - 500000e0) / (0.9996e0 * {_double(big)}))"
    x, y = xi, eta
    for i, d in enumerate(delta, 1):
        x += f" - {_double(d)} * sin({2 * i} * {xi}) * cosh({2 * i} * {eta})"
        y += f" - {_double(d)} * cos({2 * i} * {xi}) * sinh({2 * i} * {eta})"
    p = f"asin(sin({x}) / cosh({y}))"
    s = f"sin({p})"
    series = " + ".join(f"({_double(c)}) * power({s}, {2 * i})" for i, c in enumerate(star))
    return f"15e0 + degrees(atan(sinh({y}) / cos({x})))", f"degrees({p} + {s} * cos({p}) * ({series}))"


def geographic_envelope(boxes: DataFrame, key: str, points: int = 101) -> DataFrame:
    """(key, west, south, east, north): longitudes and latitudes that boxes (min_e, min_n, max_e, max_n) cover, by ``points`` along each edge, as edges are curved."""
    k = F.expr(f"explode(sequence(0, {points - 1}))")
    b = boxes.select("*", k.alias("__k"))
    t = F.col("__k") / (points - 1)
    e, n = F.col("min_e") + (F.col("max_e") - F.col("min_e")) * t, F.col("min_n") + (F.col("max_n") - F.col("min_n")) * t
    at = lambda x, y: F.struct(x.alias("pe"), y.alias("pn"))
    p = b.select(key, F.inline(F.array(at(e, F.col("min_n")), at(e, F.col("max_n")), at(F.col("min_e"), n), at(F.col("max_e"), n))))
    lon, lat = sweref_inverse("pe", "pn")
    p = p.select(key, F.expr(lon).alias("lon"), F.expr(lat).alias("lat"))
    return p.groupBy(key).agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


def delta_of(ground: Column, connect: Column) -> Column:
    """Steps of connect above the ground; null, a violation, where they are below 0 or don't fit 15 bits."""
    d = connect - ground
    return F.when(d.between(0, 32767), d)


def undelta(ground: Column, delta: Column) -> Column:
    """Connect again from the ground and its delta; null where the sum doesn't fit 16 bits."""
    s = ground + delta
    return F.when(s.between(-32768, 32767), s)


def to_local(east: Column, north: Column, origin_e: Column, origin_n: Column) -> tuple[Column, Column]:
    """x and z in a site's frame, to a tenth of a metre; z points south."""
    return F.bround(east - origin_e, 1), F.bround(-(north - origin_n), 1)
