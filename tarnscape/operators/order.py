"""Exact order statistics of groups of any size, by radix selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from tarnscape.session import cut

#: Low bits left after each pass over the 64-bit keys: histograms of 24, 20 and 20 bits.
SHIFTS = (40, 20, 0)
_MOST = np.int64(2**63 - 1)


@F.pandas_udf(LongType())
def _key(v: pd.Series) -> pd.Series:
    """A number that sorts as the double does; both zeros are one."""
    bits = (v.to_numpy(np.float64, na_value=np.nan) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ _MOST, bits))


@F.pandas_udf(DoubleType())
def _value(k: pd.Series) -> pd.Series:
    bits = k.to_numpy(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ _MOST, bits).view(np.float64))


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """(keys, one column for each of ``wanted``, name to share): percentiles of ``value`` in each group, interpolated between neighbours.

    As percentile() gives them, but for the memory: no task holds a group. Each value becomes
    a 64-bit key in the order of doubles. A first pass counts the keys' 24 high bits, which
    combines before the shuffle; of the bucket that holds a wanted rank the next pass counts
    20 more bits, the third the rest. So a group has 2**24 counters in the first pass and
    2**20 for each wanted rank in the others at most, whatever its rows and ties.

    Nulls and NaN don't count. Groups without a value are absent; null keys
    are a group."""
    named, keys = keys, [f"g{i}" for i in range(len(keys))]  # of any name outside
    own = [F.col(c).alias(g) for c, g in zip(named, keys, strict=True)]
    base = cut(rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*own, _key(F.col(value).cast("double")).alias("k")), "keys")
    same = lambda a, b, more="": F.expr(" AND ".join(f"{a}.{c} <=> {b}.{c}" for c in keys) + more) if keys else F.expr("true" + more)
    bucket = lambda shift: F.shiftright("k", shift).alias("bucket")
    n = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    places = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("n") - 1) * p), F.ceil((F.col("n") - 1) * p)) for p in wanted.values()])))
    targets = n.select(*keys, F.explode(places).alias("rank")).withColumn("rest", F.col("rank"))
    for last, shift in zip((None, *SHIFTS), SHIFTS, strict=False):
        first = last is None
        rows_in = base.select(*keys, bucket(shift)) if first else base.select(*keys, bucket(shift), F.shiftright("k", last).alias("above"))
        if not first:  # only what shares its high bits with a wanted rank
            some = targets.select(*keys, "above").distinct()
            rows_in = rows_in.alias("a").join(some.alias("b"), same("a", "b", " AND a.above = b.above"), "left_semi")
        parts = keys if first else [*keys, "above"]
        count = rows_in.groupBy(*parts, "bucket").agg(F.count(F.lit(1)).alias("c"))
        before = F.coalesce(F.sum("c").over(Window.partitionBy(*parts).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        count = count.withColumn("before", before)
        meet = "" if first else " AND t.above = h.above"
        holds = " AND t.rest >= h.before AND t.rest < h.before + h.c"
        found = targets.alias("t").join(count.alias("h"), same("t", "h", meet + holds))
        targets = found.select(*[F.col(f"t.{c}").alias(c) for c in keys], "t.rank", (F.col("t.rest") - F.col("h.before")).alias("rest"), F.col("h.bucket").alias("above"))
    at = targets.select(*keys, "rank", _value("above").alias("v"))
    found = at.alias("x").join(n.alias("y"), same("x", "y")).select(*[F.col(f"x.{c}").alias(c) for c in keys], "rank", "v", "n")
    out = []
    for name, p in wanted.items():
        place = (F.col("n") - 1) * p
        low, high = (F.max(F.when(F.col("rank") == f(place), F.col("v"))) for f in (F.floor, F.ceil))
        share = F.max(place - F.floor(place))
        out.append(F.when(low == high, low).otherwise(low + (high - low) * share).alias(name))
    return found.groupBy(*keys).agg(*out).select(*[F.col(g).alias(c) for c, g in zip(named, keys, strict=True)], *wanted)
