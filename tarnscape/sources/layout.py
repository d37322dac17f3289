"""Features on disk along a space-filling curve, and scans of a window that open only the files that can hold it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = ("min_e", "max_e", "min_n", "max_n")


def hilbert(x: Column, y: Column, bits: int = 16) -> Column:
    """Place of the cell (x, y), each of ``bits`` bits, on the Hilbert curve; cells that follow each other touch."""

    def step(acc: Column, s: Column) -> Column:
        side = F.call_function("shiftleft", F.lit(1).cast("long"), s)
        right, up = acc["x"].bitwiseAND(side) != 0, acc["y"].bitwiseAND(side) != 0
        quarter = F.when(right, F.when(up, 2).otherwise(3)).otherwise(F.when(up, 1).otherwise(0))
        # the lower quarters are turned, so that the curve goes on at the border
        turned = lambda v: F.when(right, F.lit((1 << bits) - 1) - v).otherwise(v)
        a, b = F.when(up, acc["x"]).otherwise(turned(acc["y"])), F.when(up, acc["y"]).otherwise(turned(acc["x"]))
        return F.struct(a.alias("x"), b.alias("y"), (acc["d"] * 4 + quarter).alias("d"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["d"])


def write_features(features: DataFrame, path: str, per_file: int = 100_000, bits: int = 16) -> None:
    """Writes features with an envelope (min_e, max_e, min_n, max_n) to ``path``/features, and the envelopes of its files to ``path``/files.

    Features are range-partitioned by size class, then by the place of their middle on a
    Hilbert curve over the whole extent. A class holds envelopes up to 1/2, 1/4, ... of the
    extent, so that a few wide ones don't widen the files of the many small ones. Ranges are
    sampled, so a crowded spot fills as many files as it needs. Features without an envelope
    come last, in files of their own. Extra columns stay as they are."""
    f = features
    box = f.agg(F.min("min_e").alias("e0"), F.max("max_e").alias("e1"), F.min("min_n").alias("n0"), F.max("max_n").alias("n1"), F.count(F.lit(1)).alias("rows")).first()
    e0, n0 = box["e0"] or 0, box["n0"] or 0
    side = max(float((box["e1"] or 0) - e0), float((box["n1"] or 0) - n0), 1e-9)
    cell = lambda lo, hi, zero: F.least(F.lit((1 << bits) - 1), F.floor(((F.col(lo) + F.col(hi)) / 2 - zero) / side * (1 << bits)))
    wide = F.greatest(F.col("max_e") - F.col("min_e"), F.col("max_n") - F.col("min_n")) / side
    size_class = F.least(F.lit(bits), F.when(wide > 0, F.floor(-F.log2(wide))).otherwise(bits)).cast("int")
    whole = F.lit(True)
    for c in ENVELOPE:
        whole = whole & F.col(c).isNotNull()
    keyed = f.withColumn("__class", F.when(whole, size_class)).withColumn("__at", F.when(whole, hilbert(cell("min_e", "max_e", e0), cell("min_n", "max_n", n0), bits)))
    order = [F.col("__class").isNull(), F.col("__class"), F.col("__at"), F.xxhash64(*[F.col(c) for c in ENVELOPE], F.monotonically_increasing_id())]
    files = max(1, -(-box["rows"] // per_file))
    ranged = keyed.withColumn("__tie", order[3]).repartitionByRange(files, order[0], "__class", "__at", "__tie")
    ranged.sortWithinPartitions(order[0], "__class", "__at").drop("__class", "__at", "__tie").write.parquet(f"{path}/features")
    written = f.sparkSession.read.parquet(f"{path}/features")
    each = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(*[(F.min if c.startswith("min") else F.max)(c).alias(c) for c in ENVELOPE], F.count(F.lit(1)).alias("features"))
    each.coalesce(1).write.parquet(f"{path}/files")


def touches(e0: float, e1: float, n0: float, n1: float) -> Column:
    """Envelopes that touch the window; an edge in common counts."""
    return (F.col("max_e") >= e0) & (F.col("min_e") <= e1) & (F.col("max_n") >= n0) & (F.col("min_n") <= n1)


def files_of(spark: SparkSession, path: str, window: tuple[float, float, float, float]) -> list[str]:
    """The files whose envelope touches the window (e0, e1, n0, n1): one row a file is looked at, and no feature."""
    return [r["file"] for r in spark.read.parquet(f"{path}/files").where(touches(*window)).select("file").collect()]


def scan_window(spark: SparkSession, path: str, window: tuple[float, float, float, float], where: Column | None = None) -> DataFrame:
    """The features whose envelope touches the window, whole, as written by write_features.

    Only files whose own envelope touches it are opened; in them, row groups are pruned by
    the statistics of the four columns, and by ``where``, which is pushed down too."""
    files = files_of(spark, path, window)
    all_of = spark.read.parquet(f"{path}/features")
    if not files:
        return all_of.limit(0)
    got = spark.read.schema(all_of.schema).parquet(*files).where(touches(*window))
    return got if where is None else got.where(where)
