"""Per-site state from an event log, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _last(value: Column, when: Column, at: str = "at") -> Column:
    return F.max_by(value, F.when(when, F.col(at)))


def fold_state(log: DataFrame) -> DataFrame:
    """(slug, built, qa_passed, bytes, uploaded, error): latest state of each site.

    ``log`` has slug, at (orderable), kind (build, upload, failure), ok and bytes. A build sets
    built, qa and bytes and clears the error; one that fails its gates takes an upload back;
    an upload clears the error; a failure only sets it. Every field is one aggregate over
    its own kinds of events, so the fold is a single map-side combined pass."""
    b, u, f = (F.col("kind") == k for k in ("build", "upload", "failure"))
    at = lambda c: F.max(F.when(c, F.col("at")))
    g = log.groupBy("slug").agg(
        F.coalesce(F.bool_or(b), F.lit(False)).alias("built"), _last(F.col("ok"), b).alias("qa_passed"), _last(F.col("bytes"), b).alias("bytes"),
        at(u).alias("__up"), at(b & ~F.col("ok")).alias("__bad"), at(f).alias("__fail"), at(b | u).alias("__fine"),
    )
    uploaded = F.col("__up").isNotNull() & (F.col("__bad").isNull() | (F.col("__up") > F.col("__bad")))
    failed = F.col("__fail").isNotNull() & (F.col("__fine").isNull() | (F.col("__fail") > F.col("__fine")))
    return g.select("slug", "built", "qa_passed", "bytes", uploaded.alias("uploaded"), failed.alias("error"))


def sync_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(slug, name, action): new, changed, unchanged or gone, by (slug, name) and digest."""
    a, b = local.withColumnRenamed("digest", "da"), remote.withColumnRenamed("digest", "db")
    action = F.when(F.col("db").isNull(), "new").when(F.col("da").isNull(), "gone").when(F.col("da") == F.col("db"), "unchanged").otherwise("changed")
    return a.join(b, ["slug", "name"], "full").select("slug", "name", action.alias("action"))


def _buckets(spark: SparkSession, state_dir: str) -> dict[int, tuple[int, str]]:
    """For each bucket of the state table the newest batch that wrote it, and where; unfinished batches don't count."""
    root = spark._jvm.org.apache.hadoop.fs.Path(state_dir)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    newest: dict[int, tuple[int, str]] = {}
    for batch in fs.listStatus(root) if fs.exists(root) else []:
        at, name = batch.getPath(), batch.getPath().getName()
        if name.startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")):
            number = int(name.removeprefix("batch="))
            for part in fs.listStatus(at):
                inside = part.getPath().getName()
                if inside.startswith("bucket="):
                    bucket = int(inside.removeprefix("bucket="))
                    newest[bucket] = max(newest.get(bucket, (-1, "")), (number, part.getPath().toString()))
    return newest


def _merge(changed: DataFrame, number: int, state_dir: str, buckets: int) -> None:
    """Puts the changed rows into the state table: the buckets that they fall into are written anew, once for each batch."""
    spark = changed.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{state_dir}/batch={number}/_SUCCESS")
    fs = done.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(done):  # a repeated batch
        return
    changed = changed.withColumn("bucket", F.pmod(F.xxhash64("slug"), F.lit(buckets)).cast("int")).persist()
    try:
        touched = {r["bucket"] for r in changed.select("bucket").distinct().collect()}
        old = [(b, path) for b, (_, path) in _buckets(spark, state_dir).items() if b in touched]
        if old:
            columns = [c for c in changed.columns if c != "bucket"]
            names = changed.select(F.col("slug").alias("__s"))
            now = changed.schema
            before = spark.read.schema(now).parquet(*[path for _, path in old]).drop("bucket")
            kept = before.join(names, F.expr("slug <=> __s"), "left_anti").withColumn("bucket", F.pmod(F.xxhash64("slug"), F.lit(buckets)).cast("int"))
            merged = changed.unionByName(kept.select(*columns, "bucket"))
        else:
            merged = changed
        if touched:
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state_dir}/batch={number}")
            for _, path in old:  # superseded, now that the batch is complete
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)
    finally:
        changed.unpersist()


def stream_state(spark: SparkSession, log_dir: str, schema, state_dir: str, checkpoint: str, buckets: int = 64):
    """Folds a folder of log files into the state table ``state_dir``, as files arrive. Gives the query.

    The fold is fold_state itself: a streaming aggregation whose keyed state is one row a
    slug, in Spark's state store under ``checkpoint``; no past event is read again. Each
    micro-batch hands on the slugs that it changed, and these replace their rows in the state
    table: its buckets (by hash of the slug) are written anew where they change. Every field
    is a maximum by time, so replayed and late events change nothing that they shouldn't. A
    batch counts when it is complete, and a repeated one is known by its number."""
    state = fold_state(spark.readStream.schema(schema).parquet(log_dir))
    keep = lambda batch, number: _merge(batch, number, state_dir, buckets)
    return state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(spark: SparkSession, state_dir: str) -> DataFrame:
    """The state table as the last complete batch left it: a row a slug, as fold_state gives it."""
    paths = [path for _, path in _buckets(spark, state_dir).values()]
    if not paths:
        raise FileNotFoundError(f"no complete batch in {state_dir}")
    return spark.read.parquet(*paths)
