"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import weakref
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "tarnscape") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TARNSCAPE_DRIVER_MEMORY", "10g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, as the cluster sets it.

    A session on one machine (tests, benchmarks) that names none gets a temporary one; on a
    cluster that is an error, as executors wouldn't see the driver's folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
    return named


#: Where cut() and others wrote, in order, and which frame reads which.
_written: list[str] = []
_path_of: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder; what is written there goes at the end of a scratch()."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def cut(df: DataFrame, what: str = "step") -> DataFrame:
    """Write a frame to the shared folder and read it back, which cuts its lineage.

    The written table outlives lost executors, unlike a cached or local copy."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _path_of[back] = path
    return back


def large(df: DataFrame) -> DataFrame:
    """For one side of a join that must not be broadcast: both sides are sorted and merged.

    Spark counts a row that explode or Python makes many of as one, and a file by its packed
    bytes, so it takes such a table for small and would send it whole through the driver."""
    return df.hint("merge")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _written:
        _written.remove(path)


def drop(df: DataFrame | None) -> None:
    """Delete what cut() wrote; for steps that nothing reads any more."""
    if df is not None and df in _path_of:
        _delete(df.sparkSession, _path_of.pop(df))


@contextmanager
def scratch(spark: SparkSession, *kept: DataFrame):
    """Deletes, at its end, what was written to the shared folder inside, but for the frames that ``keep`` was given.

    For a result that is written inside: everything that led to it goes."""
    before, keep = set(_written), []
    try:
        yield keep.append
    finally:
        safe = {_path_of.get(df) for df in [*kept, *keep]}
        for path in [p for p in _written if p not in before and p not in safe]:
            _delete(spark, path)


@contextmanager
def arrow_rows(spark: SparkSession, most: int):
    """Inside, tasks of Python get at most so many rows at once; for large rows, around what is run at once (see cut)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tidy(make):
    """For a query of (spark, sf_dir): its result is written, and all that led to it is deleted."""

    @wraps(make)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with scratch(spark) as keep:
            out = cut(make(spark, sf_dir), make.__name__)
            keep(out)
        return out

    return run
