"""Rasters with their place in the world: blocks of heights as rows, read by bounds in metres."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODATA = -32768
LAYOUTS = ("tiles", "strips")
BLOCK = "grid_id long, layout string, r0 int, c0 int, h int, w int, scale double, crs string, res double, e0 double, n0 double, min_e double, max_e double, min_n double, max_n double, raw binary"


def write_raster(cells: DataFrame, places: DataFrame, path: str, scale: float, layout: str = "tiles", side: int = 256) -> None:
    """Writes cells (grid_id, r, c, z) in blocks: squares of ``side`` cells, or strips of ``side`` whole rows.

    ``places`` has grid_id, e0 and n0 (the north-western corner of cell 0, 0), res (metres a
    cell) and crs; grids without a place are refused. A block has its own bounds in metres,
    whatever the layout, and rows go in order of grid and place, so that the statistics of row
    groups prune a window. Heights are whole steps of ``scale``; what doesn't fit 16 bits
    raises. Null heights are NODATA, and blocks without a height aren't written."""
    if layout not in LAYOUTS:
        raise ValueError(f"layout {layout} is none of {LAYOUTS}")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        if pd.isna(first["res"]) or first["crs"] is None:
            raise ValueError(f"grid {first['grid_id']} has no place in the world")
        r, c = pdf["r"].to_numpy(np.int64), pdf["c"].to_numpy(np.int64)
        r0, c0 = int(r.min()), int(c.min())
        h, w = int(r.max()) - r0 + 1, int(c.max()) - c0 + 1
        q = np.rint(pdf["z"].to_numpy(np.float64) / scale)
        if (np.abs(q) > 32767).any():
            raise ValueError(f"heights of grid {first['grid_id']} don't fit 16 bits at scale {scale}")
        a = np.full((h, w), NODATA, "<i2")
        a[r - r0, c - c0] = q.astype(np.int64)
        e, n, res = first["e0"] + c0 * first["res"], first["n0"] - r0 * first["res"], first["res"]
        one = [first["grid_id"], layout, r0, c0, h, w, scale, first["crs"], res, first["e0"], first["n0"], e, e + w * res, n - h * res, n, a.tobytes()]
        return pd.DataFrame([one], columns=[x.split()[0] for x in BLOCK.split(", ")])

    block = [F.expr(f"int(floor(r / {side}))").alias("br"), (F.expr(f"int(floor(c / {side}))") if layout == "tiles" else F.lit(0)).alias("bc")]
    rows = cells.where("z IS NOT NULL").select("grid_id", "r", "c", F.col("z").cast("double").alias("z"), *block).join(places.select("grid_id", "e0", "n0", "res", "crs"), "grid_id", "left")
    packed = rows.groupBy("grid_id", "br", "bc").applyInPandas(pack, BLOCK)
    packed.repartitionByRange("grid_id", "r0", "c0").sortWithinPartitions("grid_id", "r0", "c0").write.parquet(path)


def read_raster(spark: SparkSession, path: str, bounds: tuple[float, float, float, float] | None = None, crs: str = "EPSG:3006") -> DataFrame:
    """(grid_id, r, c, e, n, z): the cells with a height whose middle (e, n) lies in ``bounds`` (e0, e1, n0, n1; edges count), in metres of ``crs``.

    Blocks outside the window aren't read, in either layout: their bounds are columns of
    their own, and the filter is pushed to the scan. A block in the window that is in another
    system is an error, found before any height is read."""
    blocks = spark.read.schema(BLOCK).parquet(path)
    if bounds:
        e0, e1, n0, n1 = bounds
        blocks = blocks.where((F.col("max_e") >= e0) & (F.col("min_e") <= e1) & (F.col("max_n") >= n0) & (F.col("min_n") <= n1))
    other = blocks.where(F.col("crs") != crs).select("crs").limit(1).collect()
    if other:
        raise ValueError(f"the raster is in {other[0]['crs']}, not in {crs}")

    def unpack(batches):
        for b in batches:
            for x in b.itertuples(index=False):
                a = np.frombuffer(x.raw, "<i2").reshape(x.h, x.w)
                r, c = np.nonzero(a != NODATA)
                z = a[r, c] * x.scale
                r, c = r + x.r0, c + x.c0
                yield pd.DataFrame({"grid_id": x.grid_id, "r": r, "c": c, "e": x.e0 + (c + 0.5) * x.res, "n": x.n0 - (r + 0.5) * x.res, "z": z})

    cells = blocks.mapInPandas(unpack, "grid_id long, r int, c int, e double, n double, z double")
    return cells.where(F.col("e").between(e0, e1) & F.col("n").between(n0, n1)) if bounds else cells
