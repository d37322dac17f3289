"""Grids on disk: square tiles of quantized heights as rows, read back as cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnscape.operators.raster import tiles

NODATA = -32768


def write_tiles(cells: DataFrame, path: str, scale: float, tile: int = 256) -> None:
    """One row a tile: (grid_id, tr, tc, tile, scale, raw), raw little-endian 16-bit steps row by row, NODATA where there is no height.

    Heights that don't fit 16 bits raise: an overflow is an error, not a wrap. Tiles go to a
    folder for each grid, in order, so a window reads few of them."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(pdf["tr"].iloc[0]), int(pdf["tc"].iloc[0])
        a = np.full((tile, tile), NODATA, np.int64)
        q = np.rint(pdf["z"].to_numpy(np.float64, na_value=np.nan) / scale)
        ok = ~np.isnan(q)
        if (np.abs(q[ok]) > 32767).any():
            raise ValueError(f"heights of tile {tr}, {tc} don't fit 16 bits at scale {scale}")
        a[pdf["r"].to_numpy()[ok] - tr * tile, pdf["c"].to_numpy()[ok] - tc * tile] = q[ok].astype(np.int64)
        return pd.DataFrame({"grid_id": pdf["grid_id"].iloc[:1], "tr": [tr], "tc": [tc], "tile": [tile], "scale": [scale], "raw": [a.astype("<i2").tobytes()]})

    packed = tiles(cells.select("grid_id", "r", "c", "z"), tile).groupBy("grid_id", "tr", "tc").applyInPandas(pack, "grid_id long, tr int, tc int, tile int, scale double, raw binary")
    packed.repartitionByRange("grid_id", "tr", "tc").sortWithinPartitions("grid_id", "tr", "tc").write.partitionBy("grid_id").parquet(path)


def read_tiles(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, tile: int = 256) -> DataFrame:
    """(grid_id, r, c, z): the cells with a height; ``window`` (r0, r1, c0, c1) prunes tiles before they are read."""
    rows = spark.read.schema("grid_id long, tr int, tc int, tile int, scale double, raw binary").parquet(path)
    if window:
        r0, r1, c0, c1 = window
        rows = rows.where(F.col("tr").between(r0 // tile, r1 // tile) & F.col("tc").between(c0 // tile, c1 // tile))

    def unpack(batches):
        for b in batches:
            for g, tr, tc, n, scale, raw in zip(b["grid_id"], b["tr"], b["tc"], b["tile"], b["scale"], b["raw"], strict=True):
                a = np.frombuffer(raw, "<i2").reshape(n, n)
                r, c = np.nonzero(a != NODATA)
                yield pd.DataFrame({"grid_id": g, "r": r + tr * n, "c": c + tc * n, "z": a[r, c] * scale})

    cells = rows.mapInPandas(unpack, "grid_id long, r int, c int, z double")
    return cells.where(F.col("r").between(r0, r1) & F.col("c").between(c0, c1)) if window else cells
