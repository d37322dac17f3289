"""Geometry blobs: a binary column to kinds and rings, with what can't be read put aside."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHAPE = "kind string, rings array<struct<hole boolean, pts array<struct<x double, y double>>>>, error string"
#: Bytes of the envelope behind each code in a blob's flags.
ENVELOPE = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
RANK = ("polygon", "line", "point")


class _Reader:
    """Reads one geometry: seven types, two or more dimensions, either byte order."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.found = raw, 0, []

    def take(self, form: str) -> tuple:
        out = struct.unpack_from(form, self.raw, self.at)
        self.at += struct.calcsize(form)
        return out

    def count(self, order: str, least: int) -> int:
        (n,) = self.take(order + "I")
        if n * least > len(self.raw) - self.at:
            raise ValueError("more parts than bytes")
        return n

    def points(self, order: str, dims: int, n: int) -> list[dict]:
        flat = self.take(f"{order}{n * dims}d")
        return [{"x": flat[i * dims], "y": flat[i * dims + 1]} for i in range(n)]

    def geometry(self, depth: int = 0) -> None:
        if depth > 8:
            raise ValueError("nested too deeply")
        (mark,) = self.take("B")
        if mark > 1:
            raise ValueError(f"byte order {mark}")
        order = ">" if mark == 0 else "<"
        (code,) = self.take(order + "I")
        dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        if code & 0x20000000:
            self.take(order + "I")
        code &= 0x0FFFFFFF
        dims, kind = dims + {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000], code % 1000
        if kind == 1:
            self.found.append(("point", False, self.points(order, dims, 1)))
        elif kind == 2:
            self.found.append(("line", False, self.points(order, dims, self.count(order, 8 * dims))))
        elif kind == 3:
            for k in range(self.count(order, 4)):
                self.found.append(("polygon", k > 0, self.points(order, dims, self.count(order, 8 * dims))))
        elif kind in (4, 5, 6, 7):
            for _ in range(self.count(order, 5)):
                self.geometry(depth + 1)
        else:
            raise ValueError(f"geometry type {kind}")


def decoded(raw: bytes | None) -> tuple[str | None, list | None, str | None]:
    """(kind, rings, error) of a blob with or without a container header; the richest kind in it counts."""
    try:
        if not raw:
            return None, None, "empty"
        r = _Reader(bytes(raw))
        if raw[:2] == b"GP":
            flags = raw[3]
            if flags & 0x10:
                return None, None, "empty"
            r.at = 8 + ENVELOPE[flags >> 1 & 7]
        r.geometry()
        parts = [p for p in r.found if p[2]]
        if not parts:
            return None, None, "empty"
        kind = min((p[0] for p in parts), key=RANK.index)
        return kind, [{"hole": hole, "pts": pts} for k, hole, pts in parts if k == kind], None
    except (struct.error, ValueError, KeyError, IndexError) as e:
        return None, None, f"{type(e).__name__}: {e}"


def decode_geometry(df: DataFrame, column: str = "geom") -> DataFrame:
    """Adds kind, rings and error for a binary column, in place of it; a row that can't be read has only an error, and none is lost."""

    @F.pandas_udf(SHAPE)
    def read(blobs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decoded(b) for b in blobs], columns=["kind", "rings", "error"])

    rest = [c for c in df.columns if c not in (column, "kind", "rings", "error")]
    return df.withColumn("__g", read.asNondeterministic()(column)).select(*rest, "__g.*")


def vertex_rows(decoded_rows: DataFrame, key: str) -> DataFrame:
    """(feature_id, ring, seq, x, y, closed, hole): vertices of decoded geometries, without a ring's repeated last point."""
    ring = decoded_rows.where("error IS NULL").select(F.col(key).alias("feature_id"), "kind", F.posexplode("rings").alias("ring", "r"))
    n = F.size("r.pts")
    twice = (F.col("kind") == "polygon") & (n > 1) & (F.element_at("r.pts", 1) == F.element_at("r.pts", -1))
    pts = F.when(twice, F.slice("r.pts", 1, n - 1)).otherwise(F.col("r.pts"))
    v = ring.select("feature_id", "ring", (F.col("kind") == "polygon").alias("closed"), F.col("r.hole").alias("hole"), F.posexplode(pts).alias("i", "p"))
    return v.select("feature_id", "ring", (F.col("i") + 1).alias("seq"), "p.x", "p.y", "closed", "hole")


def encoded_outlines(v: DataFrame) -> DataFrame:
    """(feature_id, geom): outlines of (feature_id, ring, seq, x, y, closed) as blobs with a header, points with a height."""

    @F.pandas_udf("binary")
    def pack(closed: pd.Series, points: pd.Series) -> pd.Series:
        return pd.Series([_encoded(bool(c), p) for c, p in zip(closed, points, strict=True)])

    # an outline is one row, as in any table of geometries
    one = v.groupBy("feature_id").agg(F.bool_or("closed").alias("closed"), F.array_sort(F.collect_list(F.struct("ring", "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("points"))
    return one.select("feature_id", pack("closed", "points").alias("geom"))


def _encoded(closed: bool, points) -> bytes:
    parts: dict[int, list] = {}
    for p in points:
        parts.setdefault(p["ring"], []).append((p["x"], p["y"]))
    out = []
    for pts in parts.values():
        pts = pts + pts[:1] if closed else pts
        out.append(struct.pack("<I", len(pts)) + b"".join(struct.pack("<3d", x, y, 5.0) for x, y in pts))
    head = b"GP\x00\x01" + struct.pack("<i", 3006) + b"\x01" + struct.pack("<II", 1003 if closed else 1005, len(out))
    return head + b"".join(out if closed else [b"\x01" + struct.pack("<I", 1002) + p for p in out])
