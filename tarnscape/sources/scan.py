"""Scans that count what they pass over, in the pass that filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def counted_scan(features: DataFrame, pushed: Column, usable: Column, wanted: Column) -> tuple[DataFrame, Observation]:
    """The rows that are usable and wanted, and an observation of scanned, unusable and kept; it has its numbers once the rows have been read.

    ``pushed`` goes to the source, and only rows that pass it are looked at at all. A row
    without usable geometry isn't scanned: it counts as unusable. Nulls in ``usable`` or
    ``wanted`` count as false. There is no second pass: the counts are metrics of the scan."""
    ok, want = F.coalesce(usable, F.lit(False)), F.coalesce(wanted, F.lit(False))
    seen = Observation()
    rows = features.where(pushed).observe(seen, F.count_if(ok).alias("scanned"), F.count_if(~ok).alias("unusable"), F.count_if(ok & want).alias("kept"))
    return rows.where(ok & want), seen
