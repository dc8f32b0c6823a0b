"""Unions, subtotals and tail merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def union(*frames: DataFrame) -> DataFrame:
    return union_all(*frames).distinct()


def merge_tail(stored: DataFrame, tail: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Stored aggregate plus live tail; where both have a bucket the larger value wins."""
    return union_all(stored, tail).groupBy(*keys).agg(F.max(value).alias(value))


def with_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Detail rows followed by their subtotal rows."""
    return df.unionByName(totals)
