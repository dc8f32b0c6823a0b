"""Top-k, latest-row and share-of-total operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, part: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per group. Spark limits each group before and after the shuffle, so a
    hot group sends at most ``n`` rows per task. End ``order`` with a unique key."""
    name = rank or "_rn"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def top_rank(df: DataFrame, part: Sequence[str | Column], order: Sequence[Column], n: int) -> DataFrame:
    """Rows whose rank within the group is at most ``n``; ties share a rank."""
    out = df.withColumn("_rank", F.rank().over(Window.partitionBy(*part).orderBy(*order)))
    return out.where(F.col("_rank") <= n).drop("_rank")


def latest(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """Values at the latest timestamp of each key, as a map-side combined aggregate."""
    return df.groupBy(*keys).agg(F.max(ts).alias(ts), *(F.max_by(c, ts).alias(c) for c in cols))


def top(df: DataFrame, order: Sequence[Column], n: int | None) -> DataFrame:
    ordered = df.orderBy(*order)
    return ordered if n is None else ordered.limit(n)


def top_per_mode(df: DataFrame, modes: dict[str, Column], part: Sequence[str], ties: Sequence[str], n: int) -> DataFrame:
    """Top ``n`` rows per group for each named order, in one pass: rows are fanned out to the
    modes that accept them (a null order value opts out) and limited per (group, mode)."""
    entries = F.array(
        *(F.struct(F.lit(name).alias("mode"), value.cast("double").alias("v")) for name, value in modes.items())
    )
    fanned = df.withColumn("_m", F.explode(F.filter(entries, lambda e: e["v"].isNotNull())))
    fanned = fanned.select("*", F.col("_m.mode").alias("mode"), F.col("_m.v").alias("_v")).drop("_m")
    order = [F.col("_v").desc(), *(F.col(t).asc() for t in ties)]
    return top_n(fanned, [*part, "mode"], order, n).drop("_v")


def grand_total(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add the total over all rows: one aggregate used as a scalar, no single-task window."""
    return df.withColumn(name, df.agg(F.sum(value)).scalar())


def share_of(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` per ``keys``; for aggregated frames, which are shuffled once on the keys."""
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys)))
