"""Partitioned sample store, retention, exports and tolerant reads."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import epoch_s, month_key, week_key
from ..schema import METRICS


def with_month_keys(df: DataFrame, metric: str) -> DataFrame:
    m = METRICS[metric]
    return df.withColumns({"yyyymm": month_key(F.col(m.ts)), "host_id": F.col(m.host)})


def with_week_key(df: DataFrame, metric: str) -> DataFrame:
    return df.withColumn("yyyyiw", week_key(F.col(METRICS[metric].ts)))


def write_samples(df: DataFrame, root: str, metric: str, files_per_partition: int = 8) -> None:
    """Append samples partitioned by month and host.

    Rows are first spread by (month, host, salt): a busy host is written by several tasks and a
    small one still ends in few files.
    """
    m = METRICS[metric]
    salt = F.pmod(F.xxhash64(*([*m.keys] or [m.ts])), F.lit(files_per_partition))
    keyed = with_month_keys(df, metric).withColumn("_salt", salt)
    (
        keyed.repartition("yyyymm", "host_id", "_salt").drop("_salt")
        .write.mode("append").partitionBy("yyyymm", "host_id").parquet(f"{root}/{metric}")
    )


def write_locks(df: DataFrame, root: str, metric: str = "blocking_locks", files_per_partition: int = 8) -> None:
    """Append lock or process rows partitioned by ISO week."""
    m = METRICS[metric]
    salt = F.pmod(F.xxhash64(m.host, m.ts), F.lit(files_per_partition))
    keyed = with_week_key(df, metric).withColumn("_salt", salt)
    (
        keyed.repartition("yyyyiw", "_salt").drop("_salt")
        .write.mode("append").partitionBy("yyyyiw").parquet(f"{root}/{metric}")
    )


def expired_partitions(df: DataFrame, *, as_of: date | datetime | None = None, months: int = 6, cutoff: str | None = None) -> DataFrame:
    """Month partitions older than a cutoff month, at least two months back. Lists only."""
    if cutoff is None:
        if months < 2:
            raise ValueError("keep at least two months")
        back = as_of.year * 12 + as_of.month - 1 - months
        cutoff = f"{back // 12:04d}{back % 12 + 1:02d}"
    return df.select(F.col("yyyymm").cast("string").alias("yyyymm")).distinct().where(F.col("yyyymm") < cutoff)


def expired_weeks(df: DataFrame, as_of: datetime, weeks: int = 4) -> DataFrame:
    """Week partitions older than ``weeks`` weeks before ``as_of``. Lists only."""
    limit = F.lit(as_of).cast("timestamp") - F.expr(f"interval {7 * weeks} days")
    return df.select(F.col("yyyyiw").cast("string").alias("yyyyiw")).distinct().where(F.col("yyyyiw") < week_key(limit))


def resume_point(target: DataFrame, keys: Sequence[str], ts: str, known: DataFrame, as_of, days: int = 3) -> DataFrame:
    """Last stored timestamp per key of ``known``; ``days`` back where nothing is stored yet."""
    last = target.groupBy(*keys).agg(F.max(ts).alias("last_ts"))
    fallback = F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days")
    return known.join(last, list(keys), "left").select(*keys, F.coalesce("last_ts", fallback).alias("resume_from"))


def new_samples(df: DataFrame, resume: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Rows newer than the resume point of their key; the least resume point prunes a partitioned store."""
    low = resume.agg(F.min("resume_from")).scalar()
    df = df.where(F.col(ts) > low)
    if "yyyymm" in df.columns:
        df = df.where(F.col("yyyymm") >= month_key(low).cast("int"))
    return df.join(resume, list(keys)).where(F.col(ts) > F.col("resume_from")).drop("resume_from")


def conform(df: DataFrame, metric: str) -> DataFrame:
    """Give an older source the columns of the current schema: missing counters become 0,
    missing times the epoch, missing names null."""
    m = METRICS[metric]
    have = set(df.columns)
    out: list[Column] = []
    for f in m.struct().fields:
        if f.name in have:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.name == m.ts:
            out.append(F.timestamp_seconds(F.lit(0)).alias(f.name))
        elif f.name in (*m.counters, *m.gauges):
            out.append(F.lit(0).cast(f.dataType).alias(f.name))
        else:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*out)


def to_points(df: DataFrame, measurement: str, tags: Sequence[str], fields: Sequence[str], ts: str) -> DataFrame:
    """Time-series points: measurement, tags, fields and whole epoch seconds."""
    return df.select(
        F.lit(measurement).alias("measurement"),
        F.struct(*tags).alias("tags"),
        F.struct(*fields).alias("fields"),
        epoch_s(F.col(ts)).alias("time"),
    )


def write_points(points: DataFrame, path: str, fmt: str = "json") -> None:
    points.write.mode("append").partitionBy("measurement").format(fmt).save(path)


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row: timestamps without fractions, decimals as text."""
    cols = [
        F.col(n).cast("string").alias(n) if t.startswith("decimal") else F.col(n)
        for n, t in df.dtypes
    ]
    options = {"timestampFormat": "yyyy-MM-dd HH:mm:ss", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss",
               "dateFormat": "yyyy-MM-dd", "ignoreNullFields": "false"}
    return df.select(F.to_json(F.struct(*cols), options).alias("json"))


def to_grouped_lists(ranked: DataFrame, key: str, name: str, rank: str) -> DataFrame:
    """Names per key in rank order; the frame must hold a bounded number of ranks per key."""
    entry = F.struct(F.col(rank).alias("r"), F.col(name).alias("n"))
    lists = ranked.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("l"))
    return lists.select(key, F.transform("l", lambda e: e["n"]).alias("names"))
