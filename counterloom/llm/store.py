"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether an execution's shuffle files are removed at its end; known since Spark 4.1, without effect before.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset, as in tests, a folder of the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table and read it back: later steps start from files that outlive any executor."""
    path, conf = new_path(df.sparkSession, label), df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")  # what was shuffled for the table goes once the table stands
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_digest(text: Column) -> Column:
    """SHA-256 of a text, never null: what texts decide, they decide for all rows that hold them, with any id or none."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def hashed_sample(rows: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """At most ``limit`` of the distinct values of ``keys``, about those with the smallest hashes: each task keeps its share, not
    ``limit`` rows. A value counts once however many rows repeat it."""
    values = rows.select(*keys).distinct()
    n = values.count()
    if n <= limit:
        return values
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << 30))
    return values.where(place < int((1 << 30) * limit / n)).orderBy(place, *keys).limit(limit)
