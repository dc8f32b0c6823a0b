"""Derived tables that grow by refreshes, each committed as one version.

Below ``root`` lie ``rows``, the table itself; ``carry/<name>/version=N``, what the next refresh needs of the samples already
read; and ``log``, with a row per version that is written last. A refresh that broke off before its log row is
not seen: the next one starts from the version before it and writes the same folders again.

A table of periods is partitioned by them. Its periods up to ``closed`` are final and frozen; a refresh writes the later ones by dynamic partition
overwrite, so provisional periods are replaced and final partitions are neither read nor written again.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOG = "version long, closed timestamp"


def read_if_there(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of Parquet files, or no rows where nothing was written yet."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def moment(spark: SparkSession, at: Column) -> datetime:
    """A constant time, computed in the session's time zone."""
    return spark.range(1).select(at.cast("timestamp")).first()[0]


def closed_before(spark: SparkSession, as_of, unit: str) -> datetime:
    """Start of the first period that is not final: one is final when ``as_of`` is past its end."""
    return moment(spark, F.date_trunc(unit, F.lit(as_of).cast("timestamp") - F.expr("interval 1 microsecond")))


class VersionedTable:
    """A derived table below ``root``; see the module for its layout."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def head(self) -> tuple[int, datetime | None]:
        """Number of the last committed version, 0 before the first, and the time up to which it is closed."""
        top = read_if_there(self.spark, f"{self.root}/log", _LOG).orderBy(F.desc("version")).first()
        return (top["version"], top["closed"]) if top else (0, None)

    def carried(self, name: str, schema) -> DataFrame:
        """What the last committed version left for the next one."""
        return read_if_there(self.spark, f"{self.root}/carry/{name}/version={self.head()[0]}", schema)

    def carry(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/carry/{name}/version={self.head()[0] + 1}")

    def commit(self, closed: datetime) -> None:
        version = self.head()[0] + 1
        self.spark.createDataFrame([(version, closed)], _LOG).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/log/version={version}")

    # rows that are only ever added

    def append(self, df: DataFrame) -> None:
        """Rows of the version that the next commit makes visible."""
        df.write.mode("overwrite").parquet(f"{self.root}/rows/version={self.head()[0] + 1}")

    def written(self) -> DataFrame:
        """Rows of the version that the next commit makes visible."""
        return self.spark.read.parquet(f"{self.root}/rows/version={self.head()[0] + 1}")

    def appended(self) -> DataFrame:
        """Rows of all committed versions; the filter prunes folders."""
        return self.spark.read.parquet(f"{self.root}/rows").where(F.col("version") <= self.head()[0]).drop("version")

    # rows by period

    def replace(self, df: DataFrame, *periods: str) -> None:
        """Write whole periods in place of those stored."""
        spread = df.hint("rebalance", *periods)  # few files for small periods, several tasks for a large one
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*periods).parquet(f"{self.root}/rows")

    def periods(self, schema=None) -> DataFrame:
        """All periods, or no rows of ``schema`` before the first; filters on them prune folders."""
        try:
            return self.spark.read.parquet(f"{self.root}/rows")
        except AnalysisException as missing:
            if schema is None or missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return self.spark.createDataFrame([], schema)
