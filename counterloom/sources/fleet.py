"""A fleet: the sample, dimension and event tables the reports read."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import month_key, week_key
from ..schema import METRICS
from ..session import configure
from .adapters import ADAPTERS, BASE_TABLES, references

#: Columns that partition stored sample tables.
PARTITIONS = ("yyyymm", "yyyyiw", "host_id")


class Fleet:
    """Named tables, opened on first use."""

    def __init__(self, spark: SparkSession, opener):
        self.spark = configure(spark)
        self._open = opener
        self._tables: dict[str, DataFrame] = {}

    @classmethod
    def from_store(cls, spark: SparkSession, root: str) -> "Fleet":
        """Tables written below ``root``, sample tables partitioned by month and host."""
        return cls(spark, lambda fleet, name: spark.read.parquet(f"{root}/{name}"))

    @classmethod
    def from_events(cls, spark: SparkSession, base_dir: str) -> "Fleet":
        """Tables derived from the event and order-line tables in ``base_dir``."""

        def opener(fleet: "Fleet", name: str) -> DataFrame:
            if name in BASE_TABLES:
                return spark.read.parquet(os.path.join(base_dir, f"{name}.parquet"))
            text = ADAPTERS[name]
            names = references(text, (*ADAPTERS, *BASE_TABLES))
            return spark.sql(text, **{n: fleet.table(n) for n in names})

        return cls(spark, opener)

    @classmethod
    def from_frames(cls, spark: SparkSession, frames: dict[str, DataFrame]) -> "Fleet":
        return cls(spark, lambda fleet, name: frames[name])

    def _stored(self, name: str) -> DataFrame:
        """A table as stored, with its partition columns."""
        if name not in self._tables:
            self._tables[name] = self._open(self, name)
        return self._tables[name]

    def table(self, name: str) -> DataFrame:
        """A whole table without partition columns; a report with a range reads sample tables through ``samples``."""
        return self._stored(name).drop(*PARTITIONS) if name in METRICS else self._stored(name)

    def samples(
        self, metric: str, host=None, start=None, end=None, lag: str | None = None, *, closed_start: bool = False, open_end: bool = False
    ) -> DataFrame:
        """Samples of one metric in (start - lag, end]; ``lag`` is an interval such as ``4 hours``.

        Bounds are texts, datetimes or columns such as scalar subqueries. A partitioned store is pruned by month and host, or by
        week, as well as filtered by time.
        """
        m = METRICS[metric]
        df = self._stored(metric)
        ts = F.col(m.ts)
        parts = set(df.columns)
        keys = [(c, key) for c, key in (("yyyymm", month_key), ("yyyyiw", week_key)) if c in parts]
        if host is not None:
            df = df.where(F.col(m.host) == host)
            if "host_id" in parts:
                df = df.where(F.col("host_id") == host)
        if start is not None:
            low = F.lit(start).cast("timestamp")
            if lag:
                low = low - F.expr(f"interval {lag}")
            df = df.where(ts >= low if closed_start else ts > low)
            for c, key in keys:
                df = df.where(F.col(c) >= key(low).cast("int"))
        if end is not None:
            high = F.lit(end).cast("timestamp")
            df = df.where(ts < high if open_end else ts <= high)
            for c, key in keys:
                df = df.where(F.col(c) <= key(high).cast("int"))
        return df.drop(*PARTITIONS)
