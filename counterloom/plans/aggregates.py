"""Stored aggregates and their incremental refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..functions.times import group_date
from ..operators.series import counter_delta, moving_sum
from ..schema import Reset
from ..sources.fleet import Fleet
from ..sources.versions import VersionedTable, moment
from .hosts import BUCKET_MS, sproc_load_after, table_totals_per_snapshot


def aggregate_table_size(fleet: Fleet, as_of, start, stored: DataFrame | None = None) -> DataFrame:
    """New size and row-change totals per snapshot; the last hour is left for the next run.

    Reads start at the least last snapshot of any host, which prunes partitions, and are cut per host.
    """
    first, until = F.lit(start).cast("timestamp"), F.lit(as_of).cast("timestamp") - F.expr("interval 1 hour")
    if stored is None:
        return table_totals_per_snapshot(fleet.samples("table_size_data", None, start, until, open_end=True))
    last = stored.groupBy(F.col("host_id").alias("_h")).agg(F.max("ts").alias("_last"))
    hosts = fleet.table("hosts").join(last, F.col("host_id") == F.col("_h"), "left")
    low = hosts.agg(F.min(F.coalesce("_last", first))).scalar()
    df = fleet.samples("table_size_data", None, low, until, open_end=True)
    df = df.join(last, F.col("tsd_host_id") == F.col("_h"), "left").where(F.col("tsd_timestamp") > F.coalesce("_last", first))
    return table_totals_per_snapshot(df)


def aggregate_sproc_load(fleet: Fleet, as_of, start, stored: DataFrame | None = None, carried: DataFrame | None = None) -> DataFrame:
    """New 15-minute load buckets that ended an hour ago or earlier. Runs at any times give together what one run gives."""
    until = group_date(F.lit(as_of).cast("timestamp") - F.expr("interval 1 hour"))
    return sproc_load_after(fleet, stored, start, until, carried=carried)


def refresh_sproc_load(fleet: Fleet, table: VersionedTable, as_of, start) -> DataFrame:
    """Append the load buckets that ended an hour ago or earlier to a stored aggregate, and return it whole.

    With the buckets are committed each procedure's last sample and each host's last bucket with its self time, which the next
    two-bucket sum needs. A refresh reads the samples from where the last one ended, and nothing older.
    """
    until = moment(fleet.spark, group_date(F.lit(as_of).cast("timestamp") - F.expr("interval 1 hour")))
    version, closed = table.head()
    if version and until <= closed:
        return table.appended().drop("ms")
    series, ts = ["sp_host_id", "sp_sproc_id"], F.col("sp_timestamp")
    rows = fleet.samples("sproc_performance_data", None, closed if version else start, until, closed_start=version > 0, open_end=True)
    rows = rows.select(*series, "sp_timestamp", "sp_self_time").withColumn("_before", F.lit(False))
    if version:
        rows = rows.unionByName(table.carried("samples", rows.drop("_before").schema).withColumn("_before", F.lit(True)))
    deltas = counter_delta(rows, series, "sp_timestamp", ["sp_self_time"], Reset.DROP_NOT_POSITIVE).where("not _before")
    per = deltas.groupBy(F.col("sp_host_id").alias("host_id"), group_date(ts).alias("bucket")).agg(F.sum("d_sp_self_time").alias("ms")).withColumn("_before", F.lit(False))
    if version:
        per = per.unionByName(table.carried("buckets", per.drop("_before").schema).withColumn("_before", F.lit(True)))
    load = half_up(moving_sum("ms", ["host_id"], "bucket") / F.lit(float(BUCKET_MS)), 2)
    table.append(per.withColumn("load_15min", load).where("not _before").select("host_id", "bucket", "load_15min", "ms"))
    new = table.written()
    buckets = new.select("host_id", "bucket", "ms")
    if version:
        buckets = buckets.unionByName(table.carried("buckets", buckets.schema))
    table.carry("buckets", buckets.groupBy("host_id").agg(F.max("bucket").alias("bucket"), F.max_by("ms", "bucket").alias("ms")))
    table.carry("samples", rows.groupBy(*series).agg(F.max("sp_timestamp").alias("sp_timestamp"), F.max_by("sp_self_time", "sp_timestamp").alias("sp_self_time")))
    table.commit(until)
    return table.appended().drop("ms")
