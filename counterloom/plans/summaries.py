"""Hourly and daily summaries: growth of counters per object and period."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import proc_base_name
from ..functions.times import bucket
from ..operators.series import last_in_period
from ..operators.sets import with_totals
from ..sources.fleet import Fleet
from ..sources.versions import VersionedTable, closed_before

HOST_TOTAL = " "


def _restart(cur: Column, prev: Column) -> Column:
    """Growth since the previous period, or the value itself after a restart (policy P5)."""
    grown = cur - F.coalesce(prev, F.lit(0).cast("bigint"))
    return F.when(grown < 0, cur).otherwise(grown)


def _final(period: Column, unit: str, as_of) -> Column:
    return F.lit(as_of).cast("timestamp") > period + F.expr(f"interval 1 {unit}")


def hourly_sproc_summary(fleet: Fleet, as_of, host=None, start=None, end=None) -> DataFrame:
    """Calls and time per procedure base name and hour, across schema versions.

    Counter peaks per procedure and hour are combined map-side; the previous hour is looked up in
    the aggregated series. A row without a previous hour is suspect. Every host gets a row named
    ``' '`` with the sum of its final, unsuspicious rows.
    """
    return summarise_peaks(fleet, hourly_peaks(fleet.samples("sproc_performance_data", host, start, end)), as_of)


def hourly_peaks(df: DataFrame) -> DataFrame:
    """Largest counters per procedure and hour."""
    hour = bucket(F.col("sp_timestamp"), "hour").alias("hour")
    return df.groupBy("sp_sproc_id", hour).agg(F.max("sp_calls").alias("c"), F.max("sp_total_time").alias("t"))


def summarise_peaks(fleet: Fleet, peaks: DataFrame, as_of, before: DataFrame | None = None) -> DataFrame:
    """Hourly summary from counter peaks ``c, t`` per ``sp_sproc_id`` and ``hour``.

    ``before`` has ``ss_host_id, ss_sproc_name, hour, ss_orig_calls, ss_orig_total_time`` of an hour that is already stored: it is grown
    from and not returned.
    """
    names = fleet.table("sprocs").select(
        F.col("sproc_id").alias("sp_sproc_id"), F.col("sproc_host_id").alias("ss_host_id"),
        proc_base_name(F.col("sproc_name")).alias("ss_sproc_name"),
    )
    per = peaks.join(names, "sp_sproc_id").groupBy("ss_host_id", "ss_sproc_name", "hour").agg(
        F.sum("c").alias("ss_orig_calls"), F.sum("t").alias("ss_orig_total_time")
    ).withColumn("_stored", F.lit(False))
    if before is not None:
        per = per.unionByName(before.withColumn("_stored", F.lit(True)))
    w = Window.partitionBy("ss_host_id", "ss_sproc_name").orderBy("hour")  # one row per hour
    adjacent = F.lag("hour").over(w) + F.expr("interval 1 hour") == F.col("hour")
    prev = per.withColumns({
        "pc": F.when(adjacent, F.lag("ss_orig_calls").over(w)), "pt": F.when(adjacent, F.lag("ss_orig_total_time").over(w))
    })
    rows = prev.where("not _stored").select(
        "ss_host_id", "ss_sproc_name", F.to_date("hour").alias("ss_date"), F.hour("hour").alias("ss_hour"),
        _restart(F.col("ss_orig_calls"), F.col("pc")).alias("ss_calls"),
        _restart(F.col("ss_orig_total_time"), F.col("pt")).alias("ss_total_time"),
        "ss_orig_calls", "ss_orig_total_time", _final(F.col("hour"), "hour", as_of).alias("ss_is_final"),
        F.col("pc").isNull().alias("ss_is_suspect"),
    )
    sums = ["ss_calls", "ss_total_time", "ss_orig_calls", "ss_orig_total_time"]
    totals = (
        rows.where("ss_is_final and not ss_is_suspect").groupBy("ss_host_id", "ss_date", "ss_hour")
        .agg(*(F.sum(c).alias(c) for c in sums))
        .withColumns({"ss_sproc_name": F.lit(HOST_TOTAL), "ss_is_final": F.lit(True), "ss_is_suspect": F.lit(False)})
    )
    return with_totals(rows, totals)


TABLE_COUNTERS = {"tsd_table_size": "ts_table_size", "tsd_index_size": "ts_index_size", "tsd_seq_scans": "ts_seq_scans",
                  "tsd_index_scans": "ts_index_scans"}


def daily_table_summary(fleet: Fleet, as_of, host=None, start=None, end=None) -> DataFrame:
    """Size and scan growth per table name and day; needs the day before, keeps growing tables."""
    return summarise_table_peaks(fleet, daily_table_peaks(fleet.samples("table_size_data", host, start, end)), as_of)


def daily_table_peaks(df: DataFrame) -> DataFrame:
    day = bucket(F.col("tsd_timestamp"), "day").alias("day")
    return df.groupBy("tsd_table_id", day).agg(*(F.max(c).alias(n) for c, n in TABLE_COUNTERS.items()))


def summarise_table_peaks(fleet: Fleet, peaks: DataFrame, as_of) -> DataFrame:
    """Daily summary from the peaks per table and day; a day needs the peaks of the day before."""
    names = TABLE_COUNTERS.values()
    w = Window.partitionBy("tsd_table_id").orderBy("day")  # one row per day
    pairs = peaks.select("*", F.lag("day").over(w).alias("prev_day"), *(F.lag(n).over(w).alias("p_" + n) for n in names))
    pairs = pairs.where(F.col("prev_day") + F.expr("interval 1 day") == F.col("day"))
    known = fleet.table("tables").select("t_id", F.col("t_host_id").alias("ts_host_id"), F.col("t_name").alias("ts_table_name"))
    return (
        pairs.join(known, F.col("tsd_table_id") == F.col("t_id"))
        .groupBy("ts_host_id", "ts_table_name", "day")
        .agg(
            *(F.sum(_restart(F.col(n), F.col("p_" + n))).alias(n) for n in names),
            F.max("ts_table_size").alias("ts_orig_table_size"), F.max("ts_index_size").alias("ts_orig_index_size"),
        )
        .where(F.col("ts_table_size") > 0)
        .select("ts_host_id", "ts_table_name", F.to_date("day").alias("ts_date"), *names, "ts_orig_table_size",
                "ts_orig_index_size", _final(F.col("day"), "day", as_of).alias("ts_is_final"))
    )


def daily_host_summary(fleet: Fleet, as_of, clusters: DataFrame, host=None, start=None, end=None) -> DataFrame:
    """Cache misses per host or cluster and day: growth of block reads at the day's last samples.

    ``clusters`` has ``hc_one_host_id, hc_host_id``.
    """
    return summarise_misses(fleet, daily_misses(fleet.samples("table_io_data", host, start, end)), as_of, clusters)


def daily_misses(df: DataFrame) -> DataFrame:
    """Block reads per host at the last samples of each day."""
    last = last_in_period(df, ["tio_host_id", "tio_table_id"], "tio_timestamp", "day", ["tio_heap_read", "tio_idx_read"])
    reads = F.greatest(F.col("tio_heap_read") + F.col("tio_idx_read"), F.lit(0).cast("bigint"))
    return last.groupBy(F.col("tio_host_id").alias("host_id"), F.col("period").alias("day")).agg(F.sum(reads).alias("misses"))


def summarise_misses(fleet: Fleet, per: DataFrame, as_of, clusters: DataFrame) -> DataFrame:
    """Daily summary from the block reads per host and day; a day needs those of the day before."""
    w = Window.partitionBy("host_id").orderBy("day")  # one row per day
    pairs = per.withColumns({"prev_day": F.lag("day").over(w), "prev": F.lag("misses").over(w)})
    pairs = pairs.where(F.col("prev_day") + F.expr("interval 1 day") == F.col("day"))
    grown = F.col("misses") - F.col("prev")
    merged = pairs.join(clusters, F.col("host_id") == F.col("hc_host_id"), "left").groupBy(
        F.coalesce("hc_one_host_id", "host_id").alias("hs_host_id"), "day"
    ).agg(F.sum(F.when(grown > 0, grown).otherwise(F.col("misses"))).alias("hs_cache_misses"))
    hosts = fleet.table("hosts").select(F.col("host_id").alias("hs_host_id"), F.col("host_name").alias("hs_host_name"))
    return merged.join(hosts, "hs_host_id").select(
        "hs_host_id", "hs_host_name", F.to_date("day").alias("hs_date"), "hs_cache_misses",
        _final(F.col("day"), "day", as_of).alias("hs_is_final"),
    )


# --- stored summaries -----------------------------------------------------------------------


def _open(table: VersionedTable, as_of, unit: str) -> tuple[datetime | None, datetime]:
    """Start of the first period to compute, none for all, and of the first that stays provisional."""
    closed, until = table.head()[1], closed_before(table.spark, as_of, unit)
    return closed, until if closed is None else max(closed, until)


def _from(df: DataFrame, period: Column, closed: datetime | None) -> DataFrame:
    return df if closed is None else df.where(period >= F.lit(closed))


def refresh_hourly_sproc_summary(fleet: Fleet, table: VersionedTable, as_of) -> DataFrame:
    """Bring the stored hourly summary up to ``as_of`` and return it.

    Samples of final hours are not read; what arrives late for them changes nothing. Growth after the last final hour is taken
    from the counters stored with it.
    """
    closed = table.head()[1]
    samples = fleet.samples("sproc_performance_data", None, closed, as_of, closed_start=True)
    return store_hourly_peaks(fleet, table, hourly_peaks(samples), as_of)


def store_hourly_peaks(fleet: Fleet, table: VersionedTable, peaks: DataFrame, as_of) -> DataFrame:
    """Store the summary of all hours that are not final yet, from their peaks."""
    (closed, until), before = _open(table, as_of, "hour"), None
    if closed is not None:
        hour = F.lit(closed) - F.expr("interval 1 hour")
        stored = table.periods().where((F.col("ss_date") == F.to_date(hour)) & (F.col("ss_hour") == F.hour(hour)) & (F.col("ss_sproc_name") != HOST_TOTAL))
        before = stored.select("ss_host_id", "ss_sproc_name", hour.alias("hour"), "ss_orig_calls", "ss_orig_total_time")
    rows = summarise_peaks(fleet, _from(peaks, F.col("hour"), closed), as_of, before)
    table.replace(rows, "ss_date", "ss_hour")
    table.commit(until)
    return table.periods().select(rows.columns)


def _refresh_daily(table: VersionedTable, name: str, date: str, as_of, read, summarise) -> DataFrame:
    """``read`` gives the peaks per object and ``day`` of a range of samples, ``summarise`` their summary."""
    closed, until = _open(table, as_of, "day")
    peaks = read(closed)
    if closed is not None:
        peaks = peaks.unionByName(table.carried(name, peaks.schema))
    rows = _from(summarise(peaks), F.col(date).cast("timestamp"), closed)
    table.replace(rows, date)
    # the day before the first provisional one, of which it will grow
    table.carry(name, peaks.where(F.col("day") == F.lit(until) - F.expr("interval 1 day")))
    table.commit(until)
    return table.periods().select(rows.columns)


def refresh_daily_table_summary(fleet: Fleet, table: VersionedTable, as_of) -> DataFrame:
    """Bring the stored daily table summary up to ``as_of`` and return it; the peaks of the last final day are carried."""
    def read(closed: datetime | None) -> DataFrame:
        return daily_table_peaks(fleet.samples("table_size_data", None, closed, as_of, closed_start=True))

    return _refresh_daily(table, "table_peaks", "ts_date", as_of, read, lambda peaks: summarise_table_peaks(fleet, peaks, as_of))


def refresh_daily_host_summary(fleet: Fleet, table: VersionedTable, as_of, clusters: DataFrame) -> DataFrame:
    """Bring the stored daily host summary up to ``as_of`` and return it; the block reads of the last final day are carried."""
    def read(closed: datetime | None) -> DataFrame:
        return daily_misses(fleet.samples("table_io_data", None, closed, as_of, closed_start=True))

    return _refresh_daily(table, "misses", "hs_date", as_of, read, lambda misses: summarise_misses(fleet, misses, as_of, clusters))
