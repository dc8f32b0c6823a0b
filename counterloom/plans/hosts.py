"""Host overview series and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up, normalise, pretty_size, ratio
from ..functions.predicates import in_range, opt_eq, valid_at
from ..functions.times import bucket, group_date, is_weekday, iso_week, iso_year
from ..operators.series import (
    DELTA, counter_delta, delta_after_first_nonzero, fill_gaps, moving_sum, skip_after_gap, trend,
)
from ..operators.sets import union_all
from ..operators.topn import latest
from ..schema import Reset
from ..sources.fleet import Fleet

BUCKET_MS = 15 * 60 * 1000
GB = 1024**3


def sproc_load(
    fleet: Fleet, host=None, start=None, end=None, *, policy: Reset = Reset.DROP_NOT_POSITIVE, skip_gaps: bool = False
) -> DataFrame:
    """Self time spent in procedures per 15 minutes, as a load figure over two buckets.

    The per-procedure delta is the only step over raw samples; what follows is one row per
    (host, bucket).
    """
    df = fleet.samples("sproc_performance_data", host, start, end)
    deltas = counter_delta(
        df.select("sp_host_id", "sp_sproc_id", "sp_timestamp", "sp_self_time"),
        ["sp_host_id", "sp_sproc_id"], "sp_timestamp", ["sp_self_time"], policy,
    )
    per_bucket = deltas.groupBy(
        F.col("sp_host_id").alias("host_id"), group_date(F.col("sp_timestamp")).alias("bucket")
    ).agg(F.sum("d_sp_self_time").alias("self_ms"))
    load = half_up(moving_sum("self_ms", ["host_id"], "bucket") / F.lit(float(BUCKET_MS)), 2)
    out = per_bucket.select("host_id", "bucket", load.alias("load_15min"))
    return skip_after_gap(out, ["host_id"], "bucket") if skip_gaps else out


def sproc_load_after(
    fleet: Fleet, stored: DataFrame | None, start, until, host=None, *, policy: Reset = Reset.DROP_NOT_POSITIVE,
    carried: DataFrame | None = None, closed_end: bool = False,
) -> DataFrame:
    """Load buckets after the last stored one of each host, as if computed in one go from ``start``.

    Samples are read from each host's last stored bucket on, which the next two-bucket sum needs. ``carried`` holds the last
    sample of each series before that; without it they are found in the samples since ``start``, combined map-side.
    """
    series, cols = ["sp_host_id", "sp_sproc_id"], ["sp_host_id", "sp_sproc_id", "sp_timestamp", "sp_self_time"]
    first, ts = F.lit(start).cast("timestamp"), F.col("sp_timestamp")
    if stored is None:
        rows = fleet.samples("sproc_performance_data", host, start, until, open_end=not closed_end).select(*cols)
        rows = rows.withColumns({"_last": F.lit(None).cast("timestamp"), "_before": F.lit(False)})
    else:
        last = stored.groupBy(F.col("host_id").alias("_h")).agg(F.max("bucket").alias("_last"))
        hosts = opt_eq(fleet.table("hosts"), "host_id", host)
        low = hosts.join(last, F.col("host_id") == F.col("_h"), "left").agg(F.min(F.coalesce("_last", first))).scalar()

        def since(df: DataFrame) -> DataFrame:
            return df.select(*cols).join(last, F.col("sp_host_id") == F.col("_h"), "left").drop("_h")

        rows = since(fleet.samples("sproc_performance_data", host, low, until, closed_start=True, open_end=not closed_end))
        rows = rows.where((ts > first) & (F.col("_last").isNull() | (ts >= F.col("_last"))))
        if carried is None:
            before = since(fleet.samples("sproc_performance_data", host, start, until)).where(ts < F.col("_last"))
            carried = before.groupBy(*series).agg(
                F.max("sp_timestamp").alias("sp_timestamp"), F.max_by("sp_self_time", "sp_timestamp").alias("sp_self_time")
            )
        old = carried.select(*cols).withColumn("_before", F.lit(True))
        rows = rows.withColumn("_before", F.lit(False)).unionByName(old, allowMissingColumns=True)
    deltas = counter_delta(rows, series, "sp_timestamp", ["sp_self_time"], policy).where("not _before")
    per_bucket = deltas.groupBy(F.col("sp_host_id").alias("host_id"), group_date(ts).alias("bucket")).agg(
        F.sum("d_sp_self_time").alias("ms"), F.min("_last").alias("_last")
    )
    load = half_up(moving_sum("ms", ["host_id"], "bucket") / F.lit(float(BUCKET_MS)), 2)
    out = per_bucket.withColumn("load_15min", load).where(F.col("_last").isNull() | (F.col("bucket") > F.col("_last")))
    return out.select("host_id", "bucket", "load_15min")


def sproc_load_hybrid(fleet: Fleet, stored: DataFrame, as_of, host=None, start=None, *, since="1970-01-01 00:00:00") -> DataFrame:
    """Stored load up to two hours ago, the live tail after it with raw deltas. ``since`` is where the samples behind
    ``stored`` begin."""
    now = F.lit(as_of).cast("timestamp")
    old = opt_eq(stored, "host_id", host).where(F.col("bucket") < now - F.expr("interval 2 hours"))
    tail = sproc_load_after(fleet, old, since, as_of, host, policy=Reset.RAW, closed_end=True)
    return in_range(union_all(old.select("host_id", "bucket", "load_15min"), tail), "bucket", start, open_start=True)


def cpu_load(fleet: Fleet, host=None, start=None, end=None) -> DataFrame:
    df = fleet.samples("host_load", host, start, end)
    per = df.groupBy(F.col("load_host_id").alias("host_id"), group_date(F.col("load_timestamp")).alias("bucket")).agg(
        F.sum("load_1min_value").alias("s"), F.count("load_1min_value").alias("n"), F.max("load_1min_value").alias("m")
    )
    return per.select(
        "host_id", "bucket",
        half_up(ratio(F.col("s"), F.col("n") * 100), 2).alias("load_15min_avg"),
        half_up(F.col("m") / F.lit(100.0), 2).alias("load_15min_max"),
    )


def wal_volume(fleet: Fleet, host=None, start=None, end=None) -> DataFrame:
    df = fleet.samples("host_load", host, start, end)
    return df.groupBy(
        F.col("load_host_id").alias("host_id"), group_date(F.col("load_timestamp")).alias("bucket")
    ).agg(F.coalesce(F.max("xlog_location_mb") - F.min("xlog_location_mb"), F.lit(0)).alias("wal_15min_growth"))


def blocked_counts(fleet: Fleet, start, end, host=None, *, minutes: int = 15, min_wait_s: int = 5) -> DataFrame:
    """Statements that began to wait per bucket, with empty buckets shown as 0."""
    df = fleet.samples("blocking_processes", host, start, end).where("waiting")
    waits = df.groupBy("bp_host_id", "query_start", "query").agg(
        (F.unix_timestamp(F.max("bp_timestamp")) - F.unix_timestamp(F.min("bp_timestamp"))).alias("span_s")
    )
    starts = (
        waits.where(F.col("span_s") >= min_wait_s)
        .groupBy(F.col("bp_host_id").alias("host_id"), group_date(F.col("query_start"), minutes).alias("ts"))
        .agg(F.count(F.lit(1)).alias("wait_starts"))
    )
    hosts = opt_eq(fleet.table("hosts"), "host_id", host).select("host_id")
    return fill_gaps(starts, hosts, "ts", start, end, f"{minutes} minutes", {"wait_starts": 0})


def table_totals_per_snapshot(samples: DataFrame) -> DataFrame:
    """Database size and row changes per (host, snapshot)."""
    return samples.groupBy(F.col("tsd_host_id").alias("host_id"), F.col("tsd_timestamp").alias("ts")).agg(
        (F.sum("tsd_table_size") + F.sum("tsd_index_size")).alias("size"),
        F.sum("tsd_tup_ins").alias("s_ins"), F.sum("tsd_tup_upd").alias("s_upd"), F.sum("tsd_tup_del").alias("s_del"),
    )


def _with_change(totals: DataFrame) -> DataFrame:
    out = delta_after_first_nonzero(totals, ["host_id"], "ts", ["s_ins", "s_upd", "s_del"])
    return out.select("host_id", "ts", "size", F.col("d_s_ins").alias("ins"), F.col("d_s_upd").alias("upd"),
                      F.col("d_s_del").alias("del"))


def db_size_trend(fleet: Fleet, host=None, start=None, end=None) -> DataFrame:
    return _with_change(table_totals_per_snapshot(fleet.samples("table_size_data", host, start, end)))


def db_size_trend_hybrid(fleet: Fleet, stored: DataFrame, as_of, host=None, start=None) -> DataFrame:
    """The same from the stored aggregate, with the last two hours taken live."""
    cut = F.lit(as_of).cast("timestamp") - F.expr("interval 2 hours")
    old = in_range(opt_eq(stored, "host_id", host), "ts", start, open_start=True).where(F.col("ts") < cut)
    live = fleet.samples("table_size_data", host, cut, as_of, closed_start=True)
    return _with_change(union_all(old, table_totals_per_snapshot(live)))


def iud_rates(trend_df: DataFrame) -> DataFrame:
    """Row changes per second, whole numbers, from a size trend."""
    gap_ms = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(Window.partitionBy("host_id").orderBy("ts")))) / 1000
    df = trend_df.withColumn("gap_ms", gap_ms).where("gap_ms > 0")
    per_s = [F.floor(F.col(c) * 1000 / F.col("gap_ms")).alias(f"{c}_per_s") for c in ("ins", "upd", "del")]
    return df.select("host_id", "ts", *per_s)


def database_stats(fleet: Fleet, host=None, start=None, end=None) -> DataFrame:
    """Rollbacks, temporary bytes and deadlocks per 15 minutes; connections as sampled."""
    cols = ["sdd_xact_rollback", "sdd_temp_bytes", "sdd_deadlocks"]
    df = fleet.samples("stat_database_data", host, start, end).select(
        "sdd_host_id", "sdd_timestamp", "sdd_numbackends", *cols
    )
    d = counter_delta(df, ["sdd_host_id"], "sdd_timestamp", cols, Reset.CLAMP_ZERO).where("elapsed_s is not null")
    el = F.col("elapsed_s")
    return d.select(
        F.col("sdd_host_id").alias("host_id"), F.col("sdd_timestamp").alias("ts"),
        F.col("sdd_numbackends").alias("numbackends"),
        normalise(F.col("d_sdd_xact_rollback"), el).alias("rollbacks"),
        normalise(F.col("d_sdd_temp_bytes"), el).alias("temp_files_bytes"),
        normalise(F.col("d_sdd_deadlocks"), el).alias("deadlocks"),
    )


def bgwriter_stats(fleet: Fleet, host=None, start=None, block_size: int = 8192) -> DataFrame:
    """Checkpoint and background-writer indicators per hour."""
    cols = ["sbd_checkpoints_timed", "sbd_checkpoints_req", "sbd_buffers_checkpoint", "sbd_buffers_clean",
            "sbd_buffers_backend"]
    df = fleet.samples("stat_bgwriter_data", host, start).select("sbd_host_id", "sbd_timestamp", *cols)
    d = counter_delta(df, ["sbd_host_id"], "sbd_timestamp", cols, Reset.RAW).where("elapsed_s > 0")
    hourly = d.groupBy(
        F.col("sbd_host_id").alias("host_id"), bucket(F.col("sbd_timestamp"), "hour").alias("hour")
    ).agg(F.sum("elapsed_s").alias("elapsed"), *(F.sum(DELTA + c).alias(c[4:]) for c in cols))
    checkpoints = F.col("checkpoints_timed") + F.col("checkpoints_req")
    writes = F.col("buffers_checkpoint") + F.col("buffers_clean") + F.col("buffers_backend")

    def guarded(guard, num, den):
        return F.when(guard > 0, half_up(ratio(num, den), 2))

    return hourly.select(
        "host_id", "hour",
        guarded(checkpoints, F.col("buffers_checkpoint") * block_size, checkpoints).alias("bytes_per_checkpoint"),
        guarded(checkpoints, F.col("checkpoints_req") * 100, checkpoints).alias("checkpoint_request_pct"),
        guarded(writes, F.col("buffers_checkpoint") * 100, writes).alias("checkpoint_write_pct"),
        guarded(writes, F.col("buffers_backend") * 100, writes).alias("backend_write_pct"),
        guarded(writes, writes * block_size, F.col("elapsed")).alias("written_per_second"),
    )


def fleet_overview(fleet: Fleet, stored_sizes: DataFrame, groups: DataFrame, as_of, look_back: str = "1 day") -> DataFrame:
    """Last load and size of every enabled host; the pinned group 0 comes first.

    ``groups`` has ``group_id, group_name``; ``stored_sizes`` is the stored size aggregate.
    """
    since = F.lit(as_of).cast("timestamp") - F.expr(f"interval {look_back}")
    loads = latest(
        fleet.samples("host_load", None, since), ["load_host_id"], "load_timestamp",
        ["load_5min_value"],
    ).select(F.col("load_host_id").alias("host_id"), half_up(F.col("load_5min_value") / F.lit(100.0), 1).alias("v"))
    sizes = latest(stored_sizes.where(F.col("ts") > since), ["host_id"], "ts", ["size"]).drop("ts")
    hosts = fleet.table("hosts").where("host_enabled")
    out = (
        hosts.join(loads, "host_id", "left").join(sizes, "host_id", "left")
        .join(groups, hosts["host_group_id"] == groups["group_id"], "left")
    )
    return out.select(
        "host_id", "host_ui_shortname", "host_ui_longname", "group_name",
        F.coalesce(F.format_string("%.1f", F.col("v")), F.lit("-")).alias("last_5min_load"),
        F.coalesce(pretty_size(F.col("size")), F.lit("-")).alias("last_size"),
        F.when(F.col("group_id") == 0, 0).otherwise(1).alias("group_order"),
    ).orderBy("group_order", F.col("group_name").asc_nulls_first(), "host_ui_longname")


def weekly_load_report(fleet: Fleet, host=None, start=None) -> DataFrame:
    """Load, size and WAL volume per host and ISO week, with trend against the week before."""
    sizes = fleet.samples("table_size_data", host, start, closed_start=True)
    snapshots = sizes.groupBy("tsd_host_id", "tsd_timestamp").agg(
        (F.sum("tsd_table_size") + F.sum("tsd_index_size")).alias("bytes")
    )
    weekly_size = snapshots.groupBy(
        F.col("tsd_host_id").alias("host_id"), iso_year(F.col("tsd_timestamp")).alias("iso_year"),
        iso_week(F.col("tsd_timestamp")).alias("week"),
    ).agg(half_up(F.max_by("bytes", "tsd_timestamp") / F.lit(float(GB)), 1).alias("db_size"))

    ts = F.col("load_timestamp")
    loads = fleet.samples("host_load", host, start, closed_start=True)
    weekly = loads.where(is_weekday(ts)).groupBy(
        F.col("load_host_id").alias("host_id"), iso_year(ts).alias("iso_year"), iso_week(ts).alias("week")
    ).agg(
        half_up(ratio(F.sum("load_15min_value"), F.count("load_15min_value") * 100), 2).alias("avg_load"),
        half_up(F.max("load_15min_value") / F.lit(100.0), 2).alias("max_load"),
        F.date_format(F.min(ts), "dd.MM.yyyy").alias("min_date"),
        F.date_format(F.max(ts), "dd.MM.yyyy").alias("max_date"),
        half_up((F.max("xlog_location_mb") - F.min("xlog_location_mb")) / F.lit(1024.0), 1).alias("wal_written"),
    )
    enabled = fleet.table("hosts").where("host_enabled").select("host_id", "host_ui_shortname")
    rows = weekly.join(weekly_size, ["host_id", "iso_year", "week"]).join(enabled, "host_id")
    w = Window.partitionBy("host_id").orderBy("iso_year", "week")
    return rows.select(
        "*", trend("avg_load", w).alias("trend_avg"), trend("max_load", w).alias("trend_max"),
        trend("db_size", w).alias("trend_size"), trend("wal_written", w).alias("trend_wal"),
    )


def daily_load(fleet: Fleet, host=None, start=None, end=None) -> DataFrame:
    """Average load and WAL bytes per day; days without a valid WAL range are left out."""
    df = fleet.samples("host_load", host, start, end)
    per = df.groupBy(F.col("load_host_id").alias("host_id"), bucket(F.col("load_timestamp"), "day").alias("day")).agg(
        half_up(ratio(F.sum("load_15min_value"), F.count("load_15min_value") * 100), 2).alias("cpu_15"),
        F.max("xlog_location_mb").alias("hi"), F.min("xlog_location_mb").alias("lo"),
    )
    return per.where("hi >= lo").select("host_id", "day", "cpu_15", ((F.col("hi") - F.col("lo")) * 1000000).alias("wal_b"))


def active_announcement(announcements: DataFrame, as_of) -> DataFrame:
    """Announcements whose half-open validity range contains ``as_of``."""
    return announcements.where(valid_at(F.col("valid_from"), F.col("valid_to"), as_of)).select("announcement")
