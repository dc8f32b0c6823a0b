"""Streaming jobs run to the end of their input, and the batch result they must equal.

Each job gets its samples in three consecutive deliveries, so that state crosses batches and runs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from counterloom.functions.numbers import half_up
from counterloom.operators.series import moving_sum
from counterloom.plans.metrics import HOUR, MICRO
from counterloom.sources.versions import VersionedTable
from counterloom.functions.numbers import rate
from counterloom.schema import Reset
from counterloom.session import shared_dir
from counterloom.sources.store import to_points
from counterloom.streaming import jobs as J

from .harness import rate as sql_rate
from .harness import rn, secs
from .hosts import _TOTALS
from .locks import ORACLE as LOCKS
from .primitives import ORACLE as BASIC
from .summaries import _SS, AS_OF

CUTS = ("2024-01-10 00:00:00", "2024-01-20 00:00:00")
LOCK_CUTS = ("1997-01-01 00:00:00", "1999-01-01 00:00:00")


def _work(f) -> str:
    return f"{shared_dir(f.spark)}/stream-{uuid.uuid4().hex}"


def _runs(f, df, ts, work, start, cuts=CUTS, extra=None):
    """Deliver the samples in time order and run the job to the end after each delivery, resuming
    from its checkpoint."""
    c = F.col(ts)
    parts = [df.where(p) for p in (c < cuts[0], (c >= cuts[0]) & (c < cuts[1]), c >= cuts[1])]
    parts += [extra] if extra is not None else []
    for part in parts:
        part.write.mode("append").parquet(f"{work}/in")
        start(J.read_samples(f.spark, f"{work}/in", df.schema)).awaitTermination()


def _read(f, path):
    return f.spark.read.option("recursiveFileLookup", "true").parquet(path)


def _sp(f):
    return f.table("sproc_performance_data").select("sp_host_id", "sp_sproc_id", "sp_timestamp", "sp_calls", "sp_total_time", "sp_self_time")


def _delta_table(f, work):
    cols = ["sp_calls", "sp_total_time", "sp_self_time"]
    _runs(f, _sp(f), "sp_timestamp", work, lambda s: J.stream_delta(s, "sproc_performance_data", cols, Reset.RAW, f"{work}/delta", work))
    return f"{work}/delta"


def _stream_table(f, path):
    return f.spark.readStream.schema(_read(f, path).schema).option("recursiveFileLookup", "true").parquet(path)


def stream_delta(f):
    out = _delta_table(f, _work(f))
    return _read(f, out).select("sp_host_id", "sp_sproc_id", "sp_timestamp", "d_sp_calls", "d_sp_total_time", "d_sp_self_time")


def stream_changed_only(f):
    work, cols = _work(f), ["tio_heap_read", "tio_idx_read"]
    _runs(f, f.table("table_io_data"), "tio_timestamp", work, lambda s: J.stream_changed_only(s, "table_io_data", cols, f"{work}/out", work))
    return _read(f, f"{work}/out")


def stream_sproc_load(f):
    """Deltas, then 15-minute buckets behind the watermark, then the two-bucket load."""
    work = _work(f)
    J.stream_sproc_load(_stream_table(f, _delta_table(f, work)), f"{work}/load", f"{work}/cp").awaitTermination()
    load = half_up(moving_sum("self_ms", ["host_id"], "bucket") / F.lit(900000.0), 2)
    return _read(f, f"{work}/load").select("host_id", "bucket", load.alias("load_15min"))


def stream_db_size(f):
    work = _work(f)
    _runs(f, f.table("table_size_data"), "tsd_timestamp", work, lambda s: J.stream_db_size(s, f"{work}/out", f"{work}/cp"))
    return _read(f, f"{work}/out")


def stream_summary(f):
    """Stored hourly summary: at each delivery the last hour stays provisional and is replaced by the next."""
    work = _work(f)
    table, as_of = VersionedTable(f.spark, f"{work}/summary"), iter((*CUTS, AS_OF))
    _runs(f, _sp(f), "sp_timestamp", work, lambda s: J.stream_summary(s, f, table, work, next(as_of)))
    return table.periods()


def stream_export(f):
    """WAL rate points from a stream of deltas."""
    work = _work(f)
    df = f.table("host_load").select("load_host_id", "load_timestamp", "xlog_location_mb")
    _runs(f, df, "load_timestamp", work, lambda s: J.stream_delta(s, "host_load", ["xlog_location_mb"], Reset.DROP_NEGATIVE, f"{work}/delta", work))

    def points(b):
        v = b.select(F.col("load_host_id").alias("host"), "load_timestamp", rate(F.col("d_xlog_location_mb"), F.col("elapsed_s"), HOUR * MICRO).alias("xlog_b_1h_rate"))
        return to_points(v, "load", ["host"], ["xlog_b_1h_rate"], "load_timestamp")

    src = _stream_table(f, f"{work}/delta")
    for up_to in ("2024-01-15 12:00:00", "2024-01-30 23:59:50"):  # the second run has no new files
        J.stream_export(src, points, "load_timestamp", f"{work}/out", f"{work}/export", up_to=up_to, fmt="parquet").awaitTermination()
    return _read(f, f"{work}/out").select("measurement", F.col("tags.host").alias("host"), F.col("fields.xlog_b_1h_rate").alias("xlog_b_1h_rate"), "time")


def _locks(f):
    """All snapshots and, a day after the last, a row of a host of its own: time moves on, and the last snapshots close."""
    locks = f.table("blocking_locks")
    newest = locks.orderBy(F.desc("bl_timestamp")).limit(1)
    return locks.unionByName(newest.withColumns({"bl_host_id": F.lit(-1).cast(locks.schema["bl_host_id"].dataType), "bl_timestamp": F.col("bl_timestamp") + F.expr("interval 1 day")}))


def stream_prune_locks(f):
    work = _work(f)
    _runs(f, _locks(f), "bl_timestamp", work, lambda s: J.stream_prune_locks(s, f"{work}/out", work), LOCK_CUTS)
    return _read(f, f"{work}/out")


def stream_persistent_waits(f):
    work = _work(f)
    _runs(f, _locks(f), "bl_timestamp", work, lambda s: J.stream_persistent_waits(s, f"{work}/out", work), LOCK_CUTS)
    return _read(f, f"{work}/out")


def _counted(width, work):
    return lambda s: J.append_to(J.tumbling(s, "ts", width, "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n")]), f"{work}/out", f"{work}/cp")


def _typed_events(f):
    return f.table("events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")


def stream_tumbling(f):
    work = _work(f)
    _runs(f, _typed_events(f), "ts", work, _counted("1 day", work))
    return _read(f, f"{work}/out")


def stream_late_rows(f):
    """A late delivery: rows older than the watermark are ignored."""
    work, df = _work(f), _typed_events(f)
    late = df.withColumn("event_type", F.lit("late")).where(F.col("ts") < CUTS[0])
    _runs(f, df, "ts", work, _counted("1 hour", work), extra=late)
    return _read(f, f"{work}/out")


QUERIES = {
    "stream_delta": stream_delta,
    "stream_changed_only": stream_changed_only,
    "stream_sproc_load": stream_sproc_load,
    "stream_db_size": stream_db_size,
    "stream_summary": stream_summary,
    "stream_export": stream_export,
    "stream_prune_locks": stream_prune_locks,
    "stream_persistent_waits": stream_persistent_waits,
    "stream_tumbling": stream_tumbling,
    "stream_late_rows": stream_late_rows,
}

_DELTA = """select sp_host_id, sp_sproc_id, sp_timestamp, coalesce(sp_calls - lag(sp_calls) over w, 0) as d_sp_calls, coalesce(sp_total_time - lag(sp_total_time) over w, 0) as d_sp_total_time,
  coalesce(sp_self_time - lag(sp_self_time) over w, 0) as d_sp_self_time from sproc_performance_data window w as (partition by sp_sproc_id order by sp_timestamp)"""

ORACLE = {
    "stream_delta": _DELTA,
    "stream_changed_only": BASIC["changed_only"],
    "stream_sproc_load": f"""with d as ({_DELTA}), wm as (select max(sp_timestamp) - interval 1 hour as mark from sproc_performance_data),
b as (select sp_host_id as host_id, time_bucket(interval 15 minute, sp_timestamp) as bucket, sum(d_sp_self_time) as ms from d group by 1, 2)
select host_id, bucket, {rn("(sum(ms) over (partition by host_id order by bucket rows 1 preceding) / 900000.0)", 2)} as load_15min from b, wm where bucket + interval 15 minute <= mark""",
    "stream_db_size": f"select s.* from ({_TOTALS}) s where ts <= (select max(tsd_timestamp) - interval 1 hour from table_size_data)",
    "stream_summary": _SS + " select * from ss",
    "stream_export": f"""with d as (select load_host_id as host, load_timestamp, xlog_location_mb - lag(xlog_location_mb) over w as x, {secs('load_timestamp', 'lag(load_timestamp) over w')} as el from host_load window w as (partition by load_host_id order by load_timestamp))
select 'load' as measurement, host, {sql_rate('x', 'el', 3600000000)} as xlog_b_1h_rate, cast(epoch(load_timestamp) as bigint) as time from d where x >= 0 and load_timestamp <= timestamp '2024-01-30 23:59:50'""",
    "stream_prune_locks": LOCKS["prune_locks"],
    "stream_persistent_waits": LOCKS["persistent_waits"],
    "stream_tumbling": "select cast(date_trunc('day', ts) as timestamp) as bucket, event_type, count(*) as n from events group by 1, 2 having bucket + interval 1 day <= (select max(ts) - interval 1 hour from events)",
    "stream_late_rows": "select date_trunc('hour', ts) as bucket, event_type, count(*) as n from events group by 1, 2 having bucket + interval 1 hour <= (select max(ts) - interval 1 hour from events)",
}
