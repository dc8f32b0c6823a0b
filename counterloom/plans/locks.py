"""Lock reports: pruning, persistent waits and blocking incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..functions.predicates import ADVISORY_LOCK, EXPECTED_BLOCKED, in_range, like_any, opt_eq
from ..functions.times import bucket
from ..operators.joins import flag_own_overlaps, keyed_by_identity, lock_match
from ..operators.series import PREV, with_previous
from ..sources.fleet import Fleet

AT = ["bl_host_id", "bl_timestamp"]
IDENT = ["kind", "ident"]


def _other_pids(rows: DataFrame) -> DataFrame:
    """Smallest and largest pid per lock identity: enough to tell whether another pid has it."""
    return keyed_by_identity(rows).groupBy(*AT, *IDENT).agg(F.min("pid").alias("_lo"), F.max("pid").alias("_hi"))


def _sharing(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Keyed rows whose lock identity is also held by a different pid in ``others``."""
    cond = [rows[c] == others[c] for c in (*AT, *IDENT)]
    differs = (rows["pid"] != others["_lo"]) | (rows["pid"] != others["_hi"])
    return rows.join(others, [*cond, differs], "left_semi")


def prune_locks(locks: DataFrame) -> DataFrame:
    """All waiting rows, and the granted rows some other process waits for in the same snapshot.

    Waiting rows are first reduced to one row per lock identity, so the match is linear however
    many processes queue on one lock. Lock rows are unique within a snapshot.
    """
    waiting = locks.where("not granted")
    held = keyed_by_identity(locks.where("granted"))
    kept = _sharing(held, _other_pids(waiting)).drop(*IDENT).distinct()
    return waiting.unionByName(kept)


def snapshots(locks: DataFrame) -> DataFrame:
    """Each snapshot of a host with the one before it; one row per poll."""
    polls = locks.select(*AT).distinct()
    return with_previous(polls, ["bl_host_id"], "bl_timestamp", []).withColumnRenamed(PREV + "bl_timestamp", "prev_ts")


def persistent_waits(locks: DataFrame) -> DataFrame:
    """Processes waiting for the same lock in two consecutive snapshots, and who shares that lock.

    Returns host, snapshot, pid and role (``waiter`` or ``blocker``).
    """
    waiting = keyed_by_identity(locks.where("not granted")).select(*AT, "pid", *IDENT).distinct()
    before = waiting.withColumnRenamed("bl_timestamp", "prev_ts")
    lasting = waiting.join(snapshots(locks), AT).join(before, ["bl_host_id", "prev_ts", "pid", *IDENT], "left_semi")
    waiters = lasting.select(*AT, "pid").distinct()
    # every lock a lasting waiter waits for, not only the one it kept waiting for
    wanted = waiting.join(waiters, [*AT, "pid"], "left_semi").groupBy(*AT, *IDENT).agg(
        F.min("pid").alias("_lo"), F.max("pid").alias("_hi")
    )
    all_keyed = keyed_by_identity(locks).select(*AT, "pid", *IDENT)
    blockers = _sharing(all_keyed, wanted).select(*AT, "pid").distinct()
    return waiters.withColumn("role", F.lit("waiter")).unionByName(blockers.withColumn("role", F.lit("blocker")))


def incidents(locks: DataFrame, processes: DataFrame, start=None, end=None, per: str | None = None) -> DataFrame:
    """Waiter/holder pairs with the time span in which they were seen, by lock and statements.

    With ``per`` (``day``, ``hour``) spans are cut at period borders, so one run covers many periods.
    """
    df = in_range(locks, "bl_timestamp", start, end, closed_end=True)
    pairs = lock_match(df.where("not granted"), df.where("granted"), *AT)
    p = in_range(processes, "bp_timestamp", start, end, closed_end=True).select(
        F.col("bp_host_id").alias("bl_host_id"), F.col("bp_timestamp").alias("bl_timestamp"), "pid", "query"
    ).distinct()
    waiter = p.withColumnsRenamed({"pid": "blocked_pid", "query": "blocked_query"})
    holder = p.withColumnsRenamed({"pid": "blocking_pid", "query": "blocking_query"})
    period = F.lit(None).cast("timestamp") if per is None else bucket(F.col("bl_timestamp"), per)
    return (
        pairs.join(waiter, [*AT, "blocked_pid"]).join(holder, [*AT, "blocking_pid"])
        .groupBy(F.col("bl_host_id").alias("host_id"), period.alias("period"), "blocked_pid", "blocking_pid", "relation",
                 "blocked_query", "blocking_query")
        .agg(F.min("bl_timestamp").alias("start_time"), F.max("bl_timestamp").alias("end_time"))
    )


def _report(fleet: Fleet, start, end, shortname, ignore_advisory: bool, per, by: str, other: str, host_name: str) -> DataFrame:
    hosts = opt_eq(fleet.table("hosts"), "host_ui_shortname", shortname).select("host_id", host_name)
    locks = fleet.samples("blocking_locks", None, start, end, closed_start=True)
    if shortname is not None:
        locks = locks.join(hosts, locks["bl_host_id"] == hosts["host_id"], "left_semi")
    inc = incidents(locks, fleet.samples("blocking_processes", None, start, end, closed_start=True), start, end, per)
    inc = inc.withColumn("period", F.coalesce("period", F.timestamp_seconds(F.lit(0))))
    roots = flag_own_overlaps(
        inc, ["host_id", "period"], "blocking_pid", "blocked_pid", "start_time", "end_time", "is_blocked"
    ).where("not is_blocked")
    seconds = half_up((F.unix_micros("end_time") - F.unix_micros("start_time")) / F.lit(1e6))
    grouped = (
        roots.withColumn("delta_s", seconds)
        .groupBy("host_id", "period", "start_time", "delta_s", "blocking_pid", "relation", by)
        .agg(F.countDistinct("blocked_pid").alias("threads"), F.max(other).alias(other))
    )
    shown = grouped.where(_unexpected(F.col("blocked_query"), ignore_advisory))
    keys = ["host_id", by] if per is None else ["host_id", "period", by]
    out = shown.groupBy(*keys).agg(
        F.sum("delta_s").alias("total_time_ss"), F.sum("threads").alias("threads_count"),
        F.count(F.lit(1)).alias("incidents_count"), F.max(other).alias(f"one_{other}"),
    )
    named = out.join(hosts, "host_id").drop("host_id")
    return named.orderBy(host_name, F.desc("total_time_ss"))


def _unexpected(blocked: Column, ignore_advisory: bool) -> Column:
    keep = ~like_any(blocked, EXPECTED_BLOCKED)
    return keep & ~blocked.like(ADVISORY_LOCK) if ignore_advisory else keep


def blocking_report(fleet: Fleet, start=None, end=None, shortname: str | None = None, ignore_advisory: bool = True, per: str | None = None) -> DataFrame:
    """Blocking statements per host: time, threads and incidents; chains count at their root only."""
    return _report(fleet, start, end, shortname, ignore_advisory, per, "blocking_query", "blocked_query", "host_ui_shortname")


def blocking_last_day(fleet: Fleet, start=None, end=None, ignore_advisory: bool = True, per: str | None = None) -> DataFrame:
    return _report(fleet, start, end, None, ignore_advisory, per, "blocking_query", "blocked_query", "host_name")


def blocked_last_hour(fleet: Fleet, start=None, end=None, ignore_advisory: bool = True, per: str | None = None) -> DataFrame:
    """Blocked statements per host, with one of their blockers."""
    return _report(fleet, start, end, None, ignore_advisory, per, "blocked_query", "blocking_query", "host_name")


def locks_report(report: DataFrame, min_seconds: int = 5) -> DataFrame:
    return report.where(F.col("total_time_ss") > min_seconds).orderBy("host_ui_shortname", F.desc("incidents_count"))
