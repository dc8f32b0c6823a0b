"""Joins with a meaning of their own: lock conflicts, ignore lists, overlapping intervals.

No side is forced to be broadcast: Spark broadcasts a side whose measured size is below
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles on the join keys, where
adaptive execution splits skewed keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import bucket


def lock_identities() -> Column:
    """The up to four identities of a lock row; rows conflict when they share one.

    Turning the disjunction into keys makes the match an equi-join on (host, ts, kind, id).
    """

    def entry(kind: str, present: Column, *parts: str) -> Column:
        ident = F.concat_ws("/", *(F.col(p).cast("string") for p in parts))
        return F.when(present, F.struct(F.lit(kind).alias("kind"), ident.alias("ident")))

    def known(*parts: str) -> Column:
        out = F.col(parts[0]).isNotNull()
        for p in parts[1:]:
            out = out & F.col(p).isNotNull()
        return out

    return F.array_compact(
        F.array(
            entry("xid", known("transactionid"), "transactionid"),
            entry("vxid", known("virtualxid"), "virtualxid"),
            entry("object", known("classid", "objid", "objsubid"), "classid", "objid", "objsubid"),
            entry("relation", known("database", "relation"), "database", "relation"),
        )
    )


def keyed_by_identity(locks: DataFrame) -> DataFrame:
    out = locks.withColumn("_id", F.explode(lock_identities()))
    return out.select("*", F.col("_id.kind").alias("kind"), F.col("_id.ident").alias("ident")).drop("_id")


def lock_match(waiting: DataFrame, holding: DataFrame, host: str, ts: str) -> DataFrame:
    """Distinct (host, ts, waiter, holder, relation) of conflicting rows of different pids.

    Pairs are the result here; a group is one lock in one snapshot of one host, so it has no more
    members than the server has processes.
    """
    at = [host, ts, "kind", "ident"]
    w = keyed_by_identity(waiting).select(*at, F.col("pid").alias("blocked_pid"), "relation")
    h = keyed_by_identity(holding).select(*at, F.col("pid").alias("blocking_pid"))
    # one shuffle on the join keys serves both the de-duplication and the join
    w, h = (side.repartition(*at).distinct() for side in (w, h))
    pairs = w.join(h, at).where("blocked_pid <> blocking_pid")
    return pairs.drop("kind", "ident").distinct()


def not_ignored(df: DataFrame, ignore: DataFrame, host: str, name: str) -> DataFrame:
    """Drop rows on an ignore list ``(host_id, object_name)`` whose nulls are wildcards.

    Each wildcard form is an equi anti join of its own, so the list may grow.
    """
    both = ignore.where("host_id is not null and object_name is not null").select(
        F.col("host_id").alias("_ih"), F.col("object_name").alias("_io")
    )
    hosts = ignore.where("host_id is not null and object_name is null").select(F.col("host_id").alias("_ih"))
    names = ignore.where("host_id is null and object_name is not null").select(F.col("object_name").alias("_io"))
    everything = ignore.where("host_id is null and object_name is null").agg(F.count(F.lit(1))).scalar()
    return (
        df.join(hosts, F.col(host) == F.col("_ih"), "left_anti")
        .join(names, F.col(name) == F.col("_io"), "left_anti")
        .join(both, (F.col(host) == F.col("_ih")) & (F.col(name) == F.col("_io")), "left_anti")
        .where(everything == 0)
    )


def flag_overlaps(
    df: DataFrame, other: DataFrame, keys: Sequence[str], start: str, end: str, flag: str, *, chunk: str = "day"
) -> DataFrame:
    """Add ``flag``: does an interval of ``other`` with equal keys overlap [start, end]?

    Exact and without forming pairs: some interval overlaps iff the largest end among those
    that start no later than ``end`` reaches ``start``. That is a running maximum over starts
    and query points in time order; it is cut into chunks, each primed with the maximum of the
    chunks before it, so one busy key is spread over many tasks.
    """
    cols = df.columns
    points = df.select(*cols, F.col(end).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("timestamp").alias("_e"))
    marks = other.select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.col(end).alias("_e"))
    return _running_flag(points.unionByName(marks, allowMissingColumns=True), cols, keys, start, flag, chunk)


def flag_own_overlaps(
    df: DataFrame, keys: Sequence[str], asking: str, marking: str, start: str, end: str, flag: str, *, chunk: str = "day"
) -> DataFrame:
    """:func:`flag_overlaps` of a frame with itself: rows of nonzero length, flagged when an interval whose
    ``marking`` column equals their ``asking`` column overlaps. The frame is read once; each row
    yields its query point and its mark."""
    point = F.struct(F.col(asking).alias("_k"), F.col(end).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("timestamp").alias("_e"))
    mark = F.struct(F.col(marking).alias("_k"), F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.col(end).alias("_e"))
    both = df.withColumn("_p", F.explode(F.array_compact(F.array(F.when(F.col(start) != F.col(end), point), mark))))
    both = both.select(*df.columns, "_p.*")
    return _running_flag(both, df.columns, [*keys, "_k"], start, flag, chunk)


def _running_flag(both: DataFrame, cols: Sequence[str], keys: Sequence[str], start: str, flag: str, chunk: str) -> DataFrame:
    both = both.withColumn("_chunk", bucket(F.col("_at"), chunk))
    # the query points only contribute the chunks that need priming
    per_chunk = both.groupBy(*keys, "_chunk").agg(F.max("_e").alias("_e"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    primed = per_chunk.select(
        *keys, "_chunk", F.col("_chunk").alias("_at"), F.lit(-1).alias("_kind"), F.max("_e").over(earlier).alias("_e")
    )
    running = Window.partitionBy(*keys, "_chunk").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    out = (
        both.unionByName(primed, allowMissingColumns=True)
        .withColumn("_reach", F.max("_e").over(running))
        .where("_kind = 1")
    )
    return out.select(*cols, F.coalesce(F.col("_reach") >= F.col(start), F.lit(False)).alias(flag))


def rows_for_hosts(df: DataFrame, groups: DataFrame, host: str, array_col: str) -> DataFrame:
    """Array-membership join: rows whose host is listed in the array of a group."""
    listed = groups.withColumn("_member", F.explode(array_col))
    return df.join(listed, df[host] == listed["_member"]).drop("_member")


def values_at(df: DataFrame, stamps: DataFrame, host: str, ts: str) -> DataFrame:
    """Rows at a given timestamp per host; ``stamps`` has the host and ``at``."""
    s = stamps.select(F.col(stamps.columns[0]).alias("_h"), F.col("at").alias("_at"))
    return df.join(s, (F.col(host) == F.col("_h")) & (F.col(ts) == F.col("_at"))).drop("_h", "_at")
