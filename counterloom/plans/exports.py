"""Export of metrics as points that catches up in bounded chunks and resumes where it ended.

A measurement is a :class:`VersionedTable`: each chunk's points are one version, and the time up to which each host is exported is committed
with them. A chunk that broke off is repeated in place, so every point is written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import METRICS
from ..sources.fleet import Fleet
from ..sources.versions import VersionedTable
from .metrics import as_points, metric

_EXPORTED = "host_id int, exported_to timestamp"


def plan_chunks(hosts: DataFrame, exported: DataFrame, as_of, *, first_days: int = 30, chunk_days: int = 3, margin_s: int = 10) -> DataFrame:
    """(host_id, chunk_from, chunk_to), the next range to export of each host that has one.

    A host begins where it ended last, or ``first_days`` back. One that is more than ``chunk_days`` behind gets that many days,
    others all up to ``margin_s`` seconds ago, since the newest samples may not be complete.
    """
    now = F.lit(as_of).cast("timestamp")
    days = F.expr(f"interval {chunk_days} days")
    begin = F.coalesce("exported_to", now - F.expr(f"interval {first_days} days"))
    end = F.when(F.col("chunk_from") < now - days, F.col("chunk_from") + days).otherwise(now - F.expr(f"interval {margin_s} seconds"))
    known = hosts.select(F.col("host_id").cast("int").alias("host_id")).where("host_id is not null").distinct()
    return known.join(exported, "host_id", "left").select("host_id", begin.alias("chunk_from")).withColumn("chunk_to", end).where("chunk_from < chunk_to")


def _within(fleet: Fleet, chunks: DataFrame, low, high, lag: str) -> Fleet:
    """The fleet's samples of each host's chunk and of the look-back before it."""

    def opener(_: Fleet, name: str) -> DataFrame:
        if name not in METRICS:
            return fleet.table(name)
        m = METRICS[name]
        df = fleet.samples(name, None, low, high, lag)
        mine = chunks.select(F.col("host_id").alias("_host"), (F.col("chunk_from") - F.expr(f"interval {lag}")).alias("_low"), F.col("chunk_to").alias("_high"))
        inside = (F.col(m.host) == F.col("_host")) & (F.col(m.ts) > F.col("_low")) & (F.col(m.ts) <= F.col("_high"))
        return df.join(mine, inside, "left_semi")

    return Fleet(fleet.spark, opener)


def export_chunk(fleet: Fleet, name: str, table: VersionedTable, as_of, *, lag: str = "4 hours", **planning) -> bool:
    """Write the next chunk of every host in one job; false if there was none.

    ``lag`` is how far before a chunk the sample behind its first delta is looked for.
    """
    done = table.carried("exported", _EXPORTED)
    chunks = plan_chunks(fleet.table("hosts"), done, as_of, **planning)
    low, high = chunks.agg(F.min("chunk_from"), F.max("chunk_to")).first()
    if low is None:
        return False
    rows = metric(name, _within(fleet, chunks, low, high, lag), None, low, high, lag)
    rows = rows.join(chunks.select("host_id", "chunk_from"), "host_id").where(F.col("timestamp") > F.col("chunk_from")).drop("chunk_from")
    table.append(as_points(name, fleet, rows))
    reached = done.join(chunks, "host_id", "full").select("host_id", F.coalesce("chunk_to", "exported_to").alias("exported_to"))
    table.carry("exported", reached.coalesce(1))
    table.commit(high)
    return True


def catch_up(fleet: Fleet, name: str, table: VersionedTable, as_of, **options) -> DataFrame:
    """Export chunk by chunk until every host is at ``as_of`` less the margin; returns all points exported so far."""
    while export_chunk(fleet, name, table, as_of, **options):
        pass
    return table.appended()
