"""Statement reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up, pretty_ms, ratio
from ..functions.predicates import in_range, not_copy_ddl, not_utility
from ..functions.text import clip, normalise_query
from ..operators.series import counter_delta, counter_range
from ..operators.topn import top_n, top_per_mode
from ..schema import METRICS, Reset
from ..sources.fleet import Fleet

SHOWN_QUERY = 55
COUNTERS = list(METRICS["stat_statements_data"].counters)


def top_statements(fleet: Fleet, int1_start, int2_start, host=None, limit: int = 10) -> DataFrame:
    """Top statements by calls, average and total time, over two look-back intervals.

    Both intervals and all three orders come from one aggregation of the samples; the second
    interval is a conditional range inside the first.
    """
    df = fleet.samples("stat_statements_data", host, int1_start)
    recent = F.col("ssd_timestamp") > F.lit(int2_start).cast("timestamp")

    def span(c: str, cond: Column | None = None) -> Column:
        v = F.col(c) if cond is None else F.when(cond, F.col(c))
        return F.max(v) - F.min(v)

    per = df.groupBy(
        F.col("ssd_host_id").alias("host_id"), F.col("ssd_query_id").alias("query_id"),
        clip(normalise_query(F.col("ssd_query")), SHOWN_QUERY).alias("query"),
    ).agg(
        span("ssd_calls").alias("c1"), span("ssd_total_time").alias("t1"),
        span("ssd_calls", recent).alias("c2"), span("ssd_total_time", recent).alias("t2"),
    )
    both = per.select("host_id", "query_id", "query", F.expr("stack(2, 'int1', c1, t1, 'int2', c2, t2) as (span, calls, total_ms)"))
    both = both.where("calls > 0 and total_ms > 0").withColumn("avg_ms", half_up(ratio(F.col("total_ms"), F.col("calls")), 3))
    orders = {"calls": F.col("calls"), "avg": F.col("avg_ms"), "total": F.col("total_ms")}
    top = top_per_mode(both, orders, ["host_id", "span"], ["query_id", "query"], limit)
    return top.select(
        "host_id", F.concat_ws("_", "mode", "span").alias("mode"), "query", "query_id", "calls", "total_ms", "avg_ms",
        pretty_ms(F.col("avg_ms")).alias("avg_time_pretty"), pretty_ms(F.col("total_ms")).alias("total_time_pretty"),
    )


# Report columns a caller may order by, in menu order.
REPORT_ORDERS = ("calls", "total_time", "blks_read", "blks_written", "temp_blks_read", "temp_blks_written", "avg_runtime_ms")


def statement_report(
    fleet: Fleet, host=None, start=None, end=None, *, order: str = "calls", limit: int | None = 50,
    no_copy_ddl: bool = True, min_calls: int = 3,
) -> DataFrame:
    """Counter ranges per statement in [start, end), with the chosen order, unset values last."""
    if order not in REPORT_ORDERS:
        raise ValueError(f"order must be one of {REPORT_ORDERS}")
    df = fleet.samples("stat_statements_data", host, start, end, closed_start=True, open_end=True)
    if no_copy_ddl:
        df = df.where(not_copy_ddl(F.col("ssd_query")))
    per = df.groupBy(F.col("ssd_host_id").alias("host_id"), F.col("ssd_query_id").alias("query_id")).agg(
        F.max("ssd_query").alias("query"), *((F.max(c) - F.min(c)).alias(c[4:]) for c in COUNTERS)
    ).where(F.col("calls") >= min_calls)
    out = per.withColumn("avg_runtime_ms", half_up(ratio(F.col("total_time"), F.col("calls"))))
    out = out.withColumn("query", F.ltrim(F.regexp_replace("query", r"[ \t\r]+", " ")))
    names = fleet.table("hosts").select("host_id", "host_ui_shortname")
    by = [F.desc_nulls_last(order), F.asc("query_id")]
    if limit is not None:
        out = top_n(out, ["host_id"], by, limit)
    return out.join(names, "host_id").drop("host_id").orderBy("host_ui_shortname", *by)


def statement_series(fleet: Fleet, host=None, query_id: int | None = None, start=None, end=None) -> DataFrame:
    """Delta series of one statement, or of all."""
    df = fleet.samples("stat_statements_data", host, start, end, closed_start=True)
    if query_id is not None:
        df = df.where(F.col("ssd_query_id") == query_id)
    df = df.select("ssd_host_id", "ssd_query_id", "ssd_timestamp", *COUNTERS)
    d = counter_delta(df, ["ssd_host_id", "ssd_query_id"], "ssd_timestamp", COUNTERS, Reset.RAW).where("elapsed_s is not null")
    out = d.select(F.col("ssd_host_id").alias("host_id"), F.col("ssd_query_id").alias("query_id"), F.col("ssd_timestamp").alias("ts"),
                   *(F.col("d_" + c).alias(c[4:]) for c in COUNTERS))
    avg = F.when(F.col("calls") > 0, half_up(ratio(F.col("total_time"), F.col("calls")), 2)).otherwise(F.lit(0.0))
    return out.withColumn("avg_runtime", avg)


def statement_heavy_hitters(df: DataFrame, k: int = 500) -> DataFrame:
    """Statements of a snapshot in any of six top-``k`` lists.

    ``df`` holds raw statement snapshots; equal texts are summed first. Ties at the cut are
    resolved by text.
    """
    base = df.where((F.col("ssd_calls") > 1) & (F.col("ssd_total_time") > 0) & not_utility(F.col("ssd_query")))
    snap = ["ssd_host_id", "ssd_timestamp", "ssd_query"]
    sums = base.groupBy(*snap).agg(*(F.sum(c).alias(c[4:]) for c in COUNTERS))
    positive = {c: F.when(F.col(c) > 0, F.col(c)) for c in ("total_time", "blks_read", "blks_written", "temp_blks_read", "temp_blks_written")}
    top = top_per_mode(sums, {"calls": F.col("calls"), **positive}, snap[:2], ["ssd_query"], k)
    return top.drop("mode").dropDuplicates(snap)


def statement_ranges(df: DataFrame) -> DataFrame:
    """Policy P6 per statement over the whole frame."""
    return counter_range(df, ["ssd_host_id", "ssd_query_id"], COUNTERS)
