"""Detectors: current values against baselines of earlier weeks, shards and periods.

Every detector evaluates one period or, without a date, all of them in one job: a summary row
serves as baseline for the same weekday in each of the following ``weeks`` weeks, so it is fanned
out ``weeks`` times and aggregated by the evaluated period. Work grows with the summary, not with
its square.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up, pct_over, ratio
from ..functions.times import bucket
from ..functions.text import proc_base_name
from ..operators.joins import not_ignored
from ..operators.sets import union_all
from ..sources.fleet import Fleet
from .summaries import HOST_TOTAL

MICRO = 1_000_000


@dataclass(frozen=True)
class Limits:
    weeks: int = 4
    percent: int = 30
    total_percent: int = 50
    min_total_ms: int = 1_000_000
    cache_misses: int = 1_000_000
    table_size: int = 1_000_000
    table_scans: int = 10_000
    shard_total_ms: int = 1_000_000
    shard_scans: int = 100_000
    shard_factor: int = 10
    max_higher_values: int = 3
    past_days: int = 7


def _micro(c: Column) -> Column:
    """A quotient as fixed-point integer, so that sums do not depend on row order."""
    return half_up(c * F.lit(float(MICRO)))


def _in_micros(c: Column, factor: int = 1) -> Column:
    """A sum times ``factor``, comparable with sums of ``_micro``; a decimal, since sums of large fleets times this leave 64 bits."""
    return c.cast("decimal(38,0)") * F.lit(factor * MICRO)


def _percent(c: Column, more: int) -> Column:
    """100 + ``more`` times a sum of ``_micro``, as a decimal."""
    return c.cast("decimal(38,0)") * F.lit(100 + more)


def _for_weeks(df: DataFrame, date: str, weeks: int) -> DataFrame:
    """Fan a summary out to the later dates it is a baseline for, as ``eval_date``."""
    offsets = F.array(*(F.lit(7 * k) for k in range(1, weeks + 1)))
    return df.withColumn("_days", F.explode(offsets)).withColumn("eval_date", F.date_add(F.col(date), F.col("_days"))).drop("_days")


def _on_date(df: DataFrame, column: str, date) -> DataFrame:
    return df if date is None else df.where(F.col(column) == F.lit(date).cast("date"))


def _hosts(fleet: Fleet) -> DataFrame:
    return fleet.table("hosts").select(F.col("host_id").alias("_host"), "host_name")


# --- procedures ---------------------------------------------------------------------------


def _sproc_alerts(
    fleet: Fleet, summary: DataFrame, ignore: DataFrame, limits: Limits, percent: int, date, hour, eval_avg: bool,
    combine: bool, only_totals: bool, past: DataFrame | None,
) -> DataFrame:
    rows = summary.where(~F.col("ss_is_suspect") & ((F.col("ss_sproc_name") == HOST_TOTAL) == only_totals))
    current = _on_date(rows, "ss_date", date)
    if hour is not None:
        rows, current = rows.where(F.col("ss_hour") == hour), current.where(F.col("ss_hour") == hour)
    current = current.select(
        F.col("ss_date").alias("eval_date"), "ss_hour", "ss_sproc_name", "ss_host_id", "ss_calls", "ss_total_time"
    )
    # an ignore entry naming a procedure never mutes a host total
    listed = ignore.where("object_name is null") if only_totals else ignore
    past_rows = not_ignored(rows, listed, "ss_host_id", "ss_sproc_name") if combine else rows
    fanned = _on_date(_for_weeks(past_rows, "ss_date", limits.weeks), "eval_date", date)
    keys = ["eval_date", "ss_hour", "ss_sproc_name"] + ([] if combine else ["ss_host_id"])
    base = fanned.groupBy(*keys).agg(
        F.countDistinct("ss_date").alias("weeks_cnt"),
        F.greatest(F.sum("ss_calls"), F.lit(1).cast("bigint")).alias("base_calls"),
        F.greatest(F.sum("ss_total_time"), F.lit(1).cast("bigint")).alias("base_time"),
    ).withColumn("weight", F.lit(1).cast("bigint"))

    if only_totals and combine:
        # a host takes part only if it belongs to the baseline
        current = current.join(fanned.select("eval_date", "ss_hour", "ss_host_id").distinct(), ["eval_date", "ss_hour", "ss_host_id"], "left_semi")
    if not only_totals:
        # heavy procedures without history count against a baseline of 1 call and 1 ms
        known = fanned.select("eval_date", "ss_hour", "ss_sproc_name", "ss_host_id").distinct()
        fresh = current.where((F.col("ss_total_time") > limits.min_total_ms) & (F.col("ss_calls") > 0)).join(
            known, ["eval_date", "ss_hour", "ss_sproc_name", "ss_host_id"], "left_anti"
        )
        one = F.lit(1).cast("bigint")
        base = base.unionByName(
            fresh.groupBy(*keys).agg(F.count(F.lit(1)).alias("weight")).withColumns(
                {"weeks_cnt": one, "base_calls": one, "base_time": one}
            )
        )

    hit = not_ignored(current.where("ss_calls > 0").join(base, keys), listed, "ss_host_id", "ss_sproc_name")
    hit = hit.join(_hosts(fleet), F.col("ss_host_id") == F.col("_host"))
    weekly = ratio(F.col("base_time"), F.col("weeks_cnt"))
    base_avg = ratio(F.col("base_time"), F.col("base_calls"))
    cur_avg = ratio(F.col("ss_total_time"), F.col("ss_calls"))
    over_total = F.col("base_time") * (100 + percent) < F.col("ss_total_time") * 100 * F.col("weeks_cnt")
    over_avg = base_avg * F.lit(float(100 + percent)) < cur_avg * F.lit(100.0)

    if not combine:
        hit = hit.where((F.col("ss_total_time") > limits.min_total_ms) & (over_avg if eval_avg else over_total))
        out = hit.select(
            "eval_date", "ss_hour", "ss_host_id", F.array("host_name").alias("host_names"), F.col("ss_sproc_name").alias("sproc_name"),
            F.col("ss_calls").alias("calls"), F.col("ss_total_time").alias("total_time"),
            F.floor(cur_avg).alias("avg_time"),
            (pct_over(cur_avg, base_avg) if eval_avg else pct_over(F.col("ss_total_time"), weekly)).alias("time_percent_increase"),
        )
        if past is not None:
            out = is_new_high(out, past, ["ss_host_id", "sproc_name"], "eval_date", "total_time", limits)
        return out.drop("ss_host_id")

    w = F.col("weight")
    if not eval_avg:
        hit = hit.where(over_total)
    grouped = hit.groupBy("eval_date", "ss_hour", "ss_sproc_name").agg(
        F.array_sort(F.collect_set("host_name")).alias("host_names"),
        F.sum(F.col("ss_calls") * w).alias("calls"), F.sum(F.col("ss_total_time") * w).alias("total_time"), F.sum(w).alias("n"),
        F.sum(_micro(weekly) * w).alias("weekly"), F.sum(_micro(base_avg) * w).alias("base_avg"), F.sum(_micro(cur_avg) * w).alias("cur_avg"),
    ).where(F.col("total_time") > limits.min_total_ms)
    if eval_avg:
        if only_totals:
            above = F.col("base_avg") / F.col("n") * F.lit(float(100 + percent)) < ratio(F.col("total_time"), F.col("calls")) * F.lit(100.0 * MICRO)
        else:
            above = _percent(F.col("base_avg"), percent) < F.col("cur_avg").cast("decimal(38,0)") * 100
        grouped = grouped.where(above)
        increase = pct_over(F.col("cur_avg"), F.col("base_avg"))
    else:
        increase = pct_over(_in_micros(F.col("total_time")), F.col("weekly"))
    return grouped.select(
        "eval_date", "ss_hour", "host_names", F.col("ss_sproc_name").alias("sproc_name"), "calls", "total_time",
        half_up(ratio(F.col("total_time"), F.col("calls"))).alias("avg_time"), increase.alias("time_percent_increase"),
    )


def sproc_hourly_alerts(
    fleet: Fleet, summary: DataFrame, ignore: DataFrame, limits: Limits = Limits(), *, date=None, hour: int | None = None,
    eval_avg: bool = False, combine: bool = True, past: DataFrame | None = None,
) -> DataFrame:
    """Procedures whose hour took much longer than the same hour of the same weekday before.

    Combined, the all-host baseline of a procedure is held against each host's row and the hosts
    that exceed it are summed. ``past`` (a summary) switches the new-high noise filter on.
    """
    return _sproc_alerts(fleet, summary, ignore, limits, limits.percent, date, hour, eval_avg, combine, False, past)


def host_total_alerts(
    fleet: Fleet, summary: DataFrame, ignore: DataFrame, limits: Limits = Limits(), *, date=None, hour: int | None = None,
    eval_avg: bool = False, combine: bool = True, past: DataFrame | None = None,
) -> DataFrame:
    """The same on the hosts' total rows."""
    out = _sproc_alerts(fleet, summary, ignore, limits, limits.total_percent, date, hour, eval_avg, combine, True, past)
    return out.drop("sproc_name")


def is_new_high(
    found: DataFrame, past: DataFrame, keys: list[str], date: str, value: str, limits: Limits = Limits()
) -> DataFrame:
    """Noise filter: keep a finding only if fewer than ``max_higher_values`` values of the same object
    were higher in the days up to it.

    ``past`` has the keys, the date and the value under the same names. A finding is matched to the
    dates of its window by equality, so the join is a plain hash join.
    """
    days = F.array(*(F.lit(d) for d in range(limits.past_days)))
    f = found.select(*keys, date, value).distinct()
    windowed = f.withColumn("_back", F.explode(days)).withColumn("_on", F.date_sub(F.col(date), F.col("_back"))).drop("_back")
    p = past.select(*keys, F.col(date).alias("_on"), F.col(value).alias("_v"))
    noisy = (
        windowed.join(p, [*keys, "_on"]).where(F.col("_v") > F.col(value))
        .groupBy(*keys, date, value).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= limits.max_higher_values)
    )
    return found.join(noisy.drop("_n"), [*keys, date, value], "left_anti")


def sproc_history(summary: DataFrame, host: int, name: str, limit: int = 2000) -> DataFrame:
    """Hourly values of one procedure, newest first."""
    df = summary.where((F.col("ss_host_id") == host) & (F.col("ss_sproc_name") == name) & (F.col("ss_calls") > 0))
    return df.select(
        F.floor(ratio(F.col("ss_total_time"), F.col("ss_calls"))).alias("avg_time"), "ss_date", "ss_hour",
        F.col("ss_total_time").alias("total_time"), F.col("ss_calls").alias("calls"),
        F.when(F.col("ss_is_suspect"), "suspect").otherwise("").alias("is_suspect"),
    ).orderBy(F.desc("ss_date"), F.desc("ss_hour")).limit(limit)


# --- hosts ---------------------------------------------------------------------------------


def host_cache_alerts(
    fleet: Fleet, summary: DataFrame, clusters: DataFrame, limits: Limits = Limits(), *, date=None, past: DataFrame | None = None
) -> DataFrame:
    """Hosts or clusters with far more cache misses than on the same weekday before."""
    seen = summary.where(F.col("hs_cache_misses") > limits.cache_misses)
    base = _on_date(_for_weeks(seen, "hs_date", limits.weeks), "eval_date", date).groupBy("eval_date", "hs_host_id").agg(
        F.count(F.lit(1)).alias("weeks_cnt"), F.sum("hs_cache_misses").alias("base")
    )
    current = _on_date(summary, "hs_date", date).select(
        F.col("hs_date").alias("eval_date"), "hs_host_id", "hs_host_name", F.col("hs_cache_misses").alias("cache_misses")
    )
    hit = current.join(base, ["eval_date", "hs_host_id"]).where(
        F.col("base") * (100 + limits.percent) < F.col("cache_misses") * 100 * F.col("weeks_cnt")
    )
    members = clusters.join(_hosts(fleet), F.col("hc_host_id") == F.col("_host")).groupBy("hc_one_host_id").agg(
        F.array_sort(F.collect_set("host_name")).alias("members")
    )
    out = hit.join(members, F.col("hs_host_id") == F.col("hc_one_host_id"), "left").select(
        "eval_date", "hs_host_id", F.coalesce("members", F.array("hs_host_name")).alias("host_names"), "cache_misses",
        pct_over(F.col("cache_misses"), ratio(F.col("base"), F.col("weeks_cnt"))).alias("time_percent_increase"),
    )
    if past is not None:
        out = is_new_high(out, past, ["hs_host_id"], "eval_date", "cache_misses", limits)
    return out.drop("hs_host_id")


# --- tables --------------------------------------------------------------------------------

TABLE_VALUES = ("ts_table_size", "ts_index_size", "ts_seq_scans", "ts_index_scans")


def _table_base(summary: DataFrame, limits: Limits, date, combine: bool) -> DataFrame:
    keys = ["eval_date", "ts_table_name"] + ([] if combine else ["ts_host_id"])
    return _on_date(_for_weeks(summary, "ts_date", limits.weeks), "eval_date", date).groupBy(*keys).agg(
        F.countDistinct("ts_date").alias("weeks_cnt"), *(F.sum(c).alias("b_" + c) for c in TABLE_VALUES)
    )


def _table_current(summary: DataFrame, date) -> DataFrame:
    return _on_date(summary, "ts_date", date).withColumnRenamed("ts_date", "eval_date")


def table_daily_alerts(
    fleet: Fleet, summary: DataFrame, ignore: DataFrame, limits: Limits = Limits(), *, date=None, combine: bool = True,
    by_size: bool = False, past: DataFrame | None = None,
) -> DataFrame:
    """Tables whose daily growth in size, or number of scans, exceeds the weekly baseline."""
    value = "ts_table_size" if by_size else "ts_seq_scans"
    kept = not_ignored(summary, ignore, "ts_host_id", "ts_table_name")
    base = _table_base(kept if combine else summary, limits, date, combine).where(F.col("b_" + value) > 0)
    keys = ["eval_date", "ts_table_name"] + ([] if combine else ["ts_host_id"])
    hit = _table_current(kept, date).join(base, keys).join(_hosts(fleet), F.col("ts_host_id") == F.col("_host"))
    weekly = ratio(F.col("b_" + value), F.col("weeks_cnt"))
    if combine:
        g = hit.groupBy("eval_date", "ts_table_name").agg(
            F.array_sort(F.collect_set("host_name")).alias("host_names"), *(F.sum(c).alias(c) for c in TABLE_VALUES),
            F.sum("ts_orig_table_size").alias("orig"), F.sum(_micro(weekly)).alias("weekly"),
        ).where((F.col("orig") > limits.table_size) & (_percent(F.col("weekly"), limits.percent) < _in_micros(F.col(value), 100)))
        if not by_size:
            g = g.where(F.col("ts_seq_scans") > limits.table_scans)
        return g.select(
            "eval_date", "host_names", F.col("ts_table_name").alias("table_name"), *(F.col(c).alias(c[3:]) for c in TABLE_VALUES),
            pct_over(_in_micros(F.col(value)), F.col("weekly")).alias("percent_increase"),
        )
    hit = hit.where(
        (F.col("ts_orig_table_size") > limits.table_size)
        & (F.col("b_" + value) * (100 + limits.percent) < F.col(value) * 100 * F.col("weeks_cnt"))
    )
    if not by_size:
        hit = hit.where(F.col("ts_seq_scans") > limits.table_scans)
    if past is not None:
        hit = is_new_high(hit, past, ["ts_host_id", "ts_table_name"], "eval_date", value, limits)
    return hit.select(
        "eval_date", F.array("host_name").alias("host_names"), F.col("ts_table_name").alias("table_name"),
        F.col("ts_orig_table_size").alias("table_size"), F.col("ts_orig_index_size").alias("index_size"),
        F.col("ts_seq_scans").alias("seq_scans"), F.col("ts_index_scans").alias("index_scans"),
        pct_over(F.col(value), weekly).alias("percent_increase"),
    )


# Label of each watched quantity.
SET_LABELS = {
    "ts_table_size": " table size increase ",
    "ts_index_size": " index size increase ",
    "ts_seq_scans": " tables scans increase ",
    "ts_index_scans": " index scans increase ",
}


def table_set_alerts(
    fleet: Fleet, summary: DataFrame, ignore: DataFrame, limits: Limits = Limits(), *, date=None, combine: bool = True,
    tables: list[str] | None = None,
) -> DataFrame:
    """Size and scan growth of a set of tables over all four quantities, one labelled row each."""
    chosen = summary if tables is None else summary.where(F.col("ts_table_name").isin(*tables))
    base = _table_base(not_ignored(chosen, ignore, "ts_host_id", "ts_table_name"), limits, date, combine)
    keys = ["eval_date", "ts_table_name"] + ([] if combine else ["ts_host_id"])
    hit = _table_current(chosen, date).join(base, keys).join(_hosts(fleet), F.col("ts_host_id") == F.col("_host"))
    watched = F.array(*(
        F.struct(F.lit(label).alias("label"), F.col(c).alias("value"), F.col("b_" + c).alias("base"),
                 F.lit(limits.table_size if c.endswith("size") else limits.table_scans).cast("bigint").alias("min"))
        for c, label in SET_LABELS.items()
    ))
    long = hit.select("*", F.explode(watched).alias("q")).where("q.base > 0")
    if combine:
        g = long.groupBy("eval_date", "ts_table_name", F.col("q.label").alias("label")).agg(
            F.array_sort(F.collect_set("host_name")).alias("host_names"), *(F.sum(c).alias(c) for c in TABLE_VALUES),
            F.sum("q.value").alias("value"), F.max("q.min").alias("min"), F.sum(_micro(ratio(F.col("q.base"), F.col("weeks_cnt")))).alias("weekly"),
        )
        out = g.where((F.col("value") > F.col("min")) & (_percent(F.col("weekly"), limits.percent) < _in_micros(F.col("value"), 100)))
        increase = pct_over(_in_micros(F.col("value")), F.col("weekly"))
    else:
        out = long.select("*", F.array("host_name").alias("host_names"), F.col("q.label").alias("label"), F.col("q.value").alias("value"),
                          F.col("q.base").alias("base"), F.col("q.min").alias("min"))
        out = out.where((F.col("value") > F.col("min")) & (F.col("base") * (100 + limits.percent) < F.col("value") * 100 * F.col("weeks_cnt")))
        increase = pct_over(F.col("value"), ratio(F.col("base"), F.col("weeks_cnt")))
    return out.select(
        "eval_date", "host_names", F.col("ts_table_name").alias("table_name"), *(F.col(c).alias(c[3:]) for c in TABLE_VALUES),
        "label", increase.alias("percent_increase"),
    )


# --- shards and periods ----------------------------------------------------------------------


def _oriented(test: str, a: Column, b: Column) -> list[Column]:
    """Shard names and ratio with the worse shard first."""
    forward = half_up(ratio(a, b)) > 0
    return [
        F.lit(test).alias("test_name"),
        F.when(forward, F.col("host_a")).otherwise(F.col("host_b")).alias("shard1"),
        F.when(forward, F.col("host_b")).otherwise(F.col("host_a")).alias("shard2"),
        F.when(forward, half_up(ratio(a, b))).otherwise(half_up(ratio(b, a))).alias("ratio"),
    ]


def shard_differences(
    fleet: Fleet, sproc_summary: DataFrame, table_summary: DataFrame, pairs: DataFrame, ignore: DataFrame,
    limits: Limits = Limits(), *, date=None,
) -> DataFrame:
    """Procedures and tables that behave very differently on two shards of a pair on one day.

    ``pairs`` has ``shard_a, shard_b``; summaries have one row per host, period and name. Rows go to their pairs by side, so nothing is
    joined with itself and each summary is shuffled once.
    """
    names = _hosts(fleet)
    named = (
        pairs.select("shard_a", "shard_b").distinct().join(names.withColumnsRenamed({"_host": "_a", "host_name": "host_a"}), F.col("shard_a") == F.col("_a"))
        .join(names.withColumnsRenamed({"_host": "_b", "host_name": "host_b"}), F.col("shard_b") == F.col("_b"))
    )
    sides = F.explode(F.array(*(F.struct(F.lit(i).alias("side"), F.col(c).alias("_shard")) for i, c in enumerate(("shard_a", "shard_b"))))).alias("x")
    pair = ["shard_a", "shard_b", "host_a", "host_b"]
    named = named.select(*pair, sides).select(*pair, "x.side", "x._shard")

    def paired(df: DataFrame, host: str, keys: list[str], values: list[str], together: list[str]) -> DataFrame:
        """Each row once for every pair that its host is in, and both shards' values of a pair and key in one row."""
        rows = df.dropna(subset=keys).join(named, F.col(host) == F.col("_shard")).repartition(*pair, *together)
        of = [F.max(F.when(F.col("side") == i, F.col(v))).alias(f"{v}_{t}") for i, t in enumerate("ab") for v in values]
        return rows.groupBy(*pair, *keys).agg(*of, F.count_distinct("side").alias("_sides")).where("_sides = 2")

    s = _on_date(sproc_summary, "ss_date", date).where("ss_calls > 0 and ss_total_time > 0")
    s = not_ignored(s, ignore, "ss_host_id", "ss_sproc_name")
    s = s.select("ss_host_id", "ss_date", "ss_hour", "ss_sproc_name", F.col("ss_total_time").alias("t"),
                 _micro(ratio(F.col("ss_total_time"), F.col("ss_calls"))).alias("avg"))
    both = paired(s, "ss_host_id", ["ss_date", "ss_hour", "ss_sproc_name"], ["t", "avg"], ["ss_date", "ss_sproc_name"])
    g = both.groupBy(*pair, "ss_date", "ss_sproc_name").agg(*(F.sum(c).alias(c) for c in ("t_a", "t_b", "avg_a", "avg_b")))
    far = (F.col("avg_a") > F.col("avg_b") * limits.shard_factor) | (F.col("avg_a") * limits.shard_factor < F.col("avg_b"))
    slow = g.where(far & ((F.col("t_a") > limits.shard_total_ms) | (F.col("t_b") > limits.shard_total_ms))).select(
        F.col("ss_date").alias("eval_date"), *_oriented("avg sproc time", F.col("avg_a"), F.col("avg_b")), F.col("ss_sproc_name").alias("object_name")
    )
    t = _on_date(table_summary, "ts_date", date)
    tb = paired(t, "ts_host_id", ["ts_date", "ts_table_name"], ["ts_seq_scans", "ts_orig_table_size"], ["ts_date", "ts_table_name"])
    a, b = F.col("ts_seq_scans_a"), F.col("ts_seq_scans_b")
    scans = tb.where(
        ((a > b * limits.shard_factor) | (a * limits.shard_factor < b))
        & ((a > limits.shard_scans) | (b > limits.shard_scans)) & (F.col("ts_orig_table_size_a") > limits.table_size)
    ).select(F.col("ts_date").alias("eval_date"), *_oriented("seq table scans", a, b), F.col("ts_table_name").alias("object_name"))
    return union_all(slow, scans).distinct()


def compare_periods(
    summary: DataFrame, prev: tuple, curr: tuple, hosts: list[int] | None = None, hours: tuple[int, int] = (0, 23), factor: int = 2
) -> DataFrame:
    """Procedures that got slower or faster by a factor between two date ranges, and the total.

    One conditional aggregate covers both periods; host totals take part like any procedure.
    """
    df = summary.where(~F.col("ss_is_suspect") & F.col("ss_hour").between(*hours))
    if hosts is not None:
        df = df.where(F.col("ss_host_id").isin(*hosts))

    def within(p):
        return F.col("ss_date").between(F.lit(p[0]).cast("date"), F.lit(p[1]).cast("date"))

    def part(c, p):
        return F.sum(F.when(within(p), F.col(c)))

    sums = df.where(within(prev) | within(curr)).groupBy(F.col("ss_sproc_name").alias("sproc_name")).agg(
        part("ss_total_time", prev).alias("pt"), part("ss_calls", prev).alias("prev_calls"),
        part("ss_total_time", curr).alias("curr_total_time"), part("ss_calls", curr).alias("curr_calls"),
    ).where("pt > 0 and curr_total_time > 0 and prev_calls > 0 and curr_calls > 0")
    pa, ca = ratio(F.col("pt"), F.col("prev_calls")), ratio(F.col("curr_total_time"), F.col("curr_calls"))
    detail = sums.withColumn(
        "is_better_worse_total", F.when(pa * F.lit(float(factor)) < ca, "worse").when(pa > ca * F.lit(float(factor)), "better")
    ).where("is_better_worse_total is not null")
    detail = detail.withColumn("factor", half_up(F.when(F.col("is_better_worse_total") == "worse", ca / pa).otherwise(pa / ca), 2))
    total = sums.agg(*(F.sum(c).alias(c) for c in ("pt", "prev_calls", "curr_total_time", "curr_calls"))).where("pt is not null")
    slower = half_up(ca / pa, 2) > 1
    total = total.withColumns({
        "is_better_worse_total": F.lit("a total"), "sproc_name": F.lit(" "),
        "factor": F.when(slower, -half_up(ca / pa, 2)).otherwise(half_up(pa / ca, 2)),
    })
    return detail.unionByName(total).select(
        "is_better_worse_total", "factor", "sproc_name", "prev_calls", "curr_calls", half_up(pa, 2).alias("prev_avg_time"),
        half_up(ca, 2).alias("curr_avg_time"), "curr_total_time",
    )


def changed_sproc_alerts(
    fleet: Fleet, summary: DataFrame, changes: DataFrame, ignore: DataFrame, limits: Limits = Limits(), *,
    eval_avg: bool = False, combine: bool = False,
) -> DataFrame:
    """Recently changed procedures in the partial hours after the change, against whole baseline hours
    scaled to the observed minutes.

    ``changes`` has ``host_id, sproc_name, change_time``. For each change the samples after it, in its
    hour and the next, give calls, time and minutes per hour; hours with one sample are left out. The
    baseline is the same weekday and hour of earlier weeks, times observed minutes / 60.
    """
    names = fleet.table("sprocs").select(F.col("sproc_id").alias("sp_sproc_id"), F.col("sproc_host_id").alias("host_id"),
                                         proc_base_name(F.col("sproc_name")).alias("sproc_name"))
    watched = changes.groupBy("host_id", "sproc_name").agg(F.max("change_time").alias("change_time")).join(names, ["host_id", "sproc_name"])
    hour = bucket(F.col("sp_timestamp"), "hour")
    # a day of margin covers any time a change is given in
    first, last = (changes.agg(f("change_time").cast("timestamp")).scalar() for f in (F.min, F.max))
    samples = fleet.samples("sproc_performance_data", None, first, last + F.expr("interval 1 day"))
    seen = samples.join(watched, "sp_sproc_id").where(
        (F.col("sp_timestamp") > F.col("change_time")) & (hour <= bucket(F.col("change_time"), "hour") + F.expr("interval 1 hour"))
    )
    per_proc = seen.groupBy("host_id", "sproc_name", "sp_sproc_id", hour.alias("hour")).agg(
        F.min("sp_timestamp").alias("first"), F.max("sp_timestamp").alias("last"),
        (F.max("sp_calls") - F.min("sp_calls")).alias("calls"), (F.max("sp_total_time") - F.min("sp_total_time")).alias("time"),
    ).where("first <> last")
    partial = per_proc.groupBy("host_id", "sproc_name", "hour").agg(
        F.sum("calls").alias("calls"), F.sum("time").alias("total_time"),
        ((F.unix_timestamp(F.max("last")) - F.unix_timestamp(F.min("first"))) / F.lit(60)).cast("bigint").alias("minutes"),
    ).withColumns({"eval_date": F.to_date("hour"), "ss_hour": F.hour("hour")})
    base = _for_weeks(summary.where("not ss_is_suspect"), "ss_date", limits.weeks).groupBy(
        "eval_date", "ss_hour", F.col("ss_sproc_name").alias("sproc_name"), F.col("ss_host_id").alias("host_id")
    ).agg(F.countDistinct("ss_date").alias("weeks_cnt"), F.sum("ss_calls").alias("bc"), F.sum("ss_total_time").alias("bt"))
    hours = partial.join(base, ["eval_date", "ss_hour", "sproc_name", "host_id"])
    per = hours.groupBy("host_id", "sproc_name").agg(
        F.sum("calls").alias("calls"), F.sum("total_time").alias("total_time"),
        F.sum(_micro(ratio(F.col("bt") * F.col("minutes"), F.col("weeks_cnt") * 60))).alias("base_time"),
        F.sum(_micro(ratio(F.col("bc") * F.col("minutes"), F.col("weeks_cnt") * 60))).alias("base_calls"),
    ).where("calls > 0 and base_time > 0 and base_calls > 0")
    per = _drop_ignored(per, ignore).join(_hosts(fleet), F.col("host_id") == F.col("_host"))
    if combine:
        per = per.groupBy("sproc_name").agg(
            F.array_sort(F.collect_set("host_name")).alias("host_names"),
            *(F.sum(c).alias(c) for c in ("calls", "total_time", "base_time", "base_calls")),
        )
    else:
        per = per.withColumn("host_names", F.array("host_name"))
    cur, old = ratio(F.col("total_time"), F.col("calls")), ratio(F.col("base_time"), F.col("base_calls"))
    if eval_avg:
        hit = per.where(old * F.lit(float(100 + limits.percent)) < cur * F.lit(100.0))
        increase = pct_over(cur, old)
    else:
        hit = per.where(_percent(F.col("base_time"), limits.percent) < _in_micros(F.col("total_time"), 100))
        increase = pct_over(_in_micros(F.col("total_time")), F.col("base_time"))
    return hit.select(
        "host_names", "sproc_name", "calls", "total_time", F.floor(cur).alias("avg_time"), increase.alias("time_percent_increase")
    )


def _drop_ignored(df: DataFrame, ignore: DataFrame) -> DataFrame:
    return not_ignored(df.withColumnRenamed("host_id", "_h"), ignore, "_h", "sproc_name").withColumnRenamed("_h", "host_id")


# --- messages ---------------------------------------------------------------------------------

# Alert line per kind of finding; the columns fill the places in order.
MESSAGES = {
    "sproc": ("Sproc jump found on HOST: %s, SPROC: %s, CALLS: %s, AVG_TIME: %s, INCREASE: %s %%",
              ("host", "sproc_name", "calls", "avg_time", "time_percent_increase")),
    "total": ("Total sproc runtime jump found for last hour on HOST: %s, CALLS: %s, TOTAL_TIME: %s, AVG_TIME: %s, AVG TIME INCREASE: %s %%",
              ("host", "calls", "total_time", "avg_time", "time_percent_increase")),
    "table": ("Seq scan jump found on HOST: %s, TABLE: %s, TABLE_SIZE: %s, TABLE_SCANS: %s, INCREASE: %s %%",
              ("host", "table_name", "table_size", "seq_scans", "percent_increase")),
    "cache": ("Host cache miss jump found on HOST: %s, CACHE_MISSES: %s, INCREASE: %s%%",
              ("host", "cache_misses", "time_percent_increase")),
    "shard": ('Shard diference found between "%s" and "%s" - TEST_NAME: %s, OBJECT_NAME: %s, RATIO: %s',
              ("shard1", "shard2", "test_name", "object_name", "ratio")),
}


def alert_messages(found: DataFrame, kind: str) -> DataFrame:
    """One log line per finding."""
    text, cols = MESSAGES[kind]
    df = found.withColumn("host", F.array_join("host_names", ", ")) if "host_names" in found.columns else found
    return df.select(F.format_string(text, *(F.col(c).cast("string") for c in cols)).alias("message"))

