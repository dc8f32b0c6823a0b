"""Counter and time-series operators.

Deltas over raw sample tables never gather a whole series in one task: a series is cut
into time chunks, every chunk is windowed on its own, and one pre-aggregated row per
(series, chunk) carries the last values of a chunk into the next one. A series that holds
a third of all rows is thereby spread over as many tasks as it has days.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import bucket, elapsed_s
from ..schema import Reset

PREV = "prev_"
DELTA = "d_"


def with_previous(
    df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], *, chunk: str | None = "day"
) -> DataFrame:
    """Add ``prev_<col>`` (and ``prev_<ts>``) of the previous sample of the same series.

    ``chunk=None`` uses one window per series; only for frames already aggregated to one
    row per series and time bucket, where a series is as long as the timeline and no longer.
    """
    values = [ts, *cols]
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(ts)
        return df.select("*", *(F.lag(c).over(w).alias(PREV + c) for c in values))

    cut = bucket(F.col(ts), chunk)
    last = df.groupBy(*keys, cut.alias("_chunk")).agg(*(F.max_by(c, ts).alias(c) for c in values))
    chunks = Window.partitionBy(*keys).orderBy("_chunk")
    carried = (
        last.withColumn("_next", F.lead("_chunk").over(chunks))
        .where("_next is not null")
        .withColumn("_chunk", F.col("_next"))
        .drop("_next")
        .withColumn("_carried", F.lit(True))
    )
    rows = df.withColumns({"_chunk": cut, "_carried": F.lit(False)})
    w = Window.partitionBy(*keys, "_chunk").orderBy(ts)
    return (
        rows.unionByName(carried, allowMissingColumns=True)
        .select("*", *(F.lag(c).over(w).alias(PREV + c) for c in values))
        .where("not _carried")
        .drop("_chunk", "_carried")
    )


def reset_delta(col: str, policy: Reset) -> Column:
    """Delta of one counter under a reset policy; filters are applied by the caller."""
    cur, prev = F.col(col), F.col(PREV + col)
    raw = cur - prev
    if policy is Reset.RAW:
        return F.coalesce(raw, F.lit(0).cast("bigint"))
    if policy is Reset.CLAMP_ZERO or policy is Reset.ZERO_IF_LOWER:
        return F.greatest(raw, F.lit(0).cast("bigint"))
    if policy is Reset.RESTART:
        return F.when(raw < 0, cur).otherwise(raw)
    return raw


def counter_delta(
    df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], policy: Reset, *, chunk: str | None = "day"
) -> DataFrame:
    """Add ``d_<col>`` per counter and ``elapsed_s`` since the previous sample.

    The dropping policies filter on the first counter, which decides whether the source was reset.
    """
    if policy is Reset.WINDOW_RANGE:
        raise ValueError("WINDOW_RANGE is an aggregate; use counter_range")
    return deltas(with_previous(df, keys, ts, cols, chunk=chunk), ts, cols, policy)


def deltas(df: DataFrame, ts: str, cols: Sequence[str], policy: Reset) -> DataFrame:
    """Deltas of samples that have their ``prev_`` columns."""
    out = df.withColumns(
        {DELTA + c: reset_delta(c, policy) for c in cols} | {"elapsed_s": elapsed_s(F.col(ts), F.col(PREV + ts))}
    )
    if policy is Reset.DROP_NOT_POSITIVE:
        out = out.where(F.col(DELTA + cols[0]) > 0)
    elif policy is Reset.DROP_NEGATIVE:
        out = out.where(F.col(DELTA + cols[0]) >= 0)
    return out.drop(*(PREV + c for c in cols))


def counter_range(df: DataFrame, keys: Sequence[str | Column], cols: Sequence[str]) -> DataFrame:
    """Policy P6: ``max - min`` of each counter over the rows of a group."""
    return df.groupBy(*keys).agg(*((F.max(c) - F.min(c)).alias(DELTA + c) for c in cols))


def moving_sum(c: str, keys: Sequence[str], ts: str, rows: int = 2) -> Column:
    """Sum over the current and the ``rows - 1`` previous buckets of an aggregated series."""
    return F.sum(c).over(Window.partitionBy(*keys).orderBy(ts).rowsBetween(1 - rows, 0))


def fill_gaps(
    df: DataFrame, keys: DataFrame, ts: str, start, end, step: str, defaults: dict[str, object]
) -> DataFrame:
    """One row per key and step in [start, end); missing buckets get the defaults.

    ``keys`` holds the distinct series; each is expanded to its own timeline.
    """
    span = F.sequence(
        F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr(f"interval {step}")
    )
    line = keys.withColumn(ts, F.explode(span)).where(F.col(ts) < F.lit(end).cast("timestamp"))
    filled = line.join(df, [*keys.columns, ts], "left")
    return filled.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def skip_after_gap(df: DataFrame, keys: Sequence[str], ts: str, max_gap_s: int = 900) -> DataFrame:
    """Drop the two points that follow a hole in an aggregated series."""
    w = Window.partitionBy(*keys).orderBy(ts)
    gap = F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(w))
    marked = df.withColumn("_gap", F.coalesce(gap > max_gap_s, F.lit(False)))
    marked = marked.withColumn("_after", F.coalesce(F.lag("_gap").over(w), F.lit(False)))
    return marked.where("not _gap and not _after").drop("_gap", "_after")


def delta_after_first_nonzero(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """Clamped delta that stays 0 until a nonzero value has been seen (aggregated series)."""
    w = Window.partitionBy(*keys).orderBy(ts)
    before = w.rowsBetween(Window.unboundedPreceding, -1)

    def delta(c: str) -> Column:
        started = F.coalesce(F.max(F.col(c) != 0).over(before), F.lit(False))
        return F.when(started, F.greatest(F.col(c) - F.lag(c).over(w), F.lit(0).cast("bigint"))).otherwise(
            F.lit(0).cast("bigint")
        )

    return df.select("*", *(delta(c).alias(DELTA + c) for c in cols))


def delta_if_previous_nonzero(col: str) -> Column:
    """Delta that exists only where the previous value is set and not 0."""
    prev = F.col(PREV + col)
    return F.when(prev != 0, F.col(col) - prev)


def last_in_period(df: DataFrame, keys: Sequence[str], ts: str, unit: str, cols: Sequence[str]) -> DataFrame:
    """Values of the last sample per series and period; combines map-side."""
    period = bucket(F.col(ts), unit).alias("period")
    return df.groupBy(*keys, period).agg(
        F.max(ts).alias("last_ts"), *(F.max_by(c, ts).alias(c) for c in cols)
    )


def window_endpoints(df: DataFrame, host: str, key: str, ts: str, cols: Sequence[str]) -> DataFrame:
    """Values at the first and last snapshot of each host: ``first_<c>`` and ``last_<c>``.

    One map-side combined pass finds the first and last sample of each series; they are then held against the host's
    endpoints, one row per series. A series missing at the last snapshot is left out.
    """
    values = [f(c, ts).alias(f"{name}_{c}") for name, f in (("first", F.min_by), ("last", F.max_by)) for c in cols]
    per = df.groupBy(host, key).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"), *values)
    own = Window.partitionBy(host)
    per = per.withColumns({"_min": F.min("_lo").over(own), "_max": F.max("_hi").over(own)}).where(F.col("_hi") == F.col("_max"))
    first = [F.when(F.col("_lo") == F.col("_min"), F.col(f"first_{c}")).alias(f"first_{c}") for c in cols]
    return per.select(host, key, *first, *(f"last_{c}" for c in cols)).where(F.col(f"last_{cols[0]}").isNotNull())


def trim_lag(df: DataFrame, ts: str, start) -> DataFrame:
    """Drop the look-back rows that only served the first delta."""
    return df if start is None else df.where(F.col(ts) > F.lit(start).cast("timestamp"))


def to_series(df: DataFrame, ids: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row per series point; points without a value are left out."""
    return df.unpivot(list(ids), list(cols), "series", "value").where("value is not null")


def changed_only(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """Samples that differ from the previous one of their series (the first always does)."""
    prev = with_previous(df, keys, ts, cols)
    differs = reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.col(PREV + c)) for c in cols))
    return prev.where(F.col(PREV + ts).isNull() | differs).drop(*(PREV + c for c in (ts, *cols)))


def trend(c: str, w) -> Column:
    """-1, 0 or 1: how a value compares to the one of the previous period."""
    older = F.lag(c).over(w)
    return F.coalesce(F.signum(F.col(c) - older).cast("int"), F.lit(0))
