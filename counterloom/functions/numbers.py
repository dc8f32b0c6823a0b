"""Numeric column functions: rounding half away from zero, rates, ratios, pretty printers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column, digits: int = 0) -> Column:
    """Round half away from zero; a bigint for ``digits=0``, else a double."""
    scale = 10**digits
    x = c.cast("double")
    rounded = F.signum(x) * F.floor(F.abs(x) * F.lit(float(scale)) + F.lit(0.5))
    return rounded.cast("bigint") if digits == 0 else rounded / F.lit(float(scale))


def ratio(num: Column, den: Column) -> Column:
    """``num / den``; null where the denominator is 0 or null."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def rate(delta: Column, elapsed_s: Column, per_s: int) -> Column:
    """Delta scaled to ``per_s`` seconds, as a rounded bigint."""
    return half_up(ratio(delta * F.lit(per_s), elapsed_s))


def avg_per_call(delta: Column, calls: Column, scale: int = 1) -> Column:
    return ratio(delta * F.lit(scale), calls)


def hit_pct(hit: Column, read: Column, digits: int = 0) -> Column:
    """Share of hits in hits + reads, in percent; null when there was no access."""
    total = hit + read
    return F.when(total > 0, half_up(ratio(hit * F.lit(100), total), digits))


def pct_change(old: Column, new: Column, digits: int = 2) -> Column:
    return F.when(old == 0, F.lit(0.0)).otherwise(half_up(ratio((new - old) * F.lit(100), old), digits))


def pct_over(current: Column, base: Column) -> Column:
    """How many percent ``current`` lies above ``base``, as an integer."""
    return half_up((ratio(current, base) - F.lit(1.0)) * F.lit(100.0))


def normalise(value: Column, elapsed_s: Column, period_s: int = 900) -> Column:
    """Scale a delta to a fixed period; short gaps and tiny deltas are kept as they are."""
    scaled = half_up(ratio(value * F.lit(period_s), elapsed_s))
    return F.when((elapsed_s <= 60) | (value <= 1), value).otherwise(scaled)


_BYTES = 1024


def pretty_size(c: Column) -> Column:
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    a = F.abs(c)
    text = F.when(a <= _BYTES, F.concat(a.cast("string"), F.lit(" B")))
    for power, unit in ((1, "kB"), (2, "MB"), (3, "GB")):
        text = text.when(
            a < 10 * _BYTES ** (power + 1),
            F.concat(half_up(a / F.lit(float(_BYTES**power))).cast("string"), F.lit(f" {unit}")),
        )
    last = F.concat(half_up(a / F.lit(float(_BYTES**4))).cast("string"), F.lit(" TB"))
    return F.concat(sign, text.otherwise(last))


def pretty_count(c: Column) -> Column:
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    a = F.abs(c)

    def scaled(power: int, unit: str) -> Column:
        return F.concat(F.format_string("%.1f", half_up(a / F.lit(float(1000**power)), 1)), F.lit(f" {unit}"))

    text = (
        F.when(a <= 1000, a.cast("string"))
        .when(a < 1000**2, scaled(1, "K"))
        .when(a < 1000**3, scaled(2, "M"))
        .otherwise(scaled(3, "B"))
    )
    return F.concat(sign, text)


def pretty_ms(c: Column) -> Column:
    """A duration in milliseconds as text, in the largest fitting units."""
    ms = c.cast("double")
    whole = F.floor(ms)
    sec = F.floor(ms / 1000)
    minute = F.floor(sec / 60)
    hour = F.floor(minute / 60)
    rest = whole / F.lit(1000.0) - minute * 60
    return (
        F.when(ms < 1, F.concat(F.floor(ms * 1000).cast("string"), F.lit("μs")))
        .when(sec == 0, F.concat(whole.cast("string"), F.lit("ms")))
        .when(minute == 0, F.concat(F.format_string("%.1f", half_up(whole / F.lit(1000.0), 1)), F.lit("s")))
        .when(hour == 0, F.concat(minute.cast("string"), F.lit("m "), half_up(rest).cast("string"), F.lit("s")))
        .otherwise(
            F.concat(
                hour.cast("string"), F.lit("h "), (minute % 60).cast("string"), F.lit("m "),
                (sec % 60).cast("string"), F.lit("s"),
            )
        )
    )
