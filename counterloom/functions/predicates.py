"""Filters on optional parameters, name patterns and validity ranges."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .times import is_weekday

# Name patterns with a meaning to the reports.
TEMP_SCHEMAS = ("pg_temp%", "z_blocking", "tmp%", "temp%", "\\_v")
UTILITY_STATEMENTS = (
    "DEALLOCATE%", "SET %", "RESET %", "BEGIN", "BEGIN;", "COMMIT", "COMMIT;", "END", "END;", "ROLLBACK", "ROLLBACK;",
)
COPY_OR_DDL = ("COPY%", "CREATE%")
SYSTEM_SCHEMA_PATTERNS = ("pg_toast%", "pg_temp%", "pgq%")
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema", "_v", "zz_utils", "zz_commons")
EXPECTED_BLOCKED = (
    "SELECT schemaname%", "CREATE %INDEX %CON%", "create %index %con%", "DROP INDEX %CON%",
)
ADVISORY_LOCK = "select pg_advisory_lock%"
TEMP_TABLE_NAME = "^(temp|.backup).*$"
SHORT_NAME = "^[a-z|0-9]+$"


def opt_eq(df: DataFrame, column: str, value) -> DataFrame:
    """Equality filter that is left out when the parameter is not set."""
    return df if value is None else df.where(F.col(column) == value)


def in_range(df: DataFrame, ts: str, start=None, end=None, *, open_start=False, closed_end=False) -> DataFrame:
    """One- or two-sided range filter; half-open unless asked otherwise."""
    c = F.col(ts)
    if start is not None:
        s = F.lit(start).cast("timestamp")
        df = df.where(c > s if open_start else c >= s)
    if end is not None:
        e = F.lit(end).cast("timestamp")
        df = df.where(c <= e if closed_end else c < e)
    return df


def like_any(c: Column, patterns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.like(p) for p in patterns), F.lit(False))


def like_none(df: DataFrame, column: str, patterns: DataFrame) -> DataFrame:
    """Rows whose name is set and matches none of the patterns in a one-column frame; null patterns are left out.

    Patterns are looked up by what a name must begin with: the text before their first wildcard. Each distinct name is
    expanded to its beginnings, so names and patterns meet by equality, whatever the number of either.
    """
    p = patterns.select(F.col(patterns.columns[0]).alias("_pattern")).where("_pattern is not null").distinct()
    p = p.withColumn("_head", F.regexp_extract("_pattern", r"^[^%_\\]*", 0))
    names = df.select(F.col(column).alias("_name")).where("_name is not null").distinct()
    heads = F.transform(F.sequence(F.lit(0), F.length("_name")), lambda n: F.substring(F.col("_name"), F.lit(1), n))
    bad = names.withColumn("_head", F.explode(heads)).join(p, "_head").where(F.expr("_name like _pattern")).select(F.col("_name").alias(column)).distinct()
    return df.where(F.col(column).isNotNull()).join(bad, column, "left_anti").select(df.columns)


def not_temp(name: Column) -> Column:
    return ~name.rlike(TEMP_TABLE_NAME)


def ilike(c: Column, fragment: str) -> Column:
    return c.ilike(f"%{fragment}%")


def valid_shortname(c: Column) -> Column:
    return c.rlike(SHORT_NAME)


def all_equal(arr: Column, value: Column) -> Column:
    return F.forall(arr, lambda a: a == value)


def valid_at(start: Column, end: Column, at) -> Column:
    t = F.lit(at).cast("timestamp")
    return (start <= t) & (t < end)


def not_utility(query: Column) -> Column:
    return ~like_any(F.upper(query), UTILITY_STATEMENTS)


def not_copy_ddl(query: Column) -> Column:
    return ~like_any(F.upper(query), COPY_OR_DDL)


def schema_filter(df: DataFrame, config: DataFrame, host: str, schema: str) -> DataFrame:
    """Keep schemas that match an include and no exclude pattern of their host.

    ``config`` has ``host_id, pattern, included``; host 0 holds the rules of all hosts that
    have none of their own. Only distinct (host, schema) pairs meet the patterns.
    """
    own = config.where("host_id <> 0").select("host_id").distinct().withColumn("_own", F.lit(True))
    names = df.select(F.col(host).alias("_h"), F.col(schema).alias("_s")).distinct()
    names = names.join(own, names["_h"] == own["host_id"], "left").select(
        "_h", "_s", F.when(F.col("_own"), F.col("_h")).otherwise(F.lit(0)).alias("_cfg")
    )
    hit = names.join(config, names["_cfg"] == config["host_id"]).withColumn("_hit", F.expr("_s like pattern"))
    kept = (
        hit.groupBy("_h", "_s")
        .agg(F.bool_or(F.col("_hit") & F.col("included")).alias("inc"),
             F.bool_or(F.col("_hit") & ~F.col("included")).alias("exc"))
        .where("inc and not exc")
    )
    return df.join(kept, (df[host] == kept["_h"]) & (df[schema] == kept["_s"]), "left_semi")


def is_weekday_filter(df: DataFrame, ts: str) -> DataFrame:
    return df.where(is_weekday(F.col(ts)))
