"""Procedure reports, release comparison and key assignment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up, pct_change, pretty_ms, ratio
from ..functions.predicates import is_weekday_filter, opt_eq
from ..functions.text import proc_base_name, proc_short_name, signature, signature_unmarked, strip_version
from ..functions.times import group_date
from ..operators.series import counter_delta
from ..operators.topn import share_of, top_n, top_rank
from ..schema import Reset
from ..sources.fleet import Fleet
from ..sources.store import to_grouped_lists

COUNTERS = ["sp_calls", "sp_self_time", "sp_total_time"]
SERIES = ["sp_host_id", "sp_sproc_id"]


def _sprocs(fleet: Fleet) -> DataFrame:
    return fleet.table("sprocs").withColumnsRenamed({"sproc_id": "sp_sproc_id"})


def sproc_deltas(fleet: Fleet, host=None, start=None, end=None) -> DataFrame:
    """Deltas per procedure and sample; negatives are kept and the first delta is 0."""
    df = fleet.samples("sproc_performance_data", host, start, end).select("sp_timestamp", *SERIES, *COUNTERS)
    d = counter_delta(df, SERIES, "sp_timestamp", COUNTERS, Reset.RAW)
    return d.select(
        F.col("sp_host_id").alias("host_id"), "sp_sproc_id", "sp_timestamp", F.col("d_sp_calls").alias("delta_calls"),
        F.col("d_sp_self_time").alias("delta_self_time"), F.col("d_sp_total_time").alias("delta_total_time"),
    )


def sproc_buckets(fleet: Fleet, host=None, start=None, end=None) -> DataFrame:
    """Deltas per procedure and 15-minute bucket."""
    return sproc_deltas(fleet, host, start, end).groupBy(
        "host_id", "sp_sproc_id", group_date(F.col("sp_timestamp")).alias("bucket")
    ).agg(
        F.sum("delta_calls").alias("calls"), F.sum("delta_self_time").alias("self_time"),
        F.sum("delta_total_time").alias("total_time"),
    )


def active_sprocs(fleet: Fleet, host=None, start=None, end=None, limit: int | None = None) -> DataFrame:
    """Procedures by summed total time, ranked per host."""
    per = (
        sproc_deltas(fleet, host, start, end).groupBy("host_id", "sp_sproc_id")
        .agg(F.sum("delta_total_time").alias("total_time"))
        .join(_sprocs(fleet), "sp_sproc_id")
        .groupBy("host_id", "sproc_name").agg(F.sum("total_time").alias("total_time"))
    )
    if limit is not None:
        per = top_n(per, ["host_id"], [F.desc("total_time"), F.asc("sproc_name")], limit)
    return per.orderBy("host_id", F.desc("total_time"), "sproc_name")


def sproc_series(fleet: Fleet, host=None, name: str | None = None, start=None, end=None) -> DataFrame:
    """Calls, times and averages of one procedure (or all) per 15 minutes and schema version."""
    procs = _sprocs(fleet).select("sp_sproc_id", "sproc_schema", F.col("sproc_name").alias("name"))
    if name is not None:
        procs = procs.where(F.col("name").startswith(name if name.endswith(")") else name + "("))
    b = sproc_buckets(fleet, host, start, end).join(procs, "sp_sproc_id")

    def avg(c: str):
        return F.when(F.col("calls") > 0, half_up(ratio(F.col(c), F.col("calls")), 2)).otherwise(F.lit(0.0))

    return b.select(
        "host_id", "sproc_schema", "name", "bucket", "calls", "self_time", "total_time",
        avg("total_time").alias("avg_time"), avg("self_time").alias("avg_self_time"),
    )


def active_sproc_names(fleet: Fleet, host=None, start=None, end=None) -> DataFrame:
    seen = fleet.samples("sproc_performance_data", host, start, end).select("sp_sproc_id").distinct()
    return seen.join(_sprocs(fleet), "sp_sproc_id").select(
        F.col("sproc_host_id").alias("host_id"), proc_base_name(F.col("sproc_name")).alias("sproc_name")
    ).distinct()


def top_sprocs(fleet: Fleet, host=None, start=None, end=None, order: str = "avg", limit: int = 10) -> DataFrame:
    """Top procedures per host by average time, total time or calls; only buckets with calls count."""
    b = sproc_buckets(fleet, host, start, end).where("calls > 0")
    per = (
        b.groupBy("host_id", "sp_sproc_id").agg(F.sum("calls").alias("calls"), F.sum("total_time").alias("total_ms"))
        .join(_sprocs(fleet).select("sp_sproc_id", proc_short_name(F.col("sproc_name")).alias("name")), "sp_sproc_id")
        .groupBy("host_id", "name").agg(F.sum("calls").alias("calls"), F.sum("total_ms").alias("total_ms"))
        .withColumn("avg_ms", half_up(ratio(F.col("total_ms"), F.col("calls")), 1))
    )
    orders = {"avg": F.desc("avg_ms"), "total": F.desc("total_ms"), "calls": F.desc("calls")}
    top = top_n(per, ["host_id"], [orders[order], F.asc("name")], limit, rank="rank")
    return top.select("host_id", "rank", "name", "calls", pretty_ms(F.col("total_ms")).alias("total_time"),
                      pretty_ms(F.col("avg_ms")).alias("avg_time"))


def _export_base(fleet: Fleet, start, end) -> DataFrame:
    exported = fleet.table("hosts").where("host_db_export_name is not null").select("host_id", "host_db_export_name")
    procs = _sprocs(fleet).select("sp_sproc_id", F.col("sproc_host_id").alias("host_id"),
                                  proc_base_name(F.col("sproc_name")).alias("sproc_name"))
    named = procs.join(exported, "host_id").select("sp_sproc_id", F.col("host_db_export_name").alias("db"), "sproc_name")
    df = fleet.samples("sproc_performance_data", None, start, end)
    per_proc = df.groupBy("sp_sproc_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("sp_total_time").alias("hi"), F.min("sp_total_time").alias("lo")
    )
    return per_proc.join(named, "sp_sproc_id").groupBy("db", "sproc_name").agg(
        F.sum("n").alias("samples"), (F.max("hi") - F.min("lo")).alias("total_runtime")
    )


def _export_top(fleet: Fleet, start, end, by: str, limit: int) -> DataFrame:
    ranked = top_n(_export_base(fleet, start, end), ["db"], [F.desc(by), F.asc("sproc_name")], limit, rank="rank")
    return to_grouped_lists(ranked, "db", "sproc_name", "rank")


def export_top_by_calls(fleet: Fleet, start=None, end=None, limit: int = 10) -> DataFrame:
    """Most sampled procedures per exported database, as a list in rank order."""
    return _export_top(fleet, start, end, "samples", limit)


def export_top_by_runtime(fleet: Fleet, start=None, end=None, limit: int = 10) -> DataFrame:
    """Procedures with the largest total-time range per exported database."""
    return _export_top(fleet, start, end, "total_runtime", limit)


@dataclass(frozen=True)
class SprocThresholds:
    runtime_growth_pct: float = 25.0
    share_on_total_runtime_pct: float = 2.0


def release_pairs(fleet: Fleet, rel1: str, rel2: str, shortname: str | None = None, created: DataFrame | None = None) -> DataFrame:
    """Every procedure of two releases next to its previous release, before thresholds.

    ``created`` has ``sproc_id, sproc_created`` and bounds the samples to those since the first
    procedure of the older release appeared.
    """
    procs = _sprocs(fleet).where(F.col("sproc_schema").endswith(rel1) | F.col("sproc_schema").endswith(rel2))
    hosts = opt_eq(fleet.table("hosts").where("host_enabled"), "host_ui_shortname", shortname)
    named = procs.join(hosts, procs["sproc_host_id"] == hosts["host_id"]).select(
        "sp_sproc_id", "host_id", "host_ui_shortname", "sproc_schema", "sproc_name"
    )
    first = None
    if created is not None:
        first = (
            created.join(_sprocs(fleet), created["sproc_id"] == F.col("sp_sproc_id"))
            .where(F.col("sproc_schema").endswith(rel1)).agg(F.min("sproc_created")).scalar()
        )
    df = is_weekday_filter(fleet.samples("sproc_performance_data", None, first, closed_start=True), "sp_timestamp")
    per_proc = df.groupBy("sp_sproc_id").agg(F.max("sp_calls").alias("calls"), F.max("sp_total_time").alias("total"))
    per = per_proc.join(named, "sp_sproc_id").groupBy("host_id", "host_ui_shortname", "sproc_schema", "sproc_name").agg(
        F.max("calls").alias("calls2"), F.max("total").alias("proc_total_time")
    )
    per = per.withColumn("exec_avg2", half_up(ratio(F.col("proc_total_time"), F.col("calls2")), 2))
    per = share_of(per, ["sproc_schema"], "proc_total_time", "global_total_time")
    w = Window.partitionBy("host_id", F.split_part("sproc_schema", F.lit("_api_r"), F.lit(1)), "sproc_name").orderBy("sproc_schema")
    return per.withColumns(
        {"exec_avg1": F.lag("exec_avg2").over(w), "calls1": F.lag("calls2").over(w)}
    ).where("exec_avg1 is not null")


def release_regressions(
    fleet: Fleet, rel1: str, rel2: str, shortname: str | None = None, *, created: DataFrame | None = None,
    defaults: SprocThresholds = SprocThresholds(), custom: DataFrame | None = None,
) -> DataFrame:
    """Procedures that got slower, or with a custom limit more called, between two releases.

    ``custom`` has ``host_id, sproc_name, runtime_growth_pct, calls_growth_pct``.
    """
    pairs = release_pairs(fleet, rel1, rel2, shortname, created)
    if custom is None:
        pairs = pairs.withColumns({"runtime_growth_pct": F.lit(None).cast("double"), "calls_growth_pct": F.lit(None).cast("double")})
    else:
        pairs = pairs.join(custom, ["host_id", "sproc_name"], "left")
    out = pairs.select(
        "host_ui_shortname", "sproc_schema", proc_base_name(F.col("sproc_name")).alias("sproc_name"),
        pct_change(F.col("exec_avg1"), F.col("exec_avg2")).alias("calltime_change_pct"),
        F.when(F.col("global_total_time") == 0, F.lit(0.0)).otherwise(
            half_up(ratio(F.col("proc_total_time") * 100, F.col("global_total_time")), 2)
        ).alias("share_on_total_runtime"),
        "exec_avg1", "exec_avg2", "calls1", "calls2",
        pct_change(F.col("calls1"), F.col("calls2")).alias("callscount_change_pct"),
        F.coalesce("runtime_growth_pct", F.lit(defaults.runtime_growth_pct)).alias("allowed_runtime_growth_pct"),
        F.lit(defaults.share_on_total_runtime_pct).alias("allowed_share_on_total_runtime_pct"), "calls_growth_pct",
    )
    grown = (F.col("calltime_change_pct") >= F.col("allowed_runtime_growth_pct")) | F.coalesce(
        F.col("callscount_change_pct") >= F.col("calls_growth_pct"), F.lit(False)
    )
    return (
        out.where(grown & (F.col("share_on_total_runtime") >= F.col("allowed_share_on_total_runtime_pct")))
        .drop("calls_growth_pct").orderBy(F.desc("share_on_total_runtime"), "sproc_schema")
    )


def newest_versions(df: DataFrame, host: str, schema: str, n: int = 4) -> DataFrame:
    """Rows of the newest ``n`` versions of each schema family."""
    names = df.select(host, schema).distinct()
    kept = top_rank(names, [host, strip_version(F.col(schema))], [F.desc(schema)], n)
    return df.join(kept, [host, schema], "left_semi")


# --- keys -----------------------------------------------------------------------------


def lookup_or_add(df: DataFrame, dim: DataFrame, names: list[str], key: str) -> DataFrame:
    """Key of each distinct name; unknown names get one derived from the name.

    The derived key depends on nothing but the name, so a retried task assigns the same one.
    """
    seen = df.select(*names).distinct()
    out = seen.join(dim.select(*names, key), names, "left")
    return out.select(
        *names, F.coalesce(F.col(key).cast("bigint"), F.xxhash64(*names)).alias(key), F.col(key).isNull().alias("is_new")
    )


def assign_keys(observed: DataFrame, dim: DataFrame) -> DataFrame:
    """Key per observed procedure: known by its signature, adopted from a unique entry in the
    older signature format, or new.

    ``observed``: host_id, schema_name, proc_name, types, modes, collisions.
    ``dim``: sproc_id, sproc_host_id, sproc_schema, sproc_name.
    """
    seen = observed.select(
        "host_id", "schema_name", "collisions",
        signature(F.col("proc_name"), F.col("types"), F.col("modes")).alias("full_name"),
        signature_unmarked(F.col("proc_name"), F.col("types")).alias("old_name"),
    ).distinct()
    entries = dim.groupBy(
        F.col("sproc_host_id").alias("host_id"), F.col("sproc_schema").alias("schema_name"), F.col("sproc_name").alias("n")
    ).agg(F.min("sproc_id").alias("id"), F.count(F.lit(1)).alias("cnt"))
    known = entries.select("host_id", "schema_name", F.col("n").alias("full_name"), F.col("id").alias("known_id"))
    old = entries.select("host_id", "schema_name", F.col("n").alias("old_name"), F.col("id").alias("old_id"), F.col("cnt").alias("old_count"))
    hit = seen.join(known, ["host_id", "schema_name", "full_name"], "left").join(
        old, ["host_id", "schema_name", "old_name"], "left"
    )
    adopt = F.col("old_id").isNotNull() & (F.col("collisions") == 1) & (F.col("old_count") == 1)
    action = F.when(F.col("known_id").isNotNull(), "known").when(adopt, "renamed").otherwise("new")
    return hit.select(
        "host_id", "schema_name", "full_name", "old_name", action.alias("action"),
        F.coalesce("known_id", F.when(adopt, F.col("old_id"))).cast("bigint").alias("found_id"),
    ).withColumn("sproc_id", F.coalesce("found_id", F.xxhash64("host_id", "schema_name", "full_name")))


def apply_renames(dim: DataFrame, assigned: DataFrame) -> DataFrame:
    """Give adopted entries their new name, in every version of the schema."""
    family = r"^(.*)_r.*$"
    ren = assigned.where("action = 'renamed'").select(
        F.col("host_id").alias("_h"), F.col("old_name").alias("_old"), F.col("full_name").alias("_new"),
        F.when(F.col("schema_name").rlike(family), F.regexp_extract("schema_name", family, 1)).otherwise(F.col("schema_name")).alias("_fam"),
    ).distinct()
    d = dim.withColumn(
        "_fam2", F.when(F.col("sproc_schema").rlike(family), F.regexp_extract("sproc_schema", family, 1)).otherwise(F.col("sproc_schema"))
    )
    out = d.join(ren, (d["sproc_host_id"] == F.col("_h")) & (d["sproc_name"] == F.col("_old")) & (d["_fam2"] == F.col("_fam")), "left")
    return out.select("sproc_id", "sproc_host_id", "sproc_schema", F.coalesce("_new", "sproc_name").alias("sproc_name"))
