"""Table, index and schema reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up, pct_change, pretty_count, pretty_size, ratio
from ..functions.predicates import SYSTEM_SCHEMA_PATTERNS, SYSTEM_SCHEMAS, ilike, in_range, like_any, like_none, not_temp, opt_eq
from ..functions.text import full_name
from ..functions.times import bucket
from ..operators.series import PREV, counter_delta, last_in_period, to_series, window_endpoints, with_previous
from ..operators.topn import grand_total, latest, share_of
from ..schema import Reset
from ..sources.fleet import Fleet

PAGE = 8192
SCANS = ["tsd_seq_scans", "tsd_index_scans"]
CHANGES = ["tsd_tup_ins", "tsd_tup_upd", "tsd_tup_del", "tsd_tup_hot_upd"]


def _named(fleet: Fleet, name: str | None) -> DataFrame:
    t = fleet.table("tables").select("t_id", full_name(F.col("t_schema"), F.col("t_name")).alias("name"))
    return opt_eq(t, "name", name)


def table_series(fleet: Fleet, host=None, name: str | None = None, start=None, end=None) -> DataFrame:
    """Sizes, scan deltas and row-change deltas of tables, one row per series point."""
    cols = [*SCANS, *CHANGES]
    df = fleet.samples("table_size_data", host, start, end).select(
        "tsd_host_id", "tsd_table_id", "tsd_timestamp", "tsd_table_size", "tsd_index_size", *cols
    )
    p = with_previous(df, ["tsd_host_id", "tsd_table_id"], "tsd_timestamp", cols)
    # Series name of each change counter.
    change_names = dict(zip(CHANGES, ("ins", "upd", "del", "hot")))
    wide = p.join(_named(fleet, name), F.col("tsd_table_id") == F.col("t_id")).select(
        F.col("tsd_host_id").alias("host_id"), "name", F.col("tsd_timestamp").alias("ts"),
        F.col("tsd_table_size").alias("table_size"), F.col("tsd_index_size").alias("index_size"),
        *((F.col(c) - F.col(PREV + c)).alias(c[4:]) for c in SCANS),
        *(F.when(F.col(PREV + c) != 0, F.col(c) - F.col(PREV + c)).alias(n) for c, n in change_names.items()),
    )
    return to_series(wide, ["host_id", "name", "ts"], ["table_size", "index_size", "seq_scans", "index_scans", *change_names.values()])


def table_io_series(fleet: Fleet, host=None, name: str | None = None, start=None, end=None) -> DataFrame:
    """Block read and hit deltas of tables, one row per series point."""
    cols = {"tio_heap_read": "heap_read", "tio_heap_hit": "heap_hit", "tio_idx_read": "index_read", "tio_idx_hit": "index_hit"}
    df = fleet.samples("table_io_data", host, start, end).select("tio_host_id", "tio_table_id", "tio_timestamp", *cols)
    p = with_previous(df, ["tio_host_id", "tio_table_id"], "tio_timestamp", list(cols))
    wide = p.join(_named(fleet, name), F.col("tio_table_id") == F.col("t_id")).select(
        F.col("tio_host_id").alias("host_id"), "name", F.col("tio_timestamp").alias("ts"),
        *((F.col(c) - F.col(PREV + c)).alias(n) for c, n in cols.items()),
    )
    return to_series(wide, ["host_id", "name", "ts"], list(cols.values()))


def _growth(now: str, before: str) -> Column:
    return F.when(F.col(before) > 0, ratio(F.col(now), F.col(before))).otherwise(F.lit(0.0))


def table_order(n: int) -> list[Column]:
    """Sort columns of entry ``n`` (1-12) of the report's order menu."""
    menu = (
        [F.asc("schema"), F.asc("name")],
        [F.desc("table_size")],
        [F.desc("table_size_delta")],
        [_growth("table_size", "min_table_size").desc()],
        [F.desc("index_size")],
        [F.desc("index_size_delta")],
        [_growth("index_size", "min_index_size").desc()],
        [F.desc("iud_delta")],
        [F.desc("s_delta")],
        [F.desc("i_delta")],
        [F.desc("u_delta")],
        [F.desc("d_delta")],
    )
    if not 1 <= n <= len(menu):
        raise ValueError(f"order must be between 1 and {len(menu)}")
    return [*menu[n - 1], F.asc("host_id"), F.asc("schema"), F.asc("name")]


def top_tables(
    fleet: Fleet, host=None, start=None, end=None, *, order: int = 2, limit: int | None = 10, pattern: str = ""
) -> DataFrame:
    """Tables by size, growth or activity between the first and last snapshot of each host."""
    df = fleet.samples("table_size_data", host, start, end, closed_start=True)
    cols = ["tsd_table_size", "tsd_index_size", "tsd_seq_scans", "tsd_tup_ins", "tsd_tup_upd", "tsd_tup_del"]
    ends = window_endpoints(df, "tsd_host_id", "tsd_table_id", "tsd_timestamp", cols)

    def first(c: str) -> Column:
        return F.coalesce(F.col(f"first_{c}"), F.lit(0).cast("bigint"))

    def delta(c: str) -> Column:
        return F.col(f"last_{c}") - first(c)

    iud = delta("tsd_tup_ins") + delta("tsd_tup_upd") + delta("tsd_tup_del")
    out = ends.join(fleet.table("tables"), F.col("tsd_table_id") == F.col("t_id")).select(
        F.col("tsd_host_id").alias("host_id"), F.col("t_schema").alias("schema"), F.col("t_name").alias("name"),
        F.col("last_tsd_table_size").alias("table_size"), first("tsd_table_size").alias("min_table_size"),
        delta("tsd_table_size").alias("table_size_delta"),
        F.col("last_tsd_index_size").alias("index_size"), first("tsd_index_size").alias("min_index_size"),
        delta("tsd_index_size").alias("index_size_delta"),
        iud.alias("iud_delta"), delta("tsd_seq_scans").alias("s_delta"), delta("tsd_tup_ins").alias("i_delta"),
        delta("tsd_tup_upd").alias("u_delta"), delta("tsd_tup_del").alias("d_delta"),
    )
    if pattern:
        out = out.where(ilike(F.col("name"), pattern))
    out = out.orderBy(*table_order(order))
    return out if limit is None else out.limit(limit)


def top_tables_pretty(top: DataFrame) -> DataFrame:
    """The table report as shown: readable sizes and counts, growth in percent."""
    def growth(now: str, before: str) -> Column:
        return F.when(F.col(before) > 0, half_up((ratio(F.col(now), F.col(before)) - F.lit(1.0)) * F.lit(100.0), 1)).otherwise(F.lit(0.0))

    return top.select(
        "host_id", "schema", "name",
        *(pretty_size(F.col(c)).alias(c) for c in ("table_size", "index_size", "table_size_delta", "index_size_delta")),
        growth("table_size", "min_table_size").alias("growth"), growth("index_size", "min_index_size").alias("growth_index"),
        *(pretty_count(F.col(c)).alias(c) for c in ("iud_delta", "s_delta", "i_delta", "u_delta", "d_delta")),
    )


def table_totals(top: DataFrame) -> DataFrame:
    return top.agg(F.sum("table_size").alias("t"), F.sum("index_size").alias("i")).select(
        pretty_size(F.coalesce("t", F.lit(0))).alias("total_size"), pretty_size(F.coalesce("i", F.lit(0))).alias("total_index_size")
    )


@dataclass(frozen=True)
class TableThresholds:
    seq_scan_pct: float = 50.0
    size_growth: int | None = None
    size_growth_pct: float = 10.0
    min_table_size: int = 50 * 1000 * 1000
    min_scans: int = 50


def table_regressions(
    fleet: Fleet, day1=None, day2=None, shortname: str | None = None, *, defaults: TableThresholds = TableThresholds(),
    custom: DataFrame | None = None, ignored_schemas: DataFrame | None = None, ignored_tables: DataFrame | None = None,
) -> DataFrame:
    """Tables whose daily scans or size grew beyond the limits against the day before.

    ``custom`` has ``host_id, schema_name, table_name, seq_scan_pct, size_growth_pct, min_scans, size_growth``;
    the ignore lists are ``(pattern)`` and ``(schema_name, table_name)``.
    """
    hosts = opt_eq(fleet.table("hosts").where("host_enabled"), "host_ui_shortname", shortname)
    names = fleet.table("tables").where(not_temp(F.col("t_name"))).select(
        "t_id", F.col("t_host_id").alias("host_id"), F.col("t_schema").alias("schema_name"), F.col("t_name").alias("table_name")
    )
    if ignored_schemas is not None:
        names = like_none(names, "schema_name", ignored_schemas)
    if ignored_tables is not None:
        names = names.join(ignored_tables, ["schema_name", "table_name"], "left_anti")
    names = names.join(hosts.select("host_id", "host_ui_shortname"), "host_id")
    df = fleet.samples("table_size_data", None, day1, day2, "1 day", closed_start=True)
    per_table = df.groupBy("tsd_table_id", bucket(F.col("tsd_timestamp"), "day").alias("day")).agg(
        F.max("tsd_seq_scans").alias("hi"), F.min("tsd_seq_scans").alias("lo"), F.max("tsd_table_size").alias("size2")
    )
    keys = ["host_id", "host_ui_shortname", "schema_name", "table_name"]
    daily = per_table.join(names, F.col("tsd_table_id") == F.col("t_id")).groupBy(*keys, "day").agg(
        (F.max("hi") - F.min("lo")).alias("scans2"), F.max("size2").alias("size2")
    )
    w = Window.partitionBy("host_id", "schema_name", "table_name").orderBy("day")  # one row per day
    pairs = daily.withColumns({"scans1": F.lag("scans2").over(w), "size1": F.lag("size2").over(w)}).where("scans1 is not null")
    if custom is None:
        pairs = pairs.selectExpr("*", "cast(null as double) as seq_scan_pct", "cast(null as double) as size_growth_pct",
                                 "cast(null as bigint) as min_scans", "cast(null as bigint) as size_growth")
    else:
        pairs = pairs.join(custom, ["host_id", "schema_name", "table_name"], "left")
    growth_limit = F.coalesce("size_growth", F.lit(defaults.size_growth).cast("bigint"))
    out = pairs.withColumns({
        "scan_change_pct": pct_change(F.col("scans1"), F.col("scans2")),
        "size_change_pct": pct_change(F.col("size1"), F.col("size2")),
        "allowed_seq_scan_pct": F.coalesce("seq_scan_pct", F.lit(defaults.seq_scan_pct)),
    }).where(
        (F.col("size2") >= defaults.min_table_size)
        & (F.col("scans2") >= F.coalesce("min_scans", F.lit(defaults.min_scans)))
        & (
            (F.col("scan_change_pct") >= F.col("allowed_seq_scan_pct"))
            | (F.col("size_change_pct") >= F.coalesce("size_growth_pct", F.lit(defaults.size_growth_pct)))
            | F.coalesce(F.col("size2") - F.col("size1") > growth_limit, F.lit(False))
        )
    )
    return out.select(
        "host_ui_shortname", "schema_name", "table_name", "day", "scan_change_pct", "scans1", "scans2",
        pretty_size(F.col("size1")).alias("size1"), pretty_size(F.col("size2")).alias("size2"), "size_change_pct",
        "allowed_seq_scan_pct",
    ).orderBy(F.desc("scan_change_pct"), "host_ui_shortname", "schema_name", "table_name", "day")


def index_series(fleet: Fleet, host=None, schema: str | None = None, table: str | None = None, start=None, end=None) -> DataFrame:
    """Size, scans and tuples read of a table's indexes, with the share of their size at the end."""
    idx = opt_eq(opt_eq(fleet.table("indexes"), "i_schema", schema), "i_table_name", table).select("i_id", "i_schema", "i_table_name", "i_name")
    df = fleet.samples("index_usage_data", host, start, end, closed_start=True)
    df = df.select("iud_host_id", "iud_index_id", "iud_timestamp", "iud_size", "iud_scan", "iud_tup_read")
    at = ["iud_host_id", "i_schema", "i_table_name"]
    totals = (
        df.join(idx, F.col("iud_index_id") == F.col("i_id")).groupBy(*at, "iud_timestamp").agg(F.sum("iud_size").alias("b"))
    )
    end_size = latest(totals, at, "iud_timestamp", ["b"]).select(*at, F.col("b").alias("total_end_size"))
    d = counter_delta(df, ["iud_host_id", "iud_index_id"], "iud_timestamp", ["iud_scan", "iud_tup_read"], Reset.ZERO_IF_LOWER)
    d = d.where("elapsed_s is not null").join(idx, F.col("iud_index_id") == F.col("i_id")).join(end_size, at)
    return d.select(
        F.col("iud_host_id").alias("host_id"), full_name(F.col("i_schema"), F.col("i_table_name")).alias("table_name"),
        F.col("i_name").alias("index_name"), F.col("iud_timestamp").alias("ts"), F.col("iud_size").alias("size"),
        F.col("d_iud_scan").alias("scan"), F.col("d_iud_tup_read").alias("tup_read"), "total_end_size",
        half_up(ratio(F.col("iud_size") * 100, F.col("total_end_size")), 1).alias("pct_of_total_end_size"),
    )


# --- index catalog snapshots: host_id, schema_name, table_name, index_name, index_def, index_size,
# --- table_size, scans, is_unique, is_valid --------------------------------------------

AT_TABLE = ["host_id", "schema_name", "table_name"]


def _marked_indexes(catalog: DataFrame, marked: Column) -> DataFrame:
    """Marked indexes with their share of the table's index space and the grand total."""
    space = catalog.groupBy(*AT_TABLE).agg(F.sum("index_size").alias("indexes_size_bytes"))
    hit = catalog.where(marked).join(space, AT_TABLE)
    hit = grand_total(hit, F.col("index_size"), "total_marked_index_size_bytes")
    pct = F.when(F.col("indexes_size_bytes") == 0, F.lit(0.0)).otherwise(
        half_up(ratio(F.col("index_size") * 100, F.col("indexes_size_bytes")), 1)
    )
    return hit.select(
        "host_id", full_name(F.col("schema_name"), F.col("table_name")).alias("table_full_name"),
        full_name(F.col("schema_name"), F.col("index_name")).alias("index_full_name"),
        F.col("index_size").alias("index_size_bytes"), "indexes_size_bytes", "scans",
        pretty_size(F.col("index_size")).alias("index_size"), pretty_size(F.col("table_size")).alias("table_size"),
        pct.alias("pct_of_tables_index_space"), "total_marked_index_size_bytes",
        pretty_size(F.col("total_marked_index_size_bytes")).alias("total_marked_index_size"),
    )


def unused_indexes(catalog: DataFrame, min_bytes: int = 100 * 1000 * 1000, max_scans: int = 5) -> DataFrame:
    marked = (
        ~F.col("is_unique") & ~like_any(F.col("schema_name"), ("tmp%", "temp%"))
        & (F.col("index_size") > min_bytes) & (F.col("scans") <= max_scans)
    )
    return _marked_indexes(catalog, marked).orderBy("scans", F.desc("index_size_bytes"), "index_full_name")


def invalid_indexes(catalog: DataFrame) -> DataFrame:
    return _marked_indexes(catalog, ~F.col("is_valid")).orderBy(F.desc("index_size_bytes"), "index_full_name")


def duplicate_indexes(catalog: DataFrame) -> DataFrame:
    """Valid indexes with an equal definition once name and uniqueness are taken out, one row each.

    Members of a group stay rows (``group_def``, ``count``); nothing is gathered into lists, so a
    definition shared by very many indexes is no burden on one task.
    """
    norm = F.regexp_replace(F.replace("index_def", F.col("index_name"), F.lit("X")), "^CREATE UNIQUE", "CREATE")
    valid = catalog.where("is_valid").withColumn("group_def", norm)
    counted = valid.groupBy("host_id", "group_def").agg(F.count(F.lit(1)).alias("count")).where("count > 1")
    return valid.join(counted, ["host_id", "group_def"]).select(
        "host_id", "schema_name", full_name(F.col("schema_name"), F.col("table_name")).alias("table_full_name"), "index_name",
        "group_def", "count", F.col("table_size").alias("table_size_bytes"), pretty_size(F.col("table_size")).alias("table_size"),
    )


def duplicate_index_lists(catalog: DataFrame) -> DataFrame:
    """Duplicates with their position among a definition's indexes, so that readers page through lists of any length."""
    w = Window.partitionBy("host_id", "group_def").orderBy("index_name", "table_full_name")
    return duplicate_indexes(catalog).select(
        "host_id", "group_def", "count", F.row_number().over(w).alias("position"), "index_name", "table_size_bytes"
    )


# --- bloat ------------------------------------------------------------------------------

# Page layout of the monitored servers.
PAGE_HEADER, INDEX_PAGE_OPAQUE, ALIGN = 24, 16, 8


def _pad(size: Column, whole: Column | None = None) -> Column:
    """Bytes that bring a size to the alignment, 0 where it already is aligned."""
    rest = F.pmod(size if whole is None else whole, F.lit(ALIGN))
    return F.lit(ALIGN) - F.when(rest == 0, F.lit(ALIGN)).otherwise(rest)


def table_bloat(columns: DataFrame, relations: DataFrame, by_ratio: bool = False, limit: int | None = 100) -> DataFrame:
    """Estimated wasted space per table from column statistics and page counts.

    ``columns``: schema_name, table_name, column_name, null_frac, avg_width, typlen, is_name_type.
    ``relations``: schema_name, table_name, reltuples, relpages, toastpages, toasttuples, has_oids.
    """
    keys = ["schema_name", "table_name"]
    width = F.when((F.col("typlen") == -1) & (F.col("avg_width") >= 127), F.col("avg_width") + 4).when(
        F.col("typlen") < 0, F.col("avg_width") + 1
    ).otherwise(F.col("typlen"))
    # widths in tenths of a null fraction are summed as integers, so any merge order gives the same sum
    kept = half_up((F.lit(1.0) - F.coalesce("null_frac", F.lit(0.0))) * F.lit(1e6))
    stats = columns.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cols"), F.max(F.coalesce("null_frac", F.lit(0.0))).alias("max_null"),
        (F.sum(kept * F.coalesce(width.cast("bigint"), F.lit(1024))) / F.lit(1e6)).alias("data"),
        F.bool_or("is_name_type").alias("is_na"),
    )
    hdr = (
        F.lit(23) + F.when(F.col("max_null") > 0, F.floor((F.col("n_cols") + 7) / 8)).otherwise(F.lit(0))
        + F.when(F.col("has_oids"), F.lit(4)).otherwise(F.lit(0))
    )
    sized = stats.join(relations, keys).where("not is_na").withColumn("hdr", hdr)
    tuple_size = F.lit(4) + F.col("hdr") + F.col("data") + _pad(F.col("hdr")) + _pad(F.col("data"), F.ceil("data"))
    pages = F.ceil(F.col("reltuples") / (F.lit(float(PAGE - PAGE_HEADER)) / tuple_size)) + F.ceil(F.col("toasttuples") / 4)
    total = F.col("relpages") + F.col("toastpages")
    out = sized.withColumns({"extra": total - pages, "total": total}).select(
        *keys,
        F.when(F.col("extra") > 0, half_up(ratio(F.col("extra") * 100, F.col("total")), 1)).otherwise(F.lit(0.0)).alias("bloat_factor"),
        (F.col("extra") * PAGE).alias("wasted_bytes"), pretty_size(F.col("extra") * PAGE).alias("wasted_bytes_pretty"),
    )
    out = out.orderBy(F.desc("bloat_factor" if by_ratio else "wasted_bytes"), *keys)
    return out if limit is None else out.limit(limit)


def index_bloat(columns: DataFrame, indexes: DataFrame, by_ratio: bool = False, limit: int | None = 100) -> DataFrame:
    """Estimated wasted space per btree index, honouring its fill factor.

    ``columns`` describes the indexed columns; ``indexes``: schema_name, table_name, index_name,
    reltuples, relpages, fillfactor, is_btree.
    """
    keys = ["schema_name", "table_name"]
    kept = half_up((F.lit(1.0) - F.coalesce("null_frac", F.lit(0.0))) * F.lit(1e6))
    stats = columns.groupBy(*keys).agg(
        F.max(F.coalesce("null_frac", F.lit(0.0))).alias("max_null"),
        (F.sum(kept * F.coalesce(F.col("avg_width").cast("bigint"), F.lit(1024))) / F.lit(1e6)).alias("data"),
        F.bool_or("is_name_type").alias("is_na"),
    )
    sized = indexes.where("is_btree and relpages > 0").join(stats, keys).where("not is_na")
    hdr = F.when(F.col("max_null") == 0, F.lit(2)).otherwise(F.lit(2 + (32 + 8 - 1) // 8))
    data_pad = F.when(F.col("data") == 0, F.lit(ALIGN)).otherwise(_pad(F.col("data"), half_up(F.col("data"))))
    entry = hdr + _pad(hdr) + F.col("data") + data_pad
    usable = float(PAGE - INDEX_PAGE_OPAQUE - PAGE_HEADER)
    per_page = F.floor(F.lit(usable) * F.col("fillfactor") / (F.lit(100.0) * (F.lit(4) + entry)))
    pages = F.coalesce(F.lit(1) + F.ceil(ratio(F.col("reltuples"), per_page)), F.lit(0))
    out = sized.withColumn("extra", F.col("relpages") - pages).select(
        *keys, "index_name", half_up(ratio(F.col("extra") * 100, F.col("relpages")), 1).alias("bloat_factor"),
        (F.col("extra") * PAGE).alias("wasted_bytes"), pretty_size(F.col("extra") * PAGE).alias("wasted_bytes_pretty"),
    )
    out = out.orderBy(F.desc("bloat_factor" if by_ratio else "wasted_bytes"), *keys, "index_name")
    return out if limit is None else out.limit(limit)


def relation_sizes(relations: DataFrame, indexes: DataFrame) -> DataFrame:
    """Table and index bytes from page counts; the toast relation and its index count as table."""
    keys = ["schema_name", "table_name"]
    idx = indexes.groupBy(*keys).agg(F.sum("relpages").alias("index_pages"))
    heap = F.col("relpages") + F.coalesce("toastpages", F.lit(0)) + F.coalesce("toast_index_pages", F.lit(0))
    return relations.join(idx, keys, "left").select(
        *keys, (heap * PAGE).alias("table_size"), (F.coalesce("index_pages", F.lit(0)) * PAGE).alias("index_size")
    )


# --- schemas ------------------------------------------------------------------------------

# Schemas the unused-schema report never lists.
KEPT_SCHEMA_PATTERNS = ("pg\\_%", "%\\_data")
KEPT_SCHEMAS = ("public", "_v")


# The lines of the clean-up block.
BLOCK_OPENING = ("do $$", "begin")
DROP_LINES = ("  if current_database() = '%s' then", "    execute 'drop schema if exists %s cascade';", "  end if;")
BLOCK_CLOSING = ("end;", "$$;")


def unused_schemas(fleet: Fleet, start, end, shortname: str | None = None, text: str = "") -> DataFrame:
    """Schemas whose end-of-day activity never rose in the period; a reset counts as no activity."""
    name = F.col("sud_schema_name")
    df = fleet.samples("schema_usage_data", None, start, end, closed_start=True)
    df = df.where(name.contains(text)) if text else df
    seen = df.groupBy("sud_host_id", "sud_schema_name").agg(F.min("sud_timestamp").alias("min"), F.max("sud_timestamp").alias("max"))
    cand = df.where(~like_any(name, KEPT_SCHEMA_PATTERNS) & ~name.isin(*KEPT_SCHEMAS))
    parts = ["sud_sproc_calls", "sud_tup_ins", "sud_tup_upd", "sud_tup_del"]
    daily = last_in_period(cand, ["sud_host_id", "sud_schema_name"], "sud_timestamp", "day", parts)
    daily = daily.withColumn("total", sum((F.col(c) for c in parts[1:]), F.col(parts[0])))
    w = Window.partitionBy("sud_host_id", "sud_schema_name").orderBy("period")  # one row per day
    flat = daily.withColumn("same", F.coalesce(F.lag("total").over(w) >= F.col("total"), F.lit(True)))
    still = flat.groupBy("sud_host_id", "sud_schema_name").agg(F.bool_and("same").alias("unchanged")).where("unchanged")
    hosts = opt_eq(fleet.table("hosts").where("host_enabled"), "host_ui_shortname", shortname)
    return (
        still.join(seen, ["sud_host_id", "sud_schema_name"]).join(hosts, F.col("sud_host_id") == F.col("host_id"))
        .select("host_name", "host_db", "host_id", "host_ui_shortname", F.col("sud_schema_name").alias("schema_name"), "min", "max")
        .orderBy("host_ui_shortname", "schema_name")
    )


def drop_statements(unused: DataFrame) -> DataFrame:
    """A runnable clean-up block for unused schemas, one row per line, in the order of ``section, host_db, line_no``.

    Section 0 opens the block, section 1 has the lines of each database, section 2 closes the block. Only text is
    produced, nothing is run.
    """
    names = unused.select("host_db", "schema_name").distinct()
    own = Window.partitionBy("host_db").orderBy("schema_name")
    head, drop, foot = DROP_LINES
    body = names.select("host_db", (F.row_number().over(own) + 1).alias("line_no"), F.format_string(drop, F.col("schema_name")).alias("line"))
    per_db = names.groupBy("host_db").agg((F.count(F.lit(1)) + 2).cast("int").alias("last"))
    opened = per_db.select("host_db", F.lit(1).alias("line_no"), F.format_string(head, F.col("host_db")).alias("line"))
    closed = per_db.select("host_db", F.col("last").alias("line_no"), F.lit(foot).alias("line"))
    block = [(section, "", n + 1, line) for section, lines in ((0, BLOCK_OPENING), (2, BLOCK_CLOSING)) for n, line in enumerate(lines)]
    frame = unused.sparkSession.createDataFrame(block, "section int, host_db string, line_no int, line string")
    return frame.unionByName(body.unionByName(opened).unionByName(closed).withColumn("section", F.lit(1)))


def schema_usage(fleet: Fleet, start=None, end=None, host=None, text: str = "") -> DataFrame:
    """Daily usage vector per schema: calls, scans, inserts, updates, deletes."""
    df = fleet.samples("schema_usage_data", host, start, end, closed_start=True)
    if text:
        df = df.where(F.col("sud_schema_name").contains(text))

    def span(*cols: str) -> Column:
        hi, lo = (sum((f(c) for c in cols[1:]), f(cols[0])) for f in (F.max, F.min))
        return hi - lo

    counts = F.array(
        span("sud_sproc_calls"), span("sud_seq_scans", "sud_idx_scans"), span("sud_tup_ins"), span("sud_tup_upd"), span("sud_tup_del")
    )
    return df.groupBy(
        F.col("sud_host_id").alias("host_id"), F.col("sud_schema_name").alias("schema_name"), bucket(F.col("sud_timestamp"), "day").alias("day")
    ).agg(counts.alias("daily_counts"))


def schema_rollup(procs: DataFrame, tables: DataFrame) -> DataFrame:
    """Procedure calls and table counters per host and schema, whichever side has the schema.

    ``procs``: host_id, schema_name, calls. ``tables``: host_id, schema_name, seq_scan, idx_scan, n_tup_ins/upd/del.
    """
    name = F.col("schema_name")
    user = ~like_any(name, SYSTEM_SCHEMA_PATTERNS) & ~name.isin(*SYSTEM_SCHEMAS)
    counters = ["seq_scan", "idx_scan", "n_tup_ins", "n_tup_upd", "n_tup_del"]
    keys = ["host_id", "schema_name"]
    p = procs.where(user & ~name.like("%utils%")).groupBy(*keys).agg(F.sum("calls").alias("sproc_calls"))
    t = tables.where(user).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counters))
    both = t.join(p, keys, "full")
    return both.select(*keys, *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in (*counters, "sproc_calls")))
