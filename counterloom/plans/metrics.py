"""Export metrics: rates, averages and sizes as time series, one function per measurement.

All take ``(fleet, host, start, end, lag)``: samples in (start - lag, end] are read so that the
first delta inside the range exists, and the look-back is trimmed afterwards. Without a host
every host gets its own series. Rates are whole numbers, rounded half away from zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up, hit_pct, rate, ratio
from ..functions.predicates import TEMP_SCHEMAS, like_any
from ..functions.text import proc_base_name
from ..functions.times import epoch_s
from ..operators.series import DELTA, counter_delta, trim_lag
from ..schema import Reset
from ..sources.fleet import Fleet
from ..sources.store import to_points

HOUR, MINUTE = 3600, 60
MICRO = 1_000_000


def _d(c: str) -> Column:
    return F.col(DELTA + c)


def _points(df: DataFrame, host: str, ts: str, start, cols: Sequence[Column]) -> DataFrame:
    return trim_lag(df, ts, start).select(
        F.col(host).alias("host_id"), F.col(ts).alias("timestamp"), epoch_s(F.col(ts)).alias("time"), *cols
    )


def _per_hour(names: dict[str, str], per: int = HOUR) -> list[Column]:
    return [rate(_d(c), F.col("elapsed_s"), per).alias(n) for c, n in names.items()]


def _regular_schema(c: str) -> Column:
    return ~like_any(F.col(c), TEMP_SCHEMAS)


def avg_query_runtime_per_db(fleet: Fleet, host=None, start=None, end=None, lag: str | None = "4 hours") -> DataFrame:
    """Mean of the statements' average runtimes, and summed call rates.

    Per-statement values are summed as fixed-point integers, so the result does not depend on
    the order in which partitions are merged.
    """
    cols = ["ssd_calls", "ssd_total_time"]
    df = fleet.samples("stat_statements_data", host, start, end, lag)
    df = df.where((F.col("ssd_calls") > 10) & ~F.lower("ssd_query").like("copy%"))
    df = df.select("ssd_host_id", "ssd_query_id", "ssd_timestamp", *cols)
    d = counter_delta(df, ["ssd_host_id", "ssd_query_id"], "ssd_timestamp", cols, Reset.DROP_NOT_POSITIVE)
    d = d.where((_d("ssd_total_time") > 0) & (F.col("elapsed_s") > 1))
    per = trim_lag(d, "ssd_timestamp", start).groupBy("ssd_host_id", "ssd_timestamp").agg(
        F.sum(half_up(ratio(_d("ssd_total_time") * MICRO, _d("ssd_calls")))).alias("ns"),
        F.count(F.lit(1)).alias("n"),
        F.sum(half_up(ratio(_d("ssd_calls") * HOUR * MICRO, F.col("elapsed_s")))).alias("micro_calls"),
    )
    return _points(per, "ssd_host_id", "ssd_timestamp", None, [
        # thirds leave a sum a hair below an exact half: settle the third decimal first
        half_up(half_up(ratio(F.col("ns"), F.col("n") * 1000), 3)).alias("avg_us"),
        half_up(F.col("micro_calls") / F.lit(float(MICRO))).alias("calls_1h_rate"),
    ])


def _sproc_runtime(fleet, host, start, end, lag, by_schema: bool) -> DataFrame:
    df = fleet.samples("sproc_performance_data", host, start, end, lag).where("sp_calls > 10")
    keys = ["sp_host_id"]
    if by_schema:
        df = df.join(fleet.table("sprocs").select("sproc_id", F.col("sproc_schema").alias("schema")),
                     F.col("sp_sproc_id") == F.col("sproc_id"))
        keys.append("schema")
    sums = df.groupBy(*keys, "sp_timestamp").agg(
        F.sum("sp_calls").alias("calls"), F.sum("sp_self_time").alias("self_ms"), F.sum("sp_total_time").alias("total_ms")
    )
    # one row per (host[, schema], snapshot): a series is as long as the timeline
    d = counter_delta(sums, keys, "sp_timestamp", ["calls", "self_ms", "total_ms"], Reset.DROP_NOT_POSITIVE, chunk=None)
    d = d.where((_d("self_ms") >= 0) & (_d("total_ms") >= 0))
    averages = [half_up(ratio(_d(c) * 1000, _d("calls"))).alias(n) for c, n in (("self_ms", "avg_self_us"), ("total_ms", "avg_total_us"))]
    if by_schema:
        return _points(d, "sp_host_id", "sp_timestamp", start,
                       [F.col("schema"), rate(_d("calls"), F.col("elapsed_s"), HOUR).alias("calls_1h_rate"), *averages])
    return _points(d, "sp_host_id", "sp_timestamp", start,
                   [rate(_d("calls"), F.col("elapsed_s"), MINUTE).alias("calls_1m_rate"), *averages])


def avg_sproc_runtime_per_db(fleet: Fleet, host=None, start=None, end=None, lag: str | None = "4 hours") -> DataFrame:
    return _sproc_runtime(fleet, host, start, end, lag, False)


def avg_sproc_runtime_per_schema(fleet: Fleet, host=None, start=None, end=None, lag: str | None = "4 hours") -> DataFrame:
    return _sproc_runtime(fleet, host, start, end, lag, True)


def blocked_process_counts(fleet: Fleet, host=None, start=None, end=None, lag: str | None = None) -> DataFrame:
    df = fleet.samples("blocking_processes", host, start, end).where("waiting")
    per = df.groupBy("bp_host_id", "bp_timestamp").agg(F.count(F.lit(1)).alias("count"))
    return _points(per, "bp_host_id", "bp_timestamp", start, [F.col("count")])


def db_general_info(fleet: Fleet, host=None, start=None, end=None, lag: str | None = "4 hours") -> DataFrame:
    # Output name of each counter's hourly rate.
    names = {
        "sdd_xact_commit": "commits_1h_rate",
        "sdd_xact_rollback": "rollbacks_1h_rate",
        "sdd_blks_read": "blks_read_1h_rate",
        "sdd_blks_hit": "blks_hit_hour_rate",
        "sdd_temp_files": "temp_files_hour_rate",
        "sdd_temp_bytes": "temp_bytes_1h_rate",
        "sdd_deadlocks": "deadlocks_1h_rate",
        "sdd_blk_read_time": "blk_read_time_ms_1h_rate",
        "sdd_blk_write_time": "blk_write_time_ms_1h_rate",
    }
    df = fleet.samples("stat_database_data", host, start, end, lag).select(
        "sdd_host_id", "sdd_timestamp", "sdd_numbackends", *names
    )
    d = counter_delta(df, ["sdd_host_id"], "sdd_timestamp", list(names), Reset.DROP_NEGATIVE)
    return _points(d, "sdd_host_id", "sdd_timestamp", start, [
        F.col("sdd_numbackends").alias("conns"), *_per_hour(names),
        hit_pct(_d("sdd_blks_hit"), _d("sdd_blks_read"), 1).alias("blks_sh_buf_hit_pct"),
        hit_pct(_d("sdd_blk_write_time"), _d("sdd_blk_read_time"), 1).alias("blk_write_pct"),
    ])


def _sizes(fleet, host, start, end, by_schema: bool) -> DataFrame:
    df = fleet.samples("table_size_data", host, start, end)
    keys = ["tsd_host_id", "tsd_timestamp"]
    if by_schema:
        t = fleet.table("tables").where(_regular_schema("t_schema")).select("t_id", F.col("t_schema").alias("schema"))
        df = df.join(t, F.col("tsd_table_id") == F.col("t_id"))
        keys.append("schema")
    per = df.groupBy(*keys).agg(F.sum("tsd_table_size").alias("tsize_b"), F.sum("tsd_index_size").alias("isize_b"))
    return per.where("isize_b > 0")


def db_size(fleet: Fleet, host=None, start=None, end=None, lag: str | None = None) -> DataFrame:
    return _points(_sizes(fleet, host, start, end, False), "tsd_host_id", "tsd_timestamp", start,
                   [(F.col("tsize_b") + F.col("isize_b")).alias("db_size_b"), F.col("tsize_b"), F.col("isize_b")])


def table_and_index_sizes_per_schema(fleet: Fleet, host=None, start=None, end=None, lag: str | None = None) -> DataFrame:
    return _points(_sizes(fleet, host, start, end, True), "tsd_host_id", "tsd_timestamp", start,
                   [F.col("schema"), F.col("tsize_b"), F.col("isize_b")])


def index_details(fleet: Fleet, host=None, start=None, end=None, lag: str | None = "4 hours", *, min_bytes: int = 10_000_000) -> DataFrame:
    idx = fleet.table("indexes").where(_regular_schema("i_schema")).select(
        "i_id", F.col("i_schema").alias("schema"), F.col("i_name").alias("index")
    )
    df = fleet.samples("index_usage_data", host, start, end, lag).join(idx, F.col("iud_index_id") == F.col("i_id"))
    keys = ["iud_host_id", "schema", "index"]
    per = df.groupBy(*keys, "iud_timestamp").agg(F.max("iud_scan").alias("scans"), F.max("iud_size").alias("size_b"))
    d = counter_delta(per.where("scans > 10"), keys, "iud_timestamp", ["scans"], Reset.DROP_NEGATIVE)
    d = d.where((F.col("size_b") >= min_bytes) & (F.col("elapsed_s") > 1))
    return _points(d, "iud_host_id", "iud_timestamp", start, [
        F.col("schema"), F.col("index"), rate(_d("scans"), F.col("elapsed_s"), HOUR).alias("scans_1h_rate"), F.col("size_b")
    ])


def load(fleet: Fleet, host=None, start=None, end=None, lag: str | None = "4 hours") -> DataFrame:
    df = fleet.samples("host_load", host, start, end, lag)
    d = counter_delta(df, ["load_host_id"], "load_timestamp", ["xlog_location_mb"], Reset.DROP_NEGATIVE).where("elapsed_s > 1")
    loads = [half_up(F.col(f"load_{m}min_value") / F.lit(100.0), 1).alias(f"min{m}") for m in (1, 5, 15)]
    return _points(d, "load_host_id", "load_timestamp", start, [
        *loads, rate(_d("xlog_location_mb"), F.col("elapsed_s"), HOUR * MICRO).alias("xlog_b_1h_rate")
    ])


# Output name of each table counter's hourly rate.
TABLE_RATES = {
    "tsd_seq_scans": "tscans_1h_rate",
    "tsd_index_scans": "iscans_1h_rate",
    "tsd_tup_ins": "ins_1h_rate",
    "tsd_tup_upd": "upd_1h_rate",
    "tsd_tup_del": "del_1h_rate",
}


def _scan_rates(fleet, host, start, end, lag, by_schema: bool) -> DataFrame:
    df = fleet.samples("table_size_data", host, start, end, lag)
    keys, extra = ["tsd_host_id"], []
    if by_schema:
        t = fleet.table("tables").where(_regular_schema("t_schema")).select("t_id", F.col("t_schema").alias("schema"))
        df = df.join(t, F.col("tsd_table_id") == F.col("t_id"))
        keys.append("schema")
        extra = [F.col("schema")]
    cols = list(TABLE_RATES)
    sums = df.groupBy(*keys, "tsd_timestamp").agg(*(F.sum(c).alias(c) for c in cols))
    d = counter_delta(sums, keys, "tsd_timestamp", cols, Reset.DROP_NEGATIVE, chunk=None)
    idle = F.lit(True)
    for c in cols:
        idle = idle & (_d(c) == 0)
    d = d.where((_d("tsd_index_scans") >= 0) & ~idle & (F.col("elapsed_s") > 0))
    return _points(d, "tsd_host_id", "tsd_timestamp", start, [*extra, *_per_hour(TABLE_RATES)])


def scan_and_iud_rates_per_db(fleet: Fleet, host=None, start=None, end=None, lag: str | None = "4 hours") -> DataFrame:
    return _scan_rates(fleet, host, start, end, lag, False)


def scan_and_iud_rates_per_schema(fleet: Fleet, host=None, start=None, end=None, lag: str | None = "4 hours") -> DataFrame:
    return _scan_rates(fleet, host, start, end, lag, True)


def sproc_details_per_schema_sproc(fleet: Fleet, host=None, start=None, end=None, lag: str | None = "4 hours") -> DataFrame:
    cols = ["sp_calls", "sp_total_time", "sp_self_time"]
    df = fleet.samples("sproc_performance_data", host, start, end, lag).where("sp_calls > 10")
    d = counter_delta(df.select("sp_host_id", "sp_sproc_id", "sp_timestamp", *cols), ["sp_host_id", "sp_sproc_id"],
                      "sp_timestamp", cols, Reset.DROP_NOT_POSITIVE)
    d = d.where((_d("sp_total_time") > 0) & (_d("sp_self_time") > 0) & (F.col("elapsed_s") > 0))
    names = fleet.table("sprocs").select("sproc_id", F.col("sproc_schema").alias("schema"),
                                         proc_base_name(F.col("sproc_name")).alias("sproc"))
    d = d.join(names, F.col("sp_sproc_id") == F.col("sproc_id"))
    return _points(d, "sp_host_id", "sp_timestamp", start, [
        F.col("schema"), F.col("sproc"),
        half_up(ratio(_d("sp_total_time") * HOUR, F.col("elapsed_s") * 1000)).alias("duration_s_1h_rate"),
        half_up(ratio(_d("sp_self_time") * 1000, _d("sp_calls"))).alias("avg_self_us"),
        half_up(ratio(_d("sp_total_time") * 1000, _d("sp_calls"))).alias("avg_total_us"),
    ])


def table_details(fleet: Fleet, host=None, start=None, end=None, lag: str | None = "4 hours", *, min_bytes: int = 10_000_000) -> DataFrame:
    t = fleet.table("tables").where(_regular_schema("t_schema")).select(
        "t_id", F.col("t_schema").alias("schema"), F.col("t_name").alias("table")
    )
    cols = list(TABLE_RATES)
    df = fleet.samples("table_size_data", host, start, end, lag).where((F.col("tsd_index_size") > 0) & (F.col("tsd_table_size") > min_bytes))
    df = df.select("tsd_host_id", "tsd_table_id", "tsd_timestamp", "tsd_table_size", "tsd_index_size", *cols)
    d = counter_delta(df, ["tsd_host_id", "tsd_table_id"], "tsd_timestamp", cols, Reset.DROP_NEGATIVE).where("elapsed_s > 0")
    d = d.join(t, F.col("tsd_table_id") == F.col("t_id"))
    return _points(d, "tsd_host_id", "tsd_timestamp", start, [
        F.col("schema"), F.col("table"), F.col("tsd_table_size").alias("tsize_b"), F.col("tsd_index_size").alias("isize_b"),
        *_per_hour(TABLE_RATES),
    ])


def table_io_details(fleet: Fleet, host=None, start=None, end=None, lag: str | None = "4 hours") -> DataFrame:
    # Output name of each block counter's hourly rate.
    names = {
        "tio_heap_read": "heap_read_1h_rate",
        "tio_heap_hit": "heap_hit_1h_rate",
        "tio_idx_read": "index_read_1h_rate",
        "tio_idx_hit": "index_hit_1h_rate",
    }
    t = fleet.table("tables").where(_regular_schema("t_schema")).select(
        "t_id", F.col("t_schema").alias("schema"), F.col("t_name").alias("table")
    )
    df = fleet.samples("table_io_data", host, start, end, lag).select("tio_host_id", "tio_table_id", "tio_timestamp", *names)
    d = counter_delta(df, ["tio_host_id", "tio_table_id"], "tio_timestamp", list(names), Reset.RAW).where("elapsed_s > 0")
    busy = F.lit(False)
    for c in names:
        busy = busy | (_d(c) > 0)
    d = d.where(busy).join(t, F.col("tio_table_id") == F.col("t_id"))

    def pct(hit: str, read: str) -> Column:
        total = _d(hit) + _d(read)
        return F.when(total != 0, half_up(ratio(_d(hit) * 100, total)))

    return _points(d, "tio_host_id", "tio_timestamp", start, [
        F.col("schema"), F.col("table"), *_per_hour(names),
        pct("tio_heap_hit", "tio_heap_read").alias("heap_hit_pct"), pct("tio_idx_hit", "tio_idx_read").alias("index_hit_pct"),
    ])


# Measurement base name and tag columns of every export metric.
MEASUREMENTS = {
    "avg_query_runtime_per_db": ("avg_query_runtime", ()),
    "avg_sproc_runtime_per_db": ("avg_sproc_runtime", ()),
    "avg_sproc_runtime_per_schema": ("avg_sproc_runtime_schema", ("schema",)),
    "blocked_process_counts": ("blocked_process_counts", ()),
    "db_general_info": ("db_general", ()),
    "db_size": ("db_size", ()),
    "index_details": ("index_stats", ("schema", "index")),
    "load": ("load", ()),
    "scan_and_iud_rates_per_db": ("scan_and_iud_rates", ()),
    "scan_and_iud_rates_per_schema": ("scan_and_iud_rates_schema", ("schema",)),
    "sproc_details_per_schema_sproc": ("sproc_details", ("schema", "sproc")),
    "table_and_index_sizes_per_schema": ("table_and_index_sizes", ("schema",)),
    "table_details": ("table_details", ("schema", "table")),
    "table_io_details": ("table_io_details", ("schema", "table")),
}


def metric(name: str, fleet: Fleet, host=None, start=None, end=None, lag: str | None = "4 hours") -> DataFrame:
    if name not in MEASUREMENTS:
        raise KeyError(f"unknown metric: {name}")
    return globals()[name](fleet, host, start, end, lag)


def as_points(name: str, fleet: Fleet, df: DataFrame) -> DataFrame:
    """Rows of a metric as tagged points: the host's short name and the metric's tag columns are tags,
    everything else is a field."""
    measurement, tags = MEASUREMENTS[name]
    hosts = fleet.table("hosts").select("host_id", F.col("host_ui_shortname").alias("dbname"))
    df = df.join(hosts, "host_id")
    fields = [c for c in df.columns if c not in ("host_id", "timestamp", "time", "dbname", *tags)]
    return to_points(df, measurement, ["dbname", *tags], fields, "timestamp")


def export_points(name: str, fleet: Fleet, host=None, start=None, end=None, lag: str | None = "4 hours") -> DataFrame:
    """A metric of a range as tagged points; ``exports.catch_up`` resumes and goes in chunks."""
    return as_points(name, fleet, metric(name, fleet, host, start, end, lag))
