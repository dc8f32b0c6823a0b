"""Building blocks on whole tables, and their oracles."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from counterloom.functions import predicates as C
from counterloom.functions.numbers import half_up
from counterloom.functions.times import bucket, group_date, period
from counterloom.operators import joins as J
from counterloom.operators import series as B
from counterloom.operators import sets as H
from counterloom.operators import topn as G
from counterloom.plans import settings as S
from counterloom.schema import Reset
from counterloom.session import shared_dir
from counterloom.sources import store as A

from .harness import big, rn, secs

SP = ["sp_host_id", "sp_sproc_id"]
COLS = ["sp_calls", "sp_total_time"]
T0, T1 = "2024-01-05 12:00:00", "2024-01-25 12:00:00"


def _sp(f):
    return f.table("sproc_performance_data").select("sp_host_id", "sp_sproc_id", "sp_timestamp", *COLS)


def _delta(policy):
    return lambda f: B.counter_delta(_sp(f), SP, "sp_timestamp", COLS, policy)


def _read_back(f, metric, write, *keys):
    """Rows of a stored metric per partition, with the times that its folder holds."""
    root = f"{shared_dir(f.spark)}/store-{uuid.uuid4().hex}"
    ts = "sp_timestamp" if metric == "sproc_performance_data" else "bl_timestamp"
    write(f.table(metric), root, metric)
    stored = f.spark.read.parquet(f"{root}/{metric}")
    return stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def _last_periods(f):
    """Samples and calls per host in the last complete hour and day."""
    parts = []
    for unit in ("hour", "day"):
        start, end = period(datetime(2024, 1, 20, 13, 25), unit)
        df = f.samples("sproc_performance_data", None, start, end, closed_start=True, open_end=True)
        parts.append(df.groupBy(F.lit(unit).alias("unit"), "sp_host_id").agg(F.count(F.lit(1)).alias("n"), F.max("sp_calls").alias("calls")))
    return H.union_all(*parts)


def _resume(f):
    known = f.table("hosts").select(F.col("host_id").alias("bl_host_id"))
    stored = f.table("blocking_locks").where("bl_timestamp < timestamp '1999-01-01' and bl_host_id < 4")
    return A.resume_point(stored, ["bl_host_id"], "bl_timestamp", known, "1999-01-10 00:00:00", 3)


def _conformed(f):
    old = f.table("stat_bgwriter_data").drop("sbd_buffers_alloc", "sbd_checkpoints_req")
    return A.conform(old, "stat_bgwriter_data")


def _patterns(f, *p):
    return f.spark.createDataFrame([(x,) for x in p], "pattern string")


def _schema_conf(f):
    rows = [(0, "tmp%", False), (0, "%", True), (2, "data\\_0", True), (2, "tmp%", True), (3, "%", True), (3, "data%", False)]
    return f.spark.createDataFrame(rows, "host_id int, pattern string, included boolean")


def _ignore(f):
    return f.spark.createDataFrame([(None, "table_1"), (4, None), (2, "table_3")], "host_id int, object_name string")


def _spans(f):
    """Order spans per nation, as intervals with keys."""
    o = f.table("orders").join(f.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    ts = F.col("o_orderdate").cast("timestamp")
    return o.select("o_orderkey", F.col("c_nationkey").alias("k"), F.col("o_orderpriority").alias("p"), ts.alias("a"),
                    (ts + F.make_dt_interval(F.col("o_orderkey") % 5)).alias("z"))


def _overlaps(f):
    s = _spans(f)
    return J.flag_overlaps(s.where("p like '1%'"), s.where("p like '5%'"), ["k"], "a", "z", "hit", chunk="month")


def _with_tables(f):
    return f.table("table_size_data").join(f.table("tables"), F.col("tsd_table_id") == F.col("t_id"))


def _groups(f):
    return f.table("hosts").groupBy("host_enabled").agg(F.collect_set("host_id").alias("ids"))


def _stamps(f):
    return f.table("table_size_data").groupBy("tsd_host_id").agg(F.max("tsd_timestamp").alias("at"))


def _per_host():
    return Window.partitionBy("load_host_id").orderBy("load_timestamp")


QUERIES = {
    # sources
    "src_samples_range": lambda f: f.samples("sproc_performance_data", None, T0, T1, "4 hours"),
    "src_samples_host": lambda f: f.samples("table_size_data", 2),
    "src_hosts": lambda f: f.table("hosts"),
    "src_month_keys": lambda f: A.with_month_keys(f.table("sproc_performance_data"), "sproc_performance_data").groupBy("yyyymm", "host_id").count(),
    "src_week_keys": lambda f: A.with_week_key(f.table("blocking_locks"), "blocking_locks").groupBy("yyyyiw").count(),
    "src_month_store": lambda f: _read_back(f, "sproc_performance_data", A.write_samples, "yyyymm", "host_id"),
    "src_week_store": lambda f: _read_back(f, "blocking_locks", lambda df, root, m: A.write_locks(df, root, m), "yyyyiw"),
    "src_last_periods": _last_periods,
    "src_expired_months": lambda f: A.expired_partitions(
        f.table("blocking_locks").select(F.date_format("bl_timestamp", "yyyyMM").alias("yyyymm")), as_of=date(1999, 3, 5), months=6),
    "src_expired_weeks": lambda f: A.expired_weeks(A.with_week_key(f.table("blocking_locks"), "blocking_locks"), "1999-03-05 00:00:00", 4),
    "src_resume_point": _resume,
    "src_new_samples": lambda f: A.new_samples(f.table("blocking_locks").select("bl_host_id", "bl_timestamp", "pid", "relation"), _resume(f), ["bl_host_id"], "bl_timestamp"),
    "src_conform": _conformed,
    "src_json_rows": lambda f: A.to_json_rows(f.table("events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("decimal(12,2)").alias("amount"), F.to_date("ts").alias("day"), "event_type")),
    # counters
    **{f"delta_{p.value.lower()}": _delta(p) for p in Reset if p is not Reset.WINDOW_RANGE},
    "delta_p6": lambda f: B.counter_range(_sp(f), SP, COLS),
    "delta_after_first_nonzero": lambda f: B.delta_after_first_nonzero(
        f.table("stat_database_data").select(F.col("sdd_host_id").alias("h"), F.col("sdd_timestamp").alias("ts"), "sdd_deadlocks", "sdd_blks_read"), ["h"], "ts", ["sdd_deadlocks", "sdd_blks_read"]),
    "changed_only": lambda f: B.changed_only(f.table("table_io_data"), ["tio_host_id", "tio_table_id"], "tio_timestamp", ["tio_heap_read", "tio_idx_read"]),
    "last_in_day": lambda f: B.last_in_period(f.table("table_size_data"), ["tsd_host_id", "tsd_table_id"], "tsd_timestamp", "day", ["tsd_table_size", "tsd_seq_scans"]),
    "window_endpoints": lambda f: B.window_endpoints(f.table("table_size_data"), "tsd_host_id", "tsd_table_id", "tsd_timestamp", ["tsd_table_size", "tsd_tup_ins"]),
    "time_buckets": lambda f: f.table("events").groupBy(group_date(F.col("ts").cast("timestamp")).alias("bucket")).agg(F.count(F.lit(1)).alias("n")),
    "fill_gaps": lambda f: B.fill_gaps(
        f.table("stat_database_data").select(F.col("sdd_host_id").alias("host_id"), F.col("sdd_timestamp").alias("ts"), "sdd_numbackends"),
        f.table("hosts").select("host_id"), "ts", "2024-01-01 00:00:00", "2024-01-31 00:00:00", "1 hour", {"sdd_numbackends": 0}),
    # predicates
    "where_optional": lambda f: C.opt_eq(C.opt_eq(f.table("tables"), "t_schema", None), "t_host_id", 3),
    "where_range": lambda f: C.in_range(f.table("host_load"), "load_timestamp", T0, T1).select("load_host_id", "load_timestamp"),
    "where_between": lambda f: C.in_range(f.table("host_load"), "load_timestamp", T0, T1, closed_end=True).select("load_host_id", "load_timestamp"),
    "where_weekday": lambda f: C.is_weekday_filter(f.table("host_load"), "load_timestamp").groupBy("load_host_id").count(),
    "where_like_any": lambda f: f.table("part").where(C.like_any(F.col("p_type"), ("STANDARD%", "%OMO"))).select("p_partkey"),
    "where_like_none": lambda f: C.like_none(f.table("part"), "p_type", _patterns(f, "STANDARD%", "%OMO")).select("p_partkey"),
    "where_not_temp": lambda f: f.table("documents").select("doc_id", C.not_temp(F.concat(F.lit("temp"), F.col("text"))).alias("a"), C.not_temp(F.col("source")).alias("b")),
    "where_ilike": lambda f: f.table("part").where(C.ilike(F.col("p_type"), "and")).select("p_partkey"),
    "where_shortname": lambda f: f.table("hosts").select("host_id", C.valid_shortname(F.col("host_ui_shortname")).alias("ok"), C.valid_shortname(F.col("host_name")).alias("bad")),
    "where_in_list": lambda f: f.table("sprocs").where(F.col("sproc_host_id").isin(1, 3)),
    "where_all_equal": lambda f: f.table("tables").groupBy("t_name").agg(F.collect_list("t_schema").alias("l")).select("t_name", C.all_equal(F.col("l"), F.lit("data_1")).alias("same")),
    "where_schema_filter": lambda f: C.schema_filter(f.table("tables"), _schema_conf(f), "t_host_id", "t_schema"),
    "where_not_utility": lambda f: f.table("stat_statements_data").select("ssd_host_id", "ssd_query_id", "ssd_timestamp",
        C.not_utility(F.when(F.col("ssd_query_id") % 3 == 0, F.lit("commit;")).otherwise(F.col("ssd_query"))).alias("kept"), C.not_copy_ddl(F.col("ssd_query")).alias("plain")),
    "hosts_with_feature": lambda f: S.hosts_with_feature(f.table("host_settings"), "loadGatherInterval"),
    "active_features": lambda f: S.active_features(f.table("host_settings")),
    "change_setting": lambda f: S.change_setting(f.table("host_settings"), "statDatabaseGatherInterval", 9),
    # joins
    "join_dimension": lambda f: _with_tables(f).groupBy("t_schema").agg(F.count(F.lit(1)).alias("n")),
    "join_left": lambda f: f.table("hosts").join(f.table("tables").where("t_schema = 'tmp_x' and t_host_id < 3"), F.col("host_id") == F.col("t_host_id"), "left").select("host_id", "t_name"),
    "join_full": lambda f: f.table("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("o")).join(
        f.table("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), "c_acctbal"), "k", "full"),
    "join_self_previous": lambda f: (lambda d: d.alias("a").join(d.alias("b"), (F.col("a.h") == F.col("b.h")) & (F.col("a.d") == F.date_add("b.d", 1))).select(
        F.col("a.h").alias("h"), F.col("a.d").alias("d"), (F.col("a.m") - F.col("b.m")).alias("growth")))(
        f.table("host_load").groupBy(F.col("load_host_id").alias("h"), F.to_date("load_timestamp").alias("d")).agg(F.max("xlog_location_mb").alias("m"))),
    "join_locks": lambda f: J.lock_match(f.table("blocking_locks").where("not granted"), f.table("blocking_locks").where("granted"), "bl_host_id", "bl_timestamp"),
    "join_semi": lambda f: f.table("tables").join(f.table("table_size_data").where("tsd_tup_del > 5"), F.col("t_id") == F.col("tsd_table_id"), "left_semi").select("t_id"),
    "join_not_ignored": lambda f: J.not_ignored(f.table("tables"), _ignore(f), "t_host_id", "t_name"),
    "join_anti_pair": lambda f: f.table("tables").join(f.spark.createDataFrame([("data_0", "table_0")], "t_schema string, t_name string"), ["t_schema", "t_name"], "left_anti").select("t_id"),
    "join_overlaps": _overlaps,
    "join_array_members": lambda f: J.rows_for_hosts(f.table("sprocs"), _groups(f), "sproc_host_id", "ids").select("sproc_id", "host_enabled"),
    "join_values_at": lambda f: J.values_at(f.table("table_size_data"), _stamps(f), "tsd_host_id", "tsd_timestamp").select("tsd_table_id", "tsd_table_size"),
    "join_row_compare": lambda f: f.table("sprocs").join(f.table("sprocs").select("sproc_host_id", "sproc_name").groupBy("sproc_host_id", "sproc_name").agg(F.count(F.lit(1)).alias("versions")), ["sproc_host_id", "sproc_name"]).select("sproc_id", "versions"),
    # aggregates
    "agg_basic": lambda f: f.table("host_load").groupBy("load_host_id").agg(F.count(F.lit(1)).alias("n"), F.min("load_1min_value").alias("lo"), F.max("load_1min_value").alias("hi"), F.sum("load_1min_value").alias("s")),
    "agg_distinct": lambda f: f.table("lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("supps")),
    "agg_names": lambda f: f.table("sprocs").groupBy("sproc_host_id").agg(F.array_join(F.array_sort(F.collect_set("sproc_schema")), ",").alias("schemas")),
    "agg_bools": lambda f: f.table("lineitem").groupBy("l_suppkey").agg(F.bool_and(F.col("l_discount") < 0.1).alias("every"), F.bool_or(F.col("l_tax") > 0.07).alias("some")),
    "agg_range": lambda f: f.table("lineitem").groupBy("l_suppkey").agg((F.max("l_linenumber") - F.min("l_linenumber")).alias("r")),
    "agg_ratios": lambda f: f.table("sproc_performance_data").groupBy("sp_host_id").agg(
        half_up(F.sum("sp_total_time") / F.sum("sp_calls"), 3).alias("of_sums"), half_up(F.sum(half_up(F.col("sp_total_time") / F.col("sp_calls"))) / F.count(F.lit(1)), 3).alias("mean")),
    "agg_having": lambda f: f.table("lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).where("n > 30"),
    "agg_conditional": lambda f: f.table("events").groupBy("event_type").agg(F.sum(F.when(F.col("value") > 100, 1).otherwise(0)).alias("big")),
    "agg_distinct_rows": lambda f: f.table("lineitem").select("l_suppkey", "l_returnflag").distinct(),
    "agg_totals": lambda f: H.with_totals(
        f.table("tables").groupBy("t_host_id", "t_schema").count(), f.table("tables").groupBy("t_host_id").count().withColumn("t_schema", F.lit(" "))),
    "agg_by_expression": lambda f: f.table("events").groupBy((F.col("user_id") % 10).alias("g")).agg(F.count(F.lit(1)).alias("n")),
    "agg_share": lambda f: G.share_of(f.table("tables").groupBy("t_host_id", "t_schema").count(), ["t_host_id"], "count", "all_tables"),
    "agg_grand_total": lambda f: G.grand_total(f.table("part").select("p_partkey", "p_size"), F.col("p_size"), "total"),
    # windows and order
    "win_moving_sum": lambda f: f.table("host_load").select("load_host_id", "load_timestamp", B.moving_sum("load_1min_value", ["load_host_id"], "load_timestamp", 4).alias("s")),
    "win_lag_or_self": lambda f: f.table("host_load").select("load_host_id", "load_timestamp", F.coalesce(F.lag("xlog_location_mb").over(_per_host()), "xlog_location_mb").alias("prev")),
    "win_trend": lambda f: f.table("host_load").select("load_host_id", "load_timestamp", B.trend("load_1min_value", _per_host()).alias("t")),
    "top_n_per_group": lambda f: G.top_n(f.table("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"), ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 3, "rank"),
    "top_rank": lambda f: G.top_rank(f.table("part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], [F.desc("p_size")], 2),
    "top_latest": lambda f: G.latest(f.table("host_load"), ["load_host_id"], "load_timestamp", ["load_5min_value"]),
    "top_per_mode": lambda f: G.top_per_mode(f.table("supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), {"rich": F.col("s_acctbal"), "new": F.col("s_suppkey"), "debt": F.when(F.col("s_acctbal") < 0, -F.col("s_acctbal"))}, ["s_nationkey"], ["s_suppkey"], 2),
    "top_limit": lambda f: G.top(f.table("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 25),
    "order_case_nulls": lambda f: f.table("hosts").select("host_id", F.row_number().over(Window.orderBy(F.when(F.col("host_group_id") == 0, 0).otherwise(1), F.asc_nulls_first("host_db_export_name"), "host_ui_longname")).alias("position")),
    "latest_timestamp": lambda f: f.table("index_usage_data").agg(F.max("iud_timestamp").alias("ts")),
    # sets
    "set_union_all": lambda f: H.union_all(f.table("nation").select(F.col("n_name").alias("n")), f.table("region").select(F.col("r_name").alias("n")), f.table("nation").select(F.col("n_name").alias("n"))),
    "set_union": lambda f: H.union(f.table("customer").select(F.col("c_nationkey").alias("k")), f.table("supplier").select(F.col("s_nationkey").alias("k"))),
    "set_merge_tail": lambda f: H.merge_tail(
        f.table("host_load").where(F.col("load_timestamp") < T1).select("load_host_id", "load_timestamp", F.col("load_5min_value").alias("v")),
        f.table("host_load").where(F.col("load_timestamp") >= T0).select("load_host_id", "load_timestamp", F.col("load_1min_value").alias("v")), ["load_host_id", "load_timestamp"], "v"),
    "bucket_days": lambda f: f.table("lineitem").groupBy(bucket(F.col("l_shipdate").cast("timestamp"), "month").alias("m")).agg(F.count(F.lit(1)).alias("n")),
}


def _d(policy: str) -> str:
    raw = {c: f"{c} - lag({c}) over w" for c in COLS}
    expr = {
        "p1": raw, "p2": raw, "p3": {c: f"coalesce({r}, 0)" for c, r in raw.items()},
        "p4": {c: f"case when lag({c}) over w is null then 0 else greatest({r}, 0) end" for c, r in raw.items()},
        "p5": {c: f"case when {r} < 0 then {c} else {r} end" for c, r in raw.items()},
        "p7": {c: f"case when lag({c}) over w is null then 0 when {c} < lag({c}) over w then 0 else {r} end" for c, r in raw.items()},
    }[policy]
    keep = {"p1": "where d_sp_calls > 0", "p2": "where d_sp_calls >= 0"}.get(policy, "")
    return f"""select * from (select sp_host_id, sp_sproc_id, sp_timestamp, sp_calls, sp_total_time, {', '.join(f'{e} as d_{c}' for c, e in expr.items())}, {secs('sp_timestamp', 'lag(sp_timestamp) over w')} as elapsed_s,
  lag(sp_timestamp) over w as prev_sp_timestamp from sproc_performance_data window w as (partition by sp_sproc_id order by sp_timestamp)) {keep}"""


def _nz(c: str) -> str:
    seen = f"coalesce(bool_or({c} <> 0) over (partition by sdd_host_id order by sdd_timestamp rows between unbounded preceding and 1 preceding), false)"
    return f"case when {seen} then greatest({c} - lag({c}) over w, 0) else 0 end as d_{c}"


_RESUME = """with st as (select bl_host_id, max(bl_timestamp) as ts from blocking_locks where bl_timestamp < timestamp '1999-01-01' and bl_host_id < 4 group by 1),
res as (select host_id as bl_host_id, coalesce(ts, timestamp '1999-01-07 00:00:00') as resume_from from hosts left join st on bl_host_id = host_id)"""
_LK = "((a.transactionid is not null and a.transactionid = b.transactionid) or (a.database = b.database and a.relation = b.relation))"
_SPAN = "sp as (select o_orderkey, c_nationkey as k, o_orderpriority as p, o_orderdate as a, o_orderdate + cast(o_orderkey % 5 as int) * interval '1' day as z from orders join customer on o_custkey = c_custkey)"
_RANK2 = "row_number() over (partition by s_nationkey order by {0} desc, s_suppkey) as k"

ORACLE = {
    "src_samples_range": "select * from sproc_performance_data where sp_timestamp > timestamp '2024-01-05 08:00:00' and sp_timestamp <= timestamp '2024-01-25 12:00:00'",
    "src_samples_host": "select * from table_size_data where tsd_host_id = 2",
    "src_hosts": "select * from hosts",
    "src_month_keys": "select strftime(sp_timestamp, '%Y%m') as yyyymm, sp_host_id as host_id, count(*) as count from sproc_performance_data group by 1, 2",
    "src_week_keys": "select strftime(bl_timestamp, '%G%V') as yyyyiw, count(*) as count from blocking_locks group by 1",
    "src_month_store": "select cast(strftime(sp_timestamp, '%Y%m') as int) as yyyymm, sp_host_id as host_id, count(*) as n, min(sp_timestamp) as first, max(sp_timestamp) as last from sproc_performance_data group by 1, 2",
    "src_week_store": "select cast(strftime(bl_timestamp, '%G%V') as int) as yyyyiw, count(*) as n, min(bl_timestamp) as first, max(bl_timestamp) as last from blocking_locks group by 1",
    "src_last_periods": """select unit, sp_host_id, count(*) as n, max(sp_calls) as calls from sproc_performance_data join (values ('hour', timestamp '2024-01-20 12:00:00', timestamp '2024-01-20 13:00:00'),
  ('day', timestamp '2024-01-19', timestamp '2024-01-20')) p(unit, a, b) on sp_timestamp >= a and sp_timestamp < b group by 1, 2""",
    "src_expired_months": "select distinct strftime(bl_timestamp, '%Y%m') as yyyymm from blocking_locks where bl_timestamp < timestamp '1998-09-01'",
    "src_expired_weeks": "select distinct strftime(bl_timestamp, '%G%V') as yyyyiw from blocking_locks where strftime(bl_timestamp, '%G%V') < strftime(date '1999-02-05', '%G%V')",
    "src_resume_point": _RESUME + " select * from res",
    "src_new_samples": _RESUME + " select bl_host_id, bl_timestamp, pid, relation from blocking_locks join res using (bl_host_id) where bl_timestamp > resume_from",
    "src_conform": "select sbd_timestamp, sbd_host_id, sbd_checkpoints_timed, 0 as sbd_checkpoints_req, sbd_buffers_checkpoint, sbd_buffers_clean, sbd_buffers_backend, 0 as sbd_buffers_alloc from stat_bgwriter_data",
    "src_json_rows": """select '{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","amount":"' || event_id || '.00","day":"' || strftime(ts, '%Y-%m-%d') || '","event_type":"' || event_type || '"}' as json from events""",
    **{f"delta_{p}": _d(p) for p in ("p1", "p2", "p3", "p4", "p5", "p7")},
    "delta_p6": "select sp_host_id, sp_sproc_id, max(sp_calls) - min(sp_calls) as d_sp_calls, max(sp_total_time) - min(sp_total_time) as d_sp_total_time from sproc_performance_data group by 1, 2",
    "delta_after_first_nonzero": f"select sdd_host_id as h, sdd_timestamp as ts, sdd_deadlocks, sdd_blks_read, {_nz('sdd_deadlocks')}, {_nz('sdd_blks_read')} from stat_database_data window w as (partition by sdd_host_id order by sdd_timestamp)",
    "changed_only": """select * exclude (p1, p2, n) from (select *, lag(tio_heap_read) over w as p1, lag(tio_idx_read) over w as p2, row_number() over w as n from table_io_data window w as (partition by tio_table_id order by tio_timestamp))
where n = 1 or tio_heap_read is distinct from p1 or tio_idx_read is distinct from p2""",
    "last_in_day": """select tsd_host_id, tsd_table_id, cast(date_trunc('day', tsd_timestamp) as timestamp) as period, tsd_timestamp as last_ts, tsd_table_size, tsd_seq_scans from table_size_data
qualify row_number() over (partition by tsd_table_id, date_trunc('day', tsd_timestamp) order by tsd_timestamp desc) = 1""",
    "window_endpoints": """with e as (select tsd_host_id as h, min(tsd_timestamp) as a, max(tsd_timestamp) as z from table_size_data group by 1)
select l.tsd_host_id, l.tsd_table_id, f.tsd_table_size as first_tsd_table_size, f.tsd_tup_ins as first_tsd_tup_ins, l.tsd_table_size as last_tsd_table_size, l.tsd_tup_ins as last_tsd_tup_ins
from table_size_data l join e on h = l.tsd_host_id and z = l.tsd_timestamp left join table_size_data f on f.tsd_table_id = l.tsd_table_id and f.tsd_timestamp = a""",
    "time_buckets": "select time_bucket(interval 15 minute, ts) as bucket, count(*) as n from events group by 1",
    "fill_gaps": "with line as (select host_id, unnest(range(timestamp '2024-01-01', timestamp '2024-01-31', interval 1 hour)) as ts from hosts) select line.host_id, line.ts, coalesce(sdd_numbackends, 0) as sdd_numbackends from line left join stat_database_data on sdd_host_id = host_id and sdd_timestamp = ts",
    "where_optional": "select * from tables where t_host_id = 3",
    "where_range": f"select load_host_id, load_timestamp from host_load where load_timestamp >= timestamp '{T0}' and load_timestamp < timestamp '{T1}'",
    "where_between": f"select load_host_id, load_timestamp from host_load where load_timestamp between timestamp '{T0}' and timestamp '{T1}'",
    "where_weekday": "select load_host_id, count(*) as count from host_load where isodow(load_timestamp) between 1 and 5 group by 1",
    "where_like_any": "select p_partkey from part where p_type like 'STANDARD%' or p_type like '%OMO'",
    "where_like_none": "select p_partkey from part where p_type not like 'STANDARD%' and p_type not like '%OMO'",
    "where_not_temp": "select doc_id, not regexp_matches('temp' || text, '^(temp|.backup).*$') as a, not regexp_matches(source, '^(temp|.backup).*$') as b from documents",
    "where_ilike": "select p_partkey from part where p_type ilike '%and%'",
    "where_shortname": "select host_id, true as ok, false as bad from hosts",
    "where_in_list": "select * from sprocs where sproc_host_id in (1, 3)",
    "where_all_equal": "select t_name, bool_and(t_schema = 'data_1') as same from tables group by 1",
    "where_schema_filter": "select * from tables where (t_host_id not in (2, 3) and t_schema not like 'tmp%') or (t_host_id = 2 and t_schema in ('data_0', 'tmp_x')) or (t_host_id = 3 and t_schema not like 'data%')",
    "where_not_utility": "select ssd_host_id, ssd_query_id, ssd_timestamp, ssd_query_id % 3 <> 0 as kept, ssd_query_id % 7 <> 0 as plain from stat_statements_data",
    "hosts_with_feature": "select c_custkey as host_id from customer where c_custkey % 3 > 0",
    "active_features": "select c_custkey as host_id, 'loadGatherInterval' as feature from customer where c_custkey % 3 > 0 union all select c_custkey, 'statDatabaseGatherInterval' from customer where c_nationkey % 2 > 0",
    "change_setting": """select c_custkey as host_id, '{' || chr(10) || '"loadGatherInterval": ' || c_custkey % 3 || ',' || chr(10) || '"statDatabaseGatherInterval": 9' || chr(10) || '}' as settings from customer""",
    "join_dimension": "select t_schema, count(*) as n from table_size_data join tables on t_id = tsd_table_id group by 1",
    "join_left": "select host_id, t_name from hosts left join (select * from tables where t_schema = 'tmp_x' and t_host_id < 3) t on t_host_id = host_id",
    "join_full": "select coalesce(o.k, c.c_custkey) as k, o, c_acctbal from (select o_custkey as k, count(*) as o from orders group by 1) o full join (select * from customer where c_acctbal > 0) c on c.c_custkey = o.k",
    "join_self_previous": "with m as (select load_host_id as h, cast(load_timestamp as date) as d, max(xlog_location_mb) as m from host_load group by 1, 2) select a.h, a.d, a.m - b.m as growth from m a join m b on a.h = b.h and a.d = b.d + 1",
    "join_locks": f"select distinct a.bl_host_id, a.bl_timestamp, a.pid as blocked_pid, a.relation, b.pid as blocking_pid from blocking_locks a join blocking_locks b on a.bl_host_id = b.bl_host_id and a.bl_timestamp = b.bl_timestamp and a.pid <> b.pid and not a.granted and b.granted and {_LK}",
    "join_semi": "select t_id from tables where exists (select 1 from table_size_data where tsd_table_id = t_id and tsd_tup_del > 5)",
    "join_not_ignored": "select * from tables where t_name <> 'table_1' and t_host_id <> 4 and not (t_host_id = 2 and t_name = 'table_3')",
    "join_anti_pair": "select t_id from tables where t_schema || t_name not in ('data_0table_0')",
    "join_overlaps": f"with {_SPAN} select *, exists (select 1 from sp y where y.p like '5%' and y.k = x.k and y.a <= x.z and y.z >= x.a) as hit from sp x where p like '1%'",
    "join_array_members": "select sproc_id, host_enabled from sprocs join hosts on host_id = sproc_host_id",
    "join_values_at": "select tsd_table_id, tsd_table_size from table_size_data t where tsd_timestamp = (select max(tsd_timestamp) from table_size_data m where m.tsd_host_id = t.tsd_host_id)",
    "join_row_compare": "select sproc_id, count(*) over (partition by sproc_host_id, sproc_name) as versions from sprocs",
    "agg_basic": f"select load_host_id, count(*) as n, min(load_1min_value) as lo, max(load_1min_value) as hi, {big('sum(load_1min_value)')} as s from host_load group by 1",
    "agg_distinct": "select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as supps from lineitem group by 1",
    "agg_names": "select sproc_host_id, string_agg(distinct sproc_schema, ',' order by sproc_schema) as schemas from sprocs group by 1",
    "agg_bools": "select l_suppkey, bool_and(l_discount < 0.1) as every, bool_or(l_tax > 0.07) as some from lineitem group by 1",
    "agg_range": "select l_suppkey, max(l_linenumber) - min(l_linenumber) as r from lineitem group by 1",
    "agg_ratios": f"select sp_host_id, {rn('(cast(sum(sp_total_time) as double) / sum(sp_calls))', 3)} as of_sums, {rn('(cast(sum(cast(floor(sp_total_time / sp_calls + 0.5) as bigint)) as double) / count(*))', 3)} as mean from sproc_performance_data group by 1",
    "agg_having": "select l_partkey, count(*) as n from lineitem group by 1 having count(*) > 30",
    "agg_conditional": "select event_type, count(*) filter (where value > 100) as big from events group by 1",
    "agg_distinct_rows": "select distinct l_suppkey, l_returnflag from lineitem",
    "agg_totals": "select t_host_id, t_schema, count(*) as count from tables group by 1, 2 union all select t_host_id, ' ', count(*) from tables group by 1",
    "agg_by_expression": "select user_id % 10 as g, count(*) as n from events group by 1",
    "agg_share": f"select t_host_id, t_schema, count(*) as count, {big('sum(count(*)) over (partition by t_host_id)')} as all_tables from tables group by 1, 2",
    "agg_grand_total": f"select p_partkey, p_size, {big('sum(p_size) over ()')} as total from part",
    "win_moving_sum": f"select load_host_id, load_timestamp, {big('sum(load_1min_value) over (partition by load_host_id order by load_timestamp rows 3 preceding)')} as s from host_load",
    "win_lag_or_self": "select load_host_id, load_timestamp, lead(xlog_location_mb, 1, xlog_location_mb) over (partition by load_host_id order by load_timestamp desc) as prev from host_load",
    "win_trend": "select load_host_id, load_timestamp, coalesce(cast(sign(load_1min_value - lag(load_1min_value) over (partition by load_host_id order by load_timestamp)) as int), 0) as t from host_load",
    "top_n_per_group": "select * from (select l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as rank from lineitem) where rank <= 3",
    "top_rank": "select p_partkey, p_brand, p_size from part qualify rank() over (partition by p_brand order by p_size desc) <= 2",
    "top_latest": "select load_host_id, max(load_timestamp) as load_timestamp, arg_max(load_5min_value, load_timestamp) as load_5min_value from host_load group by 1",
    "top_per_mode": f"""with m as (select *, 'rich' as mode, {_RANK2.format('s_acctbal')} from supplier union all select *, 'new', {_RANK2.format('s_suppkey')} from supplier union all select *, 'debt', {_RANK2.format('(-s_acctbal)')} from supplier where s_acctbal < 0)
select s_suppkey, s_nationkey, s_acctbal, mode from m where k <= 2""",
    "top_limit": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25",
    "order_case_nulls": "select host_id, cast(row_number() over (order by case when host_group_id = 0 then 0 else 1 end, host_db_export_name nulls first, host_ui_longname) as int) as position from hosts",
    "latest_timestamp": "select max(iud_timestamp) as ts from index_usage_data",
    "set_union_all": "select n_name as n from nation union all select r_name from region union all select n_name from nation",
    "set_union": "select c_nationkey as k from customer union select s_nationkey from supplier",
    "set_merge_tail": f"select load_host_id, load_timestamp, max(v) as v from (select load_host_id, load_timestamp, load_5min_value as v from host_load where load_timestamp < timestamp '{T1}' union all select load_host_id, load_timestamp, load_1min_value from host_load where load_timestamp >= timestamp '{T0}') group by 1, 2",
    "bucket_days": "select cast(date_trunc('month', l_shipdate) as timestamp) as m, count(*) as n from lineitem group by 1",
}
