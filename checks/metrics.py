"""Export metric queries and their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from counterloom.plans import metrics as P
from counterloom.plans.exports import catch_up
from counterloom.session import shared_dir
from counterloom.sources.versions import VersionedTable

from .harness import big, r0, rate, rn, secs


def _json_points(df):
    return df.select("measurement", F.to_json("tags").alias("tags"), F.to_json("fields").alias("fields"), "time")


def _caught_up(f, name):
    """Two runs: the first ends in the middle of a chunk."""
    table = VersionedTable(f.spark, f"{shared_dir(f.spark)}/export-{uuid.uuid4().hex}")
    catch_up(f, name, table, "2024-01-17 07:30:00", first_days=16)
    return catch_up(f, name, table, "2024-01-31 00:00:00")


QUERIES = {f"metric_{name}": (lambda f, n=name: P.metric(n, f)) for name in P.MEASUREMENTS}
QUERIES |= {
    "metric_load_with_lag": lambda f: P.metric("load", f, None, "2024-01-10 00:00:00", "2024-01-31 00:00:00", "4 hours"),
    "export_points_sproc_details": lambda f: _json_points(P.export_points("sproc_details_per_schema_sproc", f)),
    "export_points_db_size": lambda f: _json_points(P.export_points("db_size", f)),
    "export_catch_up_load": lambda f: _caught_up(f, "load").select("measurement", "tags.dbname", "fields.*", "time"),
    "export_catch_up_sproc_details": lambda f: _json_points(_caught_up(f, "sproc_details_per_schema_sproc")),
}

_NOT_TEMP = "not ({0} like 'pg_temp%' or {0} like 'z_blocking' or {0} like 'tmp%' or {0} like 'temp%' or {0} = '_v')"


def _deltas(ts: str, cols: dict[str, str]) -> str:
    parts = [f"{c} - lag({c}) over w as {a}" for c, a in cols.items()]
    return ", ".join([f"{secs(ts, f'lag({ts}) over w')} as el", *parts])


def _head(host: str, ts: str) -> str:
    return f"{host} as host_id, {ts} as timestamp, cast(epoch({ts}) as bigint) as time"


def _runtime(by_schema: bool) -> str:
    key = ", sproc_schema as schema" if by_schema else ""
    grp, part, sel = ("group by 1, 2, 3", "sp_host_id, schema", "schema, ") if by_schema else ("group by 1, 2", "sp_host_id", "")
    calls = f"{rate('c', 'el', 3600)} as calls_1h_rate" if by_schema else f"{rate('c', 'el', 60)} as calls_1m_rate"
    return f"""with s as (select sp_host_id, sp_timestamp{key}, sum(sp_calls) as calls, sum(sp_self_time) as slf, sum(sp_total_time) as tot
  from sproc_performance_data join sprocs on sproc_id = sp_sproc_id where sp_calls > 10 {grp}),
d as (select *, {_deltas('sp_timestamp', {'calls': 'c', 'slf': 's', 'tot': 't'})} from s window w as (partition by {part} order by sp_timestamp))
select {_head('sp_host_id', 'sp_timestamp')}, {sel}{calls}, {r0('(cast(s * 1000 as double) / nullif(c, 0))')} as avg_self_us,
  {r0('(cast(t * 1000 as double) / nullif(c, 0))')} as avg_total_us from d where c > 0 and s >= 0 and t >= 0"""


_GEN = {"sdd_xact_commit": "commits_1h_rate", "sdd_xact_rollback": "rollbacks_1h_rate", "sdd_blks_read": "blks_read_1h_rate",
        "sdd_blks_hit": "blks_hit_hour_rate", "sdd_temp_files": "temp_files_hour_rate", "sdd_temp_bytes": "temp_bytes_1h_rate",
        "sdd_deadlocks": "deadlocks_1h_rate", "sdd_blk_read_time": "blk_read_time_ms_1h_rate", "sdd_blk_write_time": "blk_write_time_ms_1h_rate"}
_GEN_D = {c: "d" + str(i) for i, c in enumerate(_GEN)}
_TAB = {"tsd_seq_scans": "tscans", "tsd_index_scans": "iscans", "tsd_tup_ins": "ins", "tsd_tup_upd": "upd", "tsd_tup_del": "del"}


def _pct(hit: str, read: str, digits: int, guard: str) -> str:
    x = f"(cast({hit} * 100 as double) / nullif({hit} + {read}, 0))"
    return f"case when {hit} + {read} {guard} then {rn(x, digits) if digits else r0(x)} end"


def _scan_rates(by_schema: bool) -> str:
    key, grp, part, sel = (", t_schema as schema", "group by 1, 2, 3", "tsd_host_id, schema", "schema, ") if by_schema else ("", "group by 1, 2", "tsd_host_id", "")
    where = "where " + _NOT_TEMP.format("t_schema") if by_schema else ""
    sums = ", ".join(f"{big(f'sum({c})')} as {c}" for c in _TAB)
    rates = ", ".join(f"{rate(a, 'el', 3600)} as {a}_1h_rate" for a in _TAB.values())
    return f"""with s as (select tsd_host_id, tsd_timestamp{key}, {sums} from table_size_data join tables on t_id = tsd_table_id {where} {grp}),
d as (select *, {_deltas('tsd_timestamp', _TAB)} from s window w as (partition by {part} order by tsd_timestamp))
select {_head('tsd_host_id', 'tsd_timestamp')}, {sel}{rates} from d
where tscans >= 0 and iscans >= 0 and not (tscans = 0 and iscans = 0 and ins = 0 and upd = 0 and del = 0) and el > 0"""


_SPROC_DETAILS = f"""with d as (select *, {_deltas('sp_timestamp', {'sp_calls': 'c', 'sp_total_time': 't', 'sp_self_time': 's'})}
  from sproc_performance_data where sp_calls > 10 window w as (partition by sp_sproc_id order by sp_timestamp)),
details as (select {_head('sp_host_id', 'sp_timestamp')}, sproc_schema as schema, split_part(sproc_name, '(', 1) as sproc,
  {r0('(cast(t * 3600 as double) / (el * 1000))')} as duration_s_1h_rate, {r0('(cast(s * 1000 as double) / c)')} as avg_self_us, {r0('(cast(t * 1000 as double) / c)')} as avg_total_us
  from d join sprocs on sproc_id = sp_sproc_id where c > 0 and t > 0 and s > 0)"""

_DB_SIZE = f"""with s as (select tsd_host_id, tsd_timestamp, {big('sum(tsd_table_size)')} as t, {big('sum(tsd_index_size)')} as i from table_size_data group by 1, 2),
sizes as (select {_head('tsd_host_id', 'tsd_timestamp')}, t + i as db_size_b, t as tsize_b, i as isize_b from s where i > 0)"""

_LOAD = f"""with d as (select *, {_deltas('load_timestamp', {'xlog_location_mb': 'x'})} from host_load window w as (partition by load_host_id order by load_timestamp)),
loads as (select {_head('load_host_id', 'load_timestamp')}, {rn('(load_1min_value / 100.0)', 1)} as min1, {rn('(load_5min_value / 100.0)', 1)} as min5,
  {rn('(load_15min_value / 100.0)', 1)} as min15, {rate('x', 'el', 3600000000)} as xlog_b_1h_rate from d where x >= 0 and el > 1)"""

_EDGES = ["2024-01-01 07:30:00", "2024-01-04 07:30:00", "2024-01-07 07:30:00", "2024-01-10 07:30:00", "2024-01-13 07:30:00", "2024-01-16 07:30:00",
          "2024-01-17 07:29:50", "2024-01-20 07:29:50", "2024-01-23 07:29:50", "2024-01-26 07:29:50", "2024-01-29 07:29:50"]


def _chunked(sql: str, ts: str, where: str) -> str:
    """The same rows where chunks begin at the edges and look four hours back for the sample before them."""
    edges = f"with edges as (select unnest([{', '.join(f'timestamp {e!r}' for e in _EDGES)}]) as f), d as"
    inside = f"{ts} > timestamp '{_EDGES[0]}' and {ts} <= timestamp '2024-01-30 23:59:50' and epoch_us({ts}) - el * 1000000 > epoch_us((select max(f) from edges where f < {ts})) - 14400000000"
    return sql.replace("with d as", edges).replace(where, f"{where} and {inside}")


_SPROC_POINTS = """ select 'sproc_details' as measurement, cast(to_json({dbname: host_ui_shortname, schema: schema, sproc: sproc}) as varchar) as tags,
  cast(to_json({duration_s_1h_rate: duration_s_1h_rate, avg_self_us: avg_self_us, avg_total_us: avg_total_us}) as varchar) as fields, time from details join hosts using (host_id)"""

ORACLE = {
    "metric_avg_query_runtime_per_db": f"""with d as (select *, {_deltas('ssd_timestamp', {'ssd_calls': 'c', 'ssd_total_time': 't'})}
  from stat_statements_data where ssd_calls > 10 and lower(ssd_query) not like 'copy%' window w as (partition by ssd_host_id, ssd_query_id order by ssd_timestamp)),
g as (select ssd_host_id, ssd_timestamp, avg(cast(t as double) / c) as a, sum({r0('(c * 3600000000 / el)')}) as r from d where c > 0 and t > 0 and el > 1 group by 1, 2)
select {_head('ssd_host_id', 'ssd_timestamp')}, {r0(rn('(a * 1000)', 3))} as avg_us, {r0('(r / 1000000.0)')} as calls_1h_rate from g""",
    "metric_avg_sproc_runtime_per_db": _runtime(False),
    "metric_avg_sproc_runtime_per_schema": _runtime(True),
    "metric_blocked_process_counts": f"select {_head('bp_host_id', 'bp_timestamp')}, count(*) as count from blocking_processes where waiting group by bp_host_id, bp_timestamp",
    "metric_db_general_info": f"""with d as (select *, {_deltas('sdd_timestamp', _GEN_D)} from stat_database_data window w as (partition by sdd_host_id order by sdd_timestamp))
select {_head('sdd_host_id', 'sdd_timestamp')}, sdd_numbackends as conns, {', '.join(f"{rate(_GEN_D[c], 'el', 3600)} as {n}" for c, n in _GEN.items())},
  {_pct('d3', 'd2', 1, '> 0')} as blks_sh_buf_hit_pct, {_pct('d8', 'd7', 1, '> 0')} as blk_write_pct from d where d0 >= 0""",
    "metric_db_size": _DB_SIZE + " select * from sizes",
    "metric_index_details": f"""with s as (select iud_host_id, iud_timestamp, i_schema as schema, i_name as "index", max(iud_scan) as scans, max(iud_size) as size_b
  from index_usage_data join indexes on i_id = iud_index_id where {_NOT_TEMP.format('i_schema')} group by 1, 2, 3, 4),
d as (select *, {_deltas('iud_timestamp', {'scans': 'c'})} from s where scans > 10 window w as (partition by iud_host_id, schema, "index" order by iud_timestamp))
select {_head('iud_host_id', 'iud_timestamp')}, schema, "index", {rate('c', 'el', 3600)} as scans_1h_rate, size_b from d where c >= 0 and size_b >= 10000000 and el > 1""",
    "metric_load": _LOAD + " select * from loads",
    "metric_load_with_lag": _LOAD.replace("from host_load window", "from host_load where load_timestamp > timestamp '2024-01-09 20:00:00' window") + " select * from loads where timestamp > timestamp '2024-01-10 00:00:00'",
    "metric_scan_and_iud_rates_per_db": _scan_rates(False),
    "metric_scan_and_iud_rates_per_schema": _scan_rates(True),
    "metric_sproc_details_per_schema_sproc": _SPROC_DETAILS + " select * from details",
    "metric_table_and_index_sizes_per_schema": f"""with s as (select tsd_host_id, tsd_timestamp, t_schema as schema, {big('sum(tsd_table_size)')} as tsize_b, {big('sum(tsd_index_size)')} as isize_b
  from table_size_data join tables on t_id = tsd_table_id where {_NOT_TEMP.format('t_schema')} group by 1, 2, 3)
select {_head('tsd_host_id', 'tsd_timestamp')}, schema, tsize_b, isize_b from s where isize_b > 0""",
    "metric_table_details": f"""with d as (select *, {_deltas('tsd_timestamp', _TAB)} from table_size_data where tsd_index_size > 0 and tsd_table_size > 10000000
  window w as (partition by tsd_table_id order by tsd_timestamp))
select {_head('tsd_host_id', 'tsd_timestamp')}, t_schema as schema, t_name as "table", tsd_table_size as tsize_b, tsd_index_size as isize_b,
  {', '.join(f"{rate(a, 'el', 3600)} as {a}_1h_rate" for a in _TAB.values())}
from d join tables on t_id = tsd_table_id where tscans >= 0 and el > 0 and {_NOT_TEMP.format('t_schema')}""",
    "metric_table_io_details": f"""with d as (select *, {_deltas('tio_timestamp', {'tio_heap_read': 'hr', 'tio_heap_hit': 'hh', 'tio_idx_read': 'ir', 'tio_idx_hit': 'ih'})}
  from table_io_data window w as (partition by tio_table_id order by tio_timestamp))
select {_head('tio_host_id', 'tio_timestamp')}, t_schema as schema, t_name as "table", {rate('hr', 'el', 3600)} as heap_read_1h_rate, {rate('hh', 'el', 3600)} as heap_hit_1h_rate,
  {rate('ir', 'el', 3600)} as index_read_1h_rate, {rate('ih', 'el', 3600)} as index_hit_1h_rate, {_pct('hh', 'hr', 0, '<> 0')} as heap_hit_pct, {_pct('ih', 'ir', 0, '<> 0')} as index_hit_pct
from d join tables on t_id = tio_table_id where (hr > 0 or hh > 0 or ir > 0 or ih > 0) and {_NOT_TEMP.format('t_schema')}""",
    "export_points_sproc_details": _SPROC_DETAILS + _SPROC_POINTS,
    "export_catch_up_load": _chunked(_LOAD, "load_timestamp", "x >= 0 and el > 1") + " select 'load' as measurement, host_ui_shortname as dbname, min1, min5, min15, xlog_b_1h_rate, time from loads join hosts using (host_id)",
    "export_catch_up_sproc_details": _chunked(_SPROC_DETAILS, "sp_timestamp", "c > 0 and t > 0 and s > 0") + _SPROC_POINTS,
    "export_points_db_size": _DB_SIZE + """ select 'db_size' as measurement, cast(to_json({dbname: host_ui_shortname}) as varchar) as tags,
  cast(to_json({db_size_b: db_size_b, tsize_b: tsize_b, isize_b: isize_b}) as varchar) as fields, time from sizes join hosts using (host_id)""",
}
