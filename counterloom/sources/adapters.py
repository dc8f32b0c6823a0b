"""Counter samples derived from an event table and an order-line table.

Each text is a view over base tables or earlier views, named in braces, and is valid on any
engine with ANSI windows. The first step of every view is a grouped aggregate that combines
map-side, so what reaches the running totals grows with the number of time buckets only.
"""

from __future__ import annotations

ADAPTERS: dict[str, str] = {
    "hosts": """
select cast(n_nationkey % 4 + 1 as int) as host_id, lower(min(n_name)) || '.db' as host_name,
       'db' || cast(n_nationkey % 4 as varchar(10)) as host_db, cast(n_nationkey % 4 as int) as host_group_id,
       n_nationkey % 4 <> 3 as host_enabled, 'n' || cast(n_nationkey % 4 as varchar(10)) as host_ui_shortname,
       min(n_name) as host_ui_longname,
       case when n_nationkey % 4 < 2 then 'exp' || cast(n_nationkey % 4 as varchar(10)) end as host_db_export_name
from {nation} group by n_nationkey % 4
""",
    "ev": """
select cast(user_id % 4 + 1 as int) as host_id, user_id, event_type, value,
       date_trunc('hour', ts) + cast(floor(extract(minute from ts) / 15) as int) * interval '15' minute as t15,
       date_trunc('hour', ts) as t60, ts,
       case event_type when 'click' then 1 when 'error' then 2 when 'purchase' then 3 when 'signup' then 4 else 5 end as idx,
       case when ts < timestamp '2024-01-15 00:00:00' then 1 else 3 end as rel,
       case when ts < timestamp '2024-01-17 00:00:00' then 0 else 1 end as reset_epoch
from {events}
""",
    "sprocs": """
select distinct cast(host_id * 100 + rel * 10 + idx as int) as sproc_id, host_id as sproc_host_id,
       'shop_api_r24_00_0' || cast(rel as varchar(10)) as sproc_schema, event_type || '(i integer, i text)' as sproc_name
from {ev}
""",
    "sproc_performance_data": """
select t15 as sp_timestamp, host_id as sp_host_id, sproc_id as sp_sproc_id,
       cast(sum(c) over w as bigint) as sp_calls, cast(sum(tot) over w as bigint) as sp_total_time,
       cast(sum(slf) over w as bigint) as sp_self_time
from (select t15, host_id, cast(host_id * 100 + rel * 10 + idx as int) as sproc_id, reset_epoch, count(*) as c,
             sum(cast(round(value * 1000) as bigint)) as tot, sum(cast(round(value * 600) as bigint)) as slf
      from {ev} group by t15, host_id, rel, idx, reset_epoch) a
window w as (partition by sproc_id, reset_epoch order by t15 rows between unbounded preceding and current row)
""",
    "tables": """
select distinct cast(host_id * 10 + user_id as int) as t_id, host_id as t_host_id,
       case when user_id = 4 then 'tmp_x' else 'data_' || cast(user_id % 2 as varchar(10)) end as t_schema,
       'table_' || cast(user_id as varchar(10)) as t_name
from (select host_id, user_id % 5 as user_id from {ev}) e
""",
    "table_size_data": """
select t60 as tsd_timestamp, host_id as tsd_host_id, t_id as tsd_table_id,
       cast(10000000 + sum(v) over wa as bigint) as tsd_table_size, cast(2000000 + sum(v) over wa as bigint) as tsd_index_size,
       cast(sum(c) over w as bigint) as tsd_seq_scans, cast(4 * sum(c) over w as bigint) as tsd_index_scans,
       cast(sum(ci) over w as bigint) as tsd_tup_ins, cast(sum(cu) over w as bigint) as tsd_tup_upd,
       cast(sum(cd) over w as bigint) as tsd_tup_del, cast(sum(ch) over w as bigint) as tsd_tup_hot_upd
from (select t60, host_id, cast(host_id * 10 + user_id % 5 as int) as t_id, reset_epoch, count(*) as c,
             sum(cast(round(value * 100000) as bigint)) as v,
             sum(case when idx = 3 then 1 else 0 end) as ci, sum(case when idx = 5 then 1 else 0 end) as cu,
             sum(case when idx = 2 then 1 else 0 end) as cd, sum(case when idx = 1 then 1 else 0 end) as ch
      from {ev} group by t60, host_id, user_id % 5, reset_epoch) a
window w as (partition by t_id, reset_epoch order by t60 rows between unbounded preceding and current row),
       wa as (partition by t_id order by t60 rows between unbounded preceding and current row)
""",
    "table_io_data": """
select tsd_timestamp as tio_timestamp, tsd_host_id as tio_host_id, tsd_table_id as tio_table_id,
       tsd_tup_ins * 2 as tio_heap_read, tsd_seq_scans * 10 as tio_heap_hit, tsd_tup_del * 2 as tio_idx_read,
       tsd_index_scans * 10 as tio_idx_hit
from {table_size_data}
""",
    "indexes": """
select t_id * 10 + k as i_id, t_host_id as i_host_id, t_schema as i_schema, t_name as i_table_name,
       t_name || '_idx' || cast(k as varchar(10)) as i_name
from (select t_id, t_host_id, t_schema, t_name, 1 as k from {tables}
      union all select t_id, t_host_id, t_schema, t_name, 2 as k from {tables}) x
""",
    "index_usage_data": """
select tsd_timestamp as iud_timestamp, tsd_host_id as iud_host_id, tsd_table_id * 10 + k as iud_index_id,
       tsd_index_scans * k as iud_scan, tsd_index_scans * 3 as iud_tup_read, tsd_index_scans * 2 as iud_tup_fetch,
       tsd_index_size * k as iud_size
from (select *, 1 as k from {table_size_data} union all select *, 2 as k from {table_size_data}) x
""",
    "schema_usage_data": """
select date_trunc('day', tsd_timestamp) + interval '23' hour as sud_timestamp, tsd_host_id as sud_host_id, t_schema as sud_schema_name,
       cast(max(tsd_seq_scans) as bigint) as sud_sproc_calls, cast(max(tsd_seq_scans) as bigint) as sud_seq_scans,
       cast(max(tsd_index_scans) as bigint) as sud_idx_scans, cast(max(tsd_tup_ins) as bigint) as sud_tup_ins,
       cast(max(tsd_tup_upd) as bigint) as sud_tup_upd, cast(max(tsd_tup_del) as bigint) as sud_tup_del
from {table_size_data} join {tables} on t_id = tsd_table_id
group by date_trunc('day', tsd_timestamp), tsd_host_id, t_schema
union all
select distinct date_trunc('day', tsd_timestamp) + interval '23' hour, tsd_host_id, 'idle_api', cast(5 as bigint),
       cast(0 as bigint), cast(0 as bigint), cast(1 as bigint), cast(1 as bigint), cast(0 as bigint)
from {table_size_data}
""",
    "stat_statements_data": """
select t60 as ssd_timestamp, host_id as ssd_host_id,
       case when qid % 7 = 0 then 'COPY t' else 'SELECT   *  FROM t' end || cast(qid as varchar(10))
            || ' WHERE some_rather_long_predicate_column = ?' as ssd_query,
       cast(qid as bigint) as ssd_query_id, cast(sum(c) over w as bigint) as ssd_calls, cast(sum(tot) over w as bigint) as ssd_total_time,
       cast(sum(c) over w as bigint) * 3 as ssd_blks_read, cast(sum(c) over w as bigint) * 2 as ssd_blks_written,
       cast(sum(c) over w as bigint) as ssd_temp_blks_read, cast(sum(c) over w as bigint) as ssd_temp_blks_written
from (select t60, host_id, user_id % 30 as qid, count(*) as c, sum(cast(round(value * 1000) as bigint)) as tot
      from {ev} group by t60, host_id, user_id % 30) a
window w as (partition by host_id, qid order by t60 rows between unbounded preceding and current row)
""",
    "stat_database_data": """
select t60 as sdd_timestamp, host_id as sdd_host_id, cast(c as int) as sdd_numbackends,
       cast(sum(c) over w as bigint) as sdd_xact_commit, cast(sum(e) over w as bigint) as sdd_xact_rollback,
       cast(sum(c) over w as bigint) * 2 as sdd_blks_read, cast(sum(c) over w as bigint) * 30 as sdd_blks_hit,
       cast(sum(e) over w as bigint) as sdd_temp_files, cast(sum(v) over w as bigint) as sdd_temp_bytes,
       cast(sum(e) over w as bigint) as sdd_deadlocks, cast(sum(c) over w as bigint) * 5 as sdd_blk_read_time,
       cast(sum(c) over w as bigint) as sdd_blk_write_time
from (select t60, host_id, reset_epoch, count(*) as c, sum(case when idx = 2 then 1 else 0 end) as e,
             sum(cast(round(value * 100) as bigint)) as v
      from {ev} group by t60, host_id, reset_epoch) a
window w as (partition by host_id, reset_epoch order by t60 rows between unbounded preceding and current row)
""",
    "stat_bgwriter_data": """
select sdd_timestamp as sbd_timestamp, sdd_host_id as sbd_host_id, sdd_xact_commit as sbd_checkpoints_timed,
       sdd_deadlocks as sbd_checkpoints_req, sdd_blks_hit as sbd_buffers_checkpoint, sdd_blks_read as sbd_buffers_clean,
       sdd_xact_rollback as sbd_buffers_backend, sdd_blk_read_time as sbd_buffers_alloc
from {stat_database_data}
""",
    "host_load": """
select t15 as load_timestamp, host_id as load_host_id, cast(c * 100 as int) as load_1min_value,
       cast(c * 90 as int) as load_5min_value, cast(c * 80 as int) as load_15min_value,
       cast(sum(v) over w as bigint) as xlog_location_mb
from (select t15, host_id, count(*) as c, sum(cast(round(value * 10) as bigint)) as v from {ev} group by t15, host_id) a
window w as (partition by host_id order by t15 rows between unbounded preceding and current row)
""",
    "blocking_locks": """
select cast(l_suppkey % 4 + 1 as int) as bl_host_id, cast(l_shipdate + l_linenumber * interval '1' second as timestamp) as bl_timestamp,
       'relation' as locktype, 1 as database, cast(l_partkey % 3 as int) as relation, cast(null as varchar(20)) as virtualxid,
       case when l_linenumber = 1 then cast(l_orderkey % 50 as varchar(20)) end as transactionid,
       cast(null as int) as classid, cast(null as int) as objid, cast(null as int) as objsubid,
       cast(l_suppkey % 20 as int) as pid, max(l_returnflag <> 'A') as granted
from {lineitem}
group by 1, 2, 4, 5, 7, 11
""",
    "blocking_processes": """
select distinct bl_host_id as bp_host_id, bl_timestamp as bp_timestamp, pid, date_trunc('day', bl_timestamp) as query_start,
       not granted as waiting, 'query of ' || cast(pid as varchar(10)) as query
from {blocking_locks}
""",
    # catalog snapshots: one index per part, one column statistic per customer
    "index_catalog": """
select cast(p_partkey % 4 + 1 as int) as host_id, 's' || cast(p_size % 3 as varchar(10)) as schema_name, lower(replace(p_brand, '#', '_')) as table_name,
       'idx_' || cast(p_partkey as varchar(20)) as index_name,
       'CREATE ' || case when p_partkey % 5 = 0 then 'UNIQUE ' else '' end || 'INDEX idx_' || cast(p_partkey as varchar(20))
         || ' ON s' || cast(p_size % 3 as varchar(10)) || '.' || lower(replace(p_brand, '#', '_')) || ' USING btree (' || lower(replace(p_type, ' ', '_')) || ')' as index_def,
       cast(round(p_retailprice * 200000) as bigint) as index_size, cast(p_size * 10000000 as bigint) as table_size, cast(p_size % 12 as bigint) as scans,
       p_partkey % 5 = 0 as is_unique, p_partkey % 7 <> 0 as is_valid
from {part}
""",
    "column_stats": """
select 's' || cast(c_nationkey % 3 as varchar(10)) as schema_name, 'rel_' || cast(c_custkey % 211 as varchar(10)) as table_name,
       c_name as column_name, cast(c_custkey % 10 as double) / 10 as null_frac, cast(10 + c_custkey % 150 as int) as avg_width,
       case when c_custkey % 3 = 0 then -1 when c_custkey % 7 = 0 then -2 else 8 end as typlen, c_custkey % 997 = 0 as is_name_type
from {customer}
""",
    "relation_pages": """
select schema_name, table_name, cast(sum(avg_width) * 100 as bigint) as reltuples, cast(sum(avg_width) * 3 as bigint) as relpages,
       cast(max(avg_width) as bigint) as toastpages, cast(min(avg_width) * 4 as bigint) as toasttuples, cast(count(*) as bigint) as toast_index_pages, false as has_oids
from {column_stats} group by schema_name, table_name
""",
    "index_pages": """
select schema_name, table_name, table_name || '_pk' as index_name, cast(sum(avg_width) * 100 as bigint) as reltuples,
       cast(sum(avg_width) as bigint) as relpages, cast(70 + count(*) % 30 as int) as fillfactor, true as is_btree
from {column_stats} group by schema_name, table_name
""",
    "host_settings": """
select cast(c_custkey as int) as host_id,
       '{{' || chr(10) || '"loadGatherInterval": ' || cast(c_custkey % 3 as varchar(10)) || ',' || chr(10)
         || '"statDatabaseGatherInterval": ' || cast(c_nationkey % 2 as varchar(10)) || chr(10) || '}}' as settings
from {customer}
""",
}

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages",
)


def references(text: str, names) -> list[str]:
    return [n for n in names if "{" + n + "}" in text]


def with_dependencies(names) -> list[str]:
    """Adapter names in build order, each after the views it reads."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in references(ADAPTERS[name], ADAPTERS):
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        visit(n)
    return ordered
