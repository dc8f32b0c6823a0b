"""Table, index and schema queries and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from counterloom.plans import tables as P

from .harness import big, pretty_count, pretty_size, r0, rn

LIMITS = P.TableThresholds(min_table_size=10_000_000, min_scans=5)
CUSTOM = "host_id int, schema_name string, table_name string, seq_scan_pct double, size_growth_pct double, min_scans bigint, size_growth bigint"


def _regressions(f):
    s = f.spark
    return P.table_regressions(
        f, defaults=LIMITS, custom=s.createDataFrame([(1, "data_1", "table_1", 10.0, None, 1, 1000)], CUSTOM),
        ignored_schemas=s.createDataFrame([("tmp%",)], "pattern string"),
        ignored_tables=s.createDataFrame([("data_0", "table_0")], "schema_name string, table_name string"),
    )


def _rollup(f):
    calls = f.table("sproc_performance_data").groupBy("sp_sproc_id").agg(F.max("sp_calls").alias("calls"))
    procs = calls.join(f.table("sprocs"), F.col("sp_sproc_id") == F.col("sproc_id")).select(
        F.col("sproc_host_id").alias("host_id"), F.col("sproc_schema").alias("schema_name"), "calls"
    )
    names = {"tsd_seq_scans": "seq_scan", "tsd_index_scans": "idx_scan", "tsd_tup_ins": "n_tup_ins", "tsd_tup_upd": "n_tup_upd", "tsd_tup_del": "n_tup_del"}
    peak = f.table("table_size_data").groupBy("tsd_table_id").agg(*(F.max(c).alias(n) for c, n in names.items()))
    tabs = peak.join(f.table("tables"), F.col("tsd_table_id") == F.col("t_id")).select(
        F.col("t_host_id").alias("host_id"), F.col("t_schema").alias("schema_name"), *names.values()
    )
    return P.schema_rollup(procs, tabs)


def _joined(df, col):
    return df.withColumn(col, F.array_join(F.col(col).cast("array<string>"), ","))


D1, D2 = "2024-01-01 00:00:00", "2024-01-02 23:59:59"

QUERIES = {
    "table_series": lambda f: P.table_series(f),
    "table_io_series": lambda f: P.table_io_series(f),
    "top_tables": lambda f: P.top_tables(f, limit=None),
    **{f"top_tables_order_{n}": (lambda f, n=n: P.top_tables(f, order=n, limit=5, pattern="TABLE")) for n in range(1, 13)},
    "top_tables_pretty": lambda f: P.top_tables_pretty(P.top_tables(f, limit=None)),
    "table_totals": lambda f: P.table_totals(P.top_tables(f, limit=None)),
    "table_regressions": lambda f: _regressions(f),
    "index_series": lambda f: P.index_series(f),
    "unused_indexes": lambda f: P.unused_indexes(f.table("index_catalog")),
    "invalid_indexes": lambda f: P.invalid_indexes(f.table("index_catalog")),
    "duplicate_indexes": lambda f: P.duplicate_indexes(f.table("index_catalog")),
    "duplicate_index_lists": lambda f: P.duplicate_index_lists(f.table("index_catalog")),
    "table_bloat": lambda f: P.table_bloat(f.table("column_stats"), f.table("relation_pages"), limit=50),
    "table_bloat_by_ratio": lambda f: P.table_bloat(f.table("column_stats"), f.table("relation_pages"), True, None),
    "index_bloat": lambda f: P.index_bloat(f.table("column_stats"), f.table("index_pages"), limit=50),
    "index_bloat_by_ratio": lambda f: P.index_bloat(f.table("column_stats"), f.table("index_pages"), True, None),
    "relation_sizes": lambda f: P.relation_sizes(f.table("relation_pages"), f.table("index_pages")),
    "unused_schemas": lambda f: P.unused_schemas(f, "2024-01-01 00:00:00", "2024-02-01 00:00:00"),
    "unused_schemas_two_days": lambda f: P.unused_schemas(f, D1, D2, text="api"),
    "drop_statements": lambda f: P.drop_statements(P.unused_schemas(f, "2024-01-01 00:00:00", "2024-02-01 00:00:00")),
    "schema_usage": lambda f: _joined(P.schema_usage(f), "daily_counts"),
    "schema_rollup": lambda f: _rollup(f),
}

_COLS = ("table_size", "index_size", "seq_scans", "tup_ins", "tup_upd", "tup_del")
_TOP = f"""with e as (select tsd_host_id as h, min(tsd_timestamp) as mi, max(tsd_timestamp) as ma from table_size_data group by 1),
a as (select tsd_table_id as id, {', '.join(f'tsd_{c} as a_{c}' for c in _COLS)} from table_size_data join e on h = tsd_host_id and tsd_timestamp = mi),
z as (select tsd_host_id as host_id, tsd_table_id as id, {', '.join(f'tsd_{c} as z_{c}' for c in _COLS)} from table_size_data join e on h = tsd_host_id and tsd_timestamp = ma),
j as (select host_id, t_schema as schema, t_name as name, {', '.join(f'z_{c}, coalesce(a_{c}, 0) as a_{c}' for c in _COLS)} from z left join a using (id) join tables on t_id = z.id),
rep as (select host_id, schema, name, z_table_size as table_size, a_table_size as min_table_size, z_table_size - a_table_size as table_size_delta,
  z_index_size as index_size, a_index_size as min_index_size, z_index_size - a_index_size as index_size_delta,
  z_tup_ins + z_tup_upd + z_tup_del - a_tup_ins - a_tup_upd - a_tup_del as iud_delta, z_seq_scans - a_seq_scans as s_delta,
  z_tup_ins - a_tup_ins as i_delta, z_tup_upd - a_tup_upd as u_delta, z_tup_del - a_tup_del as d_delta from j)"""
_ORDERS = ("schema asc", "table_size desc", "table_size_delta desc", "case when min_table_size > 0 then table_size / min_table_size else 0 end desc",
           "index_size desc", "index_size_delta desc", "case when min_index_size > 0 then index_size / min_index_size else 0 end desc",
           "iud_delta desc", "s_delta desc", "i_delta desc", "u_delta desc", "d_delta desc")


def _top_order(n: int) -> str:
    first = "schema, name" if n == 1 else _ORDERS[n - 1]
    return _TOP + f" select * from rep where name ilike '%TABLE%' order by {first}, host_id, schema, name limit 5"


def _pct(a: str, b: str) -> str:
    return f"case when {a} = 0 then 0 else {rn(f'(cast(({b} - {a}) * 100 as double) / nullif({a}, 0))', 2)} end"


def _growth(c: str) -> str:
    return f"case when min_{c} > 0 then {rn(f'((cast({c} as double) / nullif(min_{c}, 0) - 1.0) * 100.0)', 1)} else 0 end"


def _unused(start: str, end: str, text: str = "") -> str:
    return f"""with f as (select * from schema_usage_data where sud_timestamp between timestamp '{start}' and timestamp '{end}' and sud_schema_name like '%{text}%'),
mm as (select sud_host_id as h, sud_schema_name as s, min(sud_timestamp) as min, max(sud_timestamp) as max from f group by 1, 2),
d as (select sud_host_id as h, sud_schema_name as s, sud_timestamp as ts, sud_sproc_calls + sud_tup_ins + sud_tup_upd + sud_tup_del as n from f
  where sud_schema_name not like 'pg\\_%' escape '\\' and sud_schema_name not like '%\\_data' escape '\\' and sud_schema_name not in ('public', '_v')
  qualify row_number() over (partition by h, s, date_trunc('day', sud_timestamp) order by sud_timestamp desc) = 1),
l as (select *, lag(n) over (partition by h, s order by ts) as p from d),
u as (select h, s from l group by 1, 2 having bool_and(p is null or p >= n)),
unused as (select host_name, host_db, host_id, host_ui_shortname, u.s as schema_name, min, max from u join mm on mm.h = u.h and mm.s = u.s join hosts on host_id = u.h where host_enabled)"""


def _catalog(where: str) -> str:
    return f"""with c as (select *, {big('sum(index_size) over (partition by host_id, schema_name, table_name)')} as sp from index_catalog),
m as (select *, {big('sum(index_size) over ()')} as tot from c where {where})
select host_id, schema_name || '.' || table_name as table_full_name, schema_name || '.' || index_name as index_full_name, index_size as index_size_bytes, sp as indexes_size_bytes, scans,
  {pretty_size('index_size')} as index_size, {pretty_size('table_size')} as table_size,
  case when sp = 0 then 0 else {rn('(cast(index_size * 100 as double) / nullif(sp, 0))', 1)} end as pct_of_tables_index_space, tot as total_marked_index_size_bytes, {pretty_size('tot')} as total_marked_index_size from m"""


_DUP = """with v as (select *, regexp_replace(replace(index_def, index_name, 'X'), '^CREATE UNIQUE', 'CREATE') as group_def from index_catalog where is_valid),
g as (select *, count(*) over (partition by host_id, group_def) as count from v)"""

_KEPT = r0("((1.0 - coalesce(null_frac, 0.0)) * 1000000.0)")


def _pad(x: str, whole: str) -> str:
    return f"(8 - case when {whole} % 8 = 0 then 8 else {whole} % 8 end)"


_BLOAT = f"""with s as (select schema_name, table_name, count(*) as n, max(null_frac) as mx,
  cast(sum({_KEPT} * case when typlen = -1 and avg_width < 127 then avg_width + 1 when typlen = -1 then avg_width + 4 when typlen = -2 then avg_width + 1 else typlen end) as bigint) / 1000000.0 as data, bool_or(is_name_type) as na
  from column_stats group by 1, 2),
h as (select *, 23 + case when mx > 0 then (n + 7) // 8 else 0 end as hdr from s join relation_pages using (schema_name, table_name) where not na),
t as (select *, 4 + hdr + data + {_pad('hdr', 'hdr')} + {_pad('data', 'cast(ceil(data) as bigint)')} as tpl from h),
p as (select schema_name, table_name, relpages + toastpages as total, relpages + toastpages - cast(ceil(reltuples / (cast(8168 as double) / tpl)) + ceil(toasttuples / 4) as bigint) as extra from t),
rep as (select schema_name, table_name, case when extra > 0 then {rn('(cast(extra * 100 as double) / total)', 1)} else 0 end as bloat_factor, extra * 8192 as wasted_bytes, {pretty_size('(extra * 8192)')} as wasted_bytes_pretty from p)"""
_IBLOAT = f"""with s as (select schema_name, table_name, max(null_frac) as mx, cast(sum({_KEPT} * avg_width) as bigint) / 1000000.0 as data, bool_or(is_name_type) as na from column_stats group by 1, 2),
h as (select *, case when mx = 0 then 2 else 6 end as hdr from s join index_pages using (schema_name, table_name) where not na and is_btree and relpages > 0),
t as (select *, hdr + {_pad('hdr', 'hdr')} + data + case when data = 0 then 8 else {_pad('data', r0('data'))} end as entry from h),
p as (select schema_name, table_name, index_name, relpages, relpages - coalesce(1 + cast(ceil(cast(reltuples as double) / floor(cast(8152 as double) * fillfactor / (100.0 * (4 + entry)))) as bigint), 0) as extra from t),
rep as (select schema_name, table_name, index_name, {rn('(cast(extra * 100 as double) / relpages)', 1)} as bloat_factor, extra * 8192 as wasted_bytes, {pretty_size('(extra * 8192)')} as wasted_bytes_pretty from p)"""

_SER = "schema || '.' || name"

ORACLE = {
    "table_series": """with d as (select tsd_host_id as host_id, t_schema || '.' || t_name as name, tsd_timestamp as ts, tsd_table_size as table_size, tsd_index_size as index_size,
  tsd_seq_scans - lag(tsd_seq_scans) over w as seq_scans, tsd_index_scans - lag(tsd_index_scans) over w as index_scans,
  case when lag(tsd_tup_ins) over w <> 0 then tsd_tup_ins - lag(tsd_tup_ins) over w end as ins, case when lag(tsd_tup_upd) over w <> 0 then tsd_tup_upd - lag(tsd_tup_upd) over w end as upd,
  case when lag(tsd_tup_del) over w <> 0 then tsd_tup_del - lag(tsd_tup_del) over w end as del, case when lag(tsd_tup_hot_upd) over w <> 0 then tsd_tup_hot_upd - lag(tsd_tup_hot_upd) over w end as hot
  from table_size_data join tables on t_id = tsd_table_id window w as (partition by tsd_table_id order by tsd_timestamp))
unpivot d on table_size, index_size, seq_scans, index_scans, ins, upd, del, hot into name series value value""",
    "table_io_series": """with d as (select tio_host_id as host_id, t_schema || '.' || t_name as name, tio_timestamp as ts, tio_heap_read - lag(tio_heap_read) over w as heap_read,
  tio_heap_hit - lag(tio_heap_hit) over w as heap_hit, tio_idx_read - lag(tio_idx_read) over w as index_read, tio_idx_hit - lag(tio_idx_hit) over w as index_hit
  from table_io_data join tables on t_id = tio_table_id window w as (partition by tio_table_id order by tio_timestamp))
unpivot d on heap_read, heap_hit, index_read, index_hit into name series value value""",
    "top_tables": _TOP + " select * from rep",
    **{f"top_tables_order_{n}": _top_order(n) for n in range(1, 13)},
    "top_tables_pretty": _TOP + f""" select host_id, schema, name, {', '.join(f'{pretty_size(c)} as {c}' for c in ('table_size', 'index_size', 'table_size_delta', 'index_size_delta'))},
  {_growth('table_size')} as growth, {_growth('index_size')} as growth_index, {', '.join(f'{pretty_count(c)} as {c}' for c in ('iud_delta', 's_delta', 'i_delta', 'u_delta', 'd_delta'))} from rep""",
    "table_totals": _TOP + f", s as (select {big('sum(table_size)')} as t, {big('sum(index_size)')} as i from rep) select {pretty_size('t')} as total_size, {pretty_size('i')} as total_index_size from s",
    "table_regressions": f"""with a as (select date_trunc('day', tsd_timestamp) as day, host_id, host_ui_shortname, t_schema as schema_name, t_name as table_name, max(tsd_seq_scans) - min(tsd_seq_scans) as scans2, max(tsd_table_size) as size2
  from table_size_data join tables on t_id = tsd_table_id join hosts on host_id = t_host_id where host_enabled and t_schema not like 'tmp%' and not (t_schema = 'data_0' and t_name = 'table_0') group by 1, 2, 3, 4, 5),
b as (select *, lag(scans2) over w as scans1, lag(size2) over w as size1 from a window w as (partition by host_id, schema_name, table_name order by day)),
c as (select *, {_pct('scans1', 'scans2')} as scan_change_pct, {_pct('size1', 'size2')} as size_change_pct, host_id = 1 and schema_name = 'data_1' and table_name = 'table_1' as own from b where scans1 is not null)
select host_ui_shortname, schema_name, table_name, day, scan_change_pct, scans1, scans2, {pretty_size('size1')} as size1, {pretty_size('size2')} as size2, size_change_pct, cast(case when own then 10.0 else 50.0 end as double) as allowed_seq_scan_pct
from c where size2 >= 10000000 and scans2 >= case when own then 1 else 5 end
  and (scan_change_pct >= case when own then 10 else 50 end or size_change_pct >= 10 or (own and size2 - size1 > 1000))""",
    "index_series": f"""with u as (select * from index_usage_data join indexes on i_id = iud_index_id),
e as (select i_host_id as h, i_schema as s, i_table_name as t, iud_timestamp as ts, sum(iud_size) as b from u group by 1, 2, 3, 4 qualify row_number() over (partition by h, s, t order by ts desc) = 1),
d as (select *, lag(iud_timestamp) over w as prev, greatest(iud_scan - lag(iud_scan) over w, 0) as sc, greatest(iud_tup_read - lag(iud_tup_read) over w, 0) as tr from u window w as (partition by iud_index_id order by iud_timestamp))
select iud_host_id as host_id, i_schema || '.' || i_table_name as table_name, i_name as index_name, iud_timestamp as ts, iud_size as size, sc as scan, tr as tup_read, {big('b')} as total_end_size,
  {rn('(cast(iud_size * 100 as double) / b)', 1)} as pct_of_total_end_size from d join e on h = i_host_id and s = i_schema and t = i_table_name where prev is not null""",
    "unused_indexes": _catalog("not is_unique and index_size > 100000000 and scans <= 5 and schema_name not like 'tmp%' and schema_name not like 'temp%'"),
    "invalid_indexes": _catalog("not is_valid"),
    "duplicate_indexes": _DUP + f" select host_id, schema_name, schema_name || '.' || table_name as table_full_name, index_name, group_def, count, table_size as table_size_bytes, {pretty_size('table_size')} as table_size from g where count > 1",
    "duplicate_index_lists": _DUP + " select host_id, group_def, count, cast(row_number() over (partition by host_id, group_def order by index_name, schema_name || '.' || table_name) as int) as position, index_name, table_size as table_size_bytes from g where count > 1",
    "table_bloat": _BLOAT + " select * from rep order by wasted_bytes desc, schema_name, table_name limit 50",
    "table_bloat_by_ratio": _BLOAT + " select * from rep",
    "index_bloat": _IBLOAT + " select * from rep order by wasted_bytes desc, schema_name, table_name, index_name limit 50",
    "index_bloat_by_ratio": _IBLOAT + " select * from rep",
    "relation_sizes": "select r.schema_name, r.table_name, (r.relpages + toastpages + toast_index_pages) * 8192 as table_size, coalesce(i.relpages, 0) * 8192 as index_size from relation_pages r left join index_pages i on i.schema_name = r.schema_name and i.table_name = r.table_name",
    "unused_schemas": _unused("2024-01-01 00:00:00", "2024-02-01 00:00:00") + " select * from unused",
    "unused_schemas_two_days": _unused(D1, D2, "api") + " select * from unused",
    "drop_statements": _unused("2024-01-01 00:00:00", "2024-02-01 00:00:00") + """, n as (select distinct host_db, schema_name from unused)
select 0 as section, '' as host_db, unnest([1, 2]) as line_no, unnest(['do $$', 'begin']) as line
union all select 2, '', unnest([1, 2]), unnest(['end;', '$$;'])
union all select 1, host_db, 1, '  if current_database() = ''' || host_db || ''' then' from n group by host_db
union all select 1, host_db, cast(1 + row_number() over (partition by host_db order by schema_name) as int), '    execute ''drop schema if exists ' || schema_name || ' cascade'';' from n
union all select 1, host_db, cast(count(*) + 2 as int), '  end if;' from n group by host_db""",
    "schema_usage": """select sud_host_id as host_id, sud_schema_name as schema_name, date_trunc('day', sud_timestamp) as day,
  concat_ws(',', max(sud_sproc_calls) - min(sud_sproc_calls), max(sud_seq_scans) + max(sud_idx_scans) - min(sud_seq_scans) - min(sud_idx_scans), max(sud_tup_ins) - min(sud_tup_ins),
  max(sud_tup_upd) - min(sud_tup_upd), max(sud_tup_del) - min(sud_tup_del)) as daily_counts from schema_usage_data group by 1, 2, 3""",
    "schema_rollup": f"""with p as (select sproc_host_id as host_id, sproc_schema as schema_name, {big('sum(c)')} as n from (select sp_sproc_id, max(sp_calls) as c from sproc_performance_data group by 1) x join sprocs on sproc_id = sp_sproc_id group by 1, 2),
t as (select t_host_id as host_id, t_schema as schema_name, {', '.join(f'{big(f"sum({c})")} as {c}' for c in 'abcde')} from (select tsd_table_id, max(tsd_seq_scans) as a, max(tsd_index_scans) as b, max(tsd_tup_ins) as c, max(tsd_tup_upd) as d, max(tsd_tup_del) as e from table_size_data group by 1) y join tables on t_id = tsd_table_id group by 1, 2)
select host_id, schema_name, coalesce(a, 0) as seq_scan, coalesce(b, 0) as idx_scan, coalesce(c, 0) as n_tup_ins, coalesce(d, 0) as n_tup_upd, coalesce(e, 0) as n_tup_del, coalesce(n, 0) as sproc_calls from t full join p using (host_id, schema_name)""",
}
