"""Statement queries and their oracles."""

from __future__ import annotations

from counterloom.plans import statements as P

from .harness import pretty_ms, r0, rn

S1, S2 = "2023-12-31 00:00:00", "2024-01-15 00:00:00"

QUERIES = {
    "top_statements": lambda f: P.top_statements(f, S1, S2, limit=5),
    "statement_report": lambda f: P.statement_report(f, order="total_time", limit=10),
    "statement_report_all": lambda f: P.statement_report(f, limit=None, no_copy_ddl=False, min_calls=0),
    "statement_series": lambda f: P.statement_series(f),
    "statement_heavy_hitters": lambda f: P.statement_heavy_hitters(f.table("stat_statements_data"), 3),
    "statement_ranges": lambda f: P.statement_ranges(f.table("stat_statements_data")),
}

_RANGES = ", ".join(f"max(ssd_{c}) - min(ssd_{c}) as {c}" for c in ("calls", "total_time", "blks_read", "blks_written", "temp_blks_read", "temp_blks_written"))


def _span(name: str, since: str) -> str:
    return f"""{name} as (select '{name}' as span, host_id, query_id, query, max(c) - min(c) as calls, max(t) - min(t) as total_ms from q where ts > timestamp '{since}' group by 2, 3, 4)"""


def _mode(order: str) -> str:
    return f"select '{order}' as o, *, row_number() over (partition by host_id, span order by {dict(calls='calls', avg='avg_ms', total='total_ms')[order]} desc, query_id, query) as k from a"


def _report(where: str, min_calls: int) -> str:
    return f"""with g as (select ssd_host_id, ssd_query_id as query_id, max(ssd_query) as q, {_RANGES} from stat_statements_data where {where} group by 1, 2),
r as (select *, {r0('(cast(total_time as double) / nullif(calls, 0))')} as avg_runtime_ms, row_number() over (partition by ssd_host_id order by total_time desc, query_id) as k from g where calls >= {min_calls}),
rep as (select host_ui_shortname, ltrim(regexp_replace(q, '[ \\t\\r]+', ' ', 'g')) as query, query_id, calls, total_time, blks_read, blks_written, temp_blks_read, temp_blks_written, avg_runtime_ms, k
  from r join hosts on host_id = ssd_host_id)"""


_HIT_COLS = ("calls", "total_time", "blks_read", "blks_written", "temp_blks_read", "temp_blks_written")

ORACLE = {
    "top_statements": f"""with n as (select ssd_host_id as host_id, ssd_query_id as query_id, ssd_timestamp as ts, ssd_calls as c, ssd_total_time as t,
  lower(ltrim(regexp_replace(ssd_query, '[ \\t\\n\\r]+', ' ', 'g'))) as full_q from stat_statements_data),
q as (select *, case when length(full_q) > 55 then substr(full_q, 1, 55) || '..' else full_q end as query from n),
{_span('int1', S1)}, {_span('int2', S2)},
a as (select *, {rn('(cast(total_ms as double) / nullif(calls, 0))', 3)} as avg_ms from (select * from int1 union all select * from int2) u where calls > 0 and total_ms > 0),
m as ({_mode('calls')} union all {_mode('avg')} union all {_mode('total')})
select host_id, o || '_' || span as mode, query, query_id, calls, total_ms, avg_ms, {pretty_ms('avg_ms')} as avg_time_pretty, {pretty_ms('total_ms')} as total_time_pretty from m where k <= 5""",
    "statement_report": _report("not (upper(ssd_query) like 'COPY%' or upper(ssd_query) like 'CREATE%')", 3) + " select * exclude (k) from rep where k <= 10",
    "statement_report_all": _report("true", 0) + " select * exclude (k) from rep",
    "statement_series": f"""with d as (select ssd_host_id as host_id, ssd_query_id as query_id, ssd_timestamp as ts, lag(ssd_timestamp) over w as prev,
  {', '.join(f'ssd_{c} - lag(ssd_{c}) over w as {c}' for c in _HIT_COLS)} from stat_statements_data window w as (partition by ssd_host_id, ssd_query_id order by ssd_timestamp))
select * exclude (prev), case when calls > 0 then {rn('(cast(total_time as double) / nullif(calls, 0))', 2)} else 0 end as avg_runtime from d where prev is not null""",
    "statement_heavy_hitters": f"""with s as (select ssd_host_id, ssd_timestamp, ssd_query, {', '.join(f'cast(sum(ssd_{c}) as bigint) as {c}' for c in _HIT_COLS)} from stat_statements_data
  where ssd_calls > 1 and ssd_total_time > 0 group by 1, 2, 3),
k as (select *, {', '.join(f'row_number() over (partition by ssd_host_id, ssd_timestamp order by {c} desc, ssd_query) as k{i}' for i, c in enumerate(_HIT_COLS))} from s)
select * exclude (k0, k1, k2, k3, k4, k5) from k where k0 <= 3 {' '.join(f'or ({c} > 0 and k{i} <= 3)' for i, c in enumerate(_HIT_COLS) if i)}""",
    "statement_ranges": f"select ssd_host_id, ssd_query_id, {', '.join(f'max(ssd_{c}) - min(ssd_{c}) as d_ssd_{c}' for c in _HIT_COLS)} from stat_statements_data group by 1, 2",
}
