"""Host overview queries and their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from counterloom.plans import aggregates as A
from counterloom.plans import hosts as P
from counterloom.schema import Reset
from counterloom.session import shared_dir
from counterloom.sources.fleet import Fleet
from counterloom.sources.versions import VersionedTable

from .harness import big, pretty_size, r0, rn, secs

START, END, AS_OF = "2023-12-31 00:00:00", "2024-02-01 00:00:00", "2024-01-31 00:00:00"
LOCK_START, LOCK_END = "1994-12-31 00:00:00", "2002-12-31 00:00:00"


def stored_load(fleet: Fleet):
    return A.aggregate_sproc_load(fleet, AS_OF, START)


def stored_size(fleet: Fleet):
    return A.aggregate_table_size(fleet, AS_OF, START)


def groups(fleet: Fleet):
    return fleet.table("region").select(F.col("r_regionkey").alias("group_id"), F.col("r_name").alias("group_name"))


def announcements(fleet: Fleet):
    o = fleet.table("orders")
    return o.select(
        F.col("o_orderdate").cast("timestamp").alias("valid_from"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("interval 1 day")).alias("valid_to"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("announcement"),
    )


def _updated_load(f: Fleet):
    """Refresh on top of an aggregate stored on 2024-01-20."""
    return _load_in_steps(f, "2024-01-20 00:00:00")


def _load_in_steps(f: Fleet, cut: str):
    old = A.aggregate_sproc_load(f, cut, START)
    return old.unionByName(A.aggregate_sproc_load(f, AS_OF, START, old))


def stored_table(f: Fleet) -> VersionedTable:
    return VersionedTable(f.spark, f"{shared_dir(f.spark)}/stored-{uuid.uuid4().hex}")


def _refreshed_load(f: Fleet, *runs: str):
    """Refreshes of a stored aggregate, each reading from where the last one ended."""
    table = stored_table(f)
    for as_of in runs:
        out = A.refresh_sproc_load(f, table, as_of, START)
    return out


def _updated_size(f: Fleet):
    old = A.aggregate_table_size(f, "2024-01-20 00:00:00", START)
    return old.unionByName(A.aggregate_table_size(f, AS_OF, START, old))


QUERIES = {
    "sproc_load_15min": lambda f: P.sproc_load(f),
    "sproc_load_live": lambda f: P.sproc_load(f, policy=Reset.RAW),
    "sproc_load_gap_free": lambda f: P.sproc_load(f, skip_gaps=True),
    "sproc_load_hybrid": lambda f: P.sproc_load_hybrid(f, stored_load(f), AS_OF),
    "cpu_load": lambda f: P.cpu_load(f),
    "wal_volume": lambda f: P.wal_volume(f),
    "blocked_counts": lambda f: P.blocked_counts(f, LOCK_START, LOCK_END),
    "db_size_trend": lambda f: P.db_size_trend(f),
    "db_size_trend_hybrid": lambda f: P.db_size_trend_hybrid(f, stored_size(f), AS_OF),
    "iud_rates": lambda f: P.iud_rates(P.db_size_trend(f)),
    "database_stats": lambda f: P.database_stats(f),
    "bgwriter_stats": lambda f: P.bgwriter_stats(f),
    "fleet_overview": lambda f: P.fleet_overview(f, stored_size(f), groups(f), AS_OF, "31 days"),
    "weekly_load_report": lambda f: P.weekly_load_report(f),
    "daily_load": lambda f: P.daily_load(f),
    "active_announcement": lambda f: P.active_announcement(announcements(f), "1998-01-01 12:00:00"),
    "aggregate_table_size": lambda f: _updated_size(f),
    "aggregate_sproc_load": lambda f: _updated_load(f),
    "aggregate_sproc_load_two_steps": lambda f: _refreshed_load(f, "2024-01-20 12:07:00", AS_OF),
    "aggregate_sproc_load_three_steps": lambda f: _refreshed_load(f, "2024-01-09 03:22:00", "2024-01-20 12:07:00", AS_OF),
}

B15 = "time_bucket(interval 15 minute, {})"


def _load(where_delta: str, src: str = "sproc_performance_data", first: str = "null") -> str:
    return f"""
with d as (select sp_host_id as host_id, sp_timestamp,
                  coalesce(sp_self_time - lag(sp_self_time) over (partition by sp_sproc_id order by sp_timestamp), {first}) as ms
           from {src}),
     b as (select host_id, time_bucket(interval 15 minute, sp_timestamp) as bucket, {big('sum(ms)')} as ms from d
           where {where_delta} group by 1, 2),
     l as (select host_id, bucket, {rn("(sum(ms) over (partition by host_id order by bucket rows 1 preceding) / 900000.0)", 2)} as load_15min from b)
"""


_TOTALS = f"""select tsd_host_id as host_id, tsd_timestamp as ts, {big('sum(tsd_table_size + tsd_index_size)')} as size,
       {big('sum(tsd_tup_ins)')} as s_ins, {big('sum(tsd_tup_upd)')} as s_upd, {big('sum(tsd_tup_del)')} as s_del
from table_size_data group by 1, 2"""


def _change(c: str) -> str:
    seen = f"coalesce(bool_or({c} <> 0) over (partition by host_id order by ts rows between unbounded preceding and 1 preceding), false)"
    return f"case when {seen} then greatest({c} - lag({c}) over (partition by host_id order by ts), 0) else 0 end"


_TREND = f"""with t as ({_TOTALS}),
trend as (select host_id, ts, size, {_change('s_ins')} as ins, {_change('s_upd')} as upd, {_change('s_del')} as del from t)"""


def _norm(c: str) -> str:
    d = f"greatest({c} - lag({c}) over w, 0)"
    el = secs("sdd_timestamp", "lag(sdd_timestamp) over w")
    return f"case when {el} <= 60 or {d} <= 1 then {d} else {r0(f'(({d} * 900) / {el})')} end"


def _guard(g: str, num: str, den: str) -> str:
    return f"case when {g} > 0 then {rn(f'(cast({num} as double) / {den})', 2)} end"


def _lagd(c: str) -> str:
    return f"{c} - lag({c}) over w"


_TREND_FLAG = "coalesce(cast(sign({0} - lag({0}) over w) as int), 0)"

_BEFORE = _load("ms > 0", "(select * from sproc_performance_data where sp_timestamp < timestamp '2024-01-30 23:00:00')")
_ONE_STEP = _BEFORE + " select * from l"

ORACLE = {
    "sproc_load_15min": _load("ms > 0") + "select * from l",
    "sproc_load_live": _load("true", first="0") + "select * from l",
    "sproc_load_gap_free": _load("ms > 0") + """,
g as (select *, coalesce(date_diff('minute', lag(bucket) over (partition by host_id order by bucket), bucket) > 15, false) as gap from l),
h as (select *, coalesce(lag(gap) over (partition by host_id order by bucket), false) as after_gap from g)
select host_id, bucket, load_15min from h where not gap and not after_gap""",
    "sproc_load_hybrid": _BEFORE.replace(" l as (", " old as (") + f""",
kept as (select * from old where bucket < timestamp '2024-01-30 22:00:00'), last_b as (select host_id as h, max(bucket) as lb from kept group by 1),
d2 as (select sp_host_id as host_id, sp_timestamp,
    coalesce(sp_self_time - lag(sp_self_time) over (partition by sp_sproc_id order by sp_timestamp), 0) as ms from sproc_performance_data),
b2 as (select host_id, lb, time_bucket(interval 15 minute, sp_timestamp) as bucket, sum(ms) as ms from d2 join last_b on h = host_id where sp_timestamp >= lb group by 1, 2, 3),
tail as (select host_id, lb, bucket, {rn("(sum(ms) over (partition by host_id order by bucket rows 1 preceding) / 900000.0)", 2)} as load_15min from b2)
select * from kept union all select host_id, bucket, load_15min from tail where bucket > lb""",
    "cpu_load": f"""select load_host_id as host_id, {B15.format('load_timestamp')} as bucket,
    {rn('(cast(sum(load_1min_value) as double) / (count(*) * 100))', 2)} as load_15min_avg,
    {rn('(max(load_1min_value) / 100.0)', 2)} as load_15min_max from host_load group by 1, 2""",
    "wal_volume": f"""select load_host_id as host_id, {B15.format('load_timestamp')} as bucket,
    max(xlog_location_mb) - min(xlog_location_mb) as wal_15min_growth from host_load group by 1, 2""",
    "blocked_counts": f"""with w as (select bp_host_id, query_start, query from blocking_processes where waiting
    group by 1, 2, 3 having max(bp_timestamp) - min(bp_timestamp) >= interval 5 second),
s as (select bp_host_id, time_bucket(interval 15 minute, query_start) as ts, count(*) as n from w group by 1, 2),
line as (select host_id, unnest(range(timestamp '{LOCK_START}', timestamp '{LOCK_END}', interval 15 minute)) as ts from hosts)
select line.host_id, line.ts, coalesce(n, 0) as wait_starts from line left join s on s.bp_host_id = line.host_id and s.ts = line.ts""",
    "db_size_trend": _TREND + " select * from trend",
    "db_size_trend_hybrid": _TREND + " select * from trend",
    "iud_rates": _TREND + """, g as (select *, epoch_ms(ts) - lag(epoch_ms(ts)) over (partition by host_id order by ts) as gap from trend)
select host_id, ts, cast(ins * 1000 // gap as bigint) as ins_per_s, cast(upd * 1000 // gap as bigint) as upd_per_s, cast(del * 1000 // gap as bigint) as del_per_s from g where gap > 0""",
    "database_stats": f"""select * exclude (prev) from (select sdd_host_id as host_id, sdd_timestamp as ts, sdd_numbackends as numbackends,
    {_norm('sdd_xact_rollback')} as rollbacks, {_norm('sdd_temp_bytes')} as temp_files_bytes, {_norm('sdd_deadlocks')} as deadlocks,
    lag(sdd_timestamp) over w as prev from stat_database_data window w as (partition by sdd_host_id order by sdd_timestamp)) where prev is not null""",
    "bgwriter_stats": f"""with d as (select sbd_host_id as host_id, date_trunc('hour', sbd_timestamp) as hour,
    {secs('sbd_timestamp', 'lag(sbd_timestamp) over w')} as el, {_lagd('sbd_checkpoints_timed')} as t, {_lagd('sbd_checkpoints_req')} as q,
    {_lagd('sbd_buffers_checkpoint')} as c, {_lagd('sbd_buffers_clean')} as l, {_lagd('sbd_buffers_backend')} as b
    from stat_bgwriter_data window w as (partition by sbd_host_id order by sbd_timestamp)),
h as (select host_id, hour, sum(el) as el, sum(t) + sum(q) as cp, sum(q) as q, sum(c) as c, sum(b) as b, sum(c) + sum(l) + sum(b) as wr
    from d where el > 0 group by 1, 2)
select host_id, hour, {_guard('cp', 'c * 8192', 'cp')} as bytes_per_checkpoint, {_guard('cp', 'q * 100', 'cp')} as checkpoint_request_pct,
    {_guard('wr', 'c * 100', 'wr')} as checkpoint_write_pct, {_guard('wr', 'b * 100', 'wr')} as backend_write_pct,
    {_guard('wr', 'wr * 8192', 'el')} as written_per_second from h""",
    "fleet_overview": f"""with sz as (select host_id, max(ts) as ts, arg_max(size, ts) as size from ({_TOTALS}) where ts < timestamp '2024-01-30 23:00:00' group by 1),
ld as (select load_host_id as host_id, arg_max(load_5min_value, load_timestamp) as v from host_load group by 1)
select h.host_id, host_ui_shortname, host_ui_longname, r_name as group_name,
    coalesce(printf('%.1f', {rn('(v / 100.0)', 1)}), '-') as last_5min_load, coalesce({pretty_size('size')}, '-') as last_size,
    case when r_regionkey = 0 then 0 else 1 end as group_order
from hosts h left join ld on ld.host_id = h.host_id left join sz on sz.host_id = h.host_id left join region on r_regionkey = host_group_id
where host_enabled""",
    "weekly_load_report": f"""with snap as (select tsd_host_id as host_id, tsd_timestamp as ts, sum(tsd_table_size + tsd_index_size) as b from table_size_data group by 1, 2),
sz as (select host_id, isoyear(ts) as iso_year, week(ts) as week, {rn('(cast(arg_max(b, ts) as double) / 1073741824.0)', 1)} as db_size from snap group by 1, 2, 3),
ld as (select load_host_id as host_id, isoyear(load_timestamp) as iso_year, week(load_timestamp) as week,
    {rn('(cast(sum(load_15min_value) as double) / (count(*) * 100))', 2)} as avg_load, {rn('(max(load_15min_value) / 100.0)', 2)} as max_load,
    strftime(min(load_timestamp), '%d.%m.%Y') as min_date, strftime(max(load_timestamp), '%d.%m.%Y') as max_date,
    {rn('((max(xlog_location_mb) - min(xlog_location_mb)) / 1024.0)', 1)} as wal_written
    from host_load where isodow(load_timestamp) <= 5 group by 1, 2, 3)
select ld.host_id, ld.iso_year, ld.week, avg_load, max_load, min_date, max_date, wal_written, db_size, host_ui_shortname,
    {_TREND_FLAG.format('avg_load')} as trend_avg, {_TREND_FLAG.format('max_load')} as trend_max,
    {_TREND_FLAG.format('db_size')} as trend_size, {_TREND_FLAG.format('wal_written')} as trend_wal
from ld join sz using (host_id, iso_year, week) join hosts h on h.host_id = ld.host_id where host_enabled
window w as (partition by ld.host_id order by ld.iso_year, ld.week)""",
    "daily_load": f"""select load_host_id as host_id, date_trunc('day', load_timestamp) as day,
    {rn('(cast(sum(load_15min_value) as double) / (count(*) * 100))', 2)} as cpu_15, (max(xlog_location_mb) - min(xlog_location_mb)) * 1000000 as wal_b
    from host_load group by 1, 2""",
    "active_announcement": """select 'order ' || o_orderkey as announcement from orders
    where o_orderdate <= timestamp '1998-01-01 12:00:00' and timestamp '1998-01-01 12:00:00' < o_orderdate + interval 1 day""",
    "aggregate_table_size": f"select * from ({_TOTALS}) where ts < timestamp '2024-01-30 23:00:00'",
    "aggregate_sproc_load": _ONE_STEP,
    "aggregate_sproc_load_two_steps": _ONE_STEP,
    "aggregate_sproc_load_three_steps": _ONE_STEP,
}
