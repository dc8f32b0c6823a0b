"""Summary and detector queries and their oracles."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from counterloom.plans import detectors as D
from counterloom.plans import summaries as S

from .harness import big, r0, rn
from .hosts import stored_table

AS_OF = "2024-01-31 00:00:00"
LIM = D.Limits(min_total_ms=100_000, cache_misses=10, table_size=1_000_000, table_scans=3, shard_total_ms=1000, shard_scans=2, shard_factor=2, max_higher_values=2)


# the all-host baseline is held against every host's row, so sums over hosts start far below it
LIM_ALL = dataclasses.replace(LIM, percent=-70)


def ignore(f):
    return f.spark.createDataFrame([(None, "signup"), (4, None), (2, "table_3")], "host_id int, object_name string")


def clusters(f):
    return f.spark.createDataFrame([(1, 1), (1, 2)], "hc_one_host_id int, hc_host_id int")


def pairs(f):
    return f.spark.createDataFrame([(1, 2), (3, 4)], "shard_a int, shard_b int")


def sprocs(f):
    return S.hourly_sproc_summary(f, AS_OF)


def tables(f):
    return S.daily_table_summary(f, AS_OF)


def hosts(f):
    return S.daily_host_summary(f, AS_OF, clusters(f))


RUNS = ("2024-01-12 10:25:00", "2024-01-12 12:00:00", "2024-01-23 00:00:00", AS_OF)


def _refreshed(refresh, *more):
    """A stored summary after several refreshes, as if computed in one go."""
    def run(f):
        table = stored_table(f)
        for as_of in RUNS:
            out = refresh(f, table, as_of, *(m(f) for m in more))
        return out
    return run


stored_sprocs = _refreshed(S.refresh_hourly_sproc_summary)
stored_tables = _refreshed(S.refresh_daily_table_summary)
stored_hosts = _refreshed(S.refresh_daily_host_summary, clusters)


def past_sprocs(f):
    return sprocs(f).select("ss_host_id", F.col("ss_sproc_name").alias("sproc_name"), F.col("ss_date").alias("eval_date"), F.col("ss_total_time").alias("total_time"))


def past_tables(f):
    return tables(f).select("ts_host_id", "ts_table_name", F.col("ts_date").alias("eval_date"), "ts_seq_scans")


def past_hosts(f):
    return hosts(f).select("hs_host_id", F.col("hs_date").alias("eval_date"), F.col("hs_cache_misses").alias("cache_misses"))


def changes(f):
    return f.table("sprocs").where("sproc_schema like '%r24_00_03'").select(
        F.col("sproc_host_id").alias("host_id"), F.split_part("sproc_name", F.lit("("), F.lit(1)).alias("sproc_name"),
        (F.lit("2024-01-29 08:05:00").cast("timestamp")).alias("change_time"),
    )


def _txt(df):
    return df.withColumn("host_names", F.array_join("host_names", ","))


def _sp(**kw):
    return lambda f: _txt(D.sproc_hourly_alerts(f, sprocs(f), ignore(f), LIM, **kw))


def _tot(**kw):
    return lambda f: _txt(D.host_total_alerts(f, sprocs(f), ignore(f), LIM, **kw))


def _tab(**kw):
    return lambda f: _txt(D.table_daily_alerts(f, tables(f), ignore(f), LIM if kw.get('combine') is False else LIM_ALL, **kw))


def _set(**kw):
    return lambda f: _txt(D.table_set_alerts(f, tables(f), ignore(f), LIM if kw.get('combine') is False else LIM_ALL, **kw))


P1, P2 = ("2024-01-08", "2024-01-14"), ("2024-01-22", "2024-01-28")

QUERIES = {
    "hourly_sproc_summary": lambda f: sprocs(f),
    "daily_table_summary": lambda f: tables(f),
    "daily_host_summary": lambda f: hosts(f),
    "stored_hourly_sproc_summary": lambda f: stored_sprocs(f),
    "stored_daily_table_summary": lambda f: stored_tables(f),
    "stored_daily_host_summary": lambda f: stored_hosts(f),
    "sproc_hourly_alerts": _sp(),
    "sproc_hourly_alerts_avg": _sp(eval_avg=True),
    "sproc_hourly_alerts_per_host": _sp(combine=False),
    "sproc_hourly_alerts_per_host_avg": _sp(combine=False, eval_avg=True),
    "sproc_hourly_alerts_one_hour": _sp(date="2024-01-29", hour=17),
    "sproc_hourly_alerts_new_highs": lambda f: _txt(D.sproc_hourly_alerts(f, sprocs(f), ignore(f), LIM, combine=False, past=past_sprocs(f))),
    "host_total_alerts": _tot(),
    "host_total_alerts_avg": _tot(eval_avg=True),
    "host_total_alerts_per_host": _tot(combine=False),
    "host_total_alerts_per_host_avg": _tot(combine=False, eval_avg=True),
    "host_cache_alerts": lambda f: _txt(D.host_cache_alerts(f, hosts(f), clusters(f), LIM)),
    "host_cache_alerts_new_highs": lambda f: _txt(D.host_cache_alerts(f, hosts(f), clusters(f), LIM, past=past_hosts(f))),
    "table_daily_alerts": _tab(),
    "table_daily_alerts_by_size": _tab(by_size=True),
    "table_daily_alerts_per_host": _tab(combine=False),
    "table_daily_alerts_per_host_by_size": _tab(combine=False, by_size=True),
    "table_daily_alerts_new_highs": lambda f: _txt(D.table_daily_alerts(f, tables(f), ignore(f), LIM, combine=False, past=past_tables(f))),
    "table_set_alerts": _set(),
    "table_set_alerts_per_host": _set(combine=False),
    "table_set_alerts_two_tables": _set(tables=["table_1", "table_3"]),
    "shard_differences": lambda f: D.shard_differences(f, sprocs(f), tables(f), pairs(f), ignore(f), LIM),
    "compare_periods": lambda f: D.compare_periods(sprocs(f), P1, P2, factor=1),
    "compare_periods_hours": lambda f: D.compare_periods(sprocs(f), P1, P2, hosts=[1, 2], hours=(8, 20), factor=1),
    "changed_sproc_alerts": lambda f: _txt(D.changed_sproc_alerts(f, sprocs(f), changes(f), ignore(f), LIM)),
    "changed_sproc_alerts_combined": lambda f: _txt(D.changed_sproc_alerts(f, sprocs(f), changes(f), ignore(f), LIM, combine=True)),
    "sproc_history": lambda f: D.sproc_history(sprocs(f), 1, "click"),
    "alert_messages_sproc": lambda f: D.alert_messages(D.sproc_hourly_alerts(f, sprocs(f), ignore(f), LIM, combine=False), "sproc"),
    "alert_messages_total": lambda f: D.alert_messages(D.host_total_alerts(f, sprocs(f), ignore(f), LIM, combine=False), "total"),
    "alert_messages_table": lambda f: D.alert_messages(D.table_daily_alerts(f, tables(f), ignore(f), LIM_ALL), "table"),
    "alert_messages_cache": lambda f: D.alert_messages(D.host_cache_alerts(f, hosts(f), clusters(f), LIM), "cache"),
    "alert_messages_shard": lambda f: D.alert_messages(D.shard_differences(f, sprocs(f), tables(f), pairs(f), ignore(f), LIM), "shard"),
}

_SS = f"""with m as (select sproc_host_id as h, split_part(sproc_name, '(', 1) as n, sp_sproc_id, date_trunc('hour', sp_timestamp) as hr, max(sp_calls) as c, max(sp_total_time) as t
  from sproc_performance_data join sprocs on sproc_id = sp_sproc_id group by 1, 2, 3, 4),
g as (select h, n, hr, {big('sum(c)')} as c, {big('sum(t)')} as t from m group by 1, 2, 3),
j as (select a.*, b.c as pc, b.t as pt from g a left join g b on a.h = b.h and a.n = b.n and b.hr = a.hr - interval 1 hour),
det as (select h as ss_host_id, n as ss_sproc_name, cast(hr as date) as ss_date, cast(hour(hr) as int) as ss_hour,
  case when c - coalesce(pc, 0) < 0 then c else c - coalesce(pc, 0) end as ss_calls, case when t - coalesce(pt, 0) < 0 then t else t - coalesce(pt, 0) end as ss_total_time,
  c as ss_orig_calls, t as ss_orig_total_time, timestamp '{AS_OF}' > hr + interval 1 hour as ss_is_final, pc is null as ss_is_suspect from j),
ss as (select * from det union all select ss_host_id, ' ', ss_date, ss_hour, {big('sum(ss_calls)')}, {big('sum(ss_total_time)')}, {big('sum(ss_orig_calls)')}, {big('sum(ss_orig_total_time)')}, true, false
  from det where ss_is_final and not ss_is_suspect group by 1, 3, 4)"""


def _grow(c: str) -> str:
    return f"{big(f'sum(case when a.{c} < b.{c} then a.{c} else a.{c} - b.{c} end)')}"


_TS = f"""with m as (select tsd_table_id as id, cast(tsd_timestamp as date) as d, max(tsd_table_size) as s, max(tsd_index_size) as i, max(tsd_seq_scans) as q, max(tsd_index_scans) as x from table_size_data group by 1, 2),
ts as (select t_host_id as ts_host_id, t_name as ts_table_name, a.d as ts_date, {_grow('s')} as ts_table_size, {_grow('i')} as ts_index_size, {_grow('q')} as ts_seq_scans, {_grow('x')} as ts_index_scans,
  max(a.s) as ts_orig_table_size, max(a.i) as ts_orig_index_size, timestamp '{AS_OF}' > a.d + interval 1 day as ts_is_final
  from m a join m b on a.id = b.id and b.d = a.d - interval 1 day join tables on t_id = a.id group by 1, 2, 3, a.d having {_grow('s')} > 0)"""

_HS = f"""with l as (select tio_host_id as h, tio_table_id, cast(tio_timestamp as date) as d, greatest(tio_heap_read + tio_idx_read, 0) as r from table_io_data
  qualify row_number() over (partition by tio_table_id, cast(tio_timestamp as date) order by tio_timestamp desc) = 1),
p as (select h, d, {big('sum(r)')} as m from l group by 1, 2),
cl(one, member) as (values (1, 1), (1, 2)),
c as (select coalesce(one, a.h) as h, a.d, {big('sum(case when a.m > b.m then a.m - b.m else a.m end)')} as m from p a join p b on a.h = b.h and b.d = a.d - interval 1 day left join cl on member = a.h group by 1, 2),
hs as (select h as hs_host_id, host_name as hs_host_name, d as hs_date, m as hs_cache_misses, timestamp '{AS_OF}' > d + interval 1 day as hs_is_final from c join hosts on host_id = h)"""


def _ign(h: str, n: str | None, only_hosts: bool = False) -> str:
    rows = "(4, null)" if only_hosts else "(null, 'signup'), (4, null), (2, 'table_3')"
    cond = "" if only_hosts else f" and (o is null or o = {n})"
    return f"not exists (select 1 from (values {rows}) ig(ih, o) where (ih is null or ih = {h}){cond})"


_MICRO = "cast(floor({0} * 1000000.0 + 0.5) as bigint)"
_INC = r0("((cast({0} as double) / {1} - 1.0) * 100.0)")


def _cond(avg: bool, pct: int) -> str:
    if avg:
        return f"cast(bt as double) / bc * {100 + pct}.0 < cast(ss_total_time as double) / ss_calls * 100.0"
    return f"bt * {100 + pct} < ss_total_time * 100 * wk"


def _alerts(total: bool, combine: bool, avg: bool) -> str:
    pct = 50 if total else 30
    which = "ss_sproc_name = ' '" if total else "ss_sproc_name <> ' '"
    ign = _ign("ss_host_id", "ss_sproc_name", total)
    host = "" if combine else "ss_host_id, "
    on = "e = ss_date and b.hr = ss_hour and b.n = ss_sproc_name" + ("" if combine else " and b.ss_host_id = s.ss_host_id")
    grp = f"e, {host}hr, n"
    sql = _SS + f""",
r as (select * from ss where not ss_is_suspect and {which}),
fan as (select r.*, ss_date + cast(7 * k as int) as e from r, (select unnest([1, 2, 3, 4]) as k) w where {ign if combine else 'true'}),
b0 as (select e, {host}ss_hour as hr, ss_sproc_name as n, count(distinct ss_date) as wk, greatest({big('sum(ss_calls)')}, 1) as bc, greatest({big('sum(ss_total_time)')}, 1) as bt, 1 as w from fan group by {grp}),
"""
    if total:
        sql += "b as (select * from b0),\n"
    else:
        sql += f"""fresh as (select s.* from r s where ss_total_time > 100000 and ss_calls > 0 and not exists (select 1 from fan where e = s.ss_date and fan.ss_hour = s.ss_hour and fan.ss_sproc_name = s.ss_sproc_name and fan.ss_host_id = s.ss_host_id)),
b as (select * from b0 union all select ss_date, {host}ss_hour, ss_sproc_name, 1, 1, 1, count(*) from fresh group by ss_date, {host}ss_hour, ss_sproc_name),
"""
    member = " and exists (select 1 from fan where fan.e = s.ss_date and fan.ss_hour = s.ss_hour and fan.ss_host_id = s.ss_host_id)" if total and combine else ""
    sql += f"""hit as (select s.*, wk, bc, bt, w, host_name from r s join b on {on} join hosts on host_id = s.ss_host_id where ss_calls > 0 and {ign.replace('ss_host_id', 's.ss_host_id')}{member})"""
    name = "" if total else "ss_sproc_name as sproc_name, "
    if not combine:
        inc = _INC.format("ss_total_time", "ss_calls / (cast(bt as double) / bc)") if avg else _INC.format("ss_total_time", "(cast(bt as double) / wk)")
        if avg:
            inc = r0("(((cast(ss_total_time as double) / ss_calls) / (cast(bt as double) / bc) - 1.0) * 100.0)")
        return sql + f""", out as (select ss_host_id, ss_date as eval_date, ss_hour, host_name as host_names, {name}ss_calls as calls, ss_total_time as total_time, ss_total_time // ss_calls as avg_time, {inc} as time_percent_increase
  from hit where ss_total_time > 100000 and {_cond(avg, pct)})"""
    weekly, base_avg, cur_avg = (_MICRO.format(x) for x in ("(cast(bt as double) / wk)", "(cast(bt as double) / bc)", "(cast(ss_total_time as double) / ss_calls)"))
    row = "true" if avg else _cond(False, pct)
    sql += f""", gr as (select ss_date as eval_date, ss_hour, ss_sproc_name, string_agg(distinct host_name, ',' order by host_name) as host_names, {big('sum(ss_calls * w)')} as calls, {big('sum(ss_total_time * w)')} as total_time, {big('sum(w)')} as cnt,
  {big(f'sum({weekly} * w)')} as wkl, {big(f'sum({base_avg} * w)')} as ba, {big(f'sum({cur_avg} * w)')} as ca from hit where {row} group by 1, 2, 3)"""
    if avg:
        having = f"cast(ba as double) / cnt * {100 + pct}.0 < cast(total_time as double) / calls * 100000000.0" if total else f"ba * {100 + pct} < ca * 100"
        inc = _INC.format("ca", "ba")
    else:
        having, inc = "true", _INC.format("(total_time * 1000000)", "wkl")
    return sql + f""", out as (select eval_date, ss_hour, host_names, {name}calls, total_time, {r0('(cast(total_time as double) / calls)')} as avg_time, {inc} as time_percent_increase from gr where total_time > 100000 and {having})"""


def _noise(keys: str, src: str, match: str, value: str) -> str:
    return f""" where (select count(*) from {src} p where {match} and p.{value[1]} > out.{value[0]}) < 2"""


_V = ("ts_table_size", "ts_index_size", "ts_seq_scans", "ts_index_scans")


def _tables(combine: bool, by_size: bool) -> str:
    v = "ts_table_size" if by_size else "ts_seq_scans"
    ig = _ign("ts_host_id", "ts_table_name")
    host = "" if combine else "ts_host_id, "
    sql = _TS + f""", fan as (select ts.*, ts_date + cast(7 * k as int) as e from ts, (select unnest([1, 2, 3, 4]) as k) w where {ig if combine else 'true'}),
b as (select e, {host}ts_table_name as n, count(distinct ts_date) as wk, {big(f'sum({v})')} as bv from fan group by e, {host}ts_table_name),
hit as (select s.*, wk, bv, host_name from ts s join b on e = ts_date and n = ts_table_name {'' if combine else 'and b.ts_host_id = s.ts_host_id'} join hosts on host_id = s.ts_host_id where bv > 0 and {ig.replace('ts_host_id', 's.ts_host_id')})"""
    scans = "true" if by_size else "ts_seq_scans > 3"
    if combine:
        return sql + f""", gr as (select ts_date as eval_date, ts_table_name as table_name, string_agg(distinct host_name, ',' order by host_name) as host_names, {', '.join(f'{big(f"sum({c})")} as {c}' for c in _V)},
  sum(ts_orig_table_size) as orig, {big('sum(' + _MICRO.format('(cast(bv as double) / wk)') + ')')} as wkl from hit group by 1, 2),
out as (select eval_date, host_names, table_name, {', '.join(f'{c} as {c[3:]}' for c in _V)}, {_INC.format(f'({v} * 1000000)', 'wkl')} as percent_increase from gr
  where orig > 1000000 and wkl * 30 < {v} * 100000000 and {scans})"""
    return sql + f""", out as (select ts_host_id, ts_table_name, ts_seq_scans, ts_date as eval_date, host_name as host_names, ts_table_name as table_name, ts_orig_table_size as table_size, ts_orig_index_size as index_size, ts_seq_scans as seq_scans, ts_index_scans as index_scans,
  {_INC.format(v, '(cast(bv as double) / wk)')} as percent_increase from hit where ts_orig_table_size > 1000000 and bv * 130 < {v} * 100 * wk and {scans})"""


def _table_set(combine: bool, names: str = "true") -> str:
    ig = _ign("ts_host_id", "ts_table_name")
    host = "" if combine else "ts_host_id, "
    sql = _TS + f""", ch as (select * from ts where {names}), fan as (select ch.*, ts_date + cast(7 * k as int) as e from ch, (select unnest([1, 2, 3, 4]) as k) w where {ig}),
b as (select e, {host}ts_table_name as n, count(distinct ts_date) as wk, {', '.join(f'{big(f"sum({c})")} as b_{c}' for c in _V)} from fan group by e, {host}ts_table_name),
hit as (select s.*, wk, {', '.join('b_' + c for c in _V)}, host_name from ch s join b on e = ts_date and n = ts_table_name {'' if combine else 'and b.ts_host_id = s.ts_host_id'} join hosts on host_id = s.ts_host_id)"""
    parts = []
    for c in _V:
        lim = 1000000 if c.endswith("size") else 3
        lab = {"ts_table_size": " table size increase ", "ts_index_size": " index size increase ", "ts_seq_scans": " tables scans increase ", "ts_index_scans": " index scans increase "}[c]
        if combine:
            wk = big("sum(" + _MICRO.format(f"(cast(b_{c} as double) / wk)") + ")")
            parts.append(f"""select ts_date as eval_date, string_agg(distinct host_name, ',' order by host_name) as host_names, ts_table_name as table_name, {', '.join(f'{big(f"sum({x})")} as {x[3:]}' for x in _V)}, '{lab}' as label,
  {_INC.format(f'(sum({c}) * 1000000)', wk)} as percent_increase from hit where b_{c} > 0 group by 1, 3 having sum({c}) > {lim} and {wk} * 30 < sum({c}) * 100000000""")
        else:
            parts.append(f"""select ts_date as eval_date, host_name as host_names, ts_table_name as table_name, {', '.join(f'{x} as {x[3:]}' for x in _V)}, '{lab}' as label, {_INC.format(c, f'(cast(b_{c} as double) / wk)')} as percent_increase
  from hit where b_{c} > 0 and {c} > {lim} and b_{c} * 130 < {c} * 100 * wk""")
    return sql + " " + " union all ".join(parts)


def _cache(extra: str = "") -> str:
    return _HS + f""", fan as (select hs.*, hs_date + cast(7 * k as int) as e from hs, (select unnest([1, 2, 3, 4]) as k) w where hs_cache_misses > 10),
b as (select e, hs_host_id as h, count(*) as wk, {big('sum(hs_cache_misses)')} as bm from fan group by 1, 2),
mem as (select one, string_agg(distinct host_name, ',' order by host_name) as members from cl join hosts on host_id = member group by 1),
out as (select hs_host_id, hs_date as eval_date, coalesce(members, hs_host_name) as host_names, hs_cache_misses as cache_misses, {_INC.format('hs_cache_misses', '(cast(bm as double) / wk)')} as time_percent_increase
  from hs join b on e = hs_date and h = hs_host_id left join mem on one = hs_host_id where bm * 130 < hs_cache_misses * 100 * wk)
select * exclude (hs_host_id) from out{extra}"""


def _ratio(test: str, a: str, b: str, date: str, name: str, src: str, where: str) -> str:
    fw = f"{r0(f'(cast({a} as double) / nullif({b}, 0))')} > 0"
    return f"""select {date} as eval_date, '{test}' as test_name, case when {fw} then host_a else host_b end as shard1, case when {fw} then host_b else host_a end as shard2,
  case when {fw} then {r0(f'(cast({a} as double) / nullif({b}, 0))')} else {r0(f'(cast({b} as double) / nullif({a}, 0))')} end as ratio, {name} as object_name from {src} where {where}"""


_SHARDS = _SS + ", " + _TS[5:] + f""", pr as (select * from (values (1, 2), (3, 4)) v(x, y)), nm as (select x, y, ha.host_name as host_a, hb.host_name as host_b from pr join hosts ha on ha.host_id = x join hosts hb on hb.host_id = y),
s as (select *, {_MICRO.format('(cast(ss_total_time as double) / ss_calls)')} as avg from ss where ss_calls > 0 and ss_total_time > 0 and {_ign('ss_host_id', 'ss_sproc_name')}),
sg as (select host_a, host_b, a.ss_date as d, a.ss_sproc_name as n, sum(a.ss_total_time) as ta, sum(b.ss_total_time) as tb, {big('sum(a.avg)')} as va, {big('sum(b.avg)')} as vb
  from s a join nm on x = a.ss_host_id join s b on y = b.ss_host_id and a.ss_date = b.ss_date and a.ss_hour = b.ss_hour and a.ss_sproc_name = b.ss_sproc_name group by 1, 2, 3, 4),
tg as (select host_a, host_b, a.ts_date as d, a.ts_table_name as n, a.ts_seq_scans as va, b.ts_seq_scans as vb, a.ts_orig_table_size as o
  from ts a join nm on x = a.ts_host_id join ts b on y = b.ts_host_id and a.ts_date = b.ts_date and a.ts_table_name = b.ts_table_name),
out as ({_ratio('avg sproc time', 'va', 'vb', 'd', 'n', 'sg', '(ta > 1000 or tb > 1000) and (va > vb * 2 or va * 2 < vb)')} union {_ratio('seq table scans', 'va', 'vb', 'd', 'n', 'tg', '(va > 2 or vb > 2) and o > 1000000 and (va > vb * 2 or va * 2 < vb)')})"""


def _periods(where: str = "true") -> str:
    def agg(c, p):
        return big(f"sum(case when ss_date between date '{p[0]}' and date '{p[1]}' then {c} end)")
    return _SS + f""", q as (select ss_sproc_name as sproc_name, {agg('ss_total_time', P1)} as pt, {agg('ss_calls', P1)} as pc, {agg('ss_total_time', P2)} as ct, {agg('ss_calls', P2)} as cc from ss where not ss_is_suspect and {where} group by 1),
u as (select *, cast(pt as double) / pc as pa, cast(ct as double) / cc as ca from q where pt > 0 and ct > 0 and pc > 0 and cc > 0),
tt as (select *, cast(pt as double) / pc as pa, cast(ct as double) / cc as ca from (select {', '.join(f'{big(f"sum({c})")} as {c}' for c in ('pt', 'pc', 'ct', 'cc'))} from u) x)
select 'worse' as is_better_worse_total, {rn('(ca / pa)', 2)} as factor, sproc_name, pc as prev_calls, cc as curr_calls, {rn('pa', 2)} as prev_avg_time, {rn('ca', 2)} as curr_avg_time, ct as curr_total_time from u where pa * 1.0 < ca
union all select 'better', {rn('(pa / ca)', 2)}, sproc_name, pc, cc, {rn('pa', 2)}, {rn('ca', 2)}, ct from u where pa > ca * 1.0
union all select 'a total', case when {rn('(ca / pa)', 2)} > 1 then -{rn('(ca / pa)', 2)} else {rn('(pa / ca)', 2)} end, ' ', pc, cc, {rn('pa', 2)}, {rn('ca', 2)}, ct from tt"""


def _changed(avg: bool, combine: bool) -> str:
    keep = "hs, n, c, t, bt, bc"
    group = f"""fin as (select string_agg(distinct host_name, ',' order by host_name) as hs, n, {', '.join(f'{big(f"sum({x})")} as {x}' for x in ('c', 't', 'bt', 'bc'))} from per group by n)""" if combine else f"fin as (select host_name as hs, n, c, t, bt, bc from per)"
    cond = "(cast(bt as double) / bc) * 130.0 < (cast(t as double) / c) * 100.0" if avg else "bt * 130 < t * 100000000"
    inc = r0("(((cast(t as double) / c) / (cast(bt as double) / bc) - 1.0) * 100.0)") if avg else _INC.format("(t * 1000000)", "bt")
    return _SS + f""", w as (select distinct sproc_host_id as h, split_part(sproc_name, '(', 1) as n from sprocs where sproc_schema like '%r24_00_03'),
p as (select w.h, w.n, sp_sproc_id, date_trunc('hour', sp_timestamp) as hr, min(sp_timestamp) as a, max(sp_timestamp) as z, max(sp_calls) - min(sp_calls) as c, max(sp_total_time) - min(sp_total_time) as t
  from sproc_performance_data join sprocs on sproc_id = sp_sproc_id join w on w.h = sproc_host_id and w.n = split_part(sproc_name, '(', 1)
  where sp_timestamp > timestamp '2024-01-29 08:05:00' and sp_timestamp < timestamp '2024-01-29 10:00:00' group by 1, 2, 3, 4 having min(sp_timestamp) <> max(sp_timestamp)),
pp as (select h, n, hr, sum(c) as c, sum(t) as t, date_diff('minute', min(a), max(z)) as mins from p group by 1, 2, 3),
fan as (select ss.*, ss_date + cast(7 * k as int) as e from ss, (select unnest([1, 2, 3, 4]) as k) x where not ss_is_suspect),
b as (select e, ss_hour as hh, ss_sproc_name as n, ss_host_id as h, count(distinct ss_date) as wk, {big('sum(ss_calls)')} as bc, {big('sum(ss_total_time)')} as bt from fan group by 1, 2, 3, 4),
per as (select host_name, pp.n, {big('sum(c)')} as c, {big('sum(t)')} as t, {big('sum(' + _MICRO.format('(cast(bt * mins as double) / (wk * 60))') + ')')} as bt, {big('sum(' + _MICRO.format('(cast(bc * mins as double) / (wk * 60))') + ')')} as bc
  from pp join b on b.e = cast(hr as date) and hh = hour(hr) and b.n = pp.n and b.h = pp.h join hosts on host_id = pp.h where {_ign('pp.h', 'pp.n')} group by 1, 2 having sum(c) > 0),
{group}
select hs as host_names, n as sproc_name, c as calls, t as total_time, t // c as avg_time, {inc} as time_percent_increase from fin where bt > 0 and bc > 0 and {cond}"""


_PER_HOST = _alerts(False, False, False)

ORACLE = {
    "hourly_sproc_summary": _SS + " select * from ss",
    "daily_table_summary": _TS + " select * from ts",
    "daily_host_summary": _HS + " select * from hs",
    "stored_hourly_sproc_summary": f"{_SS} select * from ss where ss_date + interval (ss_hour) hour <= timestamp '{AS_OF}'",
    "stored_daily_table_summary": f"{_TS} select * from ts where ts_date <= timestamp '{AS_OF}'",
    "stored_daily_host_summary": f"{_HS} select * from hs where hs_date <= timestamp '{AS_OF}'",
    "sproc_hourly_alerts": _alerts(False, True, False) + " select * from out",
    "sproc_hourly_alerts_avg": _alerts(False, True, True) + " select * from out",
    "sproc_hourly_alerts_per_host": _PER_HOST + " select * exclude (ss_host_id) from out",
    "sproc_hourly_alerts_per_host_avg": _alerts(False, False, True) + " select * exclude (ss_host_id) from out",
    "sproc_hourly_alerts_one_hour": _alerts(False, True, False) + " select * from out where eval_date = date '2024-01-29' and ss_hour = 17",
    "sproc_hourly_alerts_new_highs": _PER_HOST + """ select * exclude (ss_host_id) from out where (select count(*) from ss p where p.ss_host_id = out.ss_host_id and p.ss_sproc_name = out.sproc_name
  and p.ss_date between out.eval_date - 6 and out.eval_date and p.ss_total_time > out.total_time) < 2""",
    "host_total_alerts": _alerts(True, True, False) + " select * from out",
    "host_total_alerts_avg": _alerts(True, True, True) + " select * from out",
    "host_total_alerts_per_host": _alerts(True, False, False) + " select * exclude (ss_host_id) from out",
    "host_total_alerts_per_host_avg": _alerts(True, False, True) + " select * exclude (ss_host_id) from out",
    "host_cache_alerts": _cache(),
    "host_cache_alerts_new_highs": _cache(" where (select count(*) from hs p where p.hs_host_id = out.hs_host_id and p.hs_date between out.eval_date - 6 and out.eval_date and p.hs_cache_misses > out.cache_misses) < 2"),
    "table_daily_alerts": _tables(True, False) + " select * from out",
    "table_daily_alerts_by_size": _tables(True, True) + " select * from out",
    "table_daily_alerts_per_host": _tables(False, False) + " select * exclude (ts_host_id, ts_table_name, ts_seq_scans) from out",
    "table_daily_alerts_per_host_by_size": _tables(False, True) + " select * exclude (ts_host_id, ts_table_name, ts_seq_scans) from out",
    "table_daily_alerts_new_highs": _tables(False, False) + """ select * exclude (ts_host_id, ts_table_name, ts_seq_scans) from out where (select count(*) from ts p where p.ts_host_id = out.ts_host_id and p.ts_table_name = out.ts_table_name
  and p.ts_date between out.eval_date - 6 and out.eval_date and p.ts_seq_scans > out.ts_seq_scans) < 2""",
    "table_set_alerts": _table_set(True),
    "table_set_alerts_per_host": _table_set(False),
    "table_set_alerts_two_tables": _table_set(True, "ts_table_name in ('table_1', 'table_3')"),
    "shard_differences": _SHARDS.replace(" m as (select tsd", " m2 as (select tsd").replace("from m a join m b on a.id", "from m2 a join m2 b on a.id") + " select * from out",
    "compare_periods": _periods(),
    "compare_periods_hours": _periods("ss_host_id in (1, 2) and ss_hour between 8 and 20"),
    "changed_sproc_alerts": _changed(False, False),
    "changed_sproc_alerts_combined": _changed(False, True),
    "sproc_history": _SS + """ select ss_total_time // ss_calls as avg_time, ss_date, ss_hour, ss_total_time as total_time, ss_calls as calls, case when ss_is_suspect then 'suspect' else '' end as is_suspect
  from ss where ss_host_id = 1 and ss_sproc_name = 'click' and ss_calls > 0 order by ss_date desc, ss_hour desc limit 2000""",
    "alert_messages_sproc": _PER_HOST + " select 'Sproc jump found on HOST: ' || host_names || ', SPROC: ' || sproc_name || ', CALLS: ' || calls || ', AVG_TIME: ' || avg_time || ', INCREASE: ' || time_percent_increase || ' %' as message from out",
    "alert_messages_total": _alerts(True, False, False) + " select 'Total sproc runtime jump found for last hour on HOST: ' || host_names || ', CALLS: ' || calls || ', TOTAL_TIME: ' || total_time || ', AVG_TIME: ' || avg_time || ', AVG TIME INCREASE: ' || time_percent_increase || ' %' as message from out",
    "alert_messages_table": _tables(True, False) + " select 'Seq scan jump found on HOST: ' || replace(host_names, ',', ', ') || ', TABLE: ' || table_name || ', TABLE_SIZE: ' || table_size || ', TABLE_SCANS: ' || seq_scans || ', INCREASE: ' || percent_increase || ' %' as message from out",
    "alert_messages_cache": _cache().replace("select * exclude (hs_host_id) from out", "select 'Host cache miss jump found on HOST: ' || replace(host_names, ',', ', ') || ', CACHE_MISSES: ' || cache_misses || ', INCREASE: ' || time_percent_increase || '%' as message from out"),
    "alert_messages_shard": _SHARDS.replace(" m as (select tsd", " m2 as (select tsd").replace("from m a join m b on a.id", "from m2 a join m2 b on a.id") + """ select 'Shard diference found between "' || shard1 || '" and "' || shard2 || '" - TEST_NAME: ' || test_name || ', OBJECT_NAME: ' || object_name || ', RATIO: ' || ratio as message from out""",
}
