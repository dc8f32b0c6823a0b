"""Procedure queries and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from counterloom.plans import procedures as P

from .harness import big, pretty_ms, rn

CUSTOM = "host_id int, sproc_name string, runtime_growth_pct double, calls_growth_pct double"


def custom_limits(f):
    return f.spark.createDataFrame([(1, "click(i integer, i text)", 1.0, 5.0), (2, "view(i integer, i text)", -60.0, None)], CUSTOM)


def created(f):
    return f.table("sproc_performance_data").groupBy(F.col("sp_sproc_id").alias("sproc_id")).agg(
        F.min("sp_timestamp").alias("sproc_created")
    )


def observed(f):
    ev = f.table("ev")
    return ev.select(
        "host_id", F.concat(F.lit("shop_api_r24_00_0"), F.col("rel").cast("string")).alias("schema_name"),
        F.col("event_type").alias("proc_name"), F.lit("integer,text").alias("types"),
        F.when(F.col("idx") == 5, "i,o").otherwise("i,i").alias("modes"), F.when(F.col("idx") == 4, 2).otherwise(1).alias("collisions"),
    ).distinct()


def mixed_dim(f):
    """Entries 1 and 2 in the current format, the others in the older one; none for host 4."""
    idx = F.col("sproc_id") % 10
    old = F.replace("sproc_name", F.lit("i integer, i text"), F.lit("integer, text"))
    return f.table("sprocs").where("sproc_host_id < 4").withColumn("sproc_name", F.when(idx < 3, F.col("sproc_name")).otherwise(old))


def _lists(df):
    return df.select("db", F.array_join("names", ",").alias("names"))


QUERIES = {
    "sproc_deltas": lambda f: P.sproc_deltas(f),
    "active_sprocs": lambda f: P.active_sprocs(f),
    "sproc_series": lambda f: P.sproc_series(f),
    "active_sproc_names": lambda f: P.active_sproc_names(f),
    "top_sprocs_by_avg": lambda f: P.top_sprocs(f, order="avg", limit=3),
    "top_sprocs_by_total": lambda f: P.top_sprocs(f, order="total", limit=3),
    "top_sprocs_by_calls": lambda f: P.top_sprocs(f, order="calls", limit=3),
    "export_top_by_calls": lambda f: _lists(P.export_top_by_calls(f)),
    "export_top_by_runtime": lambda f: _lists(P.export_top_by_runtime(f)),
    "release_pairs": lambda f: P.release_pairs(f, "r24_00_01", "r24_00_03", created=created(f)),
    "release_regressions": lambda f: P.release_regressions(f, "r24_00_01", "r24_00_03", created=created(f), custom=custom_limits(f)),
    "newest_versions": lambda f: P.newest_versions(f.table("sprocs"), "sproc_host_id", "sproc_schema", 1),
    "assign_keys": lambda f: P.assign_keys(observed(f), mixed_dim(f)).drop("sproc_id"),
    "apply_renames": lambda f: P.apply_renames(mixed_dim(f), P.assign_keys(observed(f), mixed_dim(f))),
    "lookup_or_add": lambda f: P.lookup_or_add(
        f.table("tables"), f.table("tables").where("t_schema <> 'tmp_x'"), ["t_host_id", "t_schema", "t_name"], "t_id"
    ).select("t_host_id", "t_schema", "t_name", "is_new", F.when(~F.col("is_new"), F.col("t_id")).alias("t_id")),
}

_D = """with d as (select sp_host_id as host_id, sp_sproc_id, sp_timestamp,
  coalesce(sp_calls - lag(sp_calls) over w, 0) as delta_calls, coalesce(sp_self_time - lag(sp_self_time) over w, 0) as delta_self_time,
  coalesce(sp_total_time - lag(sp_total_time) over w, 0) as delta_total_time
  from sproc_performance_data window w as (partition by sp_sproc_id order by sp_timestamp))"""
_B = _D + f""", b as (select host_id, sp_sproc_id, time_bucket(interval 15 minute, sp_timestamp) as bucket, {big('sum(delta_calls)')} as calls,
  {big('sum(delta_self_time)')} as self_time, {big('sum(delta_total_time)')} as total_time from d group by 1, 2, 3)"""


def _avg(c: str) -> str:
    return f"case when calls > 0 then {rn(f'(cast({c} as double) / nullif(calls, 0))', 2)} else 0 end"


def _top(order: str) -> str:
    return _B + f""", p as (select host_id, replace(sproc_name, '(i integer, i text)', '()') as name, sum(calls) as calls, {big('sum(total_time)')} as t
  from b join sprocs on sproc_id = sp_sproc_id where calls > 0 group by 1, 2),
q as (select *, {rn('(cast(t as double) / calls)', 1)} as a from p),
r as (select *, row_number() over (partition by host_id order by {order} desc, name) as rank from q)
select host_id, rank, name, {big('calls')} as calls, {pretty_ms('t')} as total_time, {pretty_ms('a')} as avg_time from r where rank <= 3"""


def _export(measure: str) -> str:
    return f"""with g as (select host_db_export_name as db, split_part(sproc_name, '(', 1) as n, {measure} as v
  from sproc_performance_data join sprocs on sproc_id = sp_sproc_id join hosts on host_id = sproc_host_id where host_db_export_name is not null group by 1, 2),
r as (select *, row_number() over (partition by db order by v desc, n) as k from g)
select db, string_agg(n, ',' order by k) as names from r where k <= 10 group by 1"""


_PAIRS = f"""with a as (select host_id, host_ui_shortname, sproc_schema, sproc_name, max(sp_calls) as calls2, max(sp_total_time) as proc_total_time
  from sproc_performance_data join sprocs on sp_sproc_id = sproc_id join hosts on host_id = sproc_host_id
  where isodow(sp_timestamp) <= 5 and host_enabled and (sproc_schema like '%r24_00_01' or sproc_schema like '%r24_00_03')
    and sp_timestamp >= (select min(sp_timestamp) from sproc_performance_data join sprocs on sp_sproc_id = sproc_id where sproc_schema like '%r24_00_01')
  group by 1, 2, 3, 4),
b as (select *, {rn('(cast(proc_total_time as double) / calls2)', 2)} as exec_avg2, {big('sum(proc_total_time) over (partition by sproc_schema)')} as global_total_time from a),
c as (select *, lag(exec_avg2) over w as exec_avg1, lag(calls2) over w as calls1 from b
  window w as (partition by host_id, split_part(sproc_schema, '_api_r', 1), sproc_name order by sproc_schema)),
pairs as (select * from c where exec_avg1 is not null)"""

_OBS = """with obs as (select distinct host_id, 'shop_api_r24_00_0' || rel as schema_name, event_type, idx from ev),
names as (select *, event_type || case when idx = 5 then '(i integer, text)' else '(i integer, i text)' end as full_name, event_type || '(integer, text)' as old_name from obs),
dim as (select sproc_id, sproc_host_id, sproc_schema, case when sproc_id % 10 < 3 then sproc_name else replace(sproc_name, 'i integer, i text', 'integer, text') end as sproc_name
  from sprocs where sproc_host_id < 4),
m as (select n.*, k.sproc_id as kid, o.sproc_id as oid from names n
  left join dim k on k.sproc_host_id = host_id and k.sproc_schema = schema_name and k.sproc_name = full_name
  left join dim o on o.sproc_host_id = host_id and o.sproc_schema = schema_name and o.sproc_name = old_name),
asg as (select host_id, schema_name, full_name, old_name, case when kid is not null then 'known' when oid is not null and idx <> 4 then 'renamed' else 'new' end as action,
  coalesce(kid, case when idx <> 4 then oid end) as found_id from m)"""

ORACLE = {
    "sproc_deltas": _D + " select * from d",
    "active_sprocs": _D + f" select host_id, sproc_name, {big('sum(delta_total_time)')} as total_time from d join sprocs on sproc_id = sp_sproc_id group by 1, 2",
    "sproc_series": _B + f" select host_id, sproc_schema, sproc_name as name, bucket, calls, self_time, total_time, {_avg('total_time')} as avg_time, {_avg('self_time')} as avg_self_time from b join sprocs on sproc_id = sp_sproc_id",
    "active_sproc_names": "select distinct sp_host_id as host_id, split_part(sproc_name, '(', 1) as sproc_name from sproc_performance_data join sprocs on sproc_id = sp_sproc_id",
    "top_sprocs_by_avg": _top("a"),
    "top_sprocs_by_total": _top("t"),
    "top_sprocs_by_calls": _top("calls"),
    "export_top_by_calls": _export("count(*)"),
    "export_top_by_runtime": _export("max(sp_total_time) - min(sp_total_time)"),
    "release_pairs": _PAIRS + " select * from pairs",
    "release_regressions": _PAIRS + f""", lim as (select * from (values (1, 'click(i integer, i text)', 1.0, 5.0), (2, 'view(i integer, i text)', -60.0, null)) v(h, n, rt, ct)),
z as (select host_ui_shortname, sproc_schema, split_part(sproc_name, '(', 1) as sproc_name,
  case when exec_avg1 = 0 then 0 else {rn('((exec_avg2 - exec_avg1) * 100 / nullif(exec_avg1, 0))', 2)} end as calltime_change_pct,
  case when global_total_time = 0 then 0 else {rn('(cast(proc_total_time * 100 as double) / nullif(global_total_time, 0))', 2)} end as share_on_total_runtime,
  exec_avg1, exec_avg2, calls1, calls2, case when calls1 = 0 then 0 else {rn('(cast((calls2 - calls1) * 100 as double) / nullif(calls1, 0))', 2)} end as callscount_change_pct,
  coalesce(cast(rt as double), 25) as allowed_runtime_growth_pct, cast(2 as double) as allowed_share_on_total_runtime_pct, ct
  from pairs left join lim on h = host_id and n = sproc_name)
select * exclude (ct) from z where (calltime_change_pct >= allowed_runtime_growth_pct or coalesce(callscount_change_pct >= ct, false))
  and share_on_total_runtime >= allowed_share_on_total_runtime_pct""",
    "newest_versions": "select * from sprocs s where sproc_schema = (select max(t.sproc_schema) from sprocs t where t.sproc_host_id = s.sproc_host_id)",
    "assign_keys": _OBS + " select * from asg",
    "apply_renames": _OBS + """ select sproc_id, sproc_host_id, sproc_schema, coalesce((select max(full_name) from asg where action = 'renamed' and asg.host_id = sproc_host_id and asg.old_name = sproc_name), sproc_name) as sproc_name from dim""",
    "lookup_or_add": "select t_host_id, t_schema, t_name, t_schema = 'tmp_x' as is_new, case when t_schema <> 'tmp_x' then t_id end as t_id from tables",
}
