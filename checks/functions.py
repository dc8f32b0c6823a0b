"""Column functions over whole tables, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from counterloom.functions import numbers as N
from counterloom.functions import text as X
from counterloom.functions import times as T

from .harness import pretty_count, pretty_ms, pretty_size, r0, rn


def _orders(f):
    return f.table("orders")


def _wal(f):
    o = _orders(f)
    hi = F.hex(F.col("o_orderkey"))
    lo = F.hex((F.col("o_custkey") * 7919 + F.col("o_orderkey") * 104729) % F.lit(4294967296))
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 50 != 0, F.concat(hi, F.lit("/"), lo)).alias("location"))


def _signatures(f):
    p = f.table("part").select(
        "p_partkey", F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("name"),
        F.when(F.col("p_size") % 10 != 0, F.lower(F.replace("p_type", F.lit(" "), F.lit(",")))).otherwise(F.lit("")).alias("types"),
        F.when(F.col("p_size") % 3 == 0, F.lit("")).when(F.col("p_size") % 3 == 1, F.lit("i,o,o")).otherwise(F.lit("o")).alias("modes"),
    )
    return p.select("p_partkey", X.signature(F.col("name"), F.col("types"), F.col("modes")).alias("full_name"),
                    X.signature_unmarked(F.col("name"), F.col("types")).alias("old_name"))


def _dates(f):
    ts = F.col("ts").cast("timestamp")
    return f.table("events").select(
        "event_id", T.epoch_s(ts).alias("epoch"), F.hour(ts).alias("hour"), F.minute(ts).alias("minute"), T.iso_year(ts).alias("iso_year"),
        T.iso_week(ts).alias("week"), T.month_key(ts).alias("month"), T.week_key(ts).alias("week_key"), T.is_weekday(ts).alias("weekday"),
        T.bucket(ts, "hour").alias("b_hour"), T.bucket(ts, "day").alias("b_day"), T.bucket(ts, "week").alias("b_week"), T.bucket(ts, "month").alias("b_month"),
        F.date_format(ts, "dd.MM.yyyy").alias("shown"), T.release_label(ts).alias("release"),
    )


def _numbers(f):
    li = f.table("lineitem")
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return li.select(
        "l_orderkey", "l_linenumber", N.half_up(p).alias("whole"), N.half_up(-p, 1).alias("tenth"), N.half_up(p / q, 2).alias("cents"),
        N.pct_change(q, F.col("l_tax") * 1000).alias("change"), N.pct_over(p, q * 900).alias("over"),
        N.hit_pct(F.col("l_suppkey"), F.col("l_partkey") - F.col("l_partkey") % 7, 1).alias("hits"),
        N.ratio(F.col("l_discount"), F.col("l_tax")).isNull().alias("undefined"),
        N.normalise(F.col("l_partkey"), q * 60).alias("per_period"), N.half_up(N.avg_per_call(F.col("l_partkey"), F.col("l_suppkey"), 1000), 2).alias("per_call"),
    )


QUERIES = {
    "fn_proc_names": lambda f: f.table("sprocs").select(
        "sproc_id", X.proc_base_name(F.col("sproc_name")).alias("base"), X.proc_short_name(F.col("sproc_name")).alias("short"),
        X.strip_version(F.col("sproc_schema")).alias("family")),
    "fn_normalise_query": lambda f: f.table("documents").select(
        "doc_id", F.md5(X.normalise_query(F.translate("text", "ßİ", "  "))).alias("digest"), F.length(X.clip(F.ltrim("text"), 60, "...")).alias("shown")),
    "fn_normalise_statements": lambda f: f.table("stat_statements_data").select(
        "ssd_host_id", "ssd_query_id", "ssd_timestamp", X.clip(X.normalise_query(F.col("ssd_query")), 55).alias("query")),
    "fn_full_name": lambda f: f.table("tables").select(X.full_name(F.col("t_schema"), F.col("t_name")).alias("full"), "t_host_id").select(
        "t_host_id", "full", X.split_full_name(F.col("full"))[0].alias("s"), X.split_full_name(F.col("full"))[1].alias("t")),
    # a product of three keys leaves 64 bits where they are large
    "fn_pretty_size": lambda f: _orders(f).select("o_orderkey", N.pretty_size((F.col("o_orderkey").cast("decimal(38,0)") * F.col("o_orderkey") * F.col("o_custkey")) - 5000).alias("size")),
    "fn_pretty_count": lambda f: _orders(f).select("o_orderkey", N.pretty_count((F.col("o_orderkey") * F.col("o_custkey") * 97) - 900).alias("count")),
    "fn_pretty_ms": lambda f: _orders(f).select("o_orderkey", N.pretty_ms(F.col("o_totalprice") * F.col("o_orderkey") / 1000).alias("time"), N.pretty_ms(F.col("o_totalprice") / F.lit(1e6)).alias("short")),
    "fn_wal_mb": lambda f: _wal(f).select("o_orderkey", X.wal_mb(F.col("location")).alias("mb")),
    "fn_signature": _signatures,
    "fn_query_hash": lambda f: f.table("stat_statements_data").select("ssd_query").distinct().select("ssd_query", X.query_hash(F.col("ssd_query")).alias("query_id")),
    "fn_query_hash_documents": lambda f: f.table("documents").select("doc_id", X.query_hash(F.col("text")).alias("h")),
    "fn_settings": lambda f: f.table("host_settings").select(
        "host_id", F.coalesce(X.settings_map(F.col("settings"))["loadGatherInterval"], F.lit(-1)).alias("load_interval"),
        X.feature_on(F.col("settings"), "loadGatherInterval").alias("load_on"), X.feature_on(F.col("settings"), "nope").alias("unknown_on"),
        F.array_join(X.active_features(F.col("settings")), ",").alias("active")),
    "fn_set_setting": lambda f: f.table("host_settings").select(
        "host_id", X.set_setting(F.col("settings"), "loadGatherInterval", 77).alias("changed"), X.set_setting(F.col("settings"), "newKey", 5).alias("added"),
        X.update_setting(F.col("settings"), "newKey", 5).alias("unchanged")),
    "fn_date_parts": _dates,
    "fn_numbers": _numbers,
    "fn_group_date": lambda f: f.table("events").select(
        "event_id", *(T.group_date(F.col("ts").cast("timestamp"), m).alias(f"b{m}") for m in (5, 7, 10, 15, 30))),
}

_HI = "printf('%X', o_orderkey)"
_LO = "(o_custkey * 7919 + o_orderkey * 104729) % 4294967296"


def _b(m: int) -> str:
    return f"date_trunc('hour', ts) + cast(minute(ts) // {m} * {m} as int) * interval '1' minute as b{m}"


_SZ = "((o_orderkey * o_orderkey * o_custkey) - 5000)"
_CT = "((o_orderkey * o_custkey * 97) - 900)"
_NORM = "lower(ltrim(regexp_replace({0}, '[ \\t\\n\\r]+', ' ', 'g')))"

# the texts hold no characters beyond the basic plane, where a character is one code unit
_HASH = """with f as (select {cols}, list_reduce(list_prepend(cast(0 as hugeint), list_transform(string_split(text, ''), lambda x: cast(unicode(x) as hugeint))), lambda a, b: (a * 31 + b) % 4294967296) as v from {src})
select {cols}, cast(case when v >= 2147483648 then v - 4294967296 else v end as bigint) as {name} from f"""

ORACLE = {
    "fn_proc_names": "select sproc_id, split_part(sproc_name, '(', 1) as base, split_part(sproc_name, '(', 1) || '()' as short, 'shop' as family from sprocs",
    "fn_normalise_query": f"select doc_id, md5({_NORM.format("translate(text, 'ßİ', '  ')")}) as digest, case when length(ltrim(text)) > 60 then 63 else length(ltrim(text)) end as shown from documents",
    "fn_normalise_statements": f"with q as (select ssd_host_id, ssd_query_id, ssd_timestamp, {_NORM.format('ssd_query')} as n from stat_statements_data) select ssd_host_id, ssd_query_id, ssd_timestamp, case when length(n) > 55 then substr(n, 1, 55) || '..' else n end as query from q",
    "fn_full_name": "select t_host_id, t_schema || '.' || t_name as full, t_schema as s, t_name as t from tables",
    "fn_pretty_size": f"select o_orderkey, {pretty_size(_SZ)} as size from orders",
    "fn_pretty_count": f"select o_orderkey, {pretty_count(_CT)} as count from orders",
    "fn_pretty_ms": f"select o_orderkey, {pretty_ms('(o_totalprice * o_orderkey / 1000)')} as time, {pretty_ms('(o_totalprice / 1000000.0)')} as short from orders",
    "fn_wal_mb": f"""select o_orderkey, case when o_orderkey % 50 = 0 then 0 else greatest((o_orderkey * 256 + ({_LO}) // 16777216) * 16 + (({_LO}) % 16777216) // 1000000 - 16, 0) end as mb from orders""",
    "fn_signature": """with p as (select p_partkey, lower(replace(p_brand, '#', '_')) as name, lower(p_type) as t, p_size from part),
s as (select *, case when p_size % 10 = 0 then [] else string_split(t, ' ') end as l from p)
select p_partkey, name || '(' || coalesce(array_to_string(list_transform(l, lambda x, i: case when (p_size % 3 = 1 and i > 1) or (p_size % 3 = 2 and i = 1) then x else 'i ' || x end), ', '), '') || ')' as full_name,
  name || '(' || coalesce(array_to_string(l, ', '), '') || ')' as old_name from s""",
    "fn_query_hash": _HASH.format(src="(select distinct ssd_query, ssd_query as text from stat_statements_data)", cols="ssd_query", name="query_id"),
    "fn_query_hash_documents": _HASH.format(src="documents", cols="doc_id", name="h"),
    "fn_settings": """select c_custkey as host_id, c_custkey % 3 as load_interval, c_custkey % 3 > 0 as load_on, false as unknown_on,
  concat_ws(',', case when c_custkey % 3 > 0 then 'loadGatherInterval' end, case when c_nationkey % 2 > 0 then 'statDatabaseGatherInterval' end) as active from customer""",
    "fn_set_setting": """with s as (select c_custkey as host_id, c_custkey % 3 as l, '"statDatabaseGatherInterval": ' || c_nationkey % 2 as d, chr(10) as nl from customer)
select host_id, '{' || nl || '"loadGatherInterval": 77,' || nl || d || nl || '}' as changed, '{' || nl || '"loadGatherInterval": ' || l || ',' || nl || d || ',' || nl || '"newKey": 5' || nl || '}' as added,
  '{' || nl || '"loadGatherInterval": ' || l || ',' || nl || d || nl || '}' as unchanged from s""",
    "fn_date_parts": """select event_id, cast(floor(epoch(ts)) as bigint) as epoch, hour(ts) as hour, minute(ts) as minute, isoyear(ts) as iso_year, week(ts) as week, strftime(ts, '%Y%m') as month,
  strftime(ts, '%G%V') as week_key, isodow(ts) <= 5 as weekday, date_trunc('hour', ts) as b_hour, cast(date_trunc('day', ts) as timestamp) as b_day, cast(date_trunc('week', ts) as timestamp) as b_week,
  cast(date_trunc('month', ts) as timestamp) as b_month, strftime(ts, '%d.%m.%Y') as shown, 'r' || strftime(ts, '%y') || '_00_' || strftime(ts, '%V') as release from events""",
    "fn_numbers": f"""select l_orderkey, l_linenumber, {r0('l_extendedprice')} as whole, {rn('(-l_extendedprice)', 1)} as tenth, {rn('(l_extendedprice / l_quantity)', 2)} as cents,
  case when l_quantity = 0 then 0 else {rn('((l_tax * 1000 - l_quantity) * 100 / nullif(l_quantity, 0))', 2)} end as change, {r0('((l_extendedprice / (l_quantity * 900) - 1.0) * 100.0)')} as over,
  case when l_suppkey + l_partkey - l_partkey % 7 > 0 then {rn('(cast(l_suppkey * 100 as double) / (l_suppkey + l_partkey - l_partkey % 7))', 1)} end as hits, l_tax = 0 as undefined,
  case when l_quantity * 60 <= 60 or l_partkey <= 1 then l_partkey else {r0('(l_partkey * 900 / (l_quantity * 60))')} end as per_period, {rn('(cast(l_partkey * 1000 as double) / nullif(l_suppkey, 0))', 2)} as per_call from lineitem""",
    "fn_group_date": f"select event_id, {', '.join(_b(m) for m in (5, 7, 10, 15, 30))} from events",
}
