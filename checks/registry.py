"""All queries and oracles, by name."""

from __future__ import annotations

import importlib
from functools import partial

from pyspark.sql import functions as F

from counterloom.sources.fleet import Fleet

from .harness import with_adapters

MODULES = ("hosts", "procedures", "statements", "tables", "locks", "summaries", "metrics", "primitives", "functions", "streams")


def _modules():
    for m in MODULES:
        try:
            yield importlib.import_module(f"checks.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"checks.{m}":
                raise


def _run(fn, spark, sf_dir):
    """A query's result; dates become text, whose form does not depend on the client."""
    df = fn(Fleet.from_events(spark, sf_dir))
    return df.withColumns({n: F.col(n).cast("string") for n, t in df.dtypes if t == "date"})


def _date_column(name):
    """The date column of an oracle's result, if it has one."""
    fixed = {
        "hourly_sproc_summary": "ss_date", "stream_summary": "ss_date", "sproc_history": "ss_date",
        "daily_table_summary": "ts_date", "daily_host_summary": "hs_date", "stored_hourly_sproc_summary": "ss_date",
        "stored_daily_table_summary": "ts_date", "stored_daily_host_summary": "hs_date", "shard_differences": "eval_date",
        "join_self_previous": "d",
    }
    if "_alerts" in name and not name.startswith("changed_"):
        return "eval_date"
    return fixed.get(name)


def _oracle(name, sql):
    sql, date = with_adapters(sql), _date_column(name)
    return sql if date is None else f"select * replace (cast({date} as varchar) as {date}) from ({sql}) q"


def all_queries():
    return {name: partial(_run, fn) for m in _modules() for name, fn in m.QUERIES.items()}


def all_oracles():
    return {name: _oracle(name, sql) for m in _modules() for name, sql in m.ORACLE.items()}
