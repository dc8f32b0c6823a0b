"""Run queries on Spark and their oracles on DuckDB and compare whole results.

    python -m checks.compare [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import time

import duckdb
from pyspark.sql import SparkSession

from .harness import BASE_TABLES
from .registry import all_oracles, all_queries


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return repr(round(float(v), 6))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return None, len(rows), took, "no oracle"
    rel = con.execute(sql)
    ocols = [d[0] for d in rel.description]
    orows = rel.fetchall()
    if sorted(cols) != sorted(ocols):
        return False, len(rows), took, f"columns {sorted(cols)} vs {sorted(ocols)}"
    a, b = rows_of(cols, rows), rows_of(ocols, orows)
    if a == b:
        return True, len(rows), took, ""
    only_a = [x for x in a if x not in set(b)][:2]
    only_b = [x for x in b if x not in set(a)][:2]
    return False, len(rows), took, f"{len(a)} vs {len(b)} rows; {sorted(cols)}; spark {only_a}; oracle {only_b}"


def connect(sf_dir):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def main():
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="/root/testdata/sf0.01")
    p.add_argument("names", nargs="*")
    a = p.parse_args()
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(a.sf), all_oracles(), 0
    for name, fn in all_queries().items():
        if a.names and not any(name.startswith(n) for n in a.names):
            continue
        try:
            ok, n, took, msg = compare(spark, con, name, fn, oracles.get(name), a.sf)
        except Exception as e:  # report and go on with the next query
            ok, n, took, msg = False, -1, 0.0, f"{type(e).__name__}: {str(e)[:900]}"
        bad += ok is False
        print(f"{'ok ' if ok else 'ROW' if ok is None else 'BAD'} {name:38s} {n:8d} {took:6.2f}s {msg}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
