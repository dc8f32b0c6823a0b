"""Reports on a partitioned store equal those on the frames it was written from, and read only the partitions they need."""

import os
import re

import pytest
from pyspark.sql import functions as F

from counterloom.plans import aggregates, hosts, locks, metrics, procedures, statements, tables
from counterloom.schema import METRICS
from counterloom.sources import store as S
from counterloom.sources.fleet import Fleet

EVENTS = "/root/testdata/sf0.001"
DIMENSIONS = ("hosts", "sprocs", "tables", "indexes")
A, B = "2024-01-05 00:00:00", "2024-01-12 06:00:00"
LOCK_A, LOCK_B = "1995-01-01 00:00:00", "1996-01-01 00:00:00"
START = "2023-12-31 00:00:00"

pytestmark = pytest.mark.skipif(not os.path.isdir(EVENTS), reason="needs the generated tables")


def created(f):
    return f.table("sproc_performance_data").groupBy(F.col("sp_sproc_id").alias("sproc_id")).agg(F.min("sp_timestamp").alias("sproc_created"))


REPORTS = {
    "sproc_load": lambda f: hosts.sproc_load(f, None, A, B),
    "cpu_load": lambda f: hosts.cpu_load(f, 2, A, B),
    "wal_volume": lambda f: hosts.wal_volume(f, None, A, B),
    "db_size_trend": lambda f: hosts.db_size_trend(f, None, A, B),
    "database_stats": lambda f: hosts.database_stats(f, None, A, B),
    "bgwriter_stats": lambda f: hosts.bgwriter_stats(f, None, A),
    "weekly_load_report": lambda f: hosts.weekly_load_report(f, None, A),
    "daily_load": lambda f: hosts.daily_load(f, None, A, B),
    "fleet_overview": lambda f: hosts.fleet_overview(f, f.table("hosts").select("host_id", F.lit(A).cast("timestamp").alias("ts"), F.lit(1).alias("size")).limit(0), f.table("hosts").select(F.lit(0).alias("group_id"), F.lit("g").alias("group_name")).distinct(), B, "5 days"),
    "blocked_counts": lambda f: hosts.blocked_counts(f, LOCK_A, LOCK_B, minutes=60),
    "sproc_deltas": lambda f: procedures.sproc_deltas(f, None, A, B),
    "top_sprocs": lambda f: procedures.top_sprocs(f, None, A, B),
    "export_top_by_calls": lambda f: procedures.export_top_by_calls(f, A, B),
    "release_pairs": lambda f: procedures.release_pairs(f, "1", "2", None, created(f)),
    "top_statements": lambda f: statements.top_statements(f, A, B),
    "statement_report": lambda f: statements.statement_report(f, None, A, B),
    "statement_series": lambda f: statements.statement_series(f, 1, None, A, B),
    "table_series": lambda f: tables.table_series(f, None, None, A, B),
    "table_io_series": lambda f: tables.table_io_series(f, None, None, A, B),
    "top_tables": lambda f: tables.top_tables(f, None, A, B),
    "table_regressions": lambda f: tables.table_regressions(f, A, B),
    "index_series": lambda f: tables.index_series(f, None, None, None, A, B),
    "unused_schemas": lambda f: tables.unused_schemas(f, A, B),
    "schema_usage": lambda f: tables.schema_usage(f, A, B),
    "blocking_report": lambda f: locks.blocking_report(f, LOCK_A, LOCK_B, per="day"),
    "metric_load": lambda f: metrics.load(f, None, A, B),
    "metric_db_size": lambda f: metrics.db_size(f, None, A, B),
    "aggregate_table_size": lambda f: aggregates.aggregate_table_size(f, B, START, aggregates.aggregate_table_size(f, A, START)),
    "aggregate_sproc_load": lambda f: aggregates.aggregate_sproc_load(f, B, START, aggregates.aggregate_sproc_load(f, A, START)),
}


@pytest.fixture(scope="module")
def fleets(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store"))
    frames = Fleet.from_events(spark, EVENTS)
    for name in METRICS:
        if name.startswith("blocking"):
            S.write_locks(frames.table(name), root, name, 1)
        else:
            S.write_samples(frames.table(name), root, name, 1)
    for name in DIMENSIONS:
        frames.table(name).write.parquet(f"{root}/{name}")
    return frames, Fleet.from_store(spark, root)


def rows(df):
    return sorted((str(tuple(r)) for r in df.collect()))


@pytest.mark.parametrize("name", REPORTS)
def test_report_on_store(spark, fleets, name):
    frames, stored = fleets
    df = REPORTS[name](stored)
    assert rows(df) == rows(REPORTS[name](frames))
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scans = [x for x in re.findall(r"Location: \S+ \[[^\]]*\]\n(?:PartitionFilters: \[([^\n]*)\]\n)?", plan)]
    assert any("yyyymm" in x or "yyyyiw" in x for x in scans), plan[:3000]


def test_changed_procedures_on_store(spark, fleets):
    from checks import summaries as C

    frames, stored = fleets
    summary = C.sprocs(frames)
    got = [rows(C.D.changed_sproc_alerts(f, summary, C.changes(frames), C.ignore(frames), C.LIM)) for f in fleets]
    assert got[0] == got[1]


def test_export_in_two_runs_loses_nothing(spark, tmp_path):
    from datetime import datetime, timedelta

    from counterloom.streaming import jobs as J

    df = spark.createDataFrame([(1, datetime(2024, 1, 1) + timedelta(minutes=m)) for m in range(960)], "host int, ts timestamp")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")

    def run(up_to):
        source = J.read_samples(spark, f"{tmp_path}/in", df.schema)
        J.stream_export(source, lambda b: b, "ts", f"{tmp_path}/out", f"{tmp_path}/work", up_to=up_to, fmt="parquet").awaitTermination()
        return spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out")

    assert run("2024-01-01 10:41:00").count() == 642
    assert run("2024-01-01 12:00:00").count() == 721
    last = run("2024-01-03 00:00:00")
    assert last.count() == 960 and last.distinct().count() == 960
    assert run("2024-01-04 00:00:00").count() == 960


@pytest.mark.parametrize("bounds", [(None, "2024-01-01 02:00:00", None), ("2024-01-01 03:00:00", "2024-01-01 01:00:00", "2024-01-01 04:00:00", "2024-01-09"), (None, "2024-01-01 01:00:00", "2024-01-01 02:00:00", "2024-01-09")])
def test_export_with_bounds_in_any_order(spark, tmp_path, bounds):
    from datetime import datetime, timedelta

    from counterloom.streaming import jobs as J

    df = spark.createDataFrame([(k, datetime(2024, 1, 1) + timedelta(minutes=m)) for k in range(len(bounds)) for m in range(0, 300, 10)], "run int, ts timestamp")
    for k, up_to in enumerate(bounds):  # every run finds new files, of the same times
        df.where(f"run = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = J.read_samples(spark, f"{tmp_path}/in", df.schema)
        J.stream_export(source, lambda b: b, "ts", f"{tmp_path}/out", f"{tmp_path}/work", up_to=up_to, fmt="parquet").awaitTermination()
        top = datetime.fromisoformat(up_to or "9999-01-01")
        got = sorted(map(tuple, spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out").collect()))
        assert len(set(got)) == len(got) and {r for r in map(tuple, df.collect()) if r[0] <= k and r[1] <= top} <= set(got)
    assert got == sorted(map(tuple, df.collect()))
