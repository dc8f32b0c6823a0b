import json
from datetime import date, datetime, timedelta
from decimal import Decimal
from types import SimpleNamespace

from pyspark.sql import functions as F

from counterloom.schema import METRICS
from counterloom.session import shared_dir
from counterloom.sources import store as S
from counterloom.sources.fleet import Fleet

SP = METRICS["sproc_performance_data"].struct()


def samples(spark):
    rows = [(datetime(2024, m, 15, 10), h, 7, m * 10, m, m) for m in (1, 2, 3) for h in (1, 2)]
    return spark.createDataFrame(rows, SP)


def test_partitioned_store_is_pruned_by_month_and_host(spark, tmp_path):
    S.write_samples(samples(spark), str(tmp_path), "sproc_performance_data")
    S.write_samples(samples(spark).limit(0), str(tmp_path), "sproc_performance_data")
    fleet = Fleet.from_store(spark, str(tmp_path))
    df = fleet.samples("sproc_performance_data", 2, "2024-02-01 00:00:00", "2024-02-28 00:00:00", "1 day")
    assert [tuple(r)[:3] for r in df.select(*SP.names).collect()] == [(datetime(2024, 2, 15, 10), 2, 7)]
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    filters = next(line for line in plan.splitlines() if line.startswith("PartitionFilters"))
    assert "yyyymm" in filters and "host_id" in filters
    assert "PushedFilters: [" in plan and "GreaterThan(sp_timestamp" in plan


def test_lock_rows_go_to_iso_weeks(spark, tmp_path):
    df = spark.createDataFrame([(1, datetime(2024, 12, 30), 5), (1, datetime(2023, 1, 1), 6)], "bl_host_id int, bl_timestamp timestamp, pid int")
    S.write_locks(df, str(tmp_path))
    back = spark.read.parquet(f"{tmp_path}/blocking_locks")
    assert {r["yyyyiw"] for r in back.collect()} == {202501, 202252}
    old = S.expired_weeks(back, datetime(2025, 1, 15), 4)
    assert [r[0] for r in old.collect()] == ["202252"]


def test_expired_months(spark):
    df = spark.createDataFrame([("202401",), ("202402",), ("202407",)], "yyyymm string")
    assert [r[0] for r in S.expired_partitions(df, as_of=date(2024, 8, 1), months=6).collect()] == ["202401"]
    assert S.expired_partitions(df, cutoff="202408").count() == 3


def test_conform_fills_missing_columns(spark):
    old = spark.createDataFrame([(3, 9)], "sbd_host_id int, sbd_checkpoints_timed int")
    row = S.conform(old, "stat_bgwriter_data").first()
    assert row["sbd_timestamp"] == datetime(1970, 1, 1) and row["sbd_buffers_alloc"] == 0 and row["sbd_checkpoints_timed"] == 9


def test_json_rows(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 2, 3, 4, 5, 678), Decimal("1.50"), None)], "t timestamp, d decimal(9,2), n int")
    assert json.loads(S.to_json_rows(df).first()[0]) == {"t": "2024-01-02 03:04:05", "d": "1.50", "n": None}


def test_points_are_written_by_measurement(spark, tmp_path):
    df = spark.createDataFrame([("h1", 5, datetime(2024, 1, 1))], "host string, v int, ts timestamp")
    S.write_points(S.to_points(df, "load", ["host"], ["v"], "ts"), str(tmp_path / "p"))
    row = spark.read.json(str(tmp_path / "p")).first()
    assert (row["measurement"], row["tags"]["host"], row["fields"]["v"], row["time"]) == ("load", "h1", 5, 1704067200)


def test_resume_point_falls_back(spark):
    stored = spark.createDataFrame([(1, datetime(2024, 1, 5))], "h int, ts timestamp")
    known = spark.createDataFrame([(1,), (2,)], "h int")
    got = {r["h"]: r["resume_from"] for r in S.resume_point(stored, ["h"], "ts", known, datetime(2024, 1, 10), 3).collect()}
    assert got == {1: datetime(2024, 1, 5), 2: datetime(2024, 1, 7)}


def test_shared_dir_prefers_the_cluster_setting(spark):
    class Conf:
        def get(self, key, default=None):
            return "/shared/ckpt/" if key == "spark.checkpoint.dir" else default

    assert shared_dir(SimpleNamespace(conf=Conf())) == "/shared/ckpt"
    assert shared_dir(spark) != "/shared/ckpt"


def test_samples_bounds_are_open_and_closed(spark):
    fleet = Fleet.from_frames(spark, {"sproc_performance_data": samples(spark)})
    t = datetime(2024, 2, 15, 10)
    assert fleet.samples("sproc_performance_data", None, t, t + timedelta(days=60)).count() == 2
    assert fleet.samples("sproc_performance_data", None, None, t).count() == 4
    assert fleet.samples("sproc_performance_data", None, t, None, "1 minute").agg(F.count("*")).first()[0] == 4
