from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from counterloom.plans import detectors as D
from counterloom.plans import hosts as H
from counterloom.plans import procedures as P
from counterloom.plans import tables as T
from counterloom.plans.locks import blocking_report, locks_report
from counterloom.schema import METRICS, Reset
from counterloom.sources.fleet import Fleet

T0 = datetime(2024, 1, 1)
HOSTS = "host_id int, host_name string, host_db string, host_group_id int, host_enabled boolean, host_ui_shortname string, host_ui_longname string, host_db_export_name string"
SUMMARY = "ss_host_id int, ss_sproc_name string, ss_date date, ss_hour int, ss_calls bigint, ss_total_time bigint, ss_is_suspect boolean"


def fleet(spark, **frames):
    hosts = [(1, "one.db", "db1", 0, True, "h1", "One", "e1"), (2, "two.db", "db2", 1, True, "h2", "Two", None)]
    return Fleet.from_frames(spark, {"hosts": spark.createDataFrame(hosts, HOSTS), **frames})


def no_ignores(spark):
    return spark.createDataFrame([], "host_id int, object_name string")


def test_load_is_a_two_bucket_sum(spark):
    rows = [(T0 + timedelta(minutes=15 * i), 1, 7, i, v, v) for i, v in enumerate([0, 900_000, 1_800_000, 100_000, 1_000_000])]
    f = fleet(spark, sproc_performance_data=spark.createDataFrame(rows, METRICS["sproc_performance_data"].struct()))
    got = [r["load_15min"] for r in H.sproc_load(f).orderBy("bucket").collect()]
    assert got == [1.0, 2.0, 2.0]  # the reset is dropped, so its bucket is missing
    live = [r["load_15min"] for r in H.sproc_load(f, policy=Reset.RAW).orderBy("bucket").collect()]
    assert live == [0.0, 1.0, 2.0, -0.89, -0.89]


def summary(spark, rows):
    return spark.createDataFrame([(*r, False) for r in rows], SUMMARY)


def weeks(host, name, current, base, hour=10):
    day = datetime(2024, 1, 29).date()
    return [(host, name, day, hour, 10, current), *((host, name, day - timedelta(days=7 * k), hour, 10, base) for k in range(1, 5))]


def test_hourly_alert_fires_above_and_not_at_the_limit(spark):
    lim = D.Limits(min_total_ms=1000)
    for current, hit in ((13_001, True), (13_000, False)):
        out = D.sproc_hourly_alerts(fleet(spark), summary(spark, weeks(1, "f", current, 10_000)), no_ignores(spark), lim, date="2024-01-29", combine=False)
        rows = out.collect()
        assert bool(rows) is hit
        if hit:
            assert (rows[0]["sproc_name"], rows[0]["time_percent_increase"], rows[0]["avg_time"]) == ("f", 30, 1300)


def test_new_heavy_procedure_is_reported_against_one(spark):
    day = datetime(2024, 1, 29).date()
    s = summary(spark, [(1, "new", day, 10, 4, 2_000_000)])
    for combine in (True, False):
        row = D.sproc_hourly_alerts(fleet(spark), s, no_ignores(spark), combine=combine).first()
        assert (row["calls"], row["total_time"], row["time_percent_increase"]) == (4, 2_000_000, 199_999_900)


TABLE_SUMMARY = "ts_host_id int, ts_table_name string, ts_date date, ts_table_size bigint, ts_index_size bigint, ts_seq_scans bigint, ts_index_scans bigint, ts_orig_table_size bigint, ts_orig_index_size bigint"


def test_combined_alerts_of_sums_beyond_64_bits(spark):
    day, big = datetime(2024, 1, 29).date(), 10**12  # bytes: times 100 and a million this leaves 64 bits
    rows = [(1, "t", day - timedelta(days=7 * k), v, v, v, v, v, v) for k, v in enumerate([2 * big, big, big, big, big])]
    s = spark.createDataFrame(rows, TABLE_SUMMARY)
    for by_size in (True, False):
        row = D.table_daily_alerts(fleet(spark), s, no_ignores(spark), by_size=by_size, date="2024-01-29").first()
        assert (row["table_size"], row["percent_increase"]) == (2 * big, 100)
    got = D.table_set_alerts(fleet(spark), s, no_ignores(spark), date="2024-01-29").collect()
    assert len(got) == 4 and {r["percent_increase"] for r in got} == {100}
    assert D.table_set_alerts(fleet(spark), s, no_ignores(spark), D.Limits(percent=100), date="2024-01-29").count() == 0
    calls = summary(spark, weeks(1, "f", 2 * big, big))
    for avg in (True, False):
        assert D.sproc_hourly_alerts(fleet(spark), calls, no_ignores(spark), eval_avg=avg, date="2024-01-29").first()["time_percent_increase"] == 100


def test_ignored_and_quiet_procedures_are_not_reported(spark):
    s = summary(spark, weeks(1, "f", 90_000, 10_000))
    ig = spark.createDataFrame([(1, "f")], "host_id int, object_name string")
    assert D.sproc_hourly_alerts(fleet(spark), s, ig, D.Limits(min_total_ms=1)).count() == 0
    assert D.sproc_hourly_alerts(fleet(spark), s, no_ignores(spark)).count() == 0


def test_new_high_filter(spark):
    found = spark.createDataFrame([(1, "f", datetime(2024, 1, 10).date(), 100)], "h int, n string, d date, v bigint")
    past = [(1, "f", datetime(2024, 1, 10 - i).date(), 200) for i in (1, 2, 9)] + [(1, "f", datetime(2024, 1, 9).date(), 50)]
    p = spark.createDataFrame(past, "h int, n string, d date, v bigint")
    assert D.is_new_high(found, p, ["h", "n"], "d", "v", D.Limits(max_higher_values=3)).count() == 1
    assert D.is_new_high(found, p, ["h", "n"], "d", "v", D.Limits(max_higher_values=2)).count() == 0


def test_release_regression_thresholds(spark):
    sp = METRICS["sproc_performance_data"].struct()
    f = fleet(
        spark,
        sprocs=spark.createDataFrame([(1, 1, "a_api_r1", "f(i int)"), (2, 1, "a_api_r2", "f(i int)")], "sproc_id int, sproc_host_id int, sproc_schema string, sproc_name string"),
        sproc_performance_data=spark.createDataFrame([(T0, 1, 1, 10, 100, 0), (T0, 1, 2, 10, 130, 0)], sp),
    )
    row = P.release_regressions(f, "r1", "r2").first()
    assert (row["sproc_name"], row["calltime_change_pct"], row["share_on_total_runtime"]) == ("f", 30.0, 100.0)
    assert P.release_regressions(f, "r1", "r2", defaults=P.SprocThresholds(runtime_growth_pct=31)).count() == 0


LOCKS = "bl_host_id int, bl_timestamp timestamp, transactionid string, virtualxid string, classid int, objid int, objsubid int, database int, relation int, pid int, granted boolean"
PROCS = "bp_host_id int, bp_timestamp timestamp, pid int, query_start timestamp, waiting boolean, query string"


def test_only_the_root_of_a_blocking_chain_is_reported(spark):
    """3 waits for 2, 2 waits for 1; over 90 seconds."""
    locks, procs = [], []
    for s in (0, 90):
        t = T0 + timedelta(seconds=s)
        for rel, waiter, holder in ((10, 2, 1), (20, 3, 2)):
            locks += [(1, t, None, None, None, None, None, 1, rel, waiter, False), (1, t, None, None, None, None, None, 1, rel, holder, True)]
        procs += [(1, t, pid, T0, pid != 1, f"q{pid}") for pid in (1, 2, 3)]
    f = fleet(spark, blocking_locks=spark.createDataFrame(locks, LOCKS), blocking_processes=spark.createDataFrame(procs, PROCS))
    rows = locks_report(blocking_report(f)).collect()
    assert [(r["host_ui_shortname"], r["blocking_query"], r["total_time_ss"], r["threads_count"], r["one_blocked_query"]) for r in rows] == [("h1", "q1", 90, 1, "q2")]


def test_table_order_menu_is_checked():
    with pytest.raises(ValueError):
        T.table_order(13)


def test_top_tables_without_first_snapshot_counts_from_zero(spark):
    cols = METRICS["table_size_data"].struct()
    rows = [dict.fromkeys(cols.names, 0) | {"tsd_timestamp": T0 + timedelta(hours=h), "tsd_host_id": 1, "tsd_table_id": t, "tsd_table_size": size}
            for h, t, size in ((0, 1, 100), (2, 1, 150), (2, 2, 70))]
    f = fleet(spark, table_size_data=spark.createDataFrame([tuple(r[c] for c in cols.names) for r in rows], cols),
              tables=spark.createDataFrame([(1, 1, "s", "a"), (2, 1, "s", "b")], "t_id int, t_host_id int, t_schema string, t_name string"))
    got = {r["name"]: r["table_size_delta"] for r in T.top_tables(f).collect()}
    assert got == {"a": 50, "b": 70}


def test_duplicate_lists_number_the_names_of_a_group(spark):
    rows = [(1, "s", "t", f"i{n}", f"CREATE {'UNIQUE ' if n % 2 else ''}INDEX i{n} ON s.t USING btree (a)", 1, 1, 0, False, True) for n in range(50)]
    cat = spark.createDataFrame(rows, "host_id int, schema_name string, table_name string, index_name string, index_def string, index_size bigint, table_size bigint, scans bigint, is_unique boolean, is_valid boolean")
    out = T.duplicate_index_lists(cat).orderBy("position").collect()
    assert [r["position"] for r in out] == list(range(1, 51))
    assert [r["index_name"] for r in out] == sorted(f"i{n}" for n in range(50))
