"""Stored tables that grow by refreshes."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from counterloom.plans import aggregates as A
from counterloom.plans import summaries as S
from counterloom.schema import METRICS
from counterloom.sources import store
from counterloom.sources.fleet import Fleet
from counterloom.sources.versions import VersionedTable, closed_before
from counterloom.streaming import jobs as J

T0 = datetime(2024, 1, 1)
SP = METRICS["sproc_performance_data"].struct()


def at(hours, sproc=1, calls=0, host=1):
    return (T0 + timedelta(hours=hours), host, sproc, calls, calls * 10, calls * 5)


def fleet(spark, samples, metric="sproc_performance_data", schema=SP):
    hosts = spark.createDataFrame([(1, "a"), (2, "b")], "host_id int, host_name string")
    sprocs = spark.createDataFrame([(i, 1 if i < 10 else 2, f"f{i}(x)", "s") for i in (1, 2, 11)], "sproc_id long, sproc_host_id int, sproc_name string, sproc_schema string")
    tables = spark.createDataFrame([(1, 1, "t")], "t_id long, t_host_id int, t_name string")
    return Fleet.from_frames(spark, {metric: spark.createDataFrame(samples, schema), "hosts": hosts, "sprocs": sprocs, "tables": tables})


def rows(df):
    return {(r["ss_host_id"], r["ss_sproc_name"], r["ss_date"].day, r["ss_hour"]): (r["ss_calls"], r["ss_is_final"], r["ss_is_suspect"]) for r in df.collect()}


def test_provisional_periods_are_replaced_and_final_ones_frozen(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "summary"))
    first = [at(0.5, calls=5), at(1.5, calls=9), at(2.2, calls=12)]
    got = rows(S.refresh_hourly_sproc_summary(fleet(spark, first), table, T0 + timedelta(hours=2.5)))
    assert got[1, "f1", 1, 1] == (4, True, False) and got[1, "f1", 1, 2] == (3, False, False)
    assert got[1, S.HOST_TOTAL, 1, 1][0] == 4 and (1, S.HOST_TOTAL, 1, 2) not in got
    assert table.head() == (1, T0 + timedelta(hours=2))
    again = rows(S.refresh_hourly_sproc_summary(fleet(spark, first), table, T0 + timedelta(hours=2.5)))
    assert again == got and table.head()[0] == 2
    # hour 2 goes on, a late sample comes for hour 1
    more = [*first, at(1.9, calls=11), at(2.8, calls=20), at(3.1, calls=21)]
    later = rows(S.refresh_hourly_sproc_summary(fleet(spark, more), table, T0 + timedelta(hours=3.5)))
    assert later[1, "f1", 1, 1] == (4, True, False)  # frozen
    assert later[1, "f1", 1, 2] == (11, True, False)  # from the stored 9
    assert later[1, "f1", 1, 3] == (1, False, False)


def test_a_refresh_that_broke_off_is_repeated(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "summary"))
    data = [at(0.5, calls=5), at(1.5, calls=9), at(2.2, calls=12)]
    S.refresh_hourly_sproc_summary(fleet(spark, data[:2]), table, T0 + timedelta(hours=1.6))
    log = table.commit
    table.commit = lambda closed: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        S.refresh_hourly_sproc_summary(fleet(spark, data), table, T0 + timedelta(hours=2.5))
    table.commit = log
    assert table.head() == (1, T0 + timedelta(hours=1))
    got = rows(S.refresh_hourly_sproc_summary(fleet(spark, data), table, T0 + timedelta(hours=2.5)))
    assert got == rows(S.hourly_sproc_summary(fleet(spark, data), T0 + timedelta(hours=2.5)))


def test_daily_summaries_carry_the_last_final_day(spark, tmp_path):
    m = METRICS["table_size_data"].struct()
    names = [f.name for f in m.fields]

    def sample(day, size):
        values = {"tsd_timestamp": T0 + timedelta(days=day, hours=3), "tsd_host_id": 1, "tsd_table_id": 1, "tsd_table_size": size}
        return tuple(values.get(n, size) for n in names)

    table = VersionedTable(spark, str(tmp_path / "tables"))
    data = [sample(d, s) for d, s in ((0, 10), (1, 14), (2, 20), (3, 31))]

    def refreshed(samples, days):
        df = S.refresh_daily_table_summary(fleet(spark, samples, "table_size_data", m), table, T0 + timedelta(days=days))
        return {r["ts_date"].day: (r["ts_table_size"], r["ts_is_final"]) for r in df.collect()}

    assert refreshed(data[:2], 1.5) == {2: (4, False)}
    # only the carried peaks know the days before: their samples are gone
    assert refreshed(data[2:3] + [sample(1.2, 16)], 2.5) == {2: (6, True), 3: (4, False)}
    assert refreshed([sample(0.1, 99), *data[2:]], 4.5) == {2: (6, True), 3: (4, True), 4: (11, True)}


def test_load_refreshes_read_only_new_samples(spark, tmp_path):
    rng = __import__("random").Random(3)
    samples = sorted({at(rng.randrange(40 * 24 * 12) / 12, rng.choice((1, 1, 2)), rng.randrange(1, 500)) for _ in range(600)} | {at(2, 11, 1, 2)}, key=str)
    samples = list({(r[0], r[2]): r for r in samples}.values())
    store.write_samples(spark.createDataFrame(samples, SP), str(tmp_path / "store"), "sproc_performance_data")
    stored = Fleet(spark, lambda f, name: spark.read.parquet(str(tmp_path / "store" / name)) if name in METRICS else fleet(spark, samples).table(name))
    start, end = "2023-12-31 00:00:00", "2024-02-09 05:33:00"
    want = sorted(map(tuple, A.aggregate_sproc_load(fleet(spark, samples), end, start).collect()))
    table = VersionedTable(spark, str(tmp_path / "load"))
    for as_of in ("2024-01-10 03:22:00", "2024-01-10 03:40:00", "2024-02-03 12:07:00", end):
        got = A.refresh_sproc_load(stored, table, as_of, start)
    assert sorted(map(tuple, got.collect())) == want
    # the last refresh began in February: no folder of January is read
    closed = table.head()[1]
    plan = stored.samples("sproc_performance_data", None, "2024-02-03 11:00:00", closed, closed_start=True)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*yyyymm[^\]]*>= 202402", plan)
    assert sorted(map(tuple, A.refresh_sproc_load(stored, table, end, start).collect())) == want  # nothing new
    assert closed_before(spark, "2024-01-02 00:00:00", "day") == T0 and closed_before(spark, "2024-01-02 00:00:01", "day") == T0 + timedelta(days=1)


def test_streamed_summary_equals_batch(spark, tmp_path):
    data = [at(h / 4, s, 10 * h + s, 2 if s == 11 else 1) for h in range(40) for s in (1, 2, 11)]
    f, table, work = fleet(spark, data), VersionedTable(spark, str(tmp_path / "summary")), str(tmp_path)
    for part, as_of in ((data[:50], None), (data[40:80], None), ([at(0.7, 1, 9999), *data[80:]], T0 + timedelta(days=2))):
        spark.createDataFrame(part, SP).write.mode("append").parquet(f"{work}/in")
        J.stream_summary(J.read_samples(spark, f"{work}/in", SP), f, table, work, as_of).awaitTermination()
    assert rows(table.periods()) == rows(S.hourly_sproc_summary(f, T0 + timedelta(days=2)))  # the late sample of a final hour changes nothing
