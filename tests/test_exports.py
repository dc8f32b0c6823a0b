"""Export in chunks that resumes where it ended."""

from datetime import datetime, timedelta

import pytest

from counterloom.plans import exports as E
from counterloom.plans.metrics import export_points
from counterloom.schema import METRICS
from counterloom.sources import store
from counterloom.sources.fleet import Fleet
from counterloom.sources.versions import VersionedTable

T0 = datetime(2024, 1, 1)
LOAD = METRICS["host_load"].struct()


def sample(minutes, host=1, mb=0):
    values = {"load_timestamp": T0 + timedelta(minutes=minutes), "load_host_id": host, "xlog_location_mb": mb}
    return tuple(values.get(f.name, 100) for f in LOAD.fields)


def fleet(spark, samples):
    hosts = spark.createDataFrame([(1, "a", "sa"), (2, "b", "sb"), (3, "c", "sc")], "host_id int, host_name string, host_ui_shortname string")
    return Fleet.from_frames(spark, {"host_load": spark.createDataFrame(samples, LOAD), "hosts": hosts})


def points(df):
    return sorted((r["tags"]["dbname"], r["time"], r["fields"]["xlog_b_1h_rate"], r["fields"]["min1"]) for r in df.collect())


def test_plan_of_the_next_chunk(spark):
    now = T0 + timedelta(days=20)
    hosts = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 4, None)], "host_id int")
    done = spark.createDataFrame([(1, now - timedelta(days=10)), (2, now - timedelta(days=1)), (3, now - timedelta(seconds=10))], "host_id int, exported_to timestamp")
    got = {r[0]: (r[1], r[2]) for r in E.plan_chunks(hosts, done, now, first_days=2).collect()}
    assert got == {
        1: (now - timedelta(days=10), now - timedelta(days=7)),
        2: (now - timedelta(days=1), now - timedelta(seconds=10)),
        4: (now - timedelta(days=2), now - timedelta(seconds=10)),
    }  # the third is up to date


def test_chunks_equal_one_run_with_the_delta_at_each_edge(spark, tmp_path):
    samples = [sample(h * 60 + 7 * host, host, h * h + host) for host in (1, 2) for h in range(0, 15 * 24, 2)]
    f, table, now = fleet(spark, samples), VersionedTable(spark, str(tmp_path / "load")), T0 + timedelta(days=14, hours=5)
    want = points(export_points("load", f, None, T0 + timedelta(hours=5), now - timedelta(seconds=10), "4 hours"))
    assert points(E.catch_up(f, "load", table, now, first_days=14)) == want and len(want) > 300
    assert table.head()[0] == 5 and points(E.catch_up(f, "load", table, now)) == want  # nothing is left


def test_a_host_behind_and_a_gap_without_samples(spark, tmp_path):
    table, now = VersionedTable(spark, str(tmp_path / "load")), T0 + timedelta(days=12)
    early = [sample(m, 1, m) for m in range(0, 600, 60)]
    E.catch_up(fleet(spark, early), "load", table, T0 + timedelta(hours=9, seconds=10), first_days=1)
    # after eleven days of silence samples come again; the one at the end of the first run is not written twice
    late = early + [sample(11 * 1440 + m, h, 1000 + m) for h in (1, 2) for m in range(0, 600, 60)]
    got = points(E.catch_up(fleet(spark, late), "load", table, now))
    want = points(export_points("load", fleet(spark, late)))
    begin = (T0 + timedelta(days=11)).timestamp()
    across = [p for p in want if p[0] == "sa" and p[1] == begin]  # its predecessor is further back than the look-back
    assert len(across) == 1 and got == [p for p in want if p not in across]


def test_a_chunk_that_broke_off_is_repeated(spark, tmp_path):
    f = fleet(spark, [sample(h * 60, 1, h) for h in range(200)])
    table, now = VersionedTable(spark, str(tmp_path / "load")), T0 + timedelta(days=8)
    assert E.export_chunk(f, "load", table, now, first_days=8)
    log, table.commit = table.commit, lambda closed: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        E.export_chunk(f, "load", table, now)
    table.commit = log
    assert table.head()[0] == 1 and len(points(table.appended())) == 72
    got = points(E.catch_up(f, "load", table, now))
    assert len(got) == len(set(got)) == 191


def test_a_chunk_reads_its_months_only(spark, tmp_path):
    store.write_samples(spark.createDataFrame([sample(d * 1440, 1, d) for d in range(90)], LOAD), str(tmp_path / "store"), "host_load")
    base = fleet(spark, [sample(0)])
    stored = Fleet(spark, lambda _, name: spark.read.parquet(str(tmp_path / "store" / name)) if name in METRICS else base.table(name))
    low = T0 + timedelta(days=62)
    chunks = spark.createDataFrame([(1, low, low + timedelta(days=3))], "host_id int, chunk_from timestamp, chunk_to timestamp")
    df = E._within(stored, chunks, low, low + timedelta(days=3), "4 hours").table("host_load")
    plan = df._jdf.queryExecution().toString()
    assert df.count() == 4 and "yyyymm" in plan.split("PartitionFilters:")[1].split("]")[0] and ">= 202403" in plan
