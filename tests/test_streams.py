import random
from datetime import datetime, timedelta

from counterloom.operators.series import counter_delta
from counterloom.schema import METRICS, Reset
from counterloom.streaming import jobs as J

T0 = datetime(2024, 1, 1)
SCHEMA = METRICS["sproc_performance_data"].struct()
COLS = ["sp_calls", "sp_total_time"]


def rows(n, seed):
    rng = random.Random(seed)
    seen = set()
    while len(seen) < n:
        seen.add((T0 + timedelta(minutes=5 * rng.randint(0, 3000)), 1, 1 if rng.random() < 0.6 else rng.randint(2, 9)))
    return [(*r, rng.randint(0, 100), rng.randint(0, 100), 0) for r in sorted(seen)]


def read(spark, path):
    return spark.read.option("recursiveFileLookup", "true").parquet(path)


def test_stream_deltas_equal_batch_deltas(spark, tmp_path):
    data, work = rows(400, 1), str(tmp_path)
    for part in (data[:150], data[150:160], data[160:]):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(f"{work}/in")
        src = J.read_samples(spark, f"{work}/in", SCHEMA)
        J.stream_delta(src, "sproc_performance_data", COLS, Reset.RESTART, f"{work}/out", work).awaitTermination()
    want = counter_delta(spark.createDataFrame(data, SCHEMA), ["sp_host_id", "sp_sproc_id"], "sp_timestamp", COLS, Reset.RESTART)
    names = ["sp_timestamp", "sp_sproc_id", "d_sp_calls", "d_sp_total_time", "elapsed_s"]
    assert sorted(map(str, read(spark, f"{work}/out").select(*names).collect())) == sorted(map(str, want.select(*names).collect()))


def test_old_samples_are_ignored_and_silent_series_restart(spark, tmp_path):
    work = str(tmp_path)

    def deliver(part):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(f"{work}/in")
        src = J.read_samples(spark, f"{work}/in", SCHEMA)
        J.stream_delta(src, "sproc_performance_data", COLS, Reset.RAW, f"{work}/out", work, ttl="4 hours").awaitTermination()

    deliver([(T0 + timedelta(hours=1), 1, 1, 10, 10, 0), (T0 + timedelta(hours=1), 1, 2, 10, 10, 0)])
    deliver([(T0, 1, 1, 5, 5, 0), (T0 + timedelta(hours=2), 1, 1, 14, 14, 0)])
    deliver([(T0 + timedelta(hours=9), 1, 2, 99, 99, 0), (T0 + timedelta(hours=4), 1, 1, 15, 15, 0)])  # silent for eight hours, and for two
    got = sorted((r["sp_sproc_id"], r["sp_timestamp"].hour, r["d_sp_calls"]) for r in read(spark, f"{work}/out").collect())
    assert got == [(1, 1, 0), (1, 2, 4), (1, 4, 1), (2, 1, 0), (2, 9, 0)]


def test_changed_samples_only_across_batches(spark, tmp_path):
    work = str(tmp_path)
    for part in ([(1, 1, 5), (2, 1, 5), (1, 2, 7)], [(3, 1, 5), (4, 1, 6)], [(5, 1, 6), (2, 2, 7), (6, 2, 8)]):
        df = spark.createDataFrame([(T0 + timedelta(hours=h), 1, s, v, v, 0) for h, s, v in part], SCHEMA)
        df.write.mode("append").parquet(f"{work}/in")
        J.stream_changed_only(J.read_samples(spark, f"{work}/in", SCHEMA), "sproc_performance_data", COLS, f"{work}/out", work).awaitTermination()
    got = sorted((r["sp_sproc_id"], r["sp_timestamp"].hour, r["sp_calls"]) for r in read(spark, f"{work}/out").collect())
    assert got == [(1, 1, 5), (1, 4, 6), (2, 1, 7), (2, 6, 8)]


def test_state_of_silent_series_is_dropped(spark, tmp_path):
    """The state store keeps as many series as have reported within the time to live."""
    work = str(tmp_path)
    for hours, series in ((1, range(1, 40)), (2, (1, 2)), (12, (1, 2)), (13, (1,))):
        spark.createDataFrame([(T0 + timedelta(hours=hours), 1, s, 1, 1, 0) for s in series], SCHEMA).write.mode("append").parquet(f"{work}/in")
        q = J.stream_delta(J.read_samples(spark, f"{work}/in", SCHEMA), "sproc_performance_data", COLS, Reset.RAW, f"{work}/out", work, ttl="4 hours")
        q.awaitTermination()
    left = spark.read.format("statestore").option("stateVarName", "last").load(f"{work}/checkpoint")
    assert sorted(r["key"]["sp_sproc_id"] for r in left.collect()) == [1, 2]


def test_snapshots_close_by_time_and_take_late_rows(spark, tmp_path):
    m = METRICS["blocking_locks"].struct()
    names = [f.name for f in m.fields]

    def lock(minute, pid, host=1):
        values = {"bl_timestamp": T0 + timedelta(minutes=minute), "bl_host_id": host, "pid": pid}
        return tuple(values.get(n) for n in names)

    work, seen = str(tmp_path), []

    def run(part):
        spark.createDataFrame(part, m).write.mode("append").parquet(f"{work}/in")
        J._snapshot_job(J.read_samples(spark, f"{work}/in", m), lambda df: df, f"{work}/out", work, True, "5 minutes").awaitTermination()
        got = read(spark, f"{work}/out")
        return sorted((r["bl_host_id"], r["bl_timestamp"].minute, r["n"]) for r in got.groupBy("bl_host_id", "bl_timestamp").count().withColumnRenamed("count", "n").collect())

    assert run([lock(0, 1), lock(1, 1)]) == []
    assert run([lock(1, 2), lock(4, 1)]) == []  # late, but within the delay
    assert run([lock(20, 9, 2)]) == [(1, 0, 1), (1, 1, 2), (1, 4, 1)]  # another host's time closes the last one
    assert run([lock(1, 3), lock(40, 9, 2)]) == [(1, 0, 1), (1, 1, 2), (1, 4, 1), (2, 20, 1)]  # too late
