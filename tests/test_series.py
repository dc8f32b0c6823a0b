import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from counterloom.operators import series as B
from counterloom.schema import Reset

T0 = datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp, c bigint"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


EDGES = [("a", at(0), 10), ("a", at(15), 10), ("a", at(30), 25), ("a", at(45), 5), ("a", at(1500), 9), ("b", at(3), 7), ("n", at(0), None), ("n", at(15), 4)]


@pytest.mark.parametrize("policy, want", [
    (Reset.DROP_NOT_POSITIVE, {"a": [15, 4]}),
    (Reset.DROP_NEGATIVE, {"a": [0, 15, 4]}),
    (Reset.RAW, {"a": [0, 0, 15, -20, 4], "b": [0], "n": [0, 0]}),
    (Reset.RESTART, {"a": [None, 0, 15, 5, 4], "b": [None], "n": [None, None]}),
])
def test_reset_policies(spark, policy, want):
    for chunk in ("day", None):
        rows = B.counter_delta(frame(spark, EDGES), ["k"], "ts", ["c"], policy, chunk=chunk).orderBy("k", "ts").collect()
        got = {}
        for r in rows:
            got.setdefault(r["k"], []).append(r["d_c"])
        assert got == want


def test_clamp_and_zero_if_lower(spark):
    for policy in (Reset.CLAMP_ZERO, Reset.ZERO_IF_LOWER):
        got = [r["d_c"] for r in B.counter_delta(frame(spark, EDGES[:5]), ["k"], "ts", ["c"], policy).orderBy("ts").collect()]
        assert got == [0, 0, 15, 0, 4]


def test_window_range_is_an_aggregate(spark):
    assert B.counter_range(frame(spark, EDGES[:5]), ["k"], ["c"]).first()["d_c"] == 20
    with pytest.raises(ValueError):
        B.counter_delta(frame(spark, EDGES), ["k"], "ts", ["c"], Reset.WINDOW_RANGE)


def test_chunked_previous_equals_plain_window(spark):
    """A hot series over many days, with days missing, next to sparse ones."""
    rng = random.Random(7)
    rows = [("hot", at(5 * i), rng.randint(0, 999)) for i in range(3000) if not 400 < i < 1200]
    rows += [(f"k{j}", at(rng.randint(0, 15000) + j / 100), j) for j in range(300)]
    df = frame(spark, rows).repartition(5)
    chunked = B.with_previous(df, ["k"], "ts", ["c"]).collect()
    plain = B.with_previous(df, ["k"], "ts", ["c"], chunk=None).collect()
    assert sorted(map(str, chunked)) == sorted(map(str, plain))


def test_sum_of_restart_deltas_of_monotone_counter(spark):
    rng = random.Random(3)
    total, rows = 0, []
    for i in range(500):
        total += rng.randint(0, 50)
        rows.append(("m", at(37 * i), total))
    d = B.counter_delta(frame(spark, rows), ["k"], "ts", ["c"], Reset.RESTART)
    assert d.agg(F.sum("d_c")).first()[0] == rows[-1][2] - rows[0][2]


def test_empty_input(spark):
    assert B.counter_delta(frame(spark, []), ["k"], "ts", ["c"], Reset.RAW).count() == 0


def test_first_nonzero_baseline(spark):
    rows = [("a", at(15 * i), v) for i, v in enumerate([0, 0, 50, 60, 55, 70])]
    got = [r["d_c"] for r in B.delta_after_first_nonzero(frame(spark, rows), ["k"], "ts", ["c"]).orderBy("ts").collect()]
    assert got == [0, 0, 0, 10, 0, 15]


def test_skip_two_points_after_a_hole(spark):
    rows = [("a", at(m), m) for m in (0, 15, 60, 75, 90, 105)]
    got = [r["c"] for r in B.skip_after_gap(frame(spark, rows), ["k"], "ts").orderBy("ts").collect()]
    assert got == [0, 15, 90, 105]


def test_fill_gaps(spark):
    keys = spark.createDataFrame([("a",), ("b",)], "k string")
    df = B.fill_gaps(frame(spark, [("a", at(15), 3)]), keys, "ts", T0, at(45), "15 minutes", {"c": 0})
    assert [(r["k"], r["c"]) for r in df.orderBy("k", "ts").collect()] == [("a", 0), ("a", 3), ("a", 0), ("b", 0), ("b", 0), ("b", 0)]


def test_changed_only_keeps_first_and_null_changes(spark):
    rows = [("a", at(0), None), ("a", at(5), None), ("a", at(10), 1), ("a", at(15), 1), ("a", at(1500), 1), ("a", at(1505), 2)]
    got = [r["ts"] for r in B.changed_only(frame(spark, rows), ["k"], "ts", ["c"]).orderBy("ts").collect()]
    assert got == [at(0), at(10), at(1505)]
