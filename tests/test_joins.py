import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from counterloom.functions import predicates as C
from counterloom.operators import joins as J
from counterloom.operators import topn as G
from counterloom.plans.locks import persistent_waits, prune_locks

T0 = datetime(2024, 1, 1)


def test_overlaps_match_brute_force(spark):
    rng = random.Random(11)

    def spans(n):
        out = []
        for i in range(n):
            s = T0 + timedelta(hours=rng.randint(0, 2000))
            # one key holds most intervals, some span many chunks
            out.append((i, "hot" if rng.random() < 0.7 else f"k{i % 5}", s, s + timedelta(hours=rng.choice([0, 1, 5, 200]))))
        return out

    a, b = spans(250), spans(40)
    schema = "i int, k string, s timestamp, e timestamp"
    got = J.flag_overlaps(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"], "s", "e", "hit").collect()
    want = {x[0]: any(y[1] == x[1] and y[2] <= x[3] and y[3] >= x[2] for y in b) for x in a}
    assert {r["i"]: r["hit"] for r in got} == want
    assert len(got) == len(a)


def test_ignore_list_wildcards(spark):
    df = spark.createDataFrame([(h, n) for h in (1, 2) for n in ("x", "y")], "h int, n string")

    def left(rows):
        ig = spark.createDataFrame(rows, "host_id int, object_name string")
        return sorted((r["h"], r["n"]) for r in J.not_ignored(df, ig, "h", "n").collect())

    assert left([(1, "x")]) == [(1, "y"), (2, "x"), (2, "y")]
    assert left([(None, "x")]) == [(1, "y"), (2, "y")]
    assert left([(2, None)]) == [(1, "x"), (1, "y")]
    assert left([(None, None)]) == []
    assert len(left([])) == 4


LOCK = "bl_host_id int, bl_timestamp timestamp, transactionid string, virtualxid string, classid int, objid int, objsubid int, database int, relation int, pid int, granted boolean"


def same(a, b):
    return (
        (a[2] is not None and a[2] == b[2]) or (a[3] is not None and a[3] == b[3])
        or (None not in a[4:7] and a[4:7] == b[4:7]) or (None not in a[7:9] and a[7:9] == b[7:9])
    )


def random_locks(n, seed):
    rng = random.Random(seed)

    def maybe(v):
        return v if rng.random() < 0.5 else None

    rows = set()
    for _ in range(n):
        rows.add((rng.randint(1, 2), T0 + timedelta(seconds=rng.randint(0, 4)), maybe(f"t{rng.randint(0, 3)}"), maybe(f"v{rng.randint(0, 9)}"),
                  maybe(rng.randint(0, 2)), maybe(1), maybe(0), maybe(1), maybe(rng.randint(0, 5)), rng.randint(1, 12), rng.random() < 0.7))
    return sorted(rows, key=str)


def test_prune_locks_matches_brute_force(spark):
    rows = random_locks(150, 5)
    got = prune_locks(spark.createDataFrame(rows, LOCK)).collect()
    want = [a for a in rows if not a[10] or any(
        not b[10] and b[:2] == a[:2] and b[9] != a[9] and same(a, b) for b in rows)]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_persistent_waits_match_brute_force(spark):
    rows = random_locks(120, 9)
    got = {(r["bl_host_id"], r["bl_timestamp"], r["pid"], r["role"]) for r in persistent_waits(spark.createDataFrame(rows, LOCK)).collect()}
    stamps = {h: sorted({r[1] for r in rows if r[0] == h}) for h in (1, 2)}
    waiting = [r for r in rows if not r[10]]
    waiters = set()
    for a in waiting:
        i = stamps[a[0]].index(a[1])
        if i and any(b[0] == a[0] and b[1] == stamps[a[0]][i - 1] and b[9] == a[9] and same(a, b) for b in waiting):
            waiters.add((a[0], a[1], a[9]))
    want = {(*w, "waiter") for w in waiters}
    for b in waiting:
        if (b[0], b[1], b[9]) in waiters:
            want |= {(a[0], a[1], a[9], "blocker") for a in rows if a[:2] == b[:2] and a[9] != b[9] and same(a, b)}
    assert got == want


def test_like_none_with_nulls_and_many_patterns(spark):
    df = spark.createDataFrame([("tmp_a",), ("data",), ("x_tmp",), (None,), ("",), ("a%b",)], "s string")
    for filler in (0, 3000):
        pats = spark.createDataFrame([("tmp%",), ("d_ta",), (None,), ("a\\%b",), *((f"zz{i}%",) for i in range(filler))], "p string")
        assert sorted(r[0] for r in C.like_none(df, "s", pats).collect()) == ["", "x_tmp"]
    assert C.like_none(df, "s", spark.createDataFrame([("%",)], "p string")).count() == 0
    assert C.like_none(df, "s", pats.limit(0)).count() == 5


def test_schema_filter_uses_defaults_only_without_own_rules(spark):
    df = spark.createDataFrame([(1, "tmp_x"), (1, "data"), (2, "tmp_x"), (2, "data")], "h int, s string")
    conf = spark.createDataFrame([(0, "%", True), (0, "tmp%", False), (2, "tmp%", True)], "host_id int, pattern string, included boolean")
    got = sorted((r["h"], r["s"]) for r in C.schema_filter(df, conf, "h", "s").collect())
    assert got == [(1, "data"), (2, "tmp_x")]


def test_top_per_mode_and_grand_total(spark):
    df = spark.createDataFrame([("g", i, i % 3) for i in range(9)], "g string, a int, b int")
    top = G.top_per_mode(df, {"a": F.col("a"), "b": F.when(F.col("b") > 0, F.col("b"))}, ["g"], ["a"], 2)
    assert sorted((r["mode"], r["a"]) for r in top.collect()) == [("a", 7), ("a", 8), ("b", 2), ("b", 5)]
    assert {r["t"] for r in G.grand_total(df, F.col("a"), "t").collect()} == {36}
