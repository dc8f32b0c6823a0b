from pyspark.sql import functions as F

import checks.functions
from counterloom.functions import numbers as N
from counterloom.functions import text as X
from counterloom.functions import times as T
from datetime import datetime

import pytest


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_wal_positions(spark):
    got = column(spark, ["2F1/CDABE000", "0/1644148", "0/4240", None, ""], X.wal_mb)
    assert got == [3087563, 6, 0, 0, 0]


@pytest.mark.parametrize("types, modes, new, old", [
    ("integer,integer,character varying", "i,i,i", "f(i integer, i integer, i character varying)", "f(integer, integer, character varying)"),
    ("integer,text", "i,o", "f(i integer, text)", "f(integer, text)"),
    ("integer,text", "", "f(i integer, i text)", "f(integer, text)"),
    ("", "", "f()", "f()"),
    (None, None, "f()", "f()"),
])
def test_signatures(spark, types, modes, new, old):
    df = spark.createDataFrame([("f", types, modes)], "n string, t string, m string")
    row = df.select(X.signature(F.col("n"), F.col("t"), F.col("m")), X.signature_unmarked(F.col("n"), F.col("t"))).first()
    assert tuple(row) == (new, old)


def java_hash(s):
    h = 0
    data = s.encode("utf-16-be")
    for i in range(0, len(data), 2):
        h = (31 * h + int.from_bytes(data[i:i + 2], "big")) % 2**32
    return h - 2**32 if h >= 2**31 else h


def test_query_hash_covers_all_code_units(spark):
    texts = ["", "a", "SELECT 1", "żółć", "emoji \U0001F600 end", "x" * 5000]
    assert column(spark, texts, X.query_hash) == [java_hash(t) for t in texts]


def test_query_hash_calls_nothing_for_each_code_unit(spark):
    assert column(spark, [None, "", "b" * 3_000_000], X.query_hash) == [None, 0, java_hash("b" * 3_000_000)]
    plan = spark.range(1).select(X.query_hash(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan  # a function called for each unit took 3 microseconds


def test_pretty_size_of_products_beyond_64_bits(spark):
    rows = spark.createDataFrame([(36_000_000, 900_000), (1, 1), (10, 60)], "o_orderkey bigint, o_custkey bigint")

    class Tables:
        table = staticmethod(lambda _: rows)

    got = [r["size"] for r in checks.functions.QUERIES["fn_pretty_size"](Tables).collect()]
    assert got == [f"{(36_000_000**2 * 900_000 - 5000 + 2**39) // 2**40} TB", "-5 kB", "1000 B"]


def test_rounding_is_half_away_from_zero(spark):
    assert column(spark, [2.5, -2.5, 0.5, 1.49, -0.4], N.half_up, "double") == [3, -3, 1, 1, 0]
    assert column(spark, [0.125, -0.125, 1.0], lambda c: N.half_up(c, 2), "double") == [0.13, -0.13, 1.0]


def test_guards_give_null_or_zero(spark):
    df = spark.createDataFrame([(0, 5)], "a bigint, b bigint")
    row = df.select(N.ratio(F.col("b"), F.col("a")), N.pct_change(F.col("a"), F.col("b")), N.hit_pct(F.col("a"), F.col("a")),
                    N.rate(F.col("b"), F.col("a"), 60)).first()
    assert tuple(row) == (None, 0.0, None, None)


def test_pretty_printers(spark):
    assert column(spark, [0, 1024, 1025, 10 * 1024**2, -5 * 1024**2, 3 * 1024**5], N.pretty_size, "bigint") == [
        "0 B", "1024 B", "1 kB", "10 MB", "-5120 kB", "3072 TB"]
    assert column(spark, [1000, 1001, 2_500_000, -3_000_000_000], N.pretty_count, "bigint") == ["1000", "1.0 K", "2.5 M", "-3.0 B"]
    assert column(spark, [0.5, 12.0, 1500.0, 61000.0, 3_723_000.0], N.pretty_ms, "double") == ["500μs", "12ms", "1.5s", "1m 1s", "1h 2m 3s"]


def test_settings_text(spark):
    text = '{\n"loadGatherInterval": 10\n}'
    assert column(spark, [text], lambda c: X.set_setting(c, "keyX", 1)) == ['{\n"loadGatherInterval": 10,\n"keyX": 1\n}']
    assert column(spark, [text], lambda c: X.set_setting(c, "loadGatherInterval", 100)) == ['{\n"loadGatherInterval": 100\n}']
    assert column(spark, [text], lambda c: X.update_setting(c, "keyX", 1)) == [text]
    assert column(spark, [text], lambda c: X.feature_on(c, "loadGatherInterval")) == [True]


def test_version_suffix_and_names(spark):
    assert column(spark, ["shop_api_r24_00_01", "z_API_R9", "plain"], X.strip_version) == ["shop", "z", "plain"]
    assert column(spark, ["f(i int, text)", "g"], X.proc_base_name) == ["f", "g"]
    assert column(spark, ["f(i int, text)"], X.proc_short_name) == ["f()"]
    assert column(spark, ["  SELECT\n\t 1", "x"], X.normalise_query) == ["select 1", "x"]
    assert column(spark, ["abcdef", "abc"], lambda c: X.clip(c, 3)) == ["abc..", "abc"]


def test_buckets_and_periods(spark):
    ts = [datetime(2024, 1, 1, 10, 59, 59), datetime(2024, 1, 1, 10, 14, 0)]
    assert column(spark, ts, lambda c: T.group_date(c).cast("string"), "timestamp") == ["2024-01-01 10:45:00", "2024-01-01 10:00:00"]
    assert column(spark, ts[:1], lambda c: T.group_date(c, 7).cast("string"), "timestamp") == ["2024-01-01 10:56:00"]
    assert T.period(datetime(2024, 1, 1, 0, 30), "hour") == (datetime(2023, 12, 31, 23), datetime(2024, 1, 1))
    assert T.period(datetime(2024, 1, 1, 0, 30), "day") == (datetime(2023, 12, 31), datetime(2024, 1, 1))
    with pytest.raises(ValueError):
        T.period(ts[0], "week")


def test_normalise_to_period(spark):
    df = spark.createDataFrame([(100, 1800.0), (100, 60.0), (1, 1800.0)], "v bigint, e double")
    assert [r[0] for r in df.select(N.normalise(F.col("v"), F.col("e"))).collect()] == [50, 100, 1]
