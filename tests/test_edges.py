"""Hand-worked cases at the edges: NULL keys and times, ties, odd steps, spans, equal rows."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from marketpulse.operators import cross, indicators as ind, joins, lexicon, sentiment
from marketpulse.operators.series import last_rows, over_series, running
from marketpulse.sources import feeds
from marketpulse.sources.bars import build_bars

T0 = dt.datetime(2024, 1, 1)


def hours(*hs):
    return [None if h is None else T0 + dt.timedelta(hours=h) for h in hs]


@pytest.fixture(scope="module")
def rows(spark):
    a, b, n = hours(0, 30, None)
    data = [("A", a, 1.0), ("A", b, 2.0), ("A", n, 3.0), (None, a, 4.0), (None, b, 5.0), (None, n, 6.0), (None, n, 7.0)]
    return spark.createDataFrame(data, "symbol string, ts timestamp_ntz, x double")


def test_running_keeps_null_keys_and_times(rows):
    out = running(rows, {"n": ("count", F.col("x")), "s": ("sum", F.col("x"))}, order=("ts", "x")).collect()
    got = {r["x"]: (r["n"], r["s"]) for r in out}
    assert got == {3.0: (1, 3.0), 1.0: (2, 4.0), 2.0: (3, 6.0), 6.0: (1, 6.0), 7.0: (2, 13.0), 4.0: (3, 17.0), 5.0: (4, 22.0)}


def test_over_series_keeps_null_keys_and_times(rows):
    out = over_series(rows, lambda d, w: d.withColumn("before", F.lag("x").over(w)), 1, order=("ts", "x")).collect()
    assert {r["x"]: r["before"] for r in out} == {3.0: None, 1.0: 3.0, 2.0: 1.0, 6.0: None, 7.0: 6.0, 4.0: 7.0, 5.0: 4.0}


def test_last_rows_keeps_null_keys(rows):
    assert sorted(r["x"] for r in last_rows(rows, 1).collect()) == [2.0, 5.0]


def test_asof_join_keeps_every_event(spark):
    events = spark.createDataFrame([(1, "A", h) for h in hours(5, None)] + [(2, None, h) for h in hours(5)], "id int, symbol string, ts timestamp_ntz")
    bars = spark.createDataFrame([("A", h, c) for h, c in zip(hours(1, None), (10.0, 99.0))] + [(None, hours(2)[0], 20.0)], "symbol string, ts timestamp_ntz, close double")
    got = sorted(((r["id"], r["ts"] is None, r["close"]) for r in joins.asof_join(events, bars).collect()), key=str)
    assert got == [(1, False, 10.0), (1, True, None), (2, False, 20.0)]


def test_grid_starts_at_the_first_bar(spark):
    bars = spark.createDataFrame([("A", T0 + dt.timedelta(minutes=30), 1.0), ("A", T0 + dt.timedelta(hours=22), 2.0)], "symbol string, ts timestamp_ntz, close double")
    got = [(r["ts"], r["close"]) for r in joins.resample_ffill(bars, "7 hours").orderBy("ts").collect()]
    assert got == [(T0 + dt.timedelta(minutes=30 + 420 * k), 1.0) for k in range(4)]
    days = spark.createDataFrame([("A", T0 + dt.timedelta(days=d), float(d)) for d in (0, 1, 4)], "symbol string, ts timestamp_ntz, close double")
    assert [r["close"] for r in joins.resample_ffill(days, "2 days").orderBy("ts").collect()] == [0.0, 1.0, 4.0]


@pytest.mark.parametrize("span", [1, 2, 3, 9, 1000])
def test_ewm_of_any_span(spark, span):
    xs = [100.0 + math.sin(i) * 5 for i in range(3000)]
    d = spark.createDataFrame([("A", T0 + dt.timedelta(minutes=i), x) for i, x in enumerate(xs)], "symbol string, ts timestamp_ntz, close double")
    got = [r[f"ewm_{span}"] for r in ind.ewm(d, "close", span).orderBy("ts").collect()]
    keep, s, w = 1 - 2 / (span + 1), 0.0, 0.0
    for x, y in zip(xs, got):
        s, w = x + keep * s, 1 + keep * w
        assert abs(y - s / w) < 1e-9 * abs(s / w)


def test_macd_with_spans_far_apart(spark):
    d = spark.createDataFrame([("A", T0 + dt.timedelta(minutes=i), 7.0) for i in range(2500)], "symbol string, ts timestamp_ntz, close double")
    assert ind.macd(d, 2, 400, 3).agg(F.max(F.abs("macd") + F.abs("macd_signal"))).first()[0] < 1e-9


def test_one_p_value_formula(spark):
    d = spark.createDataFrame([(0.02, n) for n in (10000, 10001, 10002)] + [(0.5, 10), (0.9, 5)], "r double, n long")
    p = [r[0] for r in d.select(cross.p_value(F.col("r"), F.col("n"))).collect()]
    assert abs(p[0] - 0.0455057) < 1e-6 and 0 < p[0] - p[1] < 2e-5 and abs((p[0] - p[1]) - (p[1] - p[2])) < 1e-8
    assert abs(p[3] - 0.1411133) < 1e-6 and abs(p[4] - 0.0373860) < 1e-6


def test_equal_posts_stay_apart(spark):
    posts = spark.createDataFrame([(1, "good day")] * 2, "post_id int, text string")
    words = spark.createDataFrame([("good", 2.0)], "token string, valence double")
    got = lexicon.lexicon_score(posts, words).collect()
    assert len(got) == 2 and got[0]["compound"] == got[1]["compound"] < 0.5


def test_ties_of_ticks(spark):
    ticks = spark.createDataFrame([("A", T0, 1.0, 4095), ("A", T0, 2.0, 4096), ("A", dt.datetime(2045, 1, 1), 3.0, 2**62)], "s string, t timestamp_ntz, p double, id long")
    got = [(r["open"], r["close"]) for r in build_bars(ticks, "s", "t", "p", "id").orderBy("ts").collect()]
    assert got == [(1.0, 2.0), (3.0, 3.0)]


def test_time_filter_reaches_the_scan(spark, tmp_path):
    d = spark.createDataFrame([(h, i) for i, h in enumerate(hours(0, 1, 2, 3))], "ts timestamp_ntz, i int")
    d.write.parquet(str(tmp_path / "t"))
    kept = sentiment.retain(spark.read.parquet(str(tmp_path / "t")), F.lit("2024-01-01 02:00:00").cast("timestamp_ntz"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThanOrEqual(ts" in plan
    assert sorted(r["i"] for r in kept.collect()) == [1, 2]


def test_sources_import():
    assert feeds
