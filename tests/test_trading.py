"""Trades, signals, risk, index and sentiment on the literal cases of the fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketpulse.operators import fear_greed as fg
from marketpulse.operators import impact as im
from marketpulse.operators import risk
from marketpulse.operators import sentiment as se
from marketpulse.operators import signals as sg
from marketpulse.operators import trades as tr
from marketpulse.operators.joins import asof_join

T0 = dt.datetime(2024, 10, 1)


def hour(h):
    return T0 + dt.timedelta(hours=h)


@pytest.mark.parametrize("action,entry,exit_,pnl,pct", [
    ("BUY", 50000.0, 52000.0, 400.0, 4.0), ("BUY", 50000.0, 48000.0, -400.0, -4.0),
    ("SELL", 50000.0, 48000.0, 400.0, 100 * (50000 / 48000 - 1)), ("STRONG_SELL", 50000.0, 52000.0, -400.0, 100 * (50 / 52 - 1)),
])
def test_trade_profit(spark, action, entry, exit_, pnl, pct):
    d = spark.createDataFrame([(action, entry, exit_, 0.2)], "action string, entry_price double, exit_price double, quantity double")
    r = tr.close_trades(d).first()
    assert (r["pnl"], r["pnl_percent"], r["status"]) == (pytest.approx(pnl), pytest.approx(pct), "CLOSED")


@pytest.mark.parametrize("index,action", [(15, "STRONG_SELL"), (30, "SELL"), (50, "HOLD"), (65, "BUY"), (85, "STRONG_BUY"),
                                          (25, "STRONG_SELL"), (40, "SELL"), (60, "HOLD"), (75, "BUY")])
def test_actions(spark, index, action):
    d = spark.createDataFrame([("X", T0, (index - 50) / 50, 10, float(index))],
                              "symbol string, ts timestamp, sentiment_score double, source_count int, fear_greed_index double")
    r = sg.signals(d, min_confidence=0.0).first()
    assert r["action"] == action
    assert 0.02 <= r["position_size"] <= 0.10


def test_conflict_is_rejected(spark):
    d = spark.createDataFrame([("X", T0, -0.9, 1, 80.0), ("Y", T0, 0.9, 12, 85.0)],
                              "symbol string, ts timestamp, sentiment_score double, source_count int, fear_greed_index double")
    got = sg.signals(d).collect()
    assert [r["symbol"] for r in got] == ["Y"]
    assert got[0]["confidence"] == pytest.approx((1 - abs(0.7 - 0.9) / 2) * 0.4 + 0.3 + 0.27)
    assert got[0]["reasoning"].startswith("Market shows extreme greed (FGI: 85.0) with very positive sentiment (score: 0.90)")


def frames(spark, signals, closes):
    s = spark.createDataFrame([("X", hour(h), a, size, 0.8, 50.0) for h, a, size in signals],
                              "symbol string, ts timestamp, action string, position_size double, confidence double, fear_greed_index double")
    b = spark.createDataFrame([("X", hour(h), float(c)) for h, c in enumerate(closes)], "symbol string, ts timestamp, close double")
    return s, b


def test_reversal_and_end(spark):
    s, b = frames(spark, [(0, "BUY", 0.1), (1, "BUY", 0.1), (2, "SELL", 0.5), (3, "HOLD", 0.1)], [100, 101, 101, 101])
    out = tr.extract_trades(s, b, slippage=0.0, rate=0.0).orderBy("entry_time").collect()
    assert [(r["action"], r["exit_reason"], r["entry_price"], r["exit_price"]) for r in out] == [
        ("BUY", "reversal", 100.0, 101.0), ("SELL", "end", 101.0, 101.0)]
    assert out[0]["pnl"] == pytest.approx(100000 * 0.1 / 100)
    assert out[1]["position_size"] == 0.25  # capped


def test_stop_comes_first(spark):
    s, b = frames(spark, [(0, "BUY", 0.1), (4, "BUY", 0.1), (5, "SELL", 0.1)], [100, 99, 97, 110, 110, 110, 110])
    out = tr.extract_trades(s, b, slippage=0.0).orderBy("entry_time").collect()
    assert [(r["exit_reason"], r["exit_price"]) for r in out] == [("stop", 97.0), ("end", 110.0)]
    s, b = frames(spark, [(0, "SELL", 0.1)], [100, 99, 94, 200])
    assert tr.extract_trades(s, b, slippage=0.0).first()["exit_reason"] == "take"


def test_profit_sign(spark):
    s, b = frames(spark, [(i, "BUY" if i % 3 else "SELL", 0.1) for i in range(0, 40)], [100 + (i * 37 % 11) for i in range(45)])
    for r in tr.extract_trades(s, b).collect():
        up = r["exit_price"] > r["entry_price"]
        assert (r["pnl"] > 0) == (up if r["side"] > 0 else r["exit_price"] < r["entry_price"])


def test_equity_ends_at_booked_profit(spark):
    s, b = frames(spark, [(0, "BUY", 0.1), (3, "SELL", 0.1), (5, "BUY", 0.2)], [100, 102, 101, 104, 103, 102, 105])
    trades = tr.extract_trades(s, b).cache()
    curve = tr.equity_curve(trades, b).orderBy("ts").collect()
    net = sum(r["pnl"] - r["entry_fee"] - r["exit_fee"] for r in trades.collect())
    assert curve[-1]["equity"] == pytest.approx(100000 + net)
    assert len(curve) == 7


def test_all_wins_have_no_profit_factor(spark):
    d = spark.createDataFrame([(5.0,), (3.0,)], "pnl double")
    assert risk.profit_factor(d).first()[0] is None
    w = risk.win_rate(d).first()
    assert (w["wins"], w["losses"], w["win_rate"]) == (2, 0, 1.0)


def test_constant_series_has_no_correlation(spark):
    d = spark.createDataFrame([(float(i), 1.0) for i in range(12)], "x double, y double")
    r = risk.labelled_corr(d, "x", "y").first()
    assert (r["correlation"], r["significance"], r["direction"]) == (0.0, "none", "neutral")
    assert risk.labelled_corr(d.limit(5), "x", "x").first()["significance"] == "insufficient_data"


def test_index_components(spark):
    rows = [(0, 0.0, 1e6, 45000.0, 100, 55.0), (1, 0.1, 1.1e6, 46000.0, 110, 54.0), (2, 0.0, 1e6, 45500.0, 105, 55.0),
            (3, -0.7, 5e5, 42000.0, 50, 65.0)]
    d = spark.createDataFrame([("BTC", hour(i), s, v, p, m, dom) for i, s, v, p, m, dom in rows],
                              "symbol string, ts timestamp, sentiment double, volume double, price double, mentions long, dominance double")
    out = fg.fear_greed_index(d).orderBy("ts").collect()
    assert [r["c_volume_momentum"] for r in out][:2] == [50.0, pytest.approx((1.1 - 0.5) / 1.5 * 100)]
    assert out[3]["c_volume_momentum"] == 0.0 and out[3]["c_sentiment"] == pytest.approx(15)
    assert out[3]["c_dominance"] == pytest.approx(50 / 3) and out[0]["c_volatility"] == 50
    assert out[0]["label"] == "Neutral" and out[3]["label"] == "Extreme Fear"
    only = fg.fear_greed_index(d, {"sentiment": 1.0}).orderBy("ts").collect()
    assert only[3]["fear_greed_index"] == pytest.approx(15)


def test_sentiment_aggregate(spark):
    now = hour(10)
    rows = [(now - dt.timedelta(minutes=i), "BTC", "twitter", 0.7, 1000, 0, False) for i in range(1, 6)]
    rows += [(now - dt.timedelta(minutes=5), "BTC", "reddit", 0.5, 0, 500, False)] * 3
    rows += [(now - dt.timedelta(minutes=10), "BTC", "news", 0.8, 0, 0, False)]
    rows += [(now - dt.timedelta(hours=5), "BTC", "twitter", -0.6, 0, 0, False)] * 3
    d = spark.createDataFrame(rows, "ts timestamp, asset string, source string, score double, followers long, karma long, verified boolean")
    out = {r["asset"]: r for r in se.aggregate_sentiment(d, F.lit(now)).collect()}
    r = out["BTC"]
    assert r["volume"] == 9 and 0.5 < r["score"] < 0.8 and r["confidence"] == pytest.approx(9 / 50)
    assert r["breakdown"] == {"news": pytest.approx(0.8), "reddit": pytest.approx(0.5), "twitter": pytest.approx(0.7)}
    assert out["OVERALL"]["score"] == pytest.approx(r["score"])


def test_asof_edges(spark):
    bars = spark.createDataFrame([("X", hour(1), 10.0), ("X", hour(1), 10.0), ("X", hour(50), 20.0)], "symbol string, ts timestamp, close double")
    asks = spark.createDataFrame([("X", hour(h)) for h in (0, 1, 49, 50, 90)] + [("Y", hour(3))], "symbol string, ts timestamp")
    got = {(r["symbol"], r["ts"]): r["close"] for r in asof_join(asks, bars).collect()}
    assert [got[("X", hour(h))] for h in (0, 1, 49, 50, 90)] == [None, 10.0, 10.0, 20.0, 20.0] and got[("Y", hour(3))] is None
    near = {r["ts"]: r["close"] for r in asof_join(asks, bars, tolerance=3600).collect()}
    assert near[hour(49)] is None and near[hour(50)] == 20.0


def test_book_walk(spark):
    levels = [(1, s, i, 100.0 + (0.05 + i * 0.01) * (1 if s == "ask" else -1), 10.0) for s in ("bid", "ask") for i in range(3)]
    book = spark.createDataFrame(levels, "book_id long, side string, level int, price double, volume double")
    orders = spark.createDataFrame([(1, 1, "buy", 15.0), (2, 1, "sell", 100.0)], "order_id long, book_id long, side string, size double")
    got = {r["order_id"]: r for r in im.walk_book(orders, book).collect()}
    assert got[1]["execution_price"] == pytest.approx((10 * 100.05 + 5 * 100.06) / 15)
    assert got[2]["executed"] == 30.0 and got[2]["slippage"] > 0


def test_schedule_sums_to_the_order(spark):
    orders = spark.createDataFrame([(1, 1000.0)], "order_id long, size double")
    for risk_aversion in (0.2, 1.0, 3.0):
        parts = [r["slice"] for r in im.execution_slices(orders, 7, risk_aversion).orderBy("t").collect()]
        assert sum(parts) == pytest.approx(1000) and parts == sorted(parts, reverse=True)
