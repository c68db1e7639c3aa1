"""Reading and writing, payload parsing, streams."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from marketpulse import schemas
from marketpulse.operators import models as mo
from marketpulse.session import scratch_path
from marketpulse.sources import bars as ba
from marketpulse.sources import feeds as fe
from marketpulse.sources import metrics as me
from marketpulse.sources import results as re_
from marketpulse.streaming import ordered
from marketpulse.streaming import streams as st

T0 = dt.datetime(2024, 1, 1)


def payloads(spark, *items):
    rows = [(T0, json.dumps(i)) for i in items]
    return spark.createDataFrame(rows, "ingest_ts timestamp, payload string")


def test_bars_round_trip(spark):
    rows = [(s, T0 + dt.timedelta(hours=h), 1.0, 2.0, 0.5, 1.5, 10.0) for s in ("A", "B") for h in range(800)]
    d = spark.createDataFrame(rows, schemas.BARS)
    path = scratch_path(spark, "bars")
    ba.write_bars(d, path)
    back = ba.read_bars(spark, path)
    assert back.count() == 1600 and back.where("symbol = 'A'").count() == 800
    assert ba.read_many(spark, [path, path + "-missing"]).count() == 1600
    assert ba.read_many(spark, [path + "-missing"]).count() == 0
    other = scratch_path(spark, "bars")
    ba.write_bars(d.where("symbol = 'B'").withColumn("symbol", F.lit("C")), other)
    some = ba.read_many(spark, [f"{path}/symbol=A", f"{path}/symbol=none", other])
    assert {(r["symbol"], r["count"]) for r in some.groupBy("symbol").count().collect()} == {("A", 800), ("C", 800)}
    assert some.columns == d.columns


def test_csv_bars_take_the_symbol_from_the_file(spark, tmp_path):
    (tmp_path / "BTC.csv").write_text("ts,open,high,low,close,volume\n2024-01-01 00:00:00,1,2,0.5,1.5,9\n")
    r = ba.read_bars(spark, str(tmp_path / "BTC.csv"), "csv").first()
    assert (r["symbol"], r["close"]) == ("BTC", 1.5)


def test_source_precedence(spark):
    rows = [("A", T0, 1.0, "x"), ("A", T0, 2.0, "y"), ("A", T0 + dt.timedelta(hours=1), 3.0, "y"), ("B", T0, 4.0, "z")]
    d = spark.createDataFrame(rows, "symbol string, ts timestamp, close double, vendor string")
    assert sorted(r["close"] for r in ba.prefer_source(d, ["x", "y"]).collect()) == [1.0, 3.0]
    assert sorted(r["close"] for r in ba.prefer_source(d, ["x", "y"], "symbol").collect()) == [1.0]


def test_bad_numbers_become_null(spark):
    d = spark.createDataFrame([("A", '[["1704067200000","1","2","x","1.5","9"]]')], "symbol string, payload string")
    r = ba.normalise_klines(d).first()
    assert r["low"] is None and r["close"] == 1.5 and r["ts"] == T0
    low = ba.lower_columns(spark.createDataFrame([(1.0, 2.0)], "Close double, Extra double"))
    assert low.columns == ["close"]


def test_tweets(spark):
    d = fe.flatten_tweets(payloads(
        spark, {"id": "7", "text": "hi", "author_id": "9", "created_at": "2024-01-02T00:00:00Z",
                "public_metrics": {"retweet_count": 2, "like_count": 3}}, {"id": "8", "text": "yo"}))
    got = {r["tweet_id"]: r for r in d.collect()}
    assert got["7"]["engagement"] == 5 and got["7"]["ts"] == dt.datetime(2024, 1, 2)
    assert got["8"]["engagement"] == 0 and got["8"]["username"] == "user_unknown" and got["8"]["ts"] == T0


def test_forum_news_ticks(spark):
    forum = fe.flatten_posts(payloads(
        spark, {"item_type": "submission", "title": "T", "selftext": "s", "score": 4}, {"item_type": "comment", "body": "[deleted]"},
        {"item_type": "comment", "body": "ok"}))
    assert sorted(r["text"] for r in forum.collect()) == ["T s", "ok"]
    news = fe.flatten_news(payloads(spark, {"title": "t", "publishedAt": "2024-03-01T10:00:00Z", "source": {"name": "W"}, "url": "u"})).first()
    assert (news["source"], news["author"], news["ts"]) == ("W", "Unknown", dt.datetime(2024, 3, 1, 10))
    tick = fe.flatten_ticks(payloads(spark, {"symbol": "BTC-USD", "price": 100.0}, {"symbol": "X", "price": 0})).collect()
    assert [(r["bid"], r["ask"], r["high_24h"]) for r in tick] == [(pytest.approx(99.9), pytest.approx(100.1), 100.0)]


def test_routing(spark):
    events = fe.union_feeds(
        twitter=spark.createDataFrame([("Go $ETH", T0, 5)], "text string, ts timestamp, followers long"),
        news=spark.createDataFrame([("Head", "about solana SOL", T0, "W")], "title string, description string, ts timestamp, source string"),
        market=spark.createDataFrame([("BTC-USD", 5.0, T0)], "symbol string, price double, ts timestamp"),
        reddit=spark.createDataFrame([("  ", T0)], "text string, ts timestamp"))
    got = {r["data_type"]: r for r in fe.route_events(events).collect()}
    assert set(got) == {"twitter", "news", "market"}
    assert (got["twitter"]["asset"], got["news"]["asset"], got["market"]["asset"]) == ("ETH", "SOL", "BTC")
    assert got["twitter"]["metadata"]["followers"] == "5" and got["news"]["text"] == "Head about solana SOL"


def test_metric_json(spark):
    d = spark.createDataFrame([("BTC", '[{"t":1704067200,"v":1.5},{"t":1704153600,"v":2}]')], "symbol string, payload string")
    assert [r["value"] for r in me.parse_metric_json(d, "m").orderBy("ts").collect()] == [1.5, 2.0]
    w = spark.createDataFrame([("BTC", json.dumps([{"week": 604800 * i, "total": i} for i in range(60)]))], "symbol string, payload string")
    assert sorted(r["commits"] for r in me.parse_weekly_activity(w, 3).collect()) == [57, 58, 59]


def test_results_on_disk(spark, tmp_path):
    out = str(tmp_path)
    trades = spark.createDataFrame([(T0, T0, "A", "BUY", 1.0, 2.0, 0.1, 3.0, 3.0, 100.0, 0.8, 60.0, "CLOSED")], schemas.TRADES)
    equity = spark.createDataFrame([("main", T0, 100.0), ("main", T0 + dt.timedelta(1), 101.0)], "portfolio_id string, ts timestamp, equity double")
    for run in ("20240101_000000", "20240102_000000"):
        re_.write_backtest(spark.range(1), equity, trades, out, run)
    assert re_.latest_run(spark, out) == "20240102_000000"
    t, e = re_.read_backtest(spark, f"{out}/backtest_20240102_000000_trades", f"{out}/backtest_20240102_000000_equity")
    assert t.first()["pnl"] == 3.0 and sorted(r["equity"] for r in e.collect()) == [100.0, 101.0]
    (tmp_path / "other.csv").write_text("when,balance\n2024-01-01,7\n")
    assert re_.read_equity(spark, f"{out}/other.csv").first()["equity"] == 7.0
    signals = spark.createDataFrame([("A", T0, "BUY", 0.5, 0.8, 0.02, 70.0, 0.4)],
                                    "symbol string, ts timestamp, action string, strength double, confidence double, position_size double, fear_greed_index double, sentiment_score double")
    re_.write_signals(signals, f"{out}/signals")
    assert spark.read.option("header", True).csv(f"{out}/signals").columns == list(re_.SIGNAL_COLUMNS)
    re_.write_metrics(spark.range(2), f"{out}/metrics")
    assert spark.read.json(f"{out}/metrics").count() == 2


def test_labels(spark, tmp_path):
    (tmp_path / "l.csv").write_text('text,sentiment\nx,Very Positive\ny,negative\nz,2\nw,odd\n"a, b",neutral\n')
    got = {r["text"]: r["label"] for r in re_.read_labelled(spark, str(tmp_path / "l.csv")).collect()}
    assert got == {"x": 2, "y": 0, "z": 2, "w": 1, "a, b": 1}


def test_missing_columns(spark):
    d = schemas.ensure_columns(spark.range(1), "id long, a string, n int", {"n": 3})
    assert tuple(d.first()) == (0, None, 3)


def test_user_model_and_saved_model(spark):
    def broken():
        def predict(texts):
            return np.array([np.nan if "bad" in t else 0.5 for t in texts])
        return predict
    d = spark.createDataFrame([(0, "ok"), (1, "bad")], "id long, text string")
    got = {r["id"]: (r["model_score"], r["model_label"]) for r in mo.score_batches(d, broken).collect()}
    assert got == {0: (0.5, "positive"), 1: (0.0, "neutral")}

    def embed():
        def predict(texts):
            return np.array([[float(len(t)), 1.0] for t in texts], dtype="float32")
        return predict
    assert mo.embed_texts(d, embed).orderBy("id").first()["embedding"] == [2.0, 1.0]

    rows = spark.createDataFrame([(i, "good great fine" if i % 2 else "awful poor weak", i % 2) for i in range(200)],
                                 "doc_id long, text string, label int")
    model, accuracy, _ = mo.fit_text_classifier(rows)
    assert accuracy == 1.0
    path = scratch_path(spark, "model")
    mo.save_model(model, path)
    assert len(mo.load_model(path).stages) == 3


def _feed(spark, folder, batches):
    """A file stream that reads one file per batch, in order."""
    for i, rows in enumerate(batches):
        d = spark.createDataFrame(rows, "ts timestamp, key string").coalesce(1)
        d.write.mode("append").parquet(folder)
    return spark.readStream.schema("ts timestamp, key string").option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("split", [[8], [2, 1, 5]])
def test_duplicates_do_not_depend_on_batches(spark, split):
    few = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    folder = scratch_path(spark, "feed")
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [(at(60 * h), "a") for h in range(8)]
    batches = [rows[sum(split[:i]) : sum(split[: i + 1])] for i in range(len(split))]
    batches[-1] += [(at(400), "b"), (at(395), "b"), (at(418), None), (at(419), None)]
    stream, end = st.closing(_feed(spark, folder, batches))
    out = st.drain(st.dedupe_stream(stream, ["key"], memory="2 hours"), "dedupe", end)
    spark.conf.set("spark.sql.shuffle.partitions", few)
    assert sorted(((r["key"], r["ts"]) for r in out.collect()), key=str) == [("a", at(0)), ("b", at(395)), (None, at(418))]


def test_first_seen_forgets():
    class Handle:
        def __init__(self):
            self.timers, self.value = [], None

        def getValueState(self, name, schema):
            return self

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

        def registerTimer(self, at):
            self.timers.append(at)

        def getCurrentWatermarkInMs(self):
            return self.now

    handle, first = Handle(), ordered.FirstSeen(["k"], 5000)
    first.init(handle)
    rows = lambda *spans: [Row(k="a", _from=a, _until=b) for a, b in spans]
    assert len(list(first.handleInputRows(("a",), rows((3000, 9000), (0, 1000)), handle))) == 1
    assert handle.value == (9000,) and handle.timers == [15]
    assert len(list(first.handleInputRows(("a",), rows((14000, 16000), (21001, 22000)), handle))) == 1
    handle.now = 15
    first.handleExpiredTimer(("a",), handle, None)
    assert handle.value == (22000,) and handle.timers == [15, 28]
    handle.now = 28
    first.handleExpiredTimer(("a",), handle, None)
    assert handle.value is None


def test_late_rows_are_dropped(spark):
    folder = scratch_path(spark, "late")
    at = lambda h: T0 + dt.timedelta(hours=h)
    # A row is late when its window was closed by the batch before.
    rows = [[(at(0), "a"), (at(0.5), "a")], [(at(5), "a")], [(at(5.5), "a")], [(at(0.2), "a"), (at(9), "a")]]
    posts = _feed(spark, folder, rows).select(
        "ts", F.col("key").alias("asset"), F.lit("news").alias("source"), F.lit(0.5).alias("score"),
        F.lit(0).alias("followers"), F.lit(0).alias("karma"), F.lit(False).alias("verified"))
    out = st.drain(st.stream_sentiment(posts, "1 hour", "1 hour"), "late")
    got = {r["window_start"]: r["volume"] for r in out.collect()}
    assert got[at(0)] == 2 and got[at(5)] == 2 and at(9) not in got


def test_each_batch(spark):
    folder, target = scratch_path(spark, "in"), scratch_path(spark, "history")
    stream = _feed(spark, folder, [[(T0, "a")], [(T0, "b")]])
    st.each_batch(stream, st.append_history(target), scratch_path(spark, "check")).awaitTermination()
    assert sorted(r["key"] for r in spark.read.parquet(target).collect()) == ["a", "b"]
