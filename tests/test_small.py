"""Small operators on literal rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from marketpulse import schemas
from marketpulse.functions import scoring as sc
from marketpulse.functions import text as tx
from marketpulse.functions.numeric import epoch_to_timestamp, timestamp_to_epoch
from marketpulse.operators import flow as fl
from marketpulse.operators import impact as im
from marketpulse.operators import indicators as ind
from marketpulse.operators import joins as jo
from marketpulse.operators import outcomes as oc
from marketpulse.operators import risk
from marketpulse.operators import trades as tr
from marketpulse.operators import walkforward as wf
from marketpulse.session import scratch_path
from marketpulse.sources import feeds as fe
from marketpulse.streaming import streams as st

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def bars(spark):
    rows = [("X", T0 + dt.timedelta(hours=i), 10.0 + i, 11.0 + i, 9.0 + i, 10.0 + i, float(1 + i % 3)) for i in range(40)]
    return spark.createDataFrame(rows, schemas.BARS)


def column(df, name):
    return [r[name] for r in df.orderBy("ts").collect()]


def test_single_indicators(bars):
    assert column(ind.log_return(bars), "log_ret")[:2] == [None, pytest.approx(0.0953102)]
    assert column(ind.rolling_sum(bars, "close", 3), "sum_3")[1:3] == [None, 33.0]
    assert column(ind.rolling_std(bars, "close", 3), "std_3")[2] == pytest.approx(1.0)
    assert column(ind.rolling_mean_partial(bars, "close", 3), "mean_3")[:2] == [10.0, 10.5]
    assert column(ind.sma(bars, "close", 3, fill=0.0), "sma_3")[:3] == [0.0, 0.0, 11.0]
    assert column(ind.bollinger_pos(bars, 5), "bb_position")[3:5] == [None, pytest.approx(0.5 + 2 / (4 * 1.5811388))]
    assert column(ind.sma_distance(bars, (2, 4)), "sma_2_4_cross")[3] == pytest.approx(1 / 11.5)
    first, second = column(ind.ewm(bars, "close", 3), "ewm_3")[:2]
    assert (first, second) == (pytest.approx(10.0), pytest.approx((11 + 0.5 * 10) / 1.5))
    assert column(ind.cum_sum(bars, "volume", "total"), "total")[:3] == [1.0, 3.0, 6.0]
    assert column(ind.diff(bars, "close", 2), "close_diff2")[2] == 0.0
    assert column(ind.annual_vol(bars, 4), "annual_vol")[3] is None


def test_small_joins(spark, bars):
    sent = bars.select("symbol", "ts", F.lit(0.5).alias("sentiment")).limit(3)
    assert jo.join_price_sentiment(bars, sent).count() == 3
    assert jo.with_volume(bars.drop("volume"), None).first()["volume"] == 0.0
    assert jo.with_volume(bars.drop("volume"), bars).where("volume > 0").count() == 40
    assert jo.align(bars, bars, "close").where("x = y").count() == 40
    assert jo.pair_by_time(bars, bars, "open", "close").count() == 40
    dim = spark.createDataFrame([("X", "Example")], "symbol string, company string")
    assert jo.lookup_dim(bars, dim, "symbol").first()["company"] == "Example"
    grid = jo.param_grid(spark, {"a": [1, 2], "b": [5, 6, 7]})
    assert [(r["a"], r["b"]) for r in grid.orderBy("param_id").collect()] == [(a, b) for a in (1, 2) for b in (5, 6, 7)]


def test_small_measures(spark, bars):
    d = spark.createDataFrame([("a", 5, 0.7), ("b", 50, 0.7)], "k string, rows int, score double")
    assert {r["k"]: r["score"] for r in risk.guard_min_rows(d, ["k"], 10, {"score": 0.5}).collect()} == {"a": 0.5, "b": 0.7}
    t = spark.createDataFrame([(T0, T0 + dt.timedelta(hours=3))], "entry_time timestamp, exit_time timestamp")
    row = tr.trade_duration(t).withColumn("h", sc.hours_between(F.col("entry_time"), F.col("exit_time"))).first()
    assert (row["duration_seconds"], row["h"]) == (10800.0, 3.0)
    e = spark.range(1).select(timestamp_to_epoch(epoch_to_timestamp(F.lit(1.5))).alias("s")).first()
    assert e["s"] == 1.5
    names = spark.createDataFrame([("Polkadot and $ETH",)], "text string").select(tx.tickers(F.col("text"), tx.COIN_NAMES)).first()[0]
    assert names == ["DOT", "ETH"]
    newest = fl.flow_summary(fl.fund_flow(bars)).collect()
    assert len(newest) == 1 and newest[0]["ts"] == T0 + dt.timedelta(hours=39)
    i = im.impact_of(spark.createDataFrame([(100.0, 1000.0, 0.02)], "size double, liquidity double, volatility double")).first()
    assert i["temporary_impact"] == pytest.approx(0.1 * 0.1 ** 0.6 * 0.02)
    assert i["permanent_impact"] == pytest.approx(i["temporary_impact"] / 2)


def test_paths_and_strategies(spark, bars):
    d = spark.createDataFrame([(0, 0, 0.1), (0, 1, -0.5), (0, 2, 0.2), (1, 0, 0.1)], "sim long, step long, r double")
    assert {r["sim"]: r["max_drawdown"] for r in oc.path_drawdowns(d).collect()} == {0: pytest.approx(-0.5), 1: 0.0}
    long = wf.apply_strategy(bars, lambda b: b.withColumn("position", F.lit(1)))
    assert column(long, "r")[:2] == [0.0, pytest.approx(0.1)]
    with pytest.raises(ValueError):
        wf.walk_forward(long, [], metric="other")


def test_json_stream(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": 1, "text": "hi"}) + "\n")
    d = fe.stream_posts(spark, str(tmp_path), "id long, text string", max_files=1)
    assert d.isStreaming and [tuple(r) for r in st.drain(d, "json").collect()] == [(1, "hi")]
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
