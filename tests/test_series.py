"""Blocked windows and chunked scans give the rows of plain windows, whatever the block size."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketpulse.functions import frames as fr
from marketpulse.operators import indicators as ind
from marketpulse.operators import quantiles
from marketpulse.operators.quantiles import exact_quantiles, value_at_share
from marketpulse.operators.series import last_rows, number_rows, over_series, running


@pytest.fixture(scope="module")
def bars(spark):
    random.seed(3)
    rows = []
    for symbol, n in (("HOT", 700), ("B", 90), ("C", 1)):
        hours = sorted(random.sample(range(3000), n))
        for h in hours:
            c = 50 + random.random() * 10
            rows.append((symbol, h, c, c + random.random(), c - random.random(), random.randint(0, 5) * 1.0))
    d = spark.createDataFrame(rows, "symbol string, h int, close double, high double, low double, volume double")
    start = F.lit("2024-01-01").cast("timestamp")
    return d.withColumn("ts", start + F.make_dt_interval(hours=F.col("h"))).withColumn("open", F.col("close")).cache()


def rows(df, *cols):
    return sorted(tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r)
                  for r in df.select("symbol", "h", *cols).collect())


@pytest.mark.parametrize("block", [7, 64, 100000])
def test_frames_do_not_depend_on_blocks(bars, block):
    def step(d, w):
        d = ind.add_adx(ind.add_rsi(d, w, 5), w, 4)
        return d.withColumns({"sma": fr.sma(F.col("close"), 6, w), "next": F.lead("close").over(w)})
    w = Window.partitionBy("symbol").orderBy("ts")
    want = rows(step(bars, w), "rsi", "adx", "sma", "next")
    got = rows(over_series(bars, step, 12, 1, block_rows=block), "rsi", "adx", "sma", "next")
    assert got == want


def test_row_numbers(bars):
    w = Window.partitionBy("symbol").orderBy("ts")
    want = rows(bars.withColumn("rn", F.row_number().over(w)), "rn")
    assert rows(number_rows(bars, name="rn"), "rn") == want


def test_running(bars):
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    holes = bars.withColumn("x", F.when(F.col("h") % 3 == 0, F.col("close")))
    want = holes.withColumns({"s": F.sum("x").over(w), "m": F.max("x").over(w), "lo": F.min("x").over(w),
                              "n": F.count("x").over(w), "l": F.last("x", True).over(w)})
    got = running(holes, {"s": ("sum", F.col("x")), "m": ("max", F.col("x")), "lo": ("min", F.col("x")),
                          "n": ("count", F.col("x")), "l": ("last", F.col("x"))})
    assert rows(got, "s", "m", "lo", "n", "l") == rows(want, "s", "m", "lo", "n", "l")


@pytest.mark.parametrize("n", [1, 5, 200])
def test_last_rows(bars, n):
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    want = bars.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
    assert rows(last_rows(bars, n)) == rows(want)


def test_no_window_holds_a_whole_series(bars):
    """Windows of the operators are keyed by block or chunk, never by the symbol alone, over the rows."""
    plan = ind.adx(bars)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window [" in line]
    assert windows
    for line in windows:
        assert "_block" in line or "_chunk" in line, line


def test_macd_matches_the_recursion(bars):
    got = {(r["symbol"], r["h"]): (r["macd"], r["macd_signal"]) for r in ind.macd(bars, block_rows=512).collect()}
    for symbol in ("HOT", "B"):
        closes = bars.where(F.col("symbol") == symbol).orderBy("h").collect()
        sums = {12: [0.0, 0.0], 26: [0.0, 0.0], 9: [0.0, 0.0]}
        for r in closes:
            for span, x in ((12, r["close"]), (26, r["close"])):
                keep = 1 - 2 / (span + 1)
                sums[span] = [x + keep * sums[span][0], 1 + keep * sums[span][1]]
            macd = sums[12][0] / sums[12][1] - sums[26][0] / sums[26][1]
            sums[9] = [macd + 0.8 * sums[9][0], 1 + 0.8 * sums[9][1]]
            assert got[(symbol, r["h"])] == pytest.approx((macd, sums[9][0] / sums[9][1]), abs=1e-9)


@pytest.mark.parametrize("accuracy", [40, 100000])
def test_exact_quantiles(spark, accuracy):
    rng = np.random.default_rng(1)
    groups = {"many": np.round(rng.normal(size=4000), 2), "few": rng.normal(size=7), "same": np.ones(500), "one": np.array([3.0])}
    d = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double").repartition(5)
    probs = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {(r["k"], r["p"]): r["q"] for r in exact_quantiles(d, ["k"], "v", probs, accuracy).collect()}
    for k, vs in groups.items():
        for p in probs:
            assert got[(k, p)] == pytest.approx(np.quantile(vs, p), abs=1e-12)
    cut = {r["k"]: (r["rank"], r["q"]) for r in value_at_share(d, ["k"], "v", 0.05, accuracy).collect()}
    for k, vs in groups.items():
        i = int(0.05 * len(vs))
        assert cut[k] == (i, pytest.approx(sorted(vs)[i]))


@pytest.mark.parametrize("margin", [-1.0, 0.0])
def test_quantile_brackets_that_miss_are_widened(spark, monkeypatch, margin):
    monkeypatch.setattr(quantiles, "MARGIN", margin)
    rng = np.random.default_rng(2)
    groups = {"many": rng.normal(size=3000), "ties": np.round(rng.normal(size=800)), "few": rng.normal(size=7)}
    d = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double").repartition(3)
    probs = [0.05, 0.5, 0.95]
    got = {(r["k"], r["p"]): r["q"] for r in exact_quantiles(d, ["k"], "v", probs, 40).collect()}
    assert got == {(k, p): pytest.approx(np.quantile(vs, p), abs=1e-12) for k, vs in groups.items() for p in probs}
    whole = np.concatenate(list(groups.values()))
    assert {r["p"]: r["q"] for r in exact_quantiles(d, [], "v", probs, 40).collect()} == {
        p: pytest.approx(np.quantile(whole, p), abs=1e-12) for p in probs}
    assert exact_quantiles(d.where("false"), ["k"], "v", probs, 40).collect() == []


@pytest.mark.parametrize("accuracy", [3, 100000])
def test_quantiles_of_a_null_key(spark, accuracy):
    rows = [(k, float(i)) for k in ("a", None) for i in range(9)] + [("none", None)]
    d = spark.createDataFrame(rows, "k string, v double")
    got = {(r["k"], r["p"]): r["q"] for r in exact_quantiles(d, ["k"], "v", [0.5, 1.0], accuracy).collect()}
    assert got == {(k, p): q for k in ("a", None) for p, q in ((0.5, 4.0), (1.0, 8.0))}


def test_drawdown_duration(spark):
    def run(values):
        d = spark.createDataFrame([("p", i, float(v)) for i, v in enumerate(values)], "portfolio_id string, seq int, equity double")
        r = ind.drawdown_duration(d, order=("seq",), chunk=F.floor(F.col("seq") / 2)).first()
        return round(r["max_drawdown"], 6), r["drawdown_rows"]
    assert run([100, 120, 90, 100, 130, 125]) == (-0.25, 3)
    assert run([100, 120, 90, 100]) == (-0.25, 2)
    assert run([1, 2, 3]) == (0.0, 0)


def test_growth_stops_at_a_total_loss(spark):
    d = spark.createDataFrame([("a", i, r) for i, r in enumerate([0.1, -1.0, 0.5])], "symbol string, seq int, r double")
    out = ind.cum_growth(d, "r", order=("seq",), chunk=F.col("seq")).orderBy("seq").collect()
    assert [round(r["growth"], 9) for r in out] == [1.1, 0.0, 0.0]


def test_transitions(spark):
    states = "A A B B B A C".split()
    d = spark.createDataFrame([("s", i, v) for i, v in enumerate(states)], "symbol string, seq int, regime string")
    out = ind.transitions(d, order=("seq",), chunk=F.floor(F.col("seq") / 3)).orderBy("seq").collect()
    assert [(r["from_state"], r["to_state"], r["duration_previous"]) for r in out] == [("A", "B", 2), ("B", "A", 3), ("A", "C", 1)]
