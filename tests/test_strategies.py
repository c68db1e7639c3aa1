"""Walk-forward tests of a Python strategy against a plain loop."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketpulse.operators import strategies as sg

GRID = {"fast": [2, 3, 5], "slow": [4, 8]}
START = dt.datetime(2024, 1, 1)


def make(days, seed):
    rnd, close, out = random.Random(seed), 100.0, []
    for i in range(days):
        close *= 1 + rnd.uniform(-0.05, 0.05)
        if rnd.random() < 0.9:
            out.append((START + dt.timedelta(days=i), close))
    return out


@pytest.fixture(scope="module")
def series():
    return {"hot": make(300, 1), "b": make(90, 2), "short": make(20, 3)}


@pytest.fixture(scope="module")
def bars(spark, series):
    rows = [(s, t, c, "extra") for s, some in series.items() for t, c in some] + [(None, START, 1.0, "x"), ("b", None, 1.0, "x")]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, close double, returns string").repartition(5)


def by_loop(some, strategy, metric):
    out, k = {}, 0
    start, end = some[0][0], some[-1][0]
    while start + dt.timedelta(days=20 * k + 60) <= end:
        a = start + dt.timedelta(days=20 * k)
        b, c = a + dt.timedelta(days=40), a + dt.timedelta(days=60)
        frame = lambda lo, hi: pd.DataFrame([x for x in some if lo <= x[0] < hi], columns=["ts", "close"])
        options = [{"fast": f, "slow": s} for f in GRID["fast"] for s in GRID["slow"]]
        scored = []
        for i, p in enumerate(options):
            try:
                scored.append((round(strategy(frame(a, b), p)[metric], 9), -i))
            except ZeroDivisionError:
                pass
        best = -max(scored)[1]
        inside, outside = strategy(frame(a, b), options[best]), strategy(frame(b, c), options[best])
        out[k + 1] = (best, options[best]["fast"], options[best]["slow"], inside["returns"], inside["sharpe"], outside["returns"], outside["sharpe"])
        k += 1
    return out


@pytest.mark.parametrize("metric, share", [("sharpe", 16), ("returns", 4), ("sortino", 1)])
def test_best_parameters(bars, series, metric, share):
    def strategy(data, params):
        if params["fast"] == 3:
            raise ZeroDivisionError
        return sg.ma_cross(data, params)

    got = sg.walk_forward_strategy(bars, strategy, GRID, metric, 40, 20, 20, share=share).collect()
    want = {(s, w): v for s, some in series.items() if s != "short" for w, v in by_loop(some, strategy, metric).items()}
    assert {(r["symbol"], r["window_id"]) for r in got} == set(want) and len(got) == len(want) > 10
    for r in got:
        assert r["failed"] == 2
        assert tuple(r)[2:5] == want[r["symbol"], r["window_id"]][:3]
        assert tuple(r)[5:9] == pytest.approx(want[r["symbol"], r["window_id"]][3:])


def test_failures_and_bounds(bars):
    def broken(data, params):
        raise RuntimeError("no")

    def undefined(data, params):
        return {"sharpe": float("nan")}

    got = sg.walk_forward_strategy(bars, broken, GRID, in_days=40, out_days=20, step_days=20).collect()
    assert got and {tuple(r)[2:] for r in got} == {(0, 2, 4, None, None, 0.0, 0.0, 6)}
    got = sg.walk_forward_strategy(bars, undefined, GRID, in_days=40, out_days=20, step_days=20).collect()
    assert got and {(r["param_id"], r["in_sample_sharpe"], r["out_of_sample_return"], r["failed"]) for r in got} == {(0, None, 0.0, 0)}
    assert sg.walk_forward_strategy(bars.limit(0), broken, GRID).collect() == []
    with pytest.raises(ValueError, match="more than 30"):
        sg.walk_forward_strategy(bars, broken, GRID, in_days=40, out_days=20, step_days=20, most=30)
    for wrong in ({"metric": "other"}, {"grid": {"fast": []}}, {"grid": {"window_id": [1]}}):
        with pytest.raises(ValueError):
            sg.walk_forward_strategy(bars, broken, **{"grid": GRID, **wrong})
    with pytest.raises(ValueError, match="clash"):
        sg.walk_forward_strategy(bars.withColumn("segment", F.lit(1)), broken, GRID)


def test_a_strategy_sees_its_window_only(bars):
    def span(data, params):
        return {"returns": float(len(data)), "sharpe": float((data["ts"].max() - data["ts"].min()).days)}

    for r in sg.walk_forward_strategy(bars, span, {"x": [1]}, in_days=40, out_days=20, step_days=20).collect():
        assert r["in_sample_sharpe"] < 40 and r["out_of_sample_sharpe"] < 20
