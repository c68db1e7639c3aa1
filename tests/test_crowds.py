"""Echo chambers and cascades against brute force, tail probabilities, walk-forward windows."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from marketpulse.operators import cross as cr
from marketpulse.operators import crowd as cw
from marketpulse.operators import lags as lg
from marketpulse.operators import outcomes as oc
from marketpulse.operators import walkforward as wf
from marketpulse.operators.chains import spaced

T0 = dt.datetime(2024, 1, 1)


def brute_chambers(points, eps, min_pts):
    core = sorted(x for x in points.values() if sum(abs(x - y) <= eps for y in points.values()) >= min_pts)
    ranges = []
    for x in core:
        if ranges and x - ranges[-1][1] <= eps:
            ranges[-1][1] = x
        else:
            ranges.append([x, x])
    out = {}
    for user, x in points.items():
        gaps = [(max(lo - x, x - hi, 0), i) for i, (lo, hi) in enumerate(ranges) if max(lo - x, x - hi, 0) <= eps]
        if gaps:
            out[user] = min(gaps)[1]
    return out


@pytest.mark.parametrize("seed,eps,min_pts", [(1, 0.05, 4), (2, 0.2, 5), (3, 0.01, 3), (4, 0.03, 6)])
def test_chambers(spark, seed, eps, min_pts):
    random.seed(seed)
    points = {f"u{i}": random.choice([random.uniform(-1, 1), random.gauss(0.5, 0.02), random.gauss(-0.4, 0.05), 0.25]) for i in range(150)}
    d = spark.createDataFrame([(u, x, 1) for u, x in points.items()], "user_id string, sentiment_score double, engagement long")
    got = {r["user_id"]: r["chamber_id"] for r in cw.chamber_members(d, eps, min_pts).collect()}
    assert got == brute_chambers(points, eps, min_pts)


@pytest.mark.parametrize("eps,min_pts,cells", [(0.5, 3, 2), (1.0, 4, 1000), (0.25, 1, 5)])
def test_chambers_of_any_scores(spark, monkeypatch, eps, min_pts, cells):
    # Scores far beyond [-1, 1], many equal ones, points just eps apart, ranges over several stretches.
    monkeypatch.setattr(cw, "CELLS", cells)
    random.seed(6)
    points = {f"u{i}": random.choice([float(random.randrange(2000)), random.uniform(-900, -880), 3.0, random.gauss(1e6, 2), i / 4]) for i in range(400)}
    rows = [(u, x, 1) for u, x in points.items()] + [("none", None, 1), ("nan", float("nan"), 1)]
    d = spark.createDataFrame(rows, "user_id string, sentiment_score double, engagement long")
    got = cw.chamber_members(d, eps, min_pts)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
    assert {r["user_id"]: r["chamber_id"] for r in got.collect()} == brute_chambers(points, eps, min_pts)
    assert cw.chamber_members(d.limit(0), eps, min_pts).collect() == []


def test_chain(spark):
    random.seed(5)
    times = {a: sorted({random.randrange(0, 400 * 3600) * 1_000_000 for _ in range(n)}) for a, n in (("A", 300), ("B", 3), ("C", 1))}
    d = spark.createDataFrame([(a, t) for a, ts in times.items() for t in ts], "asset string, _t long")
    got = {}
    for r in spaced(d, 6 * 3600 * 1_000_000 + 1, ("asset",)).collect():
        got.setdefault(r["asset"], []).append(r["_t"])
    for a, ts in times.items():
        want, reach = [], -1
        for t in ts:
            if t > reach:
                want.append(t)
                reach = t + 6 * 3600 * 1_000_000
        assert sorted(got[a]) == want


def test_influencers(spark):
    rows = [(u, f"n{u}", f, 0.1, e, T0 + dt.timedelta(days=d)) for u, f, e, d in
            [(1, 10000, 100, 0), (1, 20000, 300, 2), (2, 500, 50, 0), (3, 1000, 10, 0)]]
    d = spark.createDataFrame(rows, "user_id long, username string, follower_count long, sentiment_score double, engagement long, ts timestamp")
    got = {r["user_id"]: r for r in cw.top_influencers(d).collect()}
    assert set(got) == {1, 3}
    assert got[1]["follower_count"] == 10000 and got[1]["engagement_rate"] == pytest.approx(200 / 10000)
    assert got[1]["post_frequency"] == 1.0 and got[3]["post_frequency"] == 1.0


def tail_by_integration(t, df):
    """Two-sided tail of Student's t, Simpson's rule on the density."""
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    steps = 20000
    h = t / steps
    total = sum((1 if i in (0, steps) else 4 if i % 2 else 2) * (1 + (i * h) ** 2 / df) ** (-(df + 1) / 2)
                for i in range(steps + 1))
    return 1 - 2 * scale * total * h / 3


@pytest.mark.parametrize("r,n", [(0.5, 10), (0.9, 5), (0.1, 100), (-0.3, 37), (0.7, 3), (0.2, 4)])
def test_p_value(spark, r, n):
    got = spark.createDataFrame([(r, n)], "r double, n long").select(cr.p_value(F.col("r"), F.col("n"))).first()[0]
    assert got == pytest.approx(tail_by_integration(abs(r) * math.sqrt((n - 2) / (1 - r * r)), n - 2), abs=1e-8)


def test_best_lag_finds_the_shift(spark):
    random.seed(7)
    base = [random.gauss(0, 1) for _ in range(300)]
    rows = [("A", T0 + dt.timedelta(hours=i), base[i]) for i in range(300)]
    rows += [("B", T0 + dt.timedelta(hours=i), base[i - 5] if i >= 5 else 0.0) for i in range(300)]
    d = spark.createDataFrame(rows, "symbol string, ts timestamp, ret double")
    r = cr.best_lag(d).first()
    assert r["lag"] == -5 and r["correlation"] == pytest.approx(1) and r["p_value"] < 1e-6
    s = cr.spillover(d).collect()
    assert [(x["source_market"], x["target_market"], x["lag_hours"]) for x in s] == [("A", "B", 5)]


def test_windows_are_half_open(spark):
    rows = [("X", T0 + dt.timedelta(days=i), float(i)) for i in range(181)]
    d = spark.createDataFrame(rows, "symbol string, ts timestamp, close double")
    windows = wf.walk_windows(d).orderBy("window_id").collect()
    assert [(w["in_start"] - T0).days for w in windows] == [0, 30, 60]
    parts = wf.assign_windows(d).groupBy("window_id", "segment").count().collect()
    assert {(r["window_id"], r["segment"]): r["count"] for r in parts} == {
        (w, s): n for w in (1, 2, 3) for s, n in (("in", 90), ("out", 30))}


def test_outcomes_are_repeatable(spark):
    rows = [("X", T0 + dt.timedelta(days=i), 0.01 if i % 2 else -0.005) for i in range(252)]
    d = spark.createDataFrame(rows, "symbol string, ts timestamp, ret double")
    a = {r["sim"]: r["final_return"] for r in oc.bootstrap_outcomes(d, 50).collect()}
    b = {r["sim"]: r["final_return"] for r in oc.bootstrap_outcomes(d.repartition(7), 50).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    mean = sum(a.values()) / 50
    assert 0.4 < mean < 1.6  # (1 + 0.0025) ** 252 - 1 is about 0.88


def lagged_by_hand(rows, max_lag):
    """Per pair the aligned values, shifted one lag after the other."""
    series = {}
    for s, t, v in rows:
        if s is not None and t is not None and v is not None and math.isfinite(v):
            series.setdefault(s, {})[t] = max(v, series.get(s, {}).get(t, v))
    out = {}
    for a in series:
        for b in series:
            common = sorted(series[a].keys() & series[b].keys())
            for lag in range(-max_lag, max_lag + 1) if a < b else ():
                k, x, y = abs(lag), [series[a][t] for t in common], [series[b][t] for t in common]
                x, y = (x[k:], y[: len(y) - k]) if lag >= 0 else (x[: len(x) - k], y[k:])
                if len(x) >= 2 and len(x) == len(y):
                    mx, my = sum(x) / len(x), sum(y) / len(y)
                    xy = sum((p - mx) * (q - my) for p, q in zip(x, y))
                    scale = math.sqrt(sum((p - mx) ** 2 for p in x) * sum((q - my) ** 2 for q in y))
                    out[a, b, lag] = (None if len(set(x)) == 1 or len(set(y)) == 1 else xy / scale, len(x))
    return out


def gappy_series():
    """Series with gaps, one with few times, one constant, one far from zero; odd rows between."""
    rnd = random.Random(3)
    rows = []
    for s, share, shift in (("A", 0.9, 0), ("B", 0.7, 1e6), ("C", 0.08, 0), ("D", 0.5, None), ("E", 1.0, -5)):
        rows += [(s, T0 + dt.timedelta(hours=i), 0.1 if shift is None else shift + rnd.gauss(0, 1))
                 for i in range(400) if rnd.random() < share]
    rows += rows[10:20] + [("A", T0 + dt.timedelta(hours=30), -99.0), (None, T0, 1.0), ("A", None, 1.0), ("B", T0, None),
                           ("E", T0 + dt.timedelta(hours=900), float("nan")), ("A", T0 + dt.timedelta(hours=900), float("inf"))]
    return rows


@pytest.mark.parametrize("block,tile,max_lag", [(1, 1, 7), (50, 2, 30), (10_000, 32, 7)])
def test_lag_correlations_by_hand(spark, block, tile, max_lag):
    rows = gappy_series()
    d = spark.createDataFrame(rows, "symbol string, ts timestamp, ret double").withColumn("lag", F.lit("own"))
    got = {(r["market1"], r["market2"], r["lag"]): (r["r"], r["n"]) for r in lg.lag_correlations(d, max_lag, block=block, tile=tile).collect()}
    want = lagged_by_hand(rows, max_lag)
    assert got.keys() == want.keys()
    for k, (r, n) in want.items():
        assert got[k][1] == n and (got[k][0] is None if r is None else got[k][0] == pytest.approx(r, abs=1e-9)), k


def test_lag_correlations_of_listed_pairs(spark):
    d = spark.createDataFrame(gappy_series(), "symbol string, ts timestamp, ret double")
    names = [("E", "A"), ("A", "E"), ("B", "B"), ("C", "nobody"), (None, "A"), ("B", "E")]
    wanted = spark.createDataFrame(names, "market1 string, market2 string")
    key = lambda rows: sorted((r["market1"], r["market2"], r["lag"], r["n"], round(r["r"], 9)) for r in rows)
    every = [r for r in lg.lag_correlations(d, 5).collect() if (r["market1"], r["market2"]) in {("A", "E"), ("B", "E")}]
    assert key(lg.lag_correlations(d, 5, wanted, block=50, tile=2).collect()) == key(every)
    assert lg.lag_correlations(d.where("false"), 5).collect() == []
    assert lg.lag_correlations(d.where("symbol = 'A'"), 5).collect() == []
    assert lg.lag_correlations(d, 5, wanted.where("false")).collect() == []
