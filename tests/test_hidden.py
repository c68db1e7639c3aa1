"""Hidden states and clusters per symbol: any blocks, NULL keys, short series, a volatile neighbour."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketpulse.operators import hidden, regime

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def observed(spark):
    rnd = np.random.default_rng(3)
    data = []
    for symbol, n in (("A", 90), (None, 70), ("B", 19), ("C", 25)):
        state = 0
        for i in range(n):
            state = rnd.integers(3) if rnd.random() < 0.1 else state
            data.append((symbol, T0 + dt.timedelta(days=i), float(rnd.normal(state - 1, 0.3)), float(rnd.normal(abs(state - 1), 0.2))))
    data += [("A", T0, None, 1.0), ("A", None, 0.3, 0.2), ("C", T0, 0.1, 0.1)]
    return spark.createDataFrame(data, "symbol string, ts timestamp_ntz, ret double, vol double")


def rows_of(df):
    return sorted(((r["symbol"] or "", str(r["ts"]), round(r["ret"], 9), r["state"], round(r["probability"], 9)) for r in df.collect()))


def sequential(x, y, rounds):
    """The same model row by row, without blocks."""
    z = [(v - v.mean()) / (v.std() or 1) for v in (x, y)]
    p = np.array([1 / 3] * 3)
    a = np.where(np.eye(3), 0.8, 0.1)
    inside = [z[0] < -hidden.THIRD, abs(z[0]) <= hidden.THIRD, z[0] > hidden.THIRD]
    mean = np.array([[z[0][k].mean(), z[1][k].mean()] for k in inside])
    cov = np.array([np.eye(2)] * 3)
    o = np.column_stack(z)
    for step in range(rounds + 1):
        d = o[:, None] - mean
        log = -0.5 * (np.einsum("tsi,sij,tsj->ts", d, np.linalg.inv(cov), d) + np.log(np.linalg.det(cov)))
        b = np.exp(log - log.max(1, keepdims=True))
        f, w = np.zeros_like(b), np.ones_like(b)
        for t in range(len(b)):
            f[t] = (p if t == 0 else f[t - 1] @ a) * b[t]
            f[t] /= f[t].sum()
        for t in reversed(range(len(b) - 1)):
            w[t] = a @ (b[t + 1] * w[t + 1])
            w[t] /= w[t].sum()
        g = f * w / (f * w).sum(1, keepdims=True)
        if step == rounds:
            break
        pair = f[:-1, :, None] * a * (b * w)[1:, None, :]
        pair = (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        p, a = g[0], pair / pair.sum(1, keepdims=True)
        mean = g.T @ o / g.sum(0)[:, None]
        cov = np.array([np.einsum("t,ti,tj->ij", g[:, s], o, o) / g[:, s].sum() - np.outer(mean[s], mean[s]) + hidden.FLOOR * np.eye(2) for s in range(3)])
    best, back = np.log(p) + log[0], []
    for t in range(1, len(log)):
        ways = best[:, None] + np.log(a)
        back.append(ways.argmax(0))
        best = ways.max(0) + log[t]
    path = [int(best.argmax())]
    for came in reversed(back):
        path.append(int(came[path[-1]]))
    path = path[::-1]
    return path, g[np.arange(len(path)), path]


def test_hidden_states_for_any_blocks(observed):
    whole = rows_of(hidden.hidden_states(observed, "ret", "vol", rounds=3))
    assert {r[0] for r in whole} == {"", "A", "C"} and len(whole) == 91 + 70 + 26
    assert rows_of(hidden.hidden_states(observed, "ret", "vol", rounds=3, block=7)) == whole
    for symbol in ("", "C"):
        some = sorted((r for r in observed.where(F.coalesce("symbol", F.lit("")) == symbol).dropna(subset=["ret", "vol"]).collect()),
                      key=lambda r: (r["ts"], r["ret"]))
        path, sure = sequential(np.array([r["ret"] for r in some]), np.array([r["vol"] for r in some]), 3)
        assert [(r[3], r[4]) for r in whole if r[0] == symbol] == [(s, pytest.approx(p, abs=1e-8)) for s, p in zip(path, sure)]


def test_mixture_and_empty(observed):
    got = rows_of(hidden.hidden_states(observed, "ret", "vol", rounds=2, linked=False))
    assert rows_of(hidden.hidden_states(observed, "ret", "vol", rounds=2, linked=False, block=11)) == got
    assert hidden.hidden_states(observed.where("false"), "ret", "vol", rounds=1).collect() == []


def make_bars(spark, scale):
    rnd = np.random.default_rng(5)
    data = []
    for symbol, size in (("A", 0.01), ("B", scale)):
        price = 100.0
        for i in range(150):
            price *= float(np.exp(rnd.normal(0, size)))
            data.append((symbol, T0 + dt.timedelta(days=i), price, price * 1.01, price * 0.99, price, float(rnd.integers(1, 100))))
    return spark.createDataFrame(data, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def test_clusters_do_not_see_other_symbols(spark):
    calm, wild = (regime.regime_kmeans(make_bars(spark, s)).where("symbol = 'A'").collect() for s in (0.01, 0.5))
    assert len(calm) > 80 and sorted(map(tuple, calm), key=str) == sorted(map(tuple, wild), key=str)
    assert {r["regime"] for r in calm} == {"BULL", "BEAR", "SIDEWAYS"}
