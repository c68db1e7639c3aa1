"""Means over time ranges against exact sums of each frame."""

from __future__ import annotations

import datetime as dt
import random
from fractions import Fraction

import pytest

from marketpulse.operators.timeframes import rolling_time_mean

START = dt.datetime(2024, 3, 1, 23, 10)


def make():
    rnd = random.Random(4)
    rows = []
    for key, n, step in (("hot", 400, 400), (None, 60, 5000), ("thin", 8, 40000)):
        at = START
        for _ in range(n):
            at += dt.timedelta(seconds=rnd.choice([0, 1, 60, 300, step, 3600]))
            rows.append((key, at, rnd.choice([1e27, 1e-14, -3.5, 0.0, None, rnd.random() * 1e-14])))
    # One huge value, then tiny ones that lie more than a day later: a difference of running totals would lose them.
    rows += [("sizes", START, 1e27)] + [("sizes", START + dt.timedelta(days=2, minutes=k), 1e-14 * k) for k in range(1, 40)]
    rows += [("edge", dt.datetime(2024, 3, 2, h), float(h)) for h in range(6)] + [("nothing", START, None), ("hot", None, 5.0)]
    rows += [("old", dt.datetime(1969, 12, 31, 23, m), float(m)) for m in (10, 59)] + [("old", dt.datetime(1970, 1, 1, 0, 9, 59), 7.0)]
    return rows


@pytest.mark.parametrize("hours", [(1, 4, 24), (3,)])
def test_frames(spark, hours):
    rows = make()
    df = spark.createDataFrame(rows, "asset string, ts timestamp, v double").repartition(6)
    got = {(r["asset"], r["ts"]): r for r in rolling_time_mean(df, "v", hours).collect()}
    assert set(got) == {(a, t) for a, t, _ in rows if t is not None}
    for (asset, at), row in got.items():
        for h in hours:
            frame = [v for a, t, v in rows if a == asset and t is not None and at - dt.timedelta(hours=h) < t <= at and v is not None]
            if not frame:
                assert row[f"mean_{h}h"] is None
                continue
            exact = float(sum(map(Fraction, frame)) / len(frame))
            # The error is bounded by the values in the frame alone.
            assert abs(row[f"mean_{h}h"] - exact) <= 1e-12 * max(map(abs, frame))


def test_no_rows(spark):
    assert rolling_time_mean(spark.createDataFrame([], "asset string, ts timestamp, v double"), "v").collect() == []
