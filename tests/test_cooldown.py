"""Cooldown between signals against a walk over the sorted rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketpulse.operators import signals as sg

T0 = dt.datetime(2024, 10, 1)
SCHEMA = "symbol string, ts timestamp, action string, confidence double, note map<string,int>, _t string"


def make_rows():
    rnd = random.Random(11)
    rows = []
    for symbol, n in (("A", 300), (None, 60), ("hot", 1500), ("one", 1)):
        rows += [(symbol, T0 + dt.timedelta(minutes=rnd.randint(0, 4000)), rnd.choice(["BUY", "SELL"]), rnd.choice([0.5, 0.9, None]),
                  {"k": rnd.randint(0, 3)}, "own") for _ in range(n)]
    rows += [("A", T0 + dt.timedelta(minutes=60 * i), "BUY", 0.7, {}, "own") for i in range(20)]  # exactly one cooldown apart
    rows += rows[:15] + [("A", None, "BUY", 1.0, {}, "own"), ("none", None, "BUY", 1.0, {}, "own")]
    return rows


def walked(rows, minutes):
    kept, last = set(), {}
    timed = sorted({(r[0] or "", r[1]) for r in rows if r[1]}, key=lambda k: k)
    for symbol, ts in timed:
        if symbol not in last or ts >= last[symbol] + dt.timedelta(minutes=minutes):
            last[symbol] = ts
            same = [r for r in rows if (r[0] or "") == symbol and r[1] == ts]
            best = min((-(r[3] if r[3] is not None else -1.0), r[2]) for r in same)
            kept.add((symbol, ts, best[1], -best[0]))
    return kept


@pytest.mark.parametrize("minutes", [0.5, 60, 100_000])
def test_cooldown_is_the_walk(spark, minutes):
    rows = make_rows()
    d = spark.createDataFrame(rows, SCHEMA)
    got = [(r["symbol"] or "", r["ts"], r["action"], -1.0 if r["confidence"] is None else r["confidence"])
           for r in sg.cooled(d.repartition(5), minutes).collect()]
    assert len(got) == len(set(got)) and set(got) == walked(rows, minutes)


def test_cooldown_keeps_columns_and_runs_agree(spark):
    d = spark.createDataFrame(make_rows(), SCHEMA)
    a, b = (sg.cooled(d.repartition(n), 45) for n in (2, 7))
    assert a.columns == d.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert sg.cooled(d.where("false"), 45).collect() == []
    with pytest.raises(ValueError):
        sg.cooled(d, 0)


def test_holds_do_not_cool(spark):
    rows = [("A", T0 + dt.timedelta(minutes=m), s, 10) for m, s in
            ((0, 0.9), (10, 0.0), (20, 0.9), (60, -0.9), (70, 0.9), (130, 0.9))]
    d = spark.createDataFrame(rows, "symbol string, ts timestamp, sentiment_score double, source_count int")
    keep = lambda **k: [(r["ts"] - T0).seconds // 60 for r in sg.signals(d, min_confidence=0.1, **k).orderBy("ts").collect()]
    assert keep() == [0, 10, 20, 60, 70, 130]
    assert keep(cooldown=60) == [0, 10, 60, 130]
    assert keep(cooldown=60, max_per_day=2) == [0, 10]
