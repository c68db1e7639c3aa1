"""Forecasts from running sums, and mentions of the names of a table."""

import datetime as dt

import numpy as np
import pytest

from marketpulse.operators import gram, models, phrases

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(7)
    out = []
    for key in ("a", None):
        for day in range(5):
            for _ in range(15):
                x, y = (float(v) for v in rnd.normal(size=2))
                out.append((key, day, x, y, 4.0, 2 * x - y + 3 + float(rnd.normal(0, 0.1)) if rnd.random() > 0.1 else None))
    return out


def test_fits_use_earlier_chunks_only(spark, rows):
    names = ["x", "y", "c"]
    known = spark.createDataFrame(rows, "k string, day int, x double, y double, c double, t double")
    asked = known.select("k", "day").distinct()
    got = {(r["k"], r["day"]): r for r in gram.running_fits(known, asked, names, "t", ["k"], "day", 0.01, 20).collect()}
    for key in ("a", None):
        for day in range(5):
            past = np.array([r[2:] for r in rows if r[0] == key and r[1] < day and r[5] is not None], float).reshape(-1, 4)
            if len(past) < 20:
                assert (key, day) not in got
                continue
            x, t = past[:, :2], past[:, 3]
            z = (x - x.mean(0)) / x.std(0)
            w = np.linalg.solve(z.T @ z / len(z) + 0.01 * np.eye(2), z.T @ (t - t.mean()) / len(z)) / x.std(0)
            want = [*w, 0.0, t.mean() - x.mean(0) @ w]
            assert got[key, day]["n"] == len(past) and np.allclose(got[key, day]["coefficients"], want, atol=1e-9)
    assert gram.running_fits(known.where("false"), asked.where("false"), names, "t", ["k"], "day").collect() == []


def test_forecast_does_not_see_the_future(spark):
    rnd = np.random.default_rng(2)
    data = [("S", T0 + dt.timedelta(hours=h), 100 + float(rnd.normal()), *map(float, rnd.normal(size=12))) for h in range(24 * 6)]
    schema = "symbol string, ts timestamp_ntz, close double, " + ", ".join(f"{c} double" for c in models.FEATURES)
    cut = T0 + dt.timedelta(days=4)
    changed = [r if r[1] < cut else (*r[:2], r[2] * 3, *r[3:]) for r in data]
    before, after = ({(r["ts"], r["prediction_horizon"]): r["predicted_change"] for r in models.forecast(spark.createDataFrame(d, schema)).collect()}
                     for d in (data, changed))
    # Models of a day know nothing of that day or later ones.
    early = [k for k in before if k[0] < cut + dt.timedelta(days=1)]
    assert len(early) > 100 and all(before[k] == after[k] for k in early)
    assert any(before[k] != after[k] for k in before)


def test_phrase_mentions(spark):
    names = spark.createDataFrame([(n,) for n in ["New York", "new york  city", "new york city", "York", "Élan vital", "c", None, "", "--", "stop-loss", "a_b 1"]], "name string")
    posts = spark.createDataFrame(
        [(1, "In NEW YORK City, new york; \U0001f642 york"), (2, "Élan VITAL élan  vital C. stop-loss stop loss"), (3, None), (4, ""), (None, "xc c_ c a_b 1")],
        "post_id long, text string")
    got = sorted(((r["post_id"] or 0, r["start"], r["end"], r["name"]) for r in phrases.phrase_mentions(posts, names).collect()))
    assert got == [(0, 6, 7, "c"), (0, 8, 13, "a_b 1"), (1, 3, 16, "new york city"), (1, 18, 26, "new york"), (1, 30, 34, "york"),
                   (2, 0, 10, "élan vital"), (2, 23, 24, "c"), (2, 26, 35, "stop-loss")]
    for post, start, end, name in got:
        text = {r["post_id"] or 0: r["text"] for r in posts.collect()}[post]
        assert text[start:end].lower() == name
    assert phrases.phrase_mentions(posts, names.where("false")).collect() == []
    assert phrases.phrase_mentions(posts.where("false"), names).collect() == []


def test_many_names(spark):
    names = spark.range(200_000).selectExpr("concat('name ', id) AS name")
    posts = spark.createDataFrame([(1, "name 7, name 199999 name 200000 name 77")], "post_id long, text string")
    got = sorted(r["name"] for r in phrases.phrase_mentions(posts, names).collect())
    assert got == ["name 199999", "name 7", "name 77"]
