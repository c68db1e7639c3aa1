"""Joins on time, on series pairs and on small lookups.

Broadcasts: Catalyst broadcasts a side when its known size is below
``spark.sql.autoBroadcastJoinThreshold``. Where the size of a lookup is unknown to it,
``checked`` counts the rows first. A larger side is joined by sort or hash, and AQE
splits its skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse.functions.numeric import seconds_between
from marketpulse.operators.series import join_same, over_series, running

GRID = 4096


def asof_join(events: DataFrame, bars: DataFrame, values: Sequence[str] = ("close",), by=("symbol",),
              ts: str = "ts", tolerance: float | None = None, chunk: Column | None = None,
              bar_ts: str = "bar_ts") -> DataFrame:
    """Each event with the last bar at or before it (at most ``tolerance`` seconds older).

    Both sides are stacked and the last bar is carried forward; no range join. Events with a NULL
    time keep their row and have no bar; bars with a NULL time are no one's; a NULL key is a key.
    """
    by = list(by)
    payload = [c for c in events.columns if c not in by and c != ts]
    left = events.select(*by, ts, F.lit(1).alias("_side"), F.struct(*payload).alias("_event")
                         if payload else F.struct(F.lit(1).alias("_one")).alias("_event"))
    right = bars.where(F.col(ts).isNotNull()).select(
        *by, F.col(ts).cast(events.schema[ts].dataType).alias(ts), F.lit(0).alias("_side"),
        F.struct(F.col(ts).alias(bar_ts), *values).alias("_bar"),
    )
    stacked = left.unionByName(right, allowMissingColumns=True)
    found = running(stacked, {"_last": ("last", F.col("_bar"))}, by, (ts, "_side"), chunk)
    out = found.where(F.col("_side") == 1)
    if tolerance is not None:
        near = seconds_between(F.col(f"_last.{bar_ts}"), F.col(ts)) <= tolerance
        out = out.withColumn("_last", F.when(near, F.col("_last")))
    fields = [F.col(f"_last.{c}").alias(c) for c in (bar_ts, *values)]
    return out.select(*by, ts, *[F.col(f"_event.{c}").alias(c) for c in payload], *fields)


def resample_ffill(bars: DataFrame, step: str = "1 hour", values: Sequence[str] = ("close",), by=("symbol",),
                   ts: str = "ts") -> DataFrame:
    """Each series on a regular grid that starts at its first bar and ends by its last, values carried forward.

    ``step`` is an interval of fixed length. Grids are made in two steps of at most GRID slots, so that
    no single row expands into a whole history.
    """
    by = list(by)
    span = bars.groupBy(*by).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    kind = bars.schema[ts].dataType
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    step_micros = F.expr(f"unix_micros(timestamp_micros(0) + interval {step})")
    counted = span.where("_a IS NOT NULL").select(
        *by, micros("_a").alias("_from"), step_micros.alias("_step"),
        F.floor((micros("_b") - micros("_a")) / step_micros).alias("_last"))
    runs = counted.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"_last div {GRID}"))))
    places = F.sequence(F.col("_run") * GRID, F.least(F.col("_last"), F.col("_run") * GRID + GRID - 1))
    grid = runs.select(*by, "_from", "_step", F.explode(places).alias("_k")).select(
        *by, F.timestamp_micros(F.col("_from") + F.col("_k") * F.col("_step")).cast(kind).alias(ts))
    return asof_join(grid, bars, values, by, ts)


def join_price_sentiment(bars: DataFrame, sent: DataFrame, by=("symbol",), ts: str = "ts") -> DataFrame:
    return bars.join(sent, [*by, ts], "inner")


def with_volume(df: DataFrame, volume: DataFrame | None, by=("symbol",), ts: str = "ts") -> DataFrame:
    """Left join of volume; without a volume table the column is 0."""
    if volume is None:
        return df.withColumn("volume", F.lit(0.0))
    return df.join(volume.select(*by, ts, "volume"), [*by, ts], "left")


def with_sentiment(features: DataFrame, sent: DataFrame, by=("symbol",), ts: str = "ts") -> DataFrame:
    return features.join(sent, [*by, ts], "left")


def join_votes(base: DataFrame, others: dict[str, DataFrame], by=("symbol",), ts: str = "ts") -> DataFrame:
    """Left join of further (regime, confidence) tables, columns suffixed by their name."""
    def add(left: DataFrame, item) -> DataFrame:
        name, other = item
        votes = other.select(
            *by, ts, F.col("regime").alias(f"regime_{name}"), F.col("confidence").alias(f"confidence_{name}")
        )
        return left.join(votes, [*by, ts], "left")
    return reduce(add, others.items(), base)


def exchange_flow(inflow: DataFrame, outflow: DataFrame, by=("symbol",), ts: str = "ts") -> DataFrame:
    """Inner join of two metric series; net_flow = in - out."""
    left = inflow.withColumnRenamed("value", "v_in")
    right = outflow.withColumnRenamed("value", "v_out")
    return left.join(right, [*by, ts]).withColumn("net_flow", F.col("v_in") - F.col("v_out"))


def align(a: DataFrame, b: DataFrame, value: str, ts: str = "ts") -> DataFrame:
    """Two series on their common times."""
    return a.select(ts, F.col(value).alias("x")).join(b.select(ts, F.col(value).alias("y")), ts)


def align_outer(series: DataFrame, names: Sequence[str], name: str = "symbol", value: str = "value",
                ts: str = "ts") -> DataFrame:
    """One column per named series, NULL where a series has no value."""
    return series.groupBy(ts).pivot(name, list(names)).agg(F.first(value))


def posts_of(posts: DataFrame, users: DataFrame, key: str = "user_id") -> DataFrame:
    return posts.join(users.select(key), key, "left_semi")


def new_only(df: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    return df.join(seen.select(key), key, "left_anti")


def market_pairs(returns: DataFrame, value: str = "ret", by: str = "symbol", ts: str = "ts") -> DataFrame:
    """(market1, market2, ts, x, y) for each unordered pair of markets on common times."""
    a = returns.where(F.col(value).isNotNull()).select(ts, F.col(by).alias("market1"), F.col(value).alias("x"))
    b = returns.where(F.col(value).isNotNull()).select(ts, F.col(by).alias("market2"), F.col(value).alias("y"))
    return a.join(b, ts).where(F.col("market1") < F.col("market2"))


def lagged_pairs(pairs: DataFrame, max_lag: int = 24, pair=("market1", "market2"), ts: str = "ts",
                 lags: Sequence[int] | None = None, chunk: Column | None = None) -> DataFrame:
    """(pair..., lag, x, y): x at row i + lag against y at row i for lag > 0, and the mirror for lag < 0.

    Rows come from lag columns of one window pass; the caller aggregates them at once,
    so the copies per lag are combined before any shuffle.
    """
    lags = list(range(-max_lag, max_lag + 1)) if lags is None else list(lags)

    def step(d, w):
        def one(lag: int) -> Column:
            x = F.col("x") if lag >= 0 else F.lag("x", -lag).over(w)
            y = F.col("y") if lag <= 0 else F.lag("y", lag).over(w)
            return F.struct(F.lit(lag).alias("lag"), x.alias("x"), y.alias("y"))
        return d.withColumn("_lags", F.array(*[one(lag) for lag in lags]))
    reach = max(abs(lag) for lag in lags)
    out = over_series(pairs, step, reach, by=pair, order=(ts,), chunk=chunk)
    return out.select(*pair, F.inline("_lags")).where(F.col("x").isNotNull() & F.col("y").isNotNull())


def beside(df: DataFrame, one: DataFrame) -> DataFrame:
    """The columns of a one-row table (an aggregate without keys) next to every row."""
    return df.crossJoin(F.broadcast(one))


def join_or_beside(df: DataFrame, side: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join of aggregates on their keys, NULL keys too; without keys the side has one row."""
    return join_same(df, side, list(by)) if by else beside(df, side)


def checked(dim: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """A lookup table, marked for broadcast only if it has at most ``max_rows`` rows."""
    return F.broadcast(dim) if dim.limit(max_rows + 1).count() <= max_rows else dim


def lookup_dim(df: DataFrame, dim: DataFrame, on) -> DataFrame:
    return df.join(checked(dim), on, "left")


def expand_users(posts: DataFrame, users: DataFrame, key: str = "author_id") -> DataFrame:
    """User columns on each post: username, followers 0, verified false when unknown."""
    facts = users.select(key, F.col("username").alias("_u"), F.col("followers").alias("_f"),
                         F.col("verified").alias("_v"))
    joined = posts.drop("username", "followers", "verified").join(facts, key, "left")
    return joined.withColumns({
        "username": F.coalesce("_u", F.concat(F.lit("user_"), F.col(key).cast("string"))),
        "followers": F.coalesce("_f", F.lit(0).cast("bigint")),
        "verified": F.coalesce("_v", F.lit(False)),
    }).drop("_u", "_f", "_v")


def param_grid(spark: SparkSession, grid: dict[str, Sequence]) -> DataFrame:
    """All combinations of a literal grid, numbered in grid order (last name fastest)."""
    import itertools

    names = list(grid)
    rows = [(i, *values) for i, values in enumerate(itertools.product(*grid.values()))]
    return spark.createDataFrame(rows, ["param_id", *names])


def pair_by_time(a: DataFrame, b: DataFrame, x: str, y: str, by=("symbol",), ts: str = "ts") -> DataFrame:
    """(by..., ts, x, y): two measures of the same moment."""
    left = a.select(*by, ts, F.col(x).alias("x"))
    return left.join(b.select(*by, ts, F.col(y).alias("y")), [*by, ts])


