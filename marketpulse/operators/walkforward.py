"""Walk-forward evaluation: rolling windows, grid search in sample, test out of sample.

A bar's windows follow from its distance to the start of the series, so windows are
assigned without a join and every (window, parameters) pair is one group of a single
aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.functions import frames as fr
from marketpulse.functions.numeric import div, num
from marketpulse.operators import indicators as ind
from marketpulse.operators.series import over_series
from marketpulse.session import materialise, sized

DAY = 86_400


def _days(ts: Column, start: Column) -> Column:
    return F.floor((F.unix_timestamp(ts.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))) / DAY)


def walk_windows(bars: DataFrame, in_days: int = 90, out_days: int = 30, step_days: int = 30) -> DataFrame:
    """(symbol, window_id, in_start, in_end, out_end): all windows that end inside the series."""
    span = bars.groupBy("symbol").agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    last = F.floor((_days(F.col("_b"), F.col("_a")) - (in_days + out_days)) / step_days)
    ids = span.where(last >= 0).select("symbol", "_a", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("_k"))

    def at(days) -> Column:
        return F.col("_a") + F.make_dt_interval(F.col("_k") * step_days + days)
    return ids.select(
        "symbol", (F.col("_k") + 1).alias("window_id"), at(F.lit(0)).alias("in_start"),
        at(F.lit(in_days)).alias("in_end"), at(F.lit(in_days + out_days)).alias("out_end"),
    )


def assign_windows(rows: DataFrame, in_days: int = 90, out_days: int = 30, step_days: int = 30) -> DataFrame:
    """Each row once per window that holds it, with ``window_id`` and ``segment`` ('in' or 'out').

    Windows are half-open. A row gets at most (in_days + out_days) / step_days + 1 copies; one without symbol or time is in no window.
    """
    rows = rows.where(F.col("ts").isNotNull())
    span = rows.groupBy("symbol").agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    whole = in_days + out_days
    d = rows.join(sized(span), "symbol")
    age = _days(F.col("ts"), F.col("_a"))
    last_window = F.floor((_days(F.col("_b"), F.col("_a")) - whole) / step_days)
    first = F.greatest(F.floor((age - whole) / step_days) + 1, F.lit(0))
    last = F.least(F.floor(age / step_days), last_window)
    d = d.withColumns({"_age": age, "_first": first, "_last": last}).where(F.col("_first") <= F.col("_last"))
    d = d.withColumn("_k", F.explode(F.sequence("_first", "_last")))
    inside = F.col("_age") - F.col("_k") * step_days < in_days
    return d.withColumns({
        "window_id": (F.col("_k") + 1).cast("int"), "segment": F.when(inside, "in").otherwise("out"),
    }).drop("_a", "_b", "_age", "_first", "_last", "_k")


def ma_cross_returns(bars: DataFrame, grid: Sequence[tuple[int, int]], **series) -> DataFrame:
    """(symbol, ts, param_id, fast, slow, r): long-only moving-average cross, position of the bar before.

    All averages come from one window pass; the grid is unrolled on the map side.
    """
    sizes = sorted({n for pair in grid for n in pair})

    def step(d, w):
        d = d.withColumns({f"_m{n}": fr.sma(F.col("close"), n, w) for n in sizes})
        d = d.withColumn("_ret", fr.change(F.col("close"), 1, w))
        return d.withColumns({
            f"_p{i}": F.lag(F.coalesce((F.col(f"_m{a}") > F.col(f"_m{b}")).cast("int"), F.lit(0))).over(w)
            for i, (a, b) in enumerate(grid)
        })
    d = over_series(bars, step, max(sizes), **series)
    options = F.array(*[
        F.struct(F.lit(i).alias("param_id"), F.lit(a).alias("fast"), F.lit(b).alias("slow"),
                 F.coalesce(F.col(f"_p{i}") * F.col("_ret"), num(0)).alias("r"))
        for i, (a, b) in enumerate(grid)
    ])
    return d.select("symbol", "ts", F.inline(options))


def _scores(assigned: DataFrame, keys: list[str]) -> DataFrame:
    r = F.col("r")
    below = F.when(r < 0, r)
    return assigned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.min(1 + r) > 0, F.exp(F.sum(F.log1p(F.when(r > -1, r))))).otherwise(num(0)).alias("_grown"),
        F.coalesce(div(F.avg(r), F.stddev_samp(r)) * F.sqrt(num(252)), num(0)).alias("sharpe"),
        F.coalesce(div(F.avg(r), F.stddev_samp(below)) * F.sqrt(num(252)), num(0)).alias("sortino"),
    ).withColumn("returns", F.col("_grown") - 1).drop("_grown")


def walk_forward(strategy: DataFrame, params: Sequence[str], metric: str = "sharpe", in_days: int = 90,
                 out_days: int = 30, step_days: int = 30, least_in: int = 10, least_out: int = 5) -> DataFrame:
    """One row per symbol and window: the parameters with the best in-sample metric and both scores.

    ``strategy`` holds the returns ``r`` of every parameter set (symbol, ts, param_id,
    parameters, r). Equal scores go to the first set of the grid.
    """
    if metric not in ("sharpe", "sortino", "returns"):
        raise ValueError(f"unknown metric: {metric}")
    keys = ["symbol", "window_id", "segment", "param_id", *params]
    scores = materialise(_scores(assign_windows(strategy, in_days, out_days, step_days), keys), "scores")
    inside = scores.where((F.col("segment") == "in") & (F.col("n") >= least_in))
    outside = scores.where((F.col("segment") == "out") & (F.col("n") >= least_out))
    best = inside.groupBy("symbol", "window_id").agg(F.max_by(
        F.struct("param_id", *params, "returns", "sharpe"), F.struct(F.round(metric, 9), -F.col("param_id"))
    ).alias("_b"))
    picked = best.select(
        "symbol", "window_id", *[F.col(f"_b.{p}").alias(p) for p in ("param_id", *params)],
        F.col("_b.returns").alias("in_sample_return"), F.col("_b.sharpe").alias("in_sample_sharpe"))
    tested = outside.select(
        "symbol", "window_id", "param_id", F.col("returns").alias("out_of_sample_return"),
        F.col("sharpe").alias("out_of_sample_sharpe"))
    return picked.join(tested, ["symbol", "window_id", "param_id"])


def param_stability(windows: DataFrame, params: Sequence[str]) -> DataFrame:
    """Mean over the parameters of 1 / (1 + coefficient of variation); 1 below two windows."""
    long = windows.select("symbol", F.inline(F.array(*[
        F.struct(F.lit(p).alias("param"), F.col(p).cast("double").alias("value")) for p in params])))
    v = F.col("value")
    per = long.groupBy("symbol", "param").agg(
        F.when((F.max(v) == F.min(v)) | (F.count(v) < 2), num(1))
        .otherwise(1 / (1 + F.stddev_pop(v) / (F.abs(F.avg(v)) + 1e-6))).alias("_s"))
    return per.groupBy("symbol").agg(F.avg("_s").alias("parameter_stability"))


def walk_forward_summary(windows: DataFrame, params: Sequence[str]) -> DataFrame:
    """Per symbol: summed out-of-sample return, ratio, drawdown, stability, efficiency."""
    windows = materialise(windows, "windows")
    chunk = F.floor(F.col("window_id") / 1000)
    curve = ind.cum_growth(windows, "out_of_sample_return", "_g", order=("window_id",), chunk=chunk)
    curve = ind.drawdown(curve, "_g", by=("symbol",), order=("window_id",), chunk=chunk)
    r = F.col("out_of_sample_return")
    out = curve.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("windows"), F.sum(r).alias("total_return"),
        F.when(F.count(r) > 1, F.avg(r) / (F.stddev_pop(r) + 1e-6) * F.sqrt(num(252))).otherwise(num(0))
        .alias("sharpe_ratio"),
        (F.min("drawdown_pct") / 100).alias("max_drawdown"),
        (F.avg("out_of_sample_sharpe") / (F.avg("in_sample_sharpe") + 1e-6)).alias("efficiency_ratio"),
    )
    return out.join(param_stability(windows, params), "symbol")


def apply_strategy(bars: DataFrame, position: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Returns of a user strategy that adds a ``position`` column to the bars."""
    d = over_series(
        position(bars),
        lambda x, w: x.withColumn("r", F.coalesce(F.lag("position").over(w) * fr.change(F.col("close"), 1, w), num(0))),
        1)
    return d.withColumn("param_id", F.lit(0))

