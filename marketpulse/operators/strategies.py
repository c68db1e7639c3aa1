"""Walk-forward tests of a strategy that is a Python function of a window's bars and its parameters.

Windows are assigned by arithmetic (``walkforward.assign_windows``), the grid is a table of its own, and each group of
(symbol, window, share of the grid) is one call into Python. Indicators see the bars of their window alone.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.operators.joins import param_grid
from marketpulse.operators.walkforward import assign_windows
from marketpulse.session import materialise

# Functions that run in Python workers are sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

METRICS = ("returns", "sharpe", "sortino")
#: Trading days of a year.
YEAR = 252


def scores_of(r: np.ndarray) -> dict[str, float]:
    """Compounded return, Sharpe and Sortino ratio of returns per bar; a ratio without spread is 0, a lost stake -1."""

    def ratio(some: np.ndarray) -> float:
        spread = some.std(ddof=1) if len(some) > 1 else 0.0
        return float(r.mean() / spread * np.sqrt(YEAR)) if spread > 0 else 0.0

    if not len(r):
        return dict.fromkeys(METRICS, 0.0)
    grown = float(np.prod(1 + r)) if (1 + r).min() > 0 else 0.0
    return {"returns": grown - 1, "sharpe": ratio(r), "sortino": ratio(r[r < 0])}


def ma_cross(data, params: dict) -> dict[str, float]:
    """Long while the fast average lies above the slow one, from the next bar on; averages start inside ``data``."""
    close = data["close"].to_numpy(float)

    def mean(n: int) -> np.ndarray:
        out = np.full(len(close), np.nan)
        if len(close) >= n:
            out[n - 1 :] = np.lib.stride_tricks.sliding_window_view(close, n).mean(axis=1)
        return out

    held = mean(int(params["fast"])) > mean(int(params["slow"]))
    r = np.zeros(len(close))
    moved = np.divide(close[1:], close[:-1], out=np.ones(max(len(close) - 1, 0)), where=close[:-1] != 0) - 1
    r[1:] = np.where(held[:-1], moved, 0.0)
    return scores_of(r)


def strategy_scores(bars: DataFrame, tried: DataFrame, strategy: Callable, names: Sequence[str], order: Sequence[str] = ("ts",)) -> DataFrame:
    """(symbol, window_id, param_id, returns, sharpe, sortino, failed): ``strategy`` on the bars of each window.

    ``tried`` has a row per symbol, window, share and parameter set (param_id and ``names``); ``bars`` come once per share. The strategy gets
    a pandas frame of all columns of the window's bars, sorted by ``order``, and a dictionary of parameters. It
    returns a dictionary; a metric it leaves out is 0, one that is not a number is NULL. If it raises, all are NULL and ``failed`` is true.
    """
    keys = ["symbol", "window_id", "_share"]
    names, order = list(names), list(order)
    kinds = dict(tried.select("symbol", "window_id").dtypes)
    hidden = ["window_id", "_share", "segment"]
    fields = ["symbol", "window_id", "param_id", *METRICS, "failed"]

    def run(rows: pa.Table, options: pa.Table) -> pa.Table:
        found: dict[str, list] = {c: [] for c in fields}
        data = None
        for option in options.to_pylist() if rows.num_rows else []:
            if data is None:
                data = rows.drop_columns(hidden).sort_by([(c, "ascending") for c in order]).to_pandas()
            try:
                result = strategy(data.copy(), {n: option[n] for n in names})
                values = [float(result.get(m, 0.0)) for m in METRICS]
            except Exception:  # a user's function may fail for some parameters; counted in the result
                values = None
            for c in ("symbol", "window_id", "param_id"):
                found[c].append(option[c])
            for i, m in enumerate(METRICS):
                found[m].append(None if values is None or np.isnan(values[i]) else values[i])
            found["failed"].append(values is None)
        types = [options.schema.field(c).type for c in fields[:3]] + [pa.float64()] * len(METRICS) + [pa.bool_()]
        return pa.table([pa.array(found[c], t) for c, t in zip(fields, types)], names=fields)

    schema = (f"symbol {kinds['symbol']}, window_id {kinds['window_id']}, param_id long, "
              + ", ".join(f"{m} double" for m in METRICS) + ", failed boolean")
    return bars.groupBy(*keys).cogroup(tried.groupBy(*keys)).applyInArrow(run, schema)


def walk_forward_strategy(bars: DataFrame, strategy: Callable, grid: dict[str, Sequence], metric: str = "sharpe", in_days: int = 90,
                          out_days: int = 30, step_days: int = 30, least_in: int = 10, least_out: int = 5, share: int = 16,
                          most: int = 2_000_000, order: Sequence[str] = ("ts",)) -> DataFrame:
    """One row per symbol and window: the parameters with the best in-sample ``metric``, and their scores in and out of sample.

    ``strategy(data, params)`` returns a dictionary with returns, sharpe and sortino. It is called for each set of the
    grid on the bars in sample, and for the best one on those out of sample; the first of equal scores wins. ``share`` sets of the grid are tried by
    one task, so a long grid is spread out; each bar is copied once per share and window that holds it. A set
    for which the strategy raises, or whose metric is not a number, is passed over; ``failed`` counts those that raised. If no set is left, the
    first one is taken with NULL scores in sample. If the strategy raises out of sample, both scores there are 0.

    A window's bars are held by one task: above ``most`` rows in a window ValueError is raised, none is cut. Bars without
    symbol or time are in no window; bars equal in ``order`` come in any order. A table without bars or windows gives no rows.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    if not grid or not all(len(v) for v in grid.values()):
        raise ValueError("the grid needs a value for each parameter")
    taken = {"symbol", "window_id", "param_id", "segment", "failed", *METRICS} & set(grid)
    if taken:
        raise ValueError(f"names of parameters are taken: {sorted(taken)}")
    names = list(grid)
    clash = {"window_id", "segment"} & set(bars.columns)
    if clash:
        raise ValueError(f"columns of the bars clash: {sorted(clash)}")
    keys = ["symbol", "window_id"]
    sets = int(np.prod([len(v) for v in grid.values()]))
    shares = -(-sets // share)

    def dealt(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    rows = assign_windows(bars, in_days, out_days, step_days)
    counts = materialise(rows.groupBy(*keys).agg(
        F.count_if(F.col("segment") == "in").alias("_in"), F.count_if(F.col("segment") == "out").alias("_out")), "counts")
    longest = counts.agg(F.max(F.greatest("_in", "_out"))).first()[0]
    if longest is not None and longest > most:
        raise ValueError(f"a window holds {longest} bars, more than {most}: use longer bars or shorter windows")
    windows = counts.where((F.col("_in") >= least_in) & (F.col("_out") >= least_out)).select(*keys)
    rows = rows.join(windows, keys, "left_semi")
    options = param_grid(bars.sparkSession, grid).withColumn("_share", F.floor(F.col("param_id") / share).cast("int"))

    inside = rows.where("segment = 'in'").withColumn("_share", dealt(shares))
    tried = windows.withColumn("_share", dealt(shares)).join(options, "_share")
    scores = strategy_scores(inside, tried, strategy, names, order)
    order_by = F.struct(F.round(metric, 9), -F.col("param_id"))
    best = scores.groupBy(*keys).agg(
        F.max_by(F.struct("param_id", "returns", "sharpe"), F.when(F.col(metric).isNotNull(), order_by)).alias("_b"),
        F.count_if("failed").alias("failed"))
    best = best.select(*keys, F.coalesce("_b.param_id", F.lit(0)).cast("long").alias("param_id"),
                       F.col("_b.returns").alias("in_sample_return"), F.col("_b.sharpe").alias("in_sample_sharpe"), "failed")
    best = materialise(best.join(options.drop("_share"), "param_id"), "best")

    outside = rows.where("segment = 'out'").withColumn("_share", F.lit(0))
    tested = strategy_scores(outside, best.select(*keys, F.lit(0).alias("_share"), "param_id", *names), strategy, names, order)
    tested = tested.select(*keys, F.coalesce("returns", F.lit(0.0)).alias("out_of_sample_return"),
                           F.coalesce("sharpe", F.lit(0.0)).alias("out_of_sample_sharpe"))
    return best.join(tested, keys).select(
        *keys, "param_id", *names, "in_sample_return", "in_sample_sharpe", "out_of_sample_return", "out_of_sample_sharpe", "failed")
