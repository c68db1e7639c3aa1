"""Correlations of many series at many lags from blocked products.

A table of all pairs of M series over T times has M * M * T / 2 rows, and one more copy per lag. Here the times are cut
into blocks and the series into tiles; a task holds the values of two tiles in one block and sends sums of products per pair and
lag. A lag counts the common times of its own pair, so a pair also sends the rows at both ends of a block: products that reach
over a block's edge are taken from those by the lag join.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.functions.numeric import div, num
from marketpulse.operators.joins import beside, lagged_pairs
from marketpulse.session import materialise, sized

# Functions that run in Python workers are sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Times of a block (a chunk of time is never cut) and series of a tile: a task holds two tiles of one block.
BLOCK, TILE = 8192, 32
#: Fixed value: a series counts as constant if its variance is below this share of its mean square.
CONSTANT = 1e-12
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _block_sums(max_lag: int):
    """Of the values of two tiles in one block and the pairs asked for: sums per lag, and the rows at both ends."""
    lags = range(-max_lag, max_lag + 1)

    def run(values: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        times, at = np.unique(values["time"].to_numpy(), return_inverse=True)
        ids, row = np.unique(values["id"].to_numpy(), return_inverse=True)
        table = np.full((len(ids), len(times)), np.nan)
        table[row, at] = values["value"].to_numpy()
        place = {int(k): i for i, k in enumerate(ids)}
        out = []
        for i, j, block in zip(pairs["i"].tolist(), pairs["j"].tolist(), pairs["block"].tolist()):
            if i not in place or j not in place:
                continue
            common = ~(np.isnan(table[place[i]]) | np.isnan(table[place[j]]))
            x, y, t = table[place[i]][common], table[place[j]][common], times[common]
            n = len(x)
            if not n:
                continue
            sums = np.zeros((len(lags), len(SUMS)))
            for k, lag in enumerate(lags):
                size = n - abs(lag)
                if size > 0:
                    a = x[lag:] if lag > 0 else x[:size]
                    b = y[-lag:] if lag < 0 else y[:size]
                    sums[k] = size, a.sum(), b.sum(), a @ a, b @ b, a @ b
            ends = np.arange(n) if n <= 2 * max_lag else np.r_[0:max_lag, n - max_lag : n]
            out.append((i, j, block, *sums.T, t[ends], x[ends], y[ends]))
        return pd.DataFrame(out, columns=["i", "j", "block", *SUMS, "time", "x", "y"])

    run.__annotations__ = {}
    return run


def _all_pairs(series: DataFrame) -> DataFrame:
    """(i, j) of all series, i < j."""
    counted = beside(series.select("id"), series.agg(F.max("id").alias("_last")))
    return counted.where("id < _last").select(
        F.col("id").alias("i"), F.explode(F.sequence(F.col("id") + 1, F.col("_last"))).alias("j"))


def _asked_pairs(series: DataFrame, wanted: DataFrame) -> DataFrame:
    """(i, j) of the pairs in ``wanted``, each once and i < j."""
    left = series.select(F.col("symbol").alias("market1"), F.col("id").alias("_a"))
    right = series.select(F.col("symbol").alias("market2"), F.col("id").alias("_b"))
    both = wanted.select("market1", "market2").join(left, "market1").join(right, "market2").where("_a <> _b")
    return both.select(F.least("_a", "_b").alias("i"), F.greatest("_a", "_b").alias("j")).distinct()


def lag_sums(rets: DataFrame, max_lag: int = 24, wanted: DataFrame | None = None, value: str = "ret",
             chunk: Column | None = None, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(market1, market2, lag, n, sx, sy, sxx, syy, sxy): sums over the products of each pair of series at each lag.

    x is market1 and y is market2, market1 < market2, each less the mean of its series. At lag k > 0, x at a common time of the
    two meets y k common times earlier; at -k, y meets the earlier x. ``wanted`` (market1, market2, in any order) names
    the pairs to compute; without it all pairs are. ``chunk`` (default: the day) must grow with ``ts``; choose a smaller one if a day has
    many more than ``block`` times.

    Rows without a symbol, a time or a finite value are left out; of rows with the same symbol and time the largest value
    counts. Names in ``wanted`` that have no rows, and pairs of a series with itself, give nothing. An empty table gives an empty result.
    """
    day = F.to_date("ts") if chunk is None else chunk
    finite = F.abs(value) < float("inf")
    rows = rets.where(F.col("symbol").isNotNull() & F.col("ts").isNotNull() & finite).select(
        "symbol", "ts", day.alias("_chunk"), F.col(value).cast("double").alias("_value"))
    rows = materialise(rows.groupBy("symbol", "ts", "_chunk").agg(F.max("_value").alias("_value")), "values")
    # One row per chunk and one per series.
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sized(rows.groupBy("_chunk").agg(F.count_distinct("ts").alias("_times")).select(
        "_chunk", F.floor(F.coalesce(F.sum("_times").over(earlier), F.lit(0)) / block).alias("block")))
    series = sized(rows.groupBy("symbol").agg(F.avg("_value").alias("_mean")).select(
        "symbol", "_mean", (F.row_number().over(Window.orderBy("symbol")) - 1).cast("long").alias("id")))

    pairs = _all_pairs(series) if wanted is None else _asked_pairs(series, wanted)
    pairs = materialise(pairs.withColumns({"ta": F.expr(f"i div {tile}"), "tb": F.expr(f"j div {tile}")}), "pairs")
    met = sized(pairs.select("ta", "tb").distinct().select("ta", "tb", F.explode(F.array_distinct(F.array("ta", "tb"))).alias("_tile")))
    group = ["block", "ta", "tb"]
    values = (
        rows.join(blocks, "_chunk").join(series, "symbol").withColumn("_tile", F.expr(f"id div {tile}")).join(met, "_tile")
        .select(*group, "id", F.unix_micros(F.col("ts").cast("timestamp")).alias("time"), (F.col("_value") - F.col("_mean")).alias("value"))
    )
    numbers = blocks.select("block").distinct().agg(F.sort_array(F.collect_list("block")).alias("_blocks"))
    asked = beside(pairs, numbers).select("i", "j", "ta", "tb", F.explode("_blocks").alias("block"))
    kinds = ", ".join(f"{c} array<double>" for c in SUMS)
    found = materialise(values.groupBy(*group).cogroup(asked.groupBy(*group)).applyInPandas(
        _block_sums(max_lag), f"i long, j long, block long, {kinds}, time array<long>, x array<double>, y array<double>"), "sums")

    inside = found.select("i", "j", F.posexplode(F.arrays_zip(*SUMS)).alias("_k", "_s")).select(
        "i", "j", (F.col("_k") - max_lag).alias("lag"), "_s.*")
    ends = found.select("i", "j", "block", F.inline(F.arrays_zip("time", "x", "y"))).select(
        "i", "j", "block", "time", F.struct("block", F.col("x").alias("v")).alias("x"), F.struct("block", F.col("y").alias("v")).alias("y"))
    # Within one block the products are summed already.
    x, y = F.col("x.v"), F.col("y.v")
    across = lagged_pairs(ends, max_lag, ("i", "j"), "time", chunk=F.col("block")).where("x.block <> y.block").select(
        "i", "j", "lag", num(1).alias("n"), x.alias("sx"), y.alias("sy"), (x * x).alias("sxx"), (y * y).alias("syy"), (x * y).alias("sxy"))
    total = inside.unionByName(across).groupBy("i", "j", "lag").agg(*[F.sum(c).alias(c) for c in SUMS])
    first = series.select(F.col("id").alias("i"), F.col("symbol").alias("market1"))
    second = series.select(F.col("id").alias("j"), F.col("symbol").alias("market2"))
    return total.where("n > 0").join(first, "i").join(second, "j").select(
        "market1", "market2", "lag", F.col("n").cast("long").alias("n"), *SUMS[1:])


def lag_correlations(rets: DataFrame, max_lag: int = 24, wanted: DataFrame | None = None, **cut) -> DataFrame:
    """(market1, market2, lag, r, n) of each pair and lag with at least two products, from ``lag_sums``.

    r is NULL if a side is constant over those rows: its variance is below CONSTANT of its mean square around the mean of the series.
    """
    n = F.col("n")

    def spread(s: str, ss: str) -> Column:
        left = n * F.col(ss) - F.col(s) * F.col(s)
        return F.when(left > CONSTANT * n * F.col(ss), F.sqrt(left))
    r = div(n * F.col("sxy") - F.col("sx") * F.col("sy"), spread("sx", "sxx") * spread("sy", "syy"))
    return lag_sums(rets, max_lag, wanted, **cut).where("n >= 2").select(
        "market1", "market2", "lag", F.when(r.isNotNull(), F.greatest(F.least(r, num(1)), num(-1))).alias("r"), "n")
