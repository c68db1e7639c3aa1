"""Resampled outcome distributions.

Every draw is a hash of (seed, path, step): the same on any cluster, after any retry,
and independent of partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.functions.numeric import num
from marketpulse.operators.indicators import cum_growth, drawdown
from marketpulse.operators.joins import join_or_beside
from marketpulse.operators.quantiles import exact_quantiles
from marketpulse.operators.series import number_rows
from marketpulse.session import sized

LEVELS = (90, 95, 99)
STEPS_PER_ROW = 1000


def _hash(seed: int, *parts: Column) -> Column:
    """A whole number in [0, 2^32) from the first 8 hex digits of an MD5."""
    key = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def _finals(draws: DataFrame, by: list[str]) -> DataFrame:
    """Final compounded return of each path; a total loss stays a total loss."""
    r = F.col("r")
    return draws.groupBy(*by, "sim").agg(
        F.when(F.min(1 + r) > 0, F.exp(F.sum(F.log1p(F.when(r > -1, r)))) - 1).otherwise(num(-1)).alias("final_return"))


def bootstrap_outcomes(returns: DataFrame, sims: int = 1000, periods: int | None = None, seed: int = 42,
                       by=("symbol",), order=("ts",), col: str = "ret") -> DataFrame:
    """(by..., sim, final_return): each path draws past returns with replacement.

    ``periods``: steps per path (default: as many as the series has returns). The
    draws are joined with the numbered returns on the drawn number, which spreads
    evenly.
    """
    by = list(by)
    numbered = number_rows(returns.where(F.col(col).isNotNull()), by, order).select(
        *by, (F.col("_rn") - 1).alias("_i"), F.col(col).alias("r"))
    sizes = returns.groupBy(*by).agg(F.count(col).alias("_n")).where(F.col("_n") > 0)
    # Paths per series, unrolled in parts of a bounded length.
    length = F.col("_n") if periods is None else F.lit(periods)
    parts = sizes.select(*by, "_n", length.alias("_len"), F.explode(
        F.sequence(F.lit(0), F.floor((length - 1) / STEPS_PER_ROW))).alias("_part"))
    # The short (series, part, path) rows are spread over the cluster before they are unrolled.
    paths = parts.withColumn("sim", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(sims - 1).cast("bigint"))))
    paths = paths.repartition("sim", "_part")
    begin = F.col("_part") * STEPS_PER_ROW
    end = F.least(begin + STEPS_PER_ROW, F.col("_len")) - 1
    steps = paths.select(*by, "_n", "sim", F.explode(F.sequence(begin, end)).alias("step"))
    drawn = steps.withColumn("_i", _hash(seed, F.col("sim"), F.col("step")) % F.col("_n"))
    return _finals(drawn.join(numbered, [*by, "_i"]), by)


def outcome_stats(paths: DataFrame, by=(), col: str = "final_return") -> DataFrame:
    """Mean, median, deviation, intervals, probabilities, extremes, value at risk of the final returns."""
    by = list(by)
    probs = {"median_return": 0.5, "var_cut": 0.05}
    for level in LEVELS:
        probs[f"ci{level}_low"] = (100 - level) / 200
        probs[f"ci{level}_high"] = 1 - (100 - level) / 200
    q = exact_quantiles(paths, by, col, sorted(set(probs.values())))
    wide = sized(q.groupBy(*by).agg(*[
        F.max(F.when(F.col("p") == p, F.col("q"))).alias(n) for n, p in probs.items()
    ]))
    x = F.col(col)
    joined = join_or_beside(paths, wide.select(*by, "var_cut"), by)
    basics = joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("simulations"), F.avg(x).alias("mean_return"), F.stddev_pop(x).alias("std_return"),
        F.avg((x > 0).cast("int")).alias("probability_profit"),
        F.avg((x < -0.1).cast("int")).alias("probability_loss_gt_10"),
        F.min(x).alias("worst_case"), F.max(x).alias("best_case"),
        (-F.avg(F.when(x <= F.col("var_cut"), x))).alias("cvar_95"),
    )
    both = join_or_beside(basics, wide, by)
    return both.withColumn("var_95", -F.col("var_cut")).drop("var_cut")


def path_drawdowns(draws: DataFrame, by=("sim",)) -> DataFrame:
    """Largest drawdown of each path of (sim, step, r); paths have a bounded number of steps."""
    chunk = F.floor(F.col("step") / 10_000)
    grown = cum_growth(draws, "r", "_g", by=by, order=("step",), chunk=chunk)
    return drawdown(grown, "_g", by=by, order=("step",), chunk=chunk).groupBy(*by).agg(
        (F.min("drawdown_pct") / 100).alias("max_drawdown"))
