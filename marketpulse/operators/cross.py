"""Cross-market measures: correlation matrix, best lag, spillover, coupling, risk regime."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from marketpulse.functions import frames as fr
from marketpulse.functions.numeric import corr, num
from marketpulse.operators.joins import beside, market_pairs
from marketpulse.operators.lags import lag_correlations
from marketpulse.operators.series import over_series
from marketpulse.session import materialise

PAIR = ["market1", "market2"]


def _p_value_udf():
    """Two-sided tail of Student's t: the incomplete beta function, one formula for every length.

    The functions are local, so executors need no copy of this package.
    """
    def beta_ratio(a: float) -> float:
        """ln of gamma(a + 1/2) / gamma(a), without the loss of two large logarithms."""
        if a < 50:
            return math.lgamma(a + 0.5) - math.lgamma(a)
        return 0.5 * math.log(a) - 1 / (8 * a) + 1 / (192 * a**3) - 1 / (640 * a**5)

    def fraction(x: float, a: float, b: float) -> float:
        """Continued fraction of the incomplete beta function (Lentz)."""
        tiny, c = 1e-300, 1.0
        d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
        out = d
        for m in range(1, 500):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                        -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + top * d
                c = 1 + top / c
                d = 1 / (d if abs(d) > tiny else tiny)
                c = c if abs(c) > tiny else tiny
                out *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return out

    def one(t: float, n: int) -> float:
        if pd.isna(t):
            return 1.0
        if t == 0:
            return 1.0
        df = float(n - 2)
        a, b, x, y = df / 2, 0.5, df / (df + t * t), t * t / (df + t * t)
        front = math.exp(beta_ratio(a) - 0.5 * math.log(math.pi) - a * math.log1p(t * t / df) + b * math.log(y))
        inside = front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(y, b, a) / b
        return min(max(inside, 0.0), 1.0)

    def run(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([one(a, b) for a, b in zip(t, n)], dtype="float64")
    run.__annotations__ = {"t": pd.Series, "n": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, DoubleType())


def t_statistic(r: Column, n: Column) -> Column:
    return r * F.sqrt(F.try_divide((n - 2).cast("double"), 1 - r * r))


def p_value(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs; 1 below three pairs, 0 for a perfect one."""
    return F.when(n < 3, num(1)).when(F.abs(r) >= 1, num(0)).otherwise(_p_value_udf()(t_statistic(r, n), n))


def returns(bars: DataFrame, **series) -> DataFrame:
    d = over_series(bars, lambda x, w: x.withColumn("ret", fr.change(F.col("close"), 1, w)), 1, **series)
    return d.where(F.col("ret").isNotNull()).select("symbol", "ts", "ret")


def corr_matrix(rets: DataFrame, value: str = "ret") -> DataFrame:
    """(market1, market2, correlation, n): every ordered pair, 1 on the diagonal."""
    half = market_pairs(rets, value).groupBy(*PAIR).agg(
        corr(F.col("x"), F.col("y")).alias("correlation"), F.count(F.lit(1)).alias("n"))
    # Each unordered pair is computed once and listed both ways.
    both = half.select(F.inline(F.array(
        F.struct("market1", "market2", "correlation", "n"),
        F.struct(F.col("market2").alias("market1"), F.col("market1").alias("market2"), "correlation", "n"),
    )))
    own = rets.where(F.col(value).isNotNull()).groupBy(F.col("symbol").alias("market1")).agg(
        F.count(F.lit(1)).alias("n"))
    diagonal = own.select("market1", F.col("market1").alias("market2"), num(1).alias("correlation"), "n")
    return both.unionByName(diagonal)


def strongest(lagged: DataFrame) -> DataFrame:
    """Per pair of (pair..., lag, r, n) the lag with the largest abs correlation (the smallest lag on ties) and its p value."""
    best = lagged.groupBy(*PAIR).agg(
        F.max_by(F.struct("lag", "r", "n"), F.struct(F.round(F.abs("r"), 12), -F.col("lag"))).alias("_b"))
    d = best.select(*PAIR, F.col("_b.lag").alias("lag"), F.coalesce("_b.r", num(0)).alias("correlation"),
                    F.col("_b.n").alias("n"))
    return d.withColumns({"t": t_statistic(F.col("correlation"), F.col("n")),
                          "p_value": p_value(F.col("correlation"), F.col("n"))})


def best_lag(rets: DataFrame, max_lag: int = 24, wanted: DataFrame | None = None, **cut) -> DataFrame:
    """(pair..., lag, correlation, n, t, p_value) of all pairs, or of those in ``wanted``; see ``lags.lag_sums``."""
    return strongest(lag_correlations(rets, max_lag, wanted, **cut))


def spilled(lagged: DataFrame, threshold: float = 0.5, alpha: float = 0.05, least: int = 10) -> DataFrame:
    """Source to target effects in (pair..., lag, r, n): the strongest significant lagged correlation above the threshold.

    At a negative lag market1 is earlier and is the source, at a positive one market2.
    """
    first = F.col("lag") < 0
    source, target = (F.when(first, F.col(a)).otherwise(F.col(b)) for a, b in (PAIR, PAIR[::-1]))
    directed = lagged.where("lag <> 0").select(
        source.alias("source_market"), target.alias("target_market"), F.abs("lag").alias("lag"), "r", "n")
    tested = directed.where(F.col("n") >= least).withColumn("p_value", p_value(F.col("r"), F.col("n")))
    tested = tested.where(F.col("p_value") < alpha)
    best = tested.groupBy("source_market", "target_market").agg(
        F.max_by(F.struct("lag", "r", "n", "p_value"), F.struct(F.round(F.abs("r"), 12), -F.col("lag"))).alias("_b"))
    r = F.col("_b.r")
    return best.where(F.abs(r) > threshold).select(
        "source_market", "target_market",
        F.abs(r).alias("spillover_strength"), F.when(r > 0, "positive").otherwise("negative").alias("direction"),
        F.col("_b.lag").alias("lag_hours"), F.col("_b.p_value").alias("p_value"),
    )


def spillover(rets: DataFrame, max_lag: int = 24, threshold: float = 0.5, alpha: float = 0.05, least: int = 10,
              wanted: DataFrame | None = None, **cut) -> DataFrame:
    """Source to target effects between all pairs, or those in ``wanted`` (both ways); see ``spilled``."""
    return spilled(lag_correlations(rets, max_lag, wanted, **cut), threshold, alpha, least)


def pair_correlations(rets: DataFrame, least: int = 10) -> DataFrame:
    return market_pairs(rets).groupBy(*PAIR).agg(
        corr(F.col("x"), F.col("y")).alias("r"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def dominance(pairs: DataFrame, market: str) -> DataFrame:
    """Mean abs correlation of one market with all others, at most 1."""
    own = pairs.where((F.col("market1") == market) | (F.col("market2") == market))
    return own.agg(F.least(F.coalesce(F.avg(F.abs("r")), num(0)), num(1)).alias("dominance"))


def coupling(pairs: DataFrame) -> DataFrame:
    """Mean abs correlation of all pairs, at most 1."""
    return pairs.agg(F.least(F.coalesce(F.avg(F.abs("r")), num(0)), num(1)).alias("market_coupling"))


def risk_regime(rets: DataFrame, base: str, stock: str, fear_level: float | None = None) -> DataFrame:
    """risk_on, risk_off or neutral from the correlation of two markets and their volatility.

    ``fear_level`` (a volatility index) replaces the mean volatility when given.
    """
    def deviation(name: str) -> Column:
        return F.stddev_samp(F.when(F.col("symbol") == name, F.col("ret"))) * F.sqrt(num(24))
    level = (deviation(base) + deviation(stock)) / 2 if fear_level is None else F.least(num(fear_level / 50), num(1))
    spread = rets.where(F.col("symbol").isin(base, stock)).agg(level.alias("volatility_level"))
    linked = pair_correlations(rets.where(F.col("symbol").isin(base, stock))).agg(
        F.coalesce(F.max("r"), num(0)).alias("correlation"))
    r, v = F.col("correlation"), F.col("volatility_level")
    on, off = (r > 0.4) & (v < 0.4), (r < -0.2) | (v > 0.6)
    return beside(spread, linked).select(
        F.when(on, "risk_on").when(off, "risk_off").otherwise("neutral").alias("regime"),
        F.when(on, F.least(r + (1 - v), num(1))).when(off, F.least(F.abs(r) + v, num(1)))
        .otherwise(1 - F.abs(r)).alias("confidence"),
        "correlation", "volatility_level",
    )


def cross_market(bars: DataFrame, base: str, stock: str) -> DataFrame:
    """One row: best lagged correlation of the two markets, dominance, coupling, spillover, risk regime."""
    rets = materialise(returns(bars), "returns")
    pairs = materialise(pair_correlations(rets), "pairs")
    two = rets.where(F.col("symbol").isin(base, stock))
    at_lags = materialise(lag_correlations(two), "lags")
    lagged = strongest(at_lags).select(F.col("correlation").alias("best_correlation"), F.col("lag").alias("best_lag"))
    spill = spilled(at_lags).agg(F.coalesce(F.avg("spillover_strength"), num(0)).alias("spillover_index"))
    risk = risk_regime(rets, base, stock).withColumnRenamed("correlation", "base_correlation")
    return reduce(beside, [dominance(pairs, base), coupling(pairs), spill, risk], lagged)

