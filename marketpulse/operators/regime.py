"""Market regimes: rules, clusters, hidden states, vote, and what happened in each regime."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marketpulse.functions import frames as fr
from marketpulse.functions.numeric import div, num
from marketpulse.operators import hidden
from marketpulse.operators import indicators as ind
from marketpulse.operators.joins import join_votes
from marketpulse.operators.series import join_same, over_series
from marketpulse.session import materialise, sized

REGIMES = ("BULL", "BEAR", "SIDEWAYS")
# Longest nested reach: the 200-row average.
FEATURE_LOOKBACK = 200
CLUSTER_FEATURES = ("ret", "volatility_20", "momentum_20", "price_to_sma_50", "trend_strength")


def add_features(d: DataFrame, w: WindowSpec, long_windows: bool = True) -> DataFrame:
    d = ind.add_returns(d, w)
    d = ind.add_sma_distance(d, w, (20, 50, 200) if long_windows else (20, 50))
    close = F.col("close")
    d = d.withColumns({
        "volatility_20": fr.std(F.col("ret"), 20, w),
        "momentum_10": fr.change(close, 10, w),
        "momentum_20": fr.change(close, 20, w),
        "volume_ratio": fr.volume_ratio(F.col("volume"), 20, w),
    })
    if long_windows:
        d = d.withColumn("volatility_50", fr.std(F.col("ret"), 50, w))
    return ind.add_hl_ratio(ind.add_adx(d, w).withColumnRenamed("adx", "trend_strength"))


def regime_features(bars: DataFrame, **series) -> DataFrame:
    """All features of the classifiers, one pass over the series."""
    return over_series(bars, add_features, FEATURE_LOOKBACK, **series)


def _points(*conditions: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") for c in conditions])


def regime_rules(bars: DataFrame, **series) -> DataFrame:
    """Four signs each way; three or more decide. (symbol, ts, regime, confidence, volatility, trend_strength)"""
    features = over_series(bars, lambda d, w: add_features(d, w, long_windows=False), 60, **series)
    close, fast, slow = F.col("close"), F.col("sma_20"), F.col("sma_50")
    move, strong = F.col("momentum_20"), F.col("trend_strength") > 25
    scored = features.withColumns({
        "_bull": _points(close > slow, fast > slow, move > 0.05, strong),
        "_bear": _points(close < slow, fast < slow, move < -0.05, strong),
    })
    unknown = slow.isNull() | fast.isNull()
    bull, bear = F.col("_bull"), F.col("_bear")
    regime = (
        F.when(unknown, "SIDEWAYS").when(bull >= 3, "BULL").when(bear >= 3, "BEAR").otherwise("SIDEWAYS")
    )
    confidence = (
        F.when(unknown, num(0.5)).when(bull >= 3, bull / num(4)).when(bear >= 3, bear / num(4))
        .otherwise(1 - F.greatest(bull, bear) / num(4))
    )
    return scored.select(
        "symbol", "ts", "close", regime.alias("regime"), confidence.alias("confidence"),
        F.col("volatility_20").alias("volatility"), "trend_strength",
    )


def _rank_by_return(classified: DataFrame, group: str) -> DataFrame:
    """Groups of each symbol ordered by mean return: lowest BEAR, highest BULL, the rest SIDEWAYS."""
    means = classified.groupBy("symbol", group).agg(F.avg("ret").alias("_mean"))
    best = sized(means.groupBy("symbol").agg(F.max_by(group, F.struct("_mean", -F.col(group))).alias("_best"),
                                             F.min_by(group, F.struct("_mean", group)).alias("_worst")))
    label = (
        F.when(F.col(group) == F.col("_worst"), "BEAR").when(F.col(group) == F.col("_best"), "BULL")
        .otherwise("SIDEWAYS")
    )
    return join_same(classified, best, ["symbol"]).withColumn("regime", label)


def _nearest(names: list[str]) -> list[Column]:
    """Squared distances of the named features to each centre of the row's ``centres``."""
    def gap(k: int) -> Column:
        return reduce(lambda a, b: a + b, [(F.col(c) - F.get(F.get("centres", F.lit(k)), F.lit(i))) ** 2 for i, c in enumerate(names)])
    return [gap(k) for k in range(3)]


def regime_kmeans(bars: DataFrame, rounds: int = 10, **series) -> DataFrame:
    """Three clusters of the standardised features of each symbol, named by their mean return.

    Seeds are the mean features of the rows in the lower, middle and upper third of a normal return. Each Lloyd step is one aggregate
    by symbol; it ends early when no centre moves. Equal distances go to the first cluster, an empty one keeps its centre.
    Rows without all features are left out, and symbols with fewer than 10 others.
    """
    rows = regime_features(bars, **series).dropna(subset=list(CLUSTER_FEATURES)).select("symbol", "ts", *CLUSTER_FEATURES)
    names = [f"_z{i}" for i in range(len(CLUSTER_FEATURES))]
    rows = materialise(hidden.standardised(materialise(rows, "features"), CLUSTER_FEATURES, names, least=10), "scaled")
    z = F.col("_z0")

    def means(inside: list[Column], empty: Callable[[int, int], Column]) -> Column:
        return F.array(*[F.array(*[F.coalesce(F.avg(F.when(k, F.col(c))), empty(j, i)) for i, c in enumerate(names)])
                         for j, k in enumerate(inside)])
    thirds = [z < -hidden.THIRD, F.abs(z) <= hidden.THIRD, z > hidden.THIRD]
    centres = sized(rows.groupBy("symbol").agg(means(thirds, lambda j, i: num(j - 1 if i == 0 else 0)).alias("centres")))
    a, b, c = _nearest(names)
    cluster = F.when((a <= b) & (a <= c), 0).when(b <= c, 1).otherwise(2)
    for _ in range(rounds):
        dealt = join_same(rows, centres, ["symbol"]).withColumn("cluster_id", cluster)
        old = lambda j, i: F.max(F.get(F.get("centres", F.lit(j)), F.lit(i)))  # noqa: E731 - the same in all rows
        moved = sized(dealt.groupBy("symbol").agg(
            means([F.col("cluster_id") == k for k in range(3)], old).alias("centres"), F.max("centres").alias("_old")))
        centres = moved.drop("_old")
        if moved.where("centres <> _old").isEmpty():
            break
    dealt = join_same(rows, centres, ["symbol"]).withColumn("cluster_id", cluster)
    near = dealt.withColumn("confidence", 1 / (1 + F.sqrt(F.least(a, b, c))))
    return _rank_by_return(near, "cluster_id").select("symbol", "ts", "regime", "confidence", "cluster_id")


def regime_hidden(bars: DataFrame, rounds: int = 10, block: int = hidden.BLOCK, linked: bool = True, **series) -> DataFrame:
    """Three hidden states with transitions over (return, volatility) of each symbol, named by their mean return.

    The state is that of the most likely path; confidence is its smoothed probability. Symbols with fewer than 20 rows are left out.
    """
    rows = regime_features(bars, **series).select("symbol", "ts", "ret", "volatility_20")
    found = hidden.hidden_states(materialise(rows, "features"), "ret", "volatility_20", rounds, block=block, linked=linked)
    found = materialise(found.select("symbol", "ts", "ret", F.col("state").alias("state_id"), F.col("probability").alias("confidence")), "states")
    return _rank_by_return(found, "state_id").select("symbol", "ts", "regime", "confidence", "state_id")


def regime_mixture(bars: DataFrame, **options) -> DataFrame:
    """``regime_hidden`` without transitions: each row for itself; confidence is the posterior."""
    return regime_hidden(bars, linked=False, **options)


def regime_vote(base: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """Confidence-weighted vote of the rule regimes and further methods."""
    joined = join_votes(base, others)
    ballots = [("regime", "confidence")] + [(f"regime_{n}", f"confidence_{n}") for n in others]

    def votes(name: str) -> Column:
        parts = [F.coalesce(F.when(F.col(r) == name, F.col(c)), num(0)) for r, c in ballots]
        return reduce(lambda a, b: a + b, parts)
    joined = joined.withColumns({f"_{name}": votes(name) for name in REGIMES})
    top = F.greatest(*[F.col(f"_{name}") for name in REGIMES])
    winner = F.when(F.col("_BULL") == top, "BULL").when(F.col("_BEAR") == top, "BEAR").otherwise("SIDEWAYS")
    cast = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for _, c in ballots])
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), num(0)) for _, c in ballots])
    return joined.select(
        "symbol", "ts", winner.alias("regime"), (total / cast).alias("confidence"), "volatility", "trend_strength"
    )


def regime(bars: DataFrame, method: str = "ensemble") -> DataFrame:
    if method == "technical":
        return regime_rules(bars)
    if method == "kmeans":
        return regime_kmeans(bars)
    if method == "hidden":
        return regime_hidden(bars)
    if method == "mixture":
        return regime_mixture(bars)
    if method == "ensemble":
        return regime_vote(regime_rules(bars), {"kmeans": regime_kmeans(bars), "hidden": regime_hidden(bars)})
    raise ValueError(f"unknown method: {method}")


def regime_transitions(regimes: DataFrame, **series) -> DataFrame:
    return ind.transitions(regimes, "regime", **series)


def _shares(regimes: DataFrame) -> DataFrame:
    """Bars, share (percent) and mean confidence per symbol and regime, all three regimes listed."""
    def of(name: str) -> Column:
        here = F.col("regime") == name
        return F.struct(F.lit(name).alias("regime"), F.count_if(here).alias("bars"),
                        F.avg(F.when(here, F.col("confidence"))).alias("avg_confidence"))
    counted = regimes.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("_n"), F.array(*[of(name) for name in REGIMES]).alias("_r")
    )
    return counted.select("symbol", "_n", F.inline("_r")).select(
        "symbol", "regime", "bars", (F.col("bars") / F.col("_n") * 100).alias("share_pct"),
        F.coalesce("avg_confidence", num(0)).alias("avg_confidence"),
    )


def regime_distribution(regimes: DataFrame) -> DataFrame:
    """Bars and share (percent) of each regime per symbol, with the number of changes."""
    changes = ind.change_count(regimes, "regime").withColumnRenamed("changes", "transitions")
    return _shares(regimes).join(changes, "symbol")


def regime_trades(bars: DataFrame, signal: str = "signal", capital: float = 10000.0, adaptive: bool = False,
                  **series) -> DataFrame:
    """Long-only trades on -1/0/1 signals over bars(symbol, ts, close, regime, signal).

    Enter at the first 1 while flat, leave at the first -1 or at the last bar. Each
    trade has the same notional, scaled 1.5 / 0.5 / 1 by the regime of the entry when
    ``adaptive``; its regime is that of the exit bar.
    """
    last = bars.groupBy("symbol").agg(F.max_by(F.struct("ts", "close", "regime"), "ts").alias("_end"))
    active = bars.where(F.col(signal) != 0)
    turns = materialise(over_series(
        active, lambda d, w: d.withColumn("_was", F.lag(signal).over(w)), 1, **series
    ).where(F.col("_was").isNull() | (F.col("_was") != F.col(signal))), "turns")
    paired = over_series(
        turns, lambda d, w: d.withColumn("_exit", F.lead(F.struct("ts", "close", "regime")).over(w)), 0, 1, **series
    ).where(F.col(signal) == 1)
    out = paired.join(last, "symbol").withColumn("_x", F.coalesce("_exit", "_end"))
    scale = F.when(F.col("regime") == "BULL", num(1.5)).when(F.col("regime") == "BEAR", num(0.5)).otherwise(num(1))
    size = num(capital) * (scale if adaptive else num(1)) / F.col("close")
    return out.select(
        "symbol", F.col("ts").alias("entry_time"), F.col("_x.ts").alias("exit_time"),
        F.col("close").alias("entry_price"), F.col("_x.close").alias("exit_price"), size.alias("size"),
        F.col("_x.regime").alias("regime"),
        (size * (F.col("_x.close") - F.col("close"))).alias("pnl"),
        ((F.col("_x.close") - F.col("close")) / F.col("close")).alias("pnl_pct"),
    )


def regime_performance(trades: DataFrame, regimes: DataFrame) -> DataFrame:
    """Per symbol and regime: trades, wins, returns, Sharpe, drawdown and time share."""
    keys = ["symbol", "regime"]
    curve = ind.cum_growth(trades, "pnl_pct", "_growth", by=keys, order=("exit_time",))
    curve = ind.drawdown(curve, "_growth", by=keys, order=("exit_time",))
    mean, spread = F.avg("pnl_pct"), F.stddev_pop("pnl_pct")
    perf = curve.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.count_if(F.col("pnl") > 0).alias("winning_trades"),
        F.count_if(F.col("pnl") < 0).alias("losing_trades"),
        (F.max_by("_growth", "exit_time") - 1).alias("total_return"),
        mean.alias("avg_return_per_trade"),
        F.when(F.count(F.lit(1)) > 1, div(mean, spread) * F.sqrt(num(252))).alias("sharpe_ratio"),
        F.abs(F.min(F.col("drawdown_pct") / 100)).alias("max_drawdown"),
    )
    share = _shares(regimes).select("symbol", "regime", F.col("share_pct").alias("time_in_regime"))
    out = share.join(perf, keys, "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("total_trades", "winning_trades", "losing_trades")}
    zero |= {c: F.coalesce(F.col(c), num(0)) for c in
             ("total_return", "avg_return_per_trade", "sharpe_ratio", "max_drawdown")}
    out = out.withColumns(zero)
    return out.withColumn(
        "win_rate", F.coalesce(div(F.col("winning_trades").cast("double"), F.col("total_trades")), num(0))
    )


def best_and_worst(performance: DataFrame) -> DataFrame:
    """Adds the regimes of each symbol with the highest and lowest return among those with trades.

    Equal returns (to 9 digits) go to the first of BULL, BEAR, SIDEWAYS. The window
    holds the three rows of a symbol.
    """
    w = Window.partitionBy("symbol")
    place = F.array_position(F.array(*[F.lit(r) for r in REGIMES]), F.col("regime"))
    traded, r = F.col("total_trades") > 0, F.round("total_return", 9)
    return performance.withColumns({
        "best_regime": F.max_by("regime", F.when(traded, F.struct(r, -place))).over(w),
        "worst_regime": F.min_by("regime", F.when(traded, F.struct(r, place))).over(w),
    })


def regime_backtest(bars: DataFrame, signals: DataFrame, adaptive: bool = False) -> DataFrame:
    """Regimes by rule, trades on the signals (symbol, ts, signal), performance per regime."""
    regimes = regime_rules(bars)
    priced = regimes.join(signals.select("symbol", "ts", "signal"), ["symbol", "ts"], "left")
    priced = materialise(priced.withColumn("signal", F.coalesce("signal", F.lit(0))), "regimes")
    trades = materialise(regime_trades(priced, adaptive=adaptive), "trades")
    return best_and_worst(regime_performance(trades, priced))


def ma_cross_signal(bars: DataFrame, fast: int = 5, slow: int = 20, **series) -> DataFrame:
    """1 / -1 while the fast average is above / below the slow one, 0 before both exist."""
    def step(d, w):
        gap = fr.sma(F.col("close"), fast, w) - fr.sma(F.col("close"), slow, w)
        return d.withColumn("signal", F.coalesce(F.signum(gap), num(0)).cast("int"))
    return over_series(bars, step, slow - 1, **series)
