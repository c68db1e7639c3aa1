"""Behavioural biases in price and sentiment: herding, FOMO, FUD, confirmation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from marketpulse.functions import frames as fr
from marketpulse.functions.numeric import nonzero, num
from marketpulse.operators.quantiles import median
from marketpulse.operators.series import over_series
from marketpulse.session import materialise, sized

# Least strength per bias.
FLOORS = {"HERDING": 0.7, "FOMO": 0.75, "FUD": 0.75}
BIASES = ("HERDING", "FOMO", "FUD", "CONFIRMATION_BIAS")
KEEP = ("symbol", "ts")


def bias_features(df: DataFrame, **series) -> DataFrame:
    """All columns the detectors need, over rows (symbol, ts, close, sentiment, volume).

    Without any volume in a series its volume ratio is 1.
    """
    def step(d: DataFrame, w: WindowSpec) -> DataFrame:
        s = F.col("sentiment")
        d = d.withColumns({"ret": fr.change(F.col("close"), 1, w), "_seq": F.col("_rn") - 1,
                           "_avg_volume": fr.sma(F.col("volume"), 10, w)})
        r = F.col("ret")
        return d.withColumns({
            "ret_5": fr.total(r, 5, w), "ret_10": fr.total(r, 10, w), "volatility": fr.std(r, 10, w),
            "acceleration": fr.diff(r, w), "sentiment_change": fr.diff(s, w), "sentiment_std": fr.std(s, 10, w),
            "sentiment_10": fr.sma(s, 10, w),
        })
    d = over_series(df, step, 11, **series)
    traded = df.groupBy("symbol").agg((F.sum("volume") > 0).alias("_traded"))
    ratio = F.when(F.col("_traded"), F.col("volume") / nonzero(F.col("_avg_volume"))).otherwise(num(1))
    return d.join(sized(traded), "symbol").withColumn("volume_ratio", ratio).drop("_traded", "_avg_volume")


def _signal(d: DataFrame, kind: str, found: Column, strength: Column, floor: float, indicators: dict[str, Column]) -> DataFrame:
    pairs = [v for k, c in indicators.items() for v in (F.lit(k), c)]
    return d.where(found).select(
        *KEEP, F.lit(kind).alias("bias_type"), F.least(strength, num(1)).alias("strength"),
        F.create_map(*pairs).alias("indicators"),
    ).where(F.col("strength") > floor)


def bias_herding(features: DataFrame, floor: float = FLOORS["HERDING"]) -> DataFrame:
    move, ratio, spread = F.abs("ret_5"), F.col("volume_ratio"), F.col("sentiment_std")
    return _signal(
        features, "HERDING", (F.col("_seq") >= 10) & (move > 0.05) & (ratio > 1.5) & (spread < 0.2),
        move * ratio / (spread + 0.1), floor,
        {"momentum": move, "volume_ratio": ratio, "sentiment_variance": spread},
    )


def bias_fomo(features: DataFrame, floor: float = FLOORS["FOMO"]) -> DataFrame:
    r, s, ds, acc = F.col("ret_5"), F.col("sentiment"), F.col("sentiment_change"), F.col("acceleration")
    return _signal(
        features, "FOMO", (F.col("_seq") >= 5) & (r > 0.1) & (s > 0.5) & (ds > 0.3) & (acc > 0), r * s * ds * 2, floor,
        {"returns_5d": r, "sentiment": s, "sentiment_change": ds, "acceleration": acc},
    )


def bias_fud(features: DataFrame, floor: float = FLOORS["FUD"]) -> DataFrame:
    """Compares the volatility with its exact median per symbol."""
    d = features.join(sized(median(features, ["symbol"], "volatility", "_median")), "symbol", "left")
    s, ds, v, r = F.col("sentiment"), F.col("sentiment_change"), F.col("volatility"), F.col("ret")
    return _signal(
        d, "FUD", (F.col("_seq") >= 10) & (s < -0.5) & (ds < -0.3) & (v > F.col("_median") * 1.5) & (r < 0),
        F.abs(s) * F.abs(ds) * v * 10, floor,
        {"sentiment": s, "sentiment_change": ds, "volatility": v, "returns": r},
    )


def bias_confirmation(features: DataFrame) -> DataFrame:
    r, s = F.col("ret_10"), F.col("sentiment_10")
    against = ((r < -0.05) & (s > 0.3)) | ((r > 0.05) & (s < -0.3))
    return _signal(
        features, "CONFIRMATION_BIAS", (F.col("_seq") >= 10) & against, F.abs(r) * F.abs(s) * 5, -1.0,
        {"returns_10d": r, "sentiment_10d": s, "divergence": s - r * 10},
    )


def bias_signals(df: DataFrame, floors: dict[str, float] | None = None, least: int = 10) -> DataFrame:
    """All signals (symbol, ts, bias_type, strength, indicators) of series with at least ``least`` rows."""
    floors = {**FLOORS, **(floors or {})}
    features = materialise(bias_features(df), "bias")
    long = features.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("symbol")
    features = features.join(long, "symbol", "left_semi")
    found = [
        bias_herding(features, floors["HERDING"]), bias_fomo(features, floors["FOMO"]),
        bias_fud(features, floors["FUD"]), bias_confirmation(features),
    ]
    return reduce(DataFrame.unionByName, found)


def bias_scores(signals: DataFrame, symbols: DataFrame) -> DataFrame:
    """Mean strength per bias (0 without signals) and their overall mean, per symbol."""
    def mean(kind: str) -> Column:
        return F.coalesce(F.avg(F.when(F.col("bias_type") == kind, F.col("strength"))), num(0))
    per = signals.groupBy("symbol").agg(
        *[mean(k).alias(k.lower()) for k in BIASES], F.count(F.lit(1)).alias("signals")
    )
    out = symbols.select("symbol").distinct().join(per, "symbol", "left")
    out = out.withColumns({k.lower(): F.coalesce(k.lower(), num(0)) for k in BIASES})
    overall = reduce(lambda a, b: a + b, [F.col(k.lower()) for k in BIASES]) / len(BIASES)
    return out.withColumns({"signals": F.coalesce("signals", F.lit(0)), "overall_bias": overall})


def bias_report(df: DataFrame, floors: dict[str, float] | None = None) -> DataFrame:
    return bias_scores(materialise(bias_signals(df, floors), "signals"), df)
