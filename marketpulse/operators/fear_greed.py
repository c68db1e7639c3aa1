"""The fear/greed index: six components on 0-100 and their weighted mean."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from marketpulse.functions import frames as fr
from marketpulse.functions.numeric import clip, num, rescale
from marketpulse.functions.scoring import dominance_score, index_label
from marketpulse.operators.series import over_series

HISTORY = 30
# Weights of the components.
WEIGHTS = {"sentiment": 0.25, "volume_momentum": 0.25, "volatility": 0.15, "social_volume": 0.15, "dominance": 0.10,
           "trends": 0.10}


def _optional(df: DataFrame, col: str, score) -> Column:
    return F.coalesce(score(F.col(col)), num(50)) if col in df.columns else num(50)


def combine(components: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of the components with a positive weight, cut to [0, 100]; 50 without weights."""
    used = {k: w for k, w in (weights or WEIGHTS).items() if w > 0 and k in components}
    whole = sum(used.values())
    if whole <= 0:
        return num(50)
    parts = [components[k] * (w / whole) for k, w in used.items()]
    return clip(reduce(lambda a, b: a + b, parts), 0, 100)


def fear_greed_index(df: DataFrame, weights: dict[str, float] | None = None, **series) -> DataFrame:
    """Index and components per row of (symbol, ts, sentiment, volume, price, mentions[, dominance, trends])."""
    names = {
        "sentiment": rescale(F.col("sentiment")),
        "dominance": _optional(df, "dominance", dominance_score),
        "trends": _optional(df, "trends", lambda c: c),
    }

    def step(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumns({
            "c_volume_momentum": fr.ratio_score(F.col("volume"), HISTORY, w),
            "c_volatility": fr.cv_score(F.col("price"), HISTORY, w),
            "c_social_volume": fr.ratio_score(F.col("mentions").cast("double"), HISTORY, w),
        })
        return d.withColumns({f"c_{k}": c for k, c in names.items()})
    scored = over_series(df, step, HISTORY - 1, **series)
    index = combine({k: F.col(f"c_{k}") for k in WEIGHTS}, weights)
    out = scored.withColumn("fear_greed_index", index)
    return out.withColumn("label", index_label(F.col("fear_greed_index")))
