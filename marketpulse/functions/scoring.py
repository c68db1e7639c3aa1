"""Labels, weights and trade arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.functions.numeric import num, rescale, seconds_between

# Credibility of the sources.
SOURCE_WEIGHTS = {"news_verified": 1.5, "twitter_verified": 1.2, "twitter_regular": 1.0, "reddit_high_karma": 1.1,
                  "reddit_regular": 1.0}
BUY_SIDE = ("BUY", "STRONG_BUY")
SELL_SIDE = ("SELL", "STRONG_SELL")


def label(score: Column, lo: float = -0.05, hi: float = 0.05, inclusive: bool = False) -> Column:
    up, down = (score >= hi, score <= lo) if inclusive else (score > hi, score < lo)
    return F.when(up, "positive").when(down, "negative").otherwise("neutral")


def signed_score(label_col: Column, confidence: Column) -> Column:
    """Model label and confidence as a signed score; an unknown label goes by 0.5."""
    low = F.lower(label_col)
    return (
        F.when(F.contains(low, F.lit("pos")), confidence).when(F.contains(low, F.lit("neg")), -confidence)
        .when(F.contains(low, F.lit("neu")), num(0)).otherwise((confidence - 0.5) * 2)
    )


def influence(followers: Column, karma: Column, verified: Column) -> Column:
    """x1.2 if verified, x(1 + 0.1 log10) of followers and of karma above 100; at most 3."""
    def reach(x: Column) -> Column:
        return F.when(x > 100, 1 + F.log10(x.cast("double")) * 0.1).otherwise(num(1))
    sure = F.when(F.coalesce(verified, F.lit(False)), num(1.2)).otherwise(num(1))
    return F.least(
        sure * reach(F.coalesce(followers, F.lit(0))) * reach(F.coalesce(karma, F.lit(0))), num(3)
    )


def source_weight(source: Column, verified: Column, karma: Column, weights=None) -> Column:
    w = weights or SOURCE_WEIGHTS
    return (
        F.when(source == "twitter", F.when(F.coalesce(verified, F.lit(False)), num(w["twitter_verified"]))
               .otherwise(num(w["twitter_regular"])))
        .when(source == "reddit", F.when(F.coalesce(karma, F.lit(0)) > 1000, num(w["reddit_high_karma"]))
              .otherwise(num(w["reddit_regular"])))
        .when(source == "news", num(w["news_verified"]))
        .otherwise(num(1))
    )


def decay(age_seconds: Column, half_life: float = 14400.0) -> Column:
    """Half after each half-life; 1 for an age of 0 or less."""
    return F.exp(-num(math.log(2)) * F.greatest(age_seconds, num(0)) / half_life)


def index_label(index: Column) -> Column:
    return (
        F.when(index < 25, "Extreme Fear").when(index < 45, "Fear").when(index <= 55, "Neutral")
        .when(index <= 75, "Greed").otherwise("Extreme Greed")
    )


def dominance_score(share: Column) -> Column:
    """70 % and more is 0, 40 % and less is 100."""
    return F.when(share >= 70, num(0)).when(share <= 40, num(100)).otherwise((70 - share) / 30 * 100)


def side(action: Column) -> Column:
    """1 for the buy side, -1 for the sell side, 0 for the rest."""
    return F.when(action.isin(*BUY_SIDE), 1).when(action.isin(*SELL_SIDE), -1).otherwise(0)


def fill_price(price: Column, buying: Column, slippage: float = 0.0005) -> Column:
    return F.when(buying, price * (1 + slippage)).otherwise(price * (1 - slippage))


def commission(price: Column, quantity: Column, rate: float = 0.001) -> Column:
    return F.abs(price * quantity * rate)


def pnl(side_col: Column, entry: Column, exit_: Column, quantity: Column) -> Column:
    return F.when(side_col > 0, exit_ - entry).otherwise(entry - exit_) * quantity


def pnl_percent(side_col: Column, entry: Column, exit_: Column) -> Column:
    """Long: exit / entry - 1. Short: entry / exit - 1."""
    return (F.when(side_col > 0, F.try_divide(exit_, entry)).otherwise(F.try_divide(entry, exit_)) - 1) * 100


def hours_between(start: Column, end: Column) -> Column:
    return seconds_between(start, end) / 3600.0


def market_impact(size: Column, liquidity: Column, volatility: Column, coefficient: float = 0.1,
                  temporary_decay: float = 0.5) -> tuple[Column, Column]:
    """(temporary, permanent) impact by the 0.6 power law."""
    temporary = coefficient * F.pow(F.try_divide(size, liquidity), num(0.6)) * volatility
    return temporary, temporary * (1 - temporary_decay)


def min_confidence(df: DataFrame, floor: float = 0.75) -> DataFrame:
    return df.where(F.col("confidence") >= floor)


def to_index(score: Column) -> Column:
    """[-1, 1] to [0, 100]."""
    return rescale(score)

