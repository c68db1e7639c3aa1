"""Trading signals from the index, their summaries and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.functions import frames as fr
from marketpulse.functions.numeric import fixed, num
from marketpulse.functions.scoring import to_index
from marketpulse.operators.chains import spaced
from marketpulse.operators.series import join_same, last_rows, over_series
from marketpulse.operators.timeframes import SECOND, micros
from marketpulse.session import materialise

# Index thresholds, position limits and the confidence floor.
THRESHOLDS = {"extreme_fear": 25.0, "fear": 40.0, "neutral": 60.0, "greed": 75.0}
SIZING = {"base": 0.05, "min": 0.02, "max": 0.10}
MIN_CONFIDENCE = 0.75
ACTIONS = ("STRONG_BUY", "BUY", "HOLD", "SELL", "STRONG_SELL")


def action_of(index: Column, t: dict[str, float] | None = None) -> Column:
    t = {**THRESHOLDS, **(t or {})}
    return (
        F.when(index > t["greed"], "STRONG_BUY").when(index > t["neutral"], "BUY").when(index > t["fear"], "HOLD")
        .when(index > t["extreme_fear"], "SELL").otherwise("STRONG_SELL")
    )


def strength_of(index: Column, t: dict[str, float] | None = None) -> Column:
    t = {**THRESHOLDS, **(t or {})}
    return (
        F.when(index > t["greed"], F.least((index - t["greed"]) / (100 - t["greed"]), num(1)))
        .when(index > t["neutral"], (index - t["neutral"]) / (t["greed"] - t["neutral"]) * 0.8)
        .when(index > t["fear"], num(0.5))
        .when(index > t["extreme_fear"], (1 - (index - t["extreme_fear"]) / (t["fear"] - t["extreme_fear"])) * 0.8)
        .otherwise(F.least(1 - index / t["extreme_fear"], num(1)))
    )


def confidence_of(index: Column, score: Column, sources: Column) -> Column:
    """0.4 x agreement of index and score + 0.3 x sources / 10 + 0.3 x abs(score), at most 1."""
    agreement = 1 - F.abs((index - 50) / 50 - score) / 2
    known = F.least(sources / num(10), num(1))
    return F.least(agreement * 0.4 + known * 0.3 + F.abs(score) * 0.3, num(1))


def position_size(strength: Column, confidence: Column) -> Column:
    size = strength * confidence * SIZING["base"]
    return F.least(F.greatest(size, num(SIZING["min"])), num(SIZING["max"]))


def _steps(x: Column, cuts: list[tuple[float, str]], rest: str) -> Column:
    out = None
    for limit, name in cuts:
        out = F.when(x < limit, name) if out is None else out.when(x < limit, name)
    return out.otherwise(rest)


def reason_of(action: Column, index: Column, score: Column, confidence: Column) -> Column:
    mood = _steps(index, [(25, "extreme fear"), (40, "fear"), (60, "neutral"), (75, "greed")], "extreme greed")
    tone = _steps(score, [(-0.3, "very negative"), (-0.1, "negative"), (0.1, "neutral"), (0.3, "positive")],
                  "very positive")
    sure = F.when(confidence > 0.7, "high").when(confidence > 0.5, "moderate").otherwise("low")
    return F.concat(
        F.lit("Market shows "), mood, F.lit(" (FGI: "), fixed(index, 1), F.lit(") with "), tone,
        F.lit(" sentiment (score: "), fixed(score, 2), F.lit("). "), action, F.lit(" signal generated with "), sure,
        F.lit(" confidence ("), fixed(confidence, 2), F.lit(")."),
    )


def signals(df: DataFrame, thresholds: dict[str, float] | None = None, min_confidence: float = MIN_CONFIDENCE,
            flow: DataFrame | None = None, max_per_day: int | None = None, cooldown: float | None = None) -> DataFrame:
    """Signals of rows (symbol, ts, sentiment_score, source_count[, fear_greed_index]).

    Without an index it is derived from the score. ``flow`` (symbol, ts, flow_strength,
    recommendation) blends the confidence 0.6 / 0.4 and turns a strongly contradicted
    action into HOLD. Off by default: ``cooldown`` (minutes between the signals of a symbol that trade; a HOLD neither starts one nor is
    held back) and ``max_per_day``, which counts what the cooldown leaves, of equal times the surest signal first.
    """
    base = df if "fear_greed_index" in df.columns else df.withColumn("fear_greed_index", F.lit(None).cast("double"))
    d = base.withColumn("fear_greed_index", F.coalesce("fear_greed_index", to_index(F.col("sentiment_score"))))
    index, score = F.col("fear_greed_index"), F.col("sentiment_score")
    d = d.withColumns({
        "action": action_of(index, thresholds), "strength": strength_of(index, thresholds),
        "confidence": confidence_of(index, score, F.col("source_count")),
    })
    if flow is not None:
        d = d.join(flow.select("symbol", "ts", "flow_strength", "recommendation"), ["symbol", "ts"], "left")
        known = F.col("flow_strength").isNotNull()
        against = (
            (F.col("recommendation").isin("STRONG_BUY", "BUY") & F.col("action").isin("SELL", "STRONG_SELL"))
            | (F.col("recommendation").isin("STRONG_SELL", "SELL") & F.col("action").isin("BUY", "STRONG_BUY"))
        )
        d = d.withColumns({
            "action": F.when(known & against & (F.col("flow_strength") > 0.7), "HOLD").otherwise(F.col("action")),
            "confidence": F.when(known, F.col("confidence") * 0.6 + F.col("flow_strength") * 0.4)
            .otherwise(F.col("confidence")),
        }).drop("flow_strength", "recommendation")
    d = d.where(F.col("confidence") >= min_confidence)
    d = d.withColumns({
        "position_size": position_size(F.col("strength"), F.col("confidence")),
        "reasoning": reason_of(F.col("action"), index, score, F.col("confidence")),
    })
    if cooldown is not None:
        d = materialise(d, "signals")
        holds = F.col("action") == "HOLD"
        d = d.where(holds).unionByName(cooled(d.where(~holds), cooldown))
    if max_per_day is not None:
        order = ["ts", F.col("confidence").desc(), "action", "strength", "fear_greed_index", "sentiment_score"]
        w = Window.partitionBy("symbol", F.to_date("ts")).orderBy(*order)
        d = d.withColumn("_pos", F.row_number().over(w)).where(F.col("_pos") <= max_per_day).drop("_pos")
    return d


def cooled(df: DataFrame, minutes: float, by=("symbol",), ts: str = "ts") -> DataFrame:
    """The first signal of each series, then always the first at least ``minutes`` after the last one kept.

    Of signals at the same time the one with the highest confidence counts, then the first action, then the first row as text; wholly
    equal rows count once. NULL keys are a series; signals without a time are left out; an empty table gives an empty result.
    """
    by = list(by)
    row = F.struct(*df.columns)
    rank = F.struct(-F.coalesce("confidence", num(-1)), "action", F.to_json(row))
    timed = df.where(F.col(ts).isNotNull()).groupBy(*by, micros(ts).alias("_t")).agg(F.min_by(row, rank).alias("_row"))
    timed = materialise(timed, "timed")
    kept = spaced(timed, round(minutes * 60 * SECOND), by)
    return join_same(timed, kept, [*by, "_t"]).select("_row.*")


def recent_signals(df: DataFrame, n: int = 100) -> DataFrame:
    """The last n signals of each symbol."""
    return last_rows(df, n)


def signal_summary(df: DataFrame) -> DataFrame:
    """Per symbol: total, count per action, mean confidence and the last action."""
    return df.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("action") == a).alias(a.lower()) for a in ACTIONS],
        F.avg("confidence").alias("avg_confidence"),
        F.max_by("action", "ts").alias("last_action"),
    )


def signals_per_day(df: DataFrame) -> DataFrame:
    """One row per day with the number of signals per action."""
    day = F.date_trunc("day", "ts").cast(df.schema["ts"].dataType)
    return df.groupBy(day.alias("day")).agg(
        *[F.count_if(F.col("action") == a).alias(a.lower()) for a in ACTIONS]
    )


def signal_accuracy(df: DataFrame, correct: str = "correct") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(correct)).alias("right"),
        F.coalesce(F.avg(F.col(correct).cast("int")), num(0)).alias("accuracy"),
    )


def ma_sentiment_signal(df: DataFrame, short: int = 20, long: int = 50, threshold: float = 0.3, **series) -> DataFrame:
    """1 / -1 where the moving averages of ``close`` and ``sentiment`` agree, else 0; 0 in the first ``long`` rows."""
    def step(d, w):
        gap = fr.sma(F.col("close"), short, w) - fr.sma(F.col("close"), long, w)
        return d.withColumn("_trend", F.when(F.col("_rn") > long, F.signum(gap)).otherwise(num(0)))
    d = over_series(df, step, long - 1, **series)
    mood = F.when(F.col("sentiment") > threshold, 1).when(F.col("sentiment") < -threshold, -1).otherwise(0)
    return d.withColumn("signal", F.when((F.col("_trend") == mood) & (mood != 0), mood).otherwise(0)).drop("_trend")
