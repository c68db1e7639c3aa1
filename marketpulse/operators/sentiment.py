"""Sentiment: decayed aggregates, breakdowns, model votes, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.functions.numeric import clip, div, num, ratio_of_sums, seconds_between
from marketpulse.functions.scoring import decay, influence, label, source_weight, to_index
from marketpulse.operators.timeframes import SECOND, micros, time_momentum

OVERALL = "OVERALL"
# Weights of the models in the weighted vote.
MODEL_WEIGHTS = {"finbert": 0.4, "vader": 0.2, "twitter-roberta": 0.3, "textblob": 0.1}


def retain(df: DataFrame, as_of: Column, seconds: int = 3600, ts: str = "ts") -> DataFrame:
    """Rows of the last ``seconds`` up to ``as_of``."""
    until = as_of.cast(df.schema[ts].dataType)
    return df.where((F.col(ts) >= until - F.make_dt_interval(secs=F.lit(seconds))) & (F.col(ts) <= until))


def point_weight(age: Column, half_life: float = 14400.0) -> Column:
    credibility = source_weight(F.col("source"), F.col("verified"), F.col("karma"))
    return credibility * influence(F.col("followers"), F.col("karma"), F.col("verified")) * decay(age, half_life)


def _per_source(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """Sums per key and source of rows with weight ``_w``."""
    return weighted.groupBy(*keys, "source").agg(
        F.sum(F.col("score") * F.col("_w")).alias("_sw"), F.sum("_w").alias("_w"),
        F.sum("score").alias("_s"), F.count(F.lit(1)).alias("_n"),
    )


def _combine(per_source: DataFrame, keys: list[str]) -> DataFrame:
    """Score, index, volume, confidence and per-source means; a few rows per key come in."""
    out = per_source.groupBy(*keys).agg(
        F.coalesce(div(F.sum("_sw"), F.sum("_w")), num(0)).alias("_raw"),
        F.sum("_n").alias("volume"),
        F.map_from_entries(F.array_sort(F.collect_list(
            F.struct("source", (F.col("_s") / F.col("_n")).alias("mean"))
        ))).alias("breakdown"),
    )
    score = clip(F.col("_raw"), -1, 1)
    return out.select(
        *keys, score.alias("score"), to_index(score).alias("fear_greed_score"), "volume",
        F.least(F.col("volume") / num(50), num(1)).alias("confidence"), "breakdown",
    )


def aggregate_sentiment(sent: DataFrame, as_of: Column | None = None, window: int = 3600,
                        half_life: float = 14400.0, overall: bool = True) -> DataFrame:
    """Per asset (and over all): the decayed weighted score at ``as_of`` (default: the newest row)."""
    if as_of is None:
        # One value, fetched first: as a literal it reaches the scan as a filter on both sides.
        as_of = F.lit(sent.agg(F.max("ts").cast("string")).first()[0])
    as_of = as_of.cast(sent.schema["ts"].dataType)
    kept = retain(sent, as_of, window)
    weighted = kept.withColumn("_w", point_weight(seconds_between(F.col("ts"), as_of), half_life))
    per_source = _per_source(weighted, ["asset"])
    if overall:
        sums = [F.sum(c).alias(c) for c in ("_sw", "_w", "_s", "_n")]
        total = per_source.groupBy("source").agg(*sums).withColumn("asset", F.lit(OVERALL))
        per_source = per_source.unionByName(total)
    return _combine(per_source, ["asset"])


def sentiment_series(sent: DataFrame, step: int = 3600, window: int = 3600, half_life: float = 14400.0,
                     back: int = 900, within: int = 3600) -> DataFrame:
    """The aggregate of each asset on a regular grid of times, with its momentum.

    A row belongs to the grid times in [ts, ts + window]: window / step + 1 copies at
    most, combined on the map side.
    """
    size = step * SECOND
    t = F.col("_t")
    timed = sent.withColumn("_t", micros("ts"))
    first = F.ceil(t / size).cast("bigint")
    last = F.floor((t + window * SECOND) / size).cast("bigint")
    copies = timed.where(first <= last).withColumn("_slot", F.explode(F.sequence(first, last)))
    at = F.timestamp_micros(F.col("_slot") * size)
    kind = sent.schema["ts"].dataType
    weighted = copies.withColumn("_w", point_weight((F.col("_slot") * size - t) / num(SECOND), half_life))
    keys = ["asset", "as_of"]
    series = _combine(_per_source(weighted.withColumn("as_of", at.cast(kind)), keys), keys)
    return time_momentum(series, "score", back, within, ("asset",), "as_of")


def source_breakdown(sent: DataFrame) -> DataFrame:
    return sent.groupBy("asset", "source").agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n"))


def weighted_mean(df: DataFrame, x: str, w: str, by: list[str], out: str = "weighted_mean") -> DataFrame:
    return df.groupBy(*by).agg(ratio_of_sums(F.col(x), F.col(w)).alias(out))


def sentiment_heatmap(sent: DataFrame, wide: bool = False) -> DataFrame:
    """Mean score per source and hour; ``wide`` has one column per hour of the day."""
    hour = F.date_trunc("hour", "ts").cast(sent.schema["ts"].dataType)
    if wide:
        hours = sent.withColumn("_h", F.hour("ts"))
        return hours.groupBy("source").pivot("_h", list(range(24))).agg(F.avg("score"))
    return sent.groupBy("source", hour.alias("hour")).agg(F.avg("score").alias("mean_score"))


def vote_models(scores: DataFrame, method: str = "weighted", weights: dict[str, float] | None = None,
                key: str = "post_id") -> DataFrame:
    """Scores (key, model, score, label, confidence) of several models combined per post.

    ``voting``: majority label (ties: positive, negative, neutral), mean score of its
    models. ``weighted``: weighted mean score. ``confidence``: the most confident model.
    """
    weights = weights or MODEL_WEIGHTS
    if method == "weighted":
        pairs = [v for m, w in weights.items() for v in (F.lit(m), num(w))]
        w = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("model")), num(1))
        out = scores.groupBy(key).agg(ratio_of_sums(F.col("score"), w).alias("ensemble_score"))
        return out.select(
            key, "ensemble_score", label(F.col("ensemble_score")).alias("ensemble_label"),
            F.least(F.abs("ensemble_score"), num(1)).alias("confidence"),
        )
    if method == "voting":
        names = ("positive", "negative", "neutral")
        out = scores.groupBy(key).agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.count_if(F.col("label") == n).alias(f"_n_{n}") for n in names],
            *[F.avg(F.when(F.col("label") == n, F.col("score"))).alias(f"_s_{n}") for n in names],
        )
        top = F.greatest(*[F.col(f"_n_{n}") for n in names])
        pick = lambda f: F.when(F.col("_n_positive") == top, f("positive")).when(
            F.col("_n_negative") == top, f("negative")).otherwise(f("neutral"))
        return out.select(
            key, F.coalesce(pick(lambda n: F.col(f"_s_{n}")), num(0)).alias("ensemble_score"),
            pick(F.lit).alias("ensemble_label"), (top / F.col("_n")).alias("confidence"),
        )
    if method == "confidence":
        order = F.array(*[F.lit(m) for m in weights])
        place = F.array_position(order, F.col("model"))
        best = F.max_by(F.struct("score", "label", "confidence"), F.struct("confidence", -place))
        out = scores.groupBy(key).agg(best.alias("_b"))
        sure = F.col("_b.confidence") > 0
        return out.select(
            key, F.when(sure, F.col("_b.score")).otherwise(num(0)).alias("ensemble_score"),
            F.when(sure, F.col("_b.label")).otherwise("neutral").alias("ensemble_label"),
            F.col("_b.confidence").alias("confidence"),
        )
    raise ValueError(f"unknown method: {method}")


def long_scores(df: DataFrame, models: dict[str, str], key: str = "post_id", lo: float = -0.05, hi: float = 0.05,
                inclusive: bool = True) -> DataFrame:
    """Score columns of a post table as (key, model, score, label, confidence) rows."""
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("score")) for m, c in models.items()])
    out = df.select(key, F.inline(rows))
    return out.withColumns({
        "label": label(F.col("score"), lo, hi, inclusive), "confidence": F.abs("score"),
    })


def hybrid_score(df: DataFrame, model: str, lexicon: str, model_confidence: str, weight: float = 0.7) -> DataFrame:
    """Model and lexicon score blended; the lexicon alone where the model gave nothing."""
    m, x = F.col(model), F.col(lexicon)
    return df.withColumns({
        "sentiment_score": F.when(m.isNull(), x).otherwise(m * weight + x * (1 - weight)),
        "sentiment_confidence": F.when(m.isNull(), F.abs(x)).otherwise(F.col(model_confidence)),
        "sentiment_method": F.when(m.isNull(), "lexicon_fallback").otherwise("hybrid"),
    })


def enrich(posts: DataFrame, score: str = "sentiment_score") -> DataFrame:
    """Final score of a post: sarcasm first, then a sure ensemble, then the language route.

    Expects is_sarcastic, adjusted_sentiment, ensemble_score, ensemble_confidence, lang
    and language_score.
    """
    after_sarcasm = F.when(F.col("is_sarcastic"), F.col("adjusted_sentiment")).otherwise(F.col(score))
    after_vote = F.when(F.col("ensemble_confidence") > 0.8, F.col("ensemble_score")).otherwise(after_sarcasm)
    final = F.when(F.col("lang") != "en", F.col("language_score")).otherwise(after_vote)
    stage = (
        F.when(F.col("lang") != "en", "language").when(F.col("ensemble_confidence") > 0.8, "ensemble")
        .when(F.col("is_sarcastic"), "sarcasm").otherwise("base")
    )
    return posts.withColumns({"original_sentiment": F.col(score), "final_score": final, "final_stage": stage})


def success_rate(events: DataFrame, ok: str = "success", by: list[str] | None = None) -> DataFrame:
    """Processed and failed rows and the share of successes."""
    return events.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(~F.col(ok)).alias("errors"),
        F.coalesce(div(F.count_if(F.col(ok)).cast("double"), F.count(F.lit(1))), num(0)).alias("success_rate"),
    )

