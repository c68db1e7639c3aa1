"""Forecasts, text classifiers on Spark ML, and hooks for models of the user."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import HashingTF, IDF
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from marketpulse.functions import frames as fr
from marketpulse.functions.numeric import div, num
from marketpulse.functions.scoring import label
from marketpulse.functions.text import clean_post, tokens
from marketpulse.operators import gram
from marketpulse.operators import indicators as ind
from marketpulse.operators.joins import with_sentiment
from marketpulse.operators.series import join_same, over_series
from marketpulse.operators.timeframes import rolling_time_mean
from marketpulse.session import materialise, sized

FEATURES = ("sentiment_1h", "sentiment_4h", "sentiment_24h", "returns_1h", "returns_4h", "returns_24h",
            "volatility_24h", "volume_ratio", "rsi_14", "macd", "macd_signal", "bb_position")
HORIZONS = (1, 4, 24)


def price_features(bars: DataFrame, sent: DataFrame | None = None, **series) -> DataFrame:
    """The twelve features of the forecaster per bar; gaps are filled forward, then with 0.

    ``sent`` (symbol, ts, sentiment) is averaged over 1, 4 and 24 hours and joined on ts.
    """
    def step(d, w):
        close = F.col("close")
        d = d.withColumns({
            "returns_1h": fr.change(close, 1, w), "returns_4h": fr.change(close, 4, w),
            "returns_24h": fr.change(close, 24, w), "volume_ratio": fr.volume_ratio(F.col("volume"), 24, w),
        })
        d = d.withColumn("volatility_24h", fr.std(F.col("returns_1h"), 24, w))
        d = ind.add_bollinger(ind.add_rsi(d, w, 14, out="rsi_14"), w)
        return ind.add_macd(d, w)
    options = {**series, "block_rows": ind.macd_reach()}
    d = over_series(bars, step, ind.macd_reach(), **options)
    if sent is None:
        d = d.withColumns({f"sentiment_{h}h": num(0) for h in (1, 4, 24)})
    else:
        means = rolling_time_mean(sent, "sentiment", by=("symbol",), prefix="sentiment")
        d = with_sentiment(d, means)
    d = materialise(d.select("symbol", "ts", "close", *FEATURES), "features")
    return ind.ffill_zero(d, FEATURES)


def forecast(features: DataFrame, horizons=HORIZONS, ridge: float = 0.01, least: int = 50, **series) -> DataFrame:
    """Predicted change (percent), price and confidence 1 - min(abs(change) / 10, 0.5) per bar and horizon (in bars).

    Each symbol and horizon has linear regressions of its own, refitted every day on all bars whose change was known before that
    day: no bar is predicted by a fit that has seen its own or a later outcome. Sums of products of all bars are made by
    one aggregate. Days with fewer than ``least`` known bars before them have no forecast.
    """
    def ahead(d, w):
        return d.withColumn("_ahead", F.array(*[
            F.struct(F.lit(h).alias("horizon"), ((div(F.lead("close", h).over(w), F.col("close")) - 1) * 100).alias("target"),
                     F.to_date(F.lead("ts", h).over(w)).alias("day")) for h in horizons]))
    rows = over_series(features, ahead, 0, max(horizons), **series)
    rows = materialise(rows.select("symbol", "ts", "close", *FEATURES, F.explode("_ahead").alias("_a")).select(
        "symbol", "ts", "close", *FEATURES, "_a.*", F.to_date("ts").alias("own_day")), "ahead")
    asked = rows.select("symbol", "horizon", F.col("own_day").alias("day")).distinct()
    fits = sized(gram.running_fits(rows.where("day IS NOT NULL"), asked, FEATURES, "target", ("symbol", "horizon"), "day", ridge, least))
    d = join_same(rows.drop("day").withColumnRenamed("own_day", "day"), fits, ["symbol", "horizon", "day"])
    d = d.withColumn("predicted_change", gram.fitted(FEATURES))
    change = F.col("predicted_change")
    return d.select(
        "symbol", "ts", F.concat(F.col("horizon").cast("string"), F.lit("h")).alias("prediction_horizon"), F.col("close").alias("current_price"),
        change, (F.col("close") * (1 + change / 100)).alias("predicted_price"),
        (1 - F.least(F.abs(change) / 10, num(0.5))).alias("confidence"), F.col("n").alias("fitted_on"),
    )


def read_labels(label_col: Column) -> Column:
    """0 negative, 1 neutral (and unknown words), 2 positive; numbers pass through."""
    low = F.lower(label_col.cast("string"))
    number = label_col.cast("string").try_cast("int")
    return F.coalesce(
        number,
        F.when(F.contains(low, F.lit("negative")), 0).when(F.contains(low, F.lit("neutral")), 1)
        .when(F.contains(low, F.lit("positive")), 2).otherwise(1),
    )


def fit_text_classifier(rows: DataFrame, key: str = "doc_id", share: float = 0.8, strengths=(0.01, 0.1),
                        n_features: int = 1 << 14, seed: int = 42):
    """Train on a hashed share of (key, text, label); keep the model with the best validation accuracy.

    Returns (model, accuracy, rows of the validation part with their prediction).
    """
    # The split is a hash of the key: the same after any retry.
    part = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1000)) < int(share * 1000)
    prepared = materialise(
        rows.select(key, F.col("label").cast("double").alias("label"),
                    tokens(clean_post(F.col("text"))).alias("words"), part.alias("_train")), "text")
    train, check = prepared.where("_train"), prepared.where(~F.col("_train"))
    score = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    best = None
    for strength in strengths:
        stages = [
            HashingTF(inputCol="words", outputCol="_tf", numFeatures=n_features), IDF(inputCol="_tf", outputCol="features"),
            LogisticRegression(featuresCol="features", labelCol="label", regParam=strength, maxIter=20),
        ]
        model = Pipeline(stages=stages).fit(train)
        predicted = model.transform(check)
        accuracy = score.evaluate(predicted)
        if best is None or accuracy > best[1]:
            best = (model, accuracy, predicted)
    return best


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score_batches(posts: DataFrame, make_predict: Callable, text: str = "text", batch_size: int = 32) -> DataFrame:
    """Score posts with a user model in batches; a score the model could not give is neutral.

    ``make_predict()`` loads the model once per Python worker and returns a function
    from an array of texts to an array of scores in [-1, 1].
    """
    model = predict_batch_udf(make_predict, return_type=DoubleType(), batch_size=batch_size)
    raw = model(F.col(text))
    score = F.when(raw.isNull() | F.isnan(raw), num(0)).otherwise(raw)
    d = posts.withColumn("model_score", score)
    return d.withColumns({
        "model_label": label(F.col("model_score")), "model_confidence": F.abs("model_score"),
    })


def embed_texts(posts: DataFrame, make_predict: Callable, text: str = "text", batch_size: int = 32) -> DataFrame:
    """An embedding per post by a user model."""
    model = predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return posts.withColumn("embedding", model(F.col(text)))
