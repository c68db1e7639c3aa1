"""Views of the test tables in the shapes the operators expect (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse.sources.bars import build_bars

# Lead-in phrases of the test posts, by doc_id % 12.
PHRASES = [
    "Bitcoin breaking out! $BTC to the moon 🚀🚀 https://example.com/a?b=1",
    "@whale_alert panic sell, market crash incoming 📉 #Bearish",
    "ETH up +5.2% today, price at $3,450.50 and rising 📈",
    "Oh great, another dump... yeah right, what could go wrong? Terrible. Wonderful!",
    "HODL your $ETH and $SOL, DIAMOND HANDS forever 💎",
    "Worried about risk and loss: down -12% since Monday 😱",
    "Binance lists $DOGE; volume hits $2.5B, bull rally!!!",
    "So very boring. \"Good news\" they said?? TSLA and AAPL flat...",
    "I am not bullish. Fear everywhere, blood on NASDAQ 🐻",
    "比特币 好 涨 突破 牛 跌",
    "ビットコイン 強気 上がる 突破 暴落",
    "비트코인 상승 강세 돌파 하락 $XRP buy 100x",
]
# Language of the phrases that are not in the language of the document.
PHRASE_LANGS = {9: "zh-cn", 10: "ja", 11: "ko"}
# A small valence lexicon; the common words exercise the join.
LEXICON = {
    "great": 3.1, "good": 1.9, "wonderful": 2.7, "boring": -1.3, "terrible": -2.1, "crash": -1.7,
    "panic": -2.3, "fear": -2.2, "loss": -1.3, "worried": -1.2, "risk": -1.1, "rising": 1.2,
    "rally": 1.4, "bullish": 2.0, "dump": -1.6, "forever": 0.6, "blood": -1.0, "right": 0.5,
    "the": 0.1, "and": 0.2, "with": -0.1, "not": -0.3, "la": 0.1, "que": -0.2, "und": 0.1, "der": -0.1,
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores when the input has fewer splits than cores.

    A file with one row group is one task however many cores there are. A large
    table has more splits than cores and is left as it is: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def bars_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return build_bars(
        table(spark, sf, "events"), symbol="event_type", ts="ts", price="value", tie="event_id", unit="hour"
    )


def bars_daily(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.sum("o_totalprice").alias("volume"),
    )


def sentiment(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.col("user_id")
    return table(spark, sf, "events").select(
        "event_id", "user_id", "ts",
        F.col("event_type").alias("asset"),
        F.element_at(F.array(F.lit("twitter"), F.lit("reddit"), F.lit("news")),
                     (user % 3 + 1).cast("int")).alias("source"),
        (k / F.lit(50.0) - 1).alias("score"),
        k.alias("k"),
        F.pmod(user * 7919, F.lit(20000)).alias("followers"),
        F.pmod(user * 104729, F.lit(3000)).alias("karma"),
        (user % 5 == 0).alias("verified"),
    )


def social(spark: SparkSession, sf: str) -> DataFrame:
    return sentiment(spark, sf).select(
        "event_id", "user_id", "ts", "asset",
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("username"),
        F.col("followers").alias("follower_count"),
        F.col("score").alias("sentiment_score"),
        F.col("k").cast("bigint").alias("engagement"),
        F.array(F.concat(F.lit("#"), F.col("asset"))).alias("hashtags"),
    )


def sentiment_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Mean score, posts and distinct sources per asset and hour."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return sentiment(spark, sf).groupBy(F.col("asset").alias("symbol"), hour.alias("ts")).agg(
        (F.sum("k") / F.lit(50.0) / F.count("k") - 1).alias("sentiment"),
        F.count(F.lit(1)).alias("posts"),
        F.count_distinct("source").alias("source_count"),
    )


def price_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    bars = bars_hourly(spark, sf).select("symbol", "ts", "close", "volume")
    return bars.join(sentiment_hourly(spark, sf).select("symbol", "ts", "sentiment"), ["symbol", "ts"])


def posts(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents"), "doc_id")
    slot = (F.col("doc_id") % 12).cast("int")
    lang = F.create_map(*[F.lit(v) for item in PHRASE_LANGS.items() for v in item])
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), slot + 1)
    return docs.select(
        F.col("doc_id").alias("post_id"),
        F.coalesce(F.try_element_at(lang, slot), F.col("lang")).alias("lang"),
        "source",
        F.concat_ws(" ", phrase, F.col("text")).alias("text"),
    )


def lexicon(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{t}', double({v}))" for t, v in LEXICON.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS lexicon(token, valence)")
