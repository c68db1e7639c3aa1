"""Feeds: payload parsing for posts, news and ticks, and the one event table they form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse import schemas
from marketpulse.functions.text import DELETED, base_asset, drop_empty, route_asset

POST_URL = "https://twitter.com/user/status/"
FORUM_URL = "https://reddit.com"


def _time(text, fallback):
    """ISO-8601 text as timestamp; the ingest time where it cannot be read."""
    return F.coalesce(F.try_to_timestamp(text), fallback)


def flatten_tweets(df: DataFrame, payload: str = "payload", ingest: str = "ingest_ts") -> DataFrame:
    """Tweet JSON to columns; missing metrics are 0, engagement is their sum."""
    d = df.select(ingest, F.from_json(payload, schemas.TWEET_PAYLOAD).alias("p"))

    def metric(name):
        return F.coalesce(F.col(f"p.public_metrics.{name}"), F.lit(0).cast("bigint"))
    return d.select(
        F.col("p.id").alias("tweet_id"), F.col("p.text").alias("text"), F.col("p.lang").alias("lang"),
        F.coalesce("p.author_id", F.lit("unknown")).alias("author_id"),
        F.concat(F.lit("user_"), F.coalesce("p.author_id", F.lit("unknown"))).alias("username"),
        _time(F.col("p.created_at"), F.col(ingest)).alias("ts"),
        metric("retweet_count").alias("retweets"), metric("like_count").alias("likes"),
        metric("reply_count").alias("replies"),
        (metric("retweet_count") + metric("like_count") + metric("reply_count")).alias("engagement"),
        F.lit(0).cast("bigint").alias("followers"), F.lit(False).alias("verified"),
        F.concat(F.lit(POST_URL), F.col("p.id")).alias("url"),
    )


def flatten_posts(df: DataFrame, payload: str = "payload", ingest: str = "ingest_ts") -> DataFrame:
    """Forum JSON to columns; deleted and empty items are dropped."""
    d = df.select(ingest, F.from_json(payload, schemas.FORUM_PAYLOAD).alias("p"))
    submission = F.col("p.item_type") == "submission"
    text = F.when(submission, F.concat_ws(" ", "p.title", "p.selftext")).otherwise(F.col("p.body"))
    return d.select(
        text.alias("text"), F.coalesce("p.author", F.lit("[deleted]")).alias("author"), F.col(ingest).alias("ts"),
        F.coalesce("p.score", F.lit(0)).cast("bigint").alias("karma"),
        F.coalesce("p.total_awards_received", F.lit(0)).cast("bigint").alias("awards"),
        F.col("p.subreddit").alias("subreddit"), F.col("p.item_type").alias("post_type"),
        F.concat(F.lit(FORUM_URL), F.col("p.permalink")).alias("url"),
    ).where(~F.col("text").isin(*DELETED))


def flatten_news(df: DataFrame, payload: str = "payload", ingest: str = "ingest_ts") -> DataFrame:
    d = df.select(ingest, F.from_json(payload, schemas.NEWS_PAYLOAD).alias("p"))
    return d.select(
        F.coalesce("p.title", F.lit("")).alias("title"), F.coalesce("p.description", F.lit("")).alias("description"),
        F.coalesce("p.content", F.lit("")).alias("content"),
        F.coalesce("p.source.name", F.lit("Unknown")).alias("source"),
        F.coalesce("p.author", F.lit("Unknown")).alias("author"),
        _time(F.col("p.publishedAt"), F.col(ingest)).alias("ts"), F.coalesce("p.url", F.lit("")).alias("url"),
    )


def flatten_ticks(df: DataFrame, payload: str = "payload", ingest: str = "ingest_ts") -> DataFrame:
    """Tick JSON to columns; high and low default to the price, bid and ask to price x 0.999 / 1.001."""
    d = df.select(ingest, F.from_json(payload, schemas.TICK_PAYLOAD).alias("p"))
    price = F.col("p.price")
    return d.where(price != 0).select(
        F.col("p.symbol").alias("symbol"), price.alias("price"),
        F.coalesce("p.volume_24h", F.lit(0.0)).alias("volume_24h"),
        F.coalesce("p.price_change_24h", F.lit(0.0)).alias("price_change_24h"), F.col(ingest).alias("ts"),
        F.coalesce("p.high_24h", price).alias("high_24h"), F.coalesce("p.low_24h", price).alias("low_24h"),
        F.coalesce("p.bid", price * 0.999).alias("bid"), F.coalesce("p.ask", price * 1.001).alias("ask"),
    )


def union_feeds(**feeds: DataFrame) -> DataFrame:
    """All feeds as one typed event table; the argument name is the data type."""
    tagged = [schemas.ensure_columns(df.withColumn("data_type", F.lit(name)), schemas.EVENTS)
              for name, df in feeds.items()]
    names = [f.split()[0] for f in schemas.EVENTS.split(", ")]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.select(*names, *[
        c for c in t.columns if c not in names]) for t in tagged])


def route_events(events: DataFrame) -> DataFrame:
    """Text, asset and metadata of each event by its type, in one pass; rows without text are dropped.

    Market rows have no text; they carry the base asset of their symbol.
    """
    kind = F.col("data_type")
    headline = F.concat_ws(" ", F.col("title"), F.col("description")) if "title" in events.columns else F.col("text")
    text = F.when(kind == "news", headline).otherwise(F.col("text"))
    meta = (
        F.when(kind == "twitter", F.create_map(
            F.lit("followers"), F.coalesce("followers", F.lit(0)).cast("string"),
            F.lit("verified"), F.coalesce("verified", F.lit(False)).cast("string"),
            F.lit("likes"), F.coalesce("likes", F.lit(0)).cast("string"),
            F.lit("retweets"), F.coalesce("retweets", F.lit(0)).cast("string")))
        .when(kind == "reddit", F.create_map(
            F.lit("karma"), F.coalesce("karma", F.lit(0)).cast("string"),
            F.lit("awards"), F.coalesce("awards", F.lit(0)).cast("string"),
            F.lit("subreddit"), F.coalesce("subreddit", F.lit("unknown"))))
        .when(kind == "news", F.create_map(
            F.lit("source"), F.coalesce("source", F.lit("")), F.lit("source_credibility"), F.lit("high")))
        .otherwise(F.create_map(F.lit("price"), F.col("price").cast("string"),
                                F.lit("volume"), F.col("volume").cast("string")))
    )
    d = events.withColumns({"text": text, "metadata": meta})
    d = d.withColumn("asset", F.when(kind == "market", base_asset(F.col("symbol"))).otherwise(route_asset(F.col("text"))))
    market = d.where(kind == "market")
    return drop_empty(d.where(~kind.eqNullSafe("market"))).unionByName(market)


def stream_posts(spark: SparkSession, path: str, schema: str, fmt: str = "json", max_files: int | None = None) -> DataFrame:
    """A file stream; ``max_files`` per trigger is the rate limit."""
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def stream_kafka(spark: SparkSession, servers: str, topic: str, schema: str, max_offsets: int | None = None) -> DataFrame:
    """A Kafka topic of JSON values (needs the Kafka package on the cluster)."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    reader = reader.option("maxOffsetsPerTrigger", max_offsets) if max_offsets else reader
    return reader.load().select(F.from_json(F.col("value").cast("string"), schema).alias("v"), "timestamp").select(
        "v.*", F.col("timestamp").alias("ingest_ts"))
