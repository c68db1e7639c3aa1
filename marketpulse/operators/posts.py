"""Preprocessing and de-duplication of posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.functions import text as tx
from marketpulse.session import sized


def preprocess(posts: DataFrame, min_len: int = 10, max_len: int = 500, truncate: bool = False,
               match: str = "word", **cleaning) -> DataFrame:
    """Entities, emoji score, cleaned text, length flags, tokens and validity, in one projection.

    ``truncate`` cuts the cleaned text at ``max_len`` before it is tokenised.
    """
    raw = F.col("text")
    out = posts.withColumns({
        "tickers": tx.tickers(raw, match=match),
        "hashtags": tx.hashtags(raw),
        "mentions": tx.mentions(raw),
        "emoji_sentiment": tx.emoji_sentiment(raw),
        "cleaned": tx.clean_post(raw, **cleaning),
    })
    out = tx.length_flags(out, "cleaned", min_len, max_len, truncate)
    out = out.withColumns({
        "entity_count": tx.entity_count(F.col("tickers"), F.col("hashtags"), F.col("mentions")),
        "tokens": tx.tokens(F.col("cleaned")),
    })
    return out.withColumns({
        "token_count": F.size("tokens"),
        "is_valid": tx.is_valid_text(F.col("cleaned"), F.col("tokens"), min_len),
    })


def token_counts(posts: DataFrame, key: str = "post_id", col: str = "tokens") -> DataFrame:
    """(token, n, posts): how often each token occurs, and in how many different keys.

    A key's tokens are counted where they are read: a post whose key no other row has counts once for each of its
    tokens, so only one row per token and task is shuffled. Rows that share a key are first put together; keys
    met twice have a known number, so few of them do not move the others.
    """
    twice = sized(posts.groupBy(F.col(key).alias("_twice")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_twice", F.lit(True).alias("_shared")))
    rows = posts.select(key, F.sort_array(col).alias("_t")).join(twice, F.col(key).eqNullSafe(F.col("_twice")), "left")
    each = rows.select(key, "_shared", "_t", F.posexplode("_t").alias("_at", "token"))
    fresh = F.coalesce(F.expr("get(_t, _at - 1)") != F.col("token"), F.lit(True))
    each = each.select(key, "_shared", "token", fresh.alias("_fresh"))
    counted = F.count_if(F.col("_fresh") & F.col("_shared").isNull() & F.col(key).isNotNull())
    single = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), counted.alias("posts"))
    several = each.where(F.col("_fresh") & F.col("_shared")).where(F.col(key).isNotNull()).select("token", key).distinct()
    several = several.groupBy("token").agg(F.lit(0).cast("long").alias("n"), F.count(F.lit(1)).alias("posts"))
    return single.unionByName(several).groupBy("token").agg(F.sum("n").alias("n"), F.sum("posts").alias("posts"))


def dedupe_posts(posts: DataFrame, key: str = "post_id", col: str = "text") -> DataFrame:
    """One post per distinct text: the one with the smallest key, and the number of copies.

    Copies are combined on the map side, so a text with very many copies is no hot key.
    """
    return posts.groupBy(tx.text_hash(F.col(col)).alias("text_hash")).agg(
        F.min(key).alias(key), F.count(F.lit(1)).alias("copies")
    )


def project_sentiment(df: DataFrame, length: int = 100) -> DataFrame:
    """Output rows with the text cut for storage."""
    return df.select(
        "asset", "source", F.col("score").alias("sentiment_score"), "confidence",
        F.substring("text", 1, length).alias("original_text"), F.col("ts").alias("processed_at"),
    )
