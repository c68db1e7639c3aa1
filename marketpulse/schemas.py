"""Fixed schemas of the feeds, bars and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BAR_ROWS = "ts timestamp, open double, high double, low double, close double, volume double"
BARS = f"symbol string, {BAR_ROWS}"
TWEET_PAYLOAD = (
    "id string, text string, author_id string, lang string, created_at string, "
    "public_metrics struct<retweet_count:bigint,like_count:bigint,reply_count:bigint>"
)
FORUM_PAYLOAD = (
    "item_type string, title string, selftext string, body string, author string, score bigint, "
    "total_awards_received bigint, subreddit string, permalink string"
)
NEWS_PAYLOAD = (
    "title string, description string, content string, author string, url string, publishedAt string, "
    "source struct<name:string>"
)
TICK_PAYLOAD = (
    "symbol string, price double, volume_24h double, price_change_24h double, high_24h double, "
    "low_24h double, bid double, ask double"
)
EVENTS = (
    "data_type string, ts timestamp, source string, text string, username string, followers bigint, "
    "verified boolean, likes bigint, retweets bigint, engagement bigint, karma bigint, awards bigint, "
    "subreddit string, url string, symbol string, price double, volume double"
)
SIGNALS = (
    "timestamp timestamp, symbol string, action string, strength double, confidence double, "
    "position_size double, fear_greed_index double, sentiment_score double"
)
TRADES = (
    "entry_time timestamp, exit_time timestamp, symbol string, action string, entry_price double, "
    "exit_price double, position_size double, quantity double, pnl double, pnl_percent double, "
    "confidence double, fear_greed_index double, status string"
)
STREAM_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def ensure_columns(df: DataFrame, schema: str | StructType, defaults: dict | None = None) -> DataFrame:
    """Add the columns of ``schema`` that are missing, as typed NULL or as the given default."""
    want = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    defaults = defaults or {}
    missing = {
        f.name: F.lit(defaults.get(f.name)).cast(f.dataType) for f in want.fields if f.name not in df.columns
    }
    return df.withColumns(missing) if missing else df
