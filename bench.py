"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``queries`` holds seconds per query (the whole result is computed and dropped).
``posts_per_min`` is the rate of the text-to-signal path: clean, score, aggregate, signal.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "bars_hourly", "returns_and_sma", "rsi_bollinger", "macd_ewm", "atr_adx", "regime_rules", "regime_distribution",
    "resample_ffill", "rolling_time_sentiment", "clean_posts", "post_tokens", "mentions", "fear_greed_words",
    "lexicon_score", "sarcasm", "model_vote", "enrich", "sentiment_aggregate", "sentiment_series", "fear_greed_index",
    "signals", "fund_flow", "asof_price", "trades", "equity_curve", "risk_report", "bias_report", "influencers",
    "echo_chambers", "cascades", "best_lag", "walk_forward", "outcome_stats", "walk_book", "latency_report",
    "dedupe_posts", "price_features", "stream_sentiment",
]


def signal_path(spark, sf: str):
    """Posts cleaned, scored, routed to assets, aggregated per asset and source, turned into signals."""
    from pyspark.sql import functions as F

    from marketpulse.functions import text as tx
    from marketpulse.operators import lexicon, posts, signals
    from marketpulse.sources import adapters

    cleaned = posts.preprocess(adapters.posts(spark, sf)).where("is_valid")
    routed = cleaned.select("post_id", "source", "text", tx.route_asset(F.col("text")).alias("symbol"))
    scored = lexicon.ensemble_score(routed, adapters.lexicon(spark))
    per_asset = scored.groupBy("symbol", "source").agg(
        F.avg("compound").alias("sentiment_score"), F.count(F.lit(1)).alias("source_count"))
    return signals.signals(per_asset.withColumn("ts", F.lit("2024-01-01").cast("timestamp")), min_confidence=0.0)


def main() -> None:
    root = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, root)
    from marketpulse.plans import catalog
    from marketpulse.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    known = catalog.queries()
    known["bars_hourly"](spark, sf).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in only:
        start = time.perf_counter()
        known[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    posts = spark.read.parquet(f"{sf}/documents.parquet").count()
    start = time.perf_counter()
    signal_path(spark, sf).write.format("noop").mode("overwrite").save()
    spent = time.perf_counter() - start
    seconds["signal_path"] = round(spent, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf.rstrip("/")), "posts_per_min": round(posts / spent * 60),
    }))


if __name__ == "__main__":
    main()
