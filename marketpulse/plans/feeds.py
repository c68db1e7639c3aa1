"""Queries over feeds, sources, joins and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse.functions import scoring as sc
from marketpulse.functions import text as tx
from marketpulse.functions.numeric import human_number, num, rescale, round_columns, timestamp_to_epoch
from marketpulse.operators import crowd as cw
from marketpulse.operators import flow as fl
from marketpulse.operators import joins as jo
from marketpulse.operators import sentiment as se
from marketpulse.operators import signals as sg
from marketpulse.operators.indicators import signal_returns
from marketpulse.operators.lexicon import fear_greed_score
from marketpulse.operators.posts import project_sentiment
from marketpulse.operators.timeframes import bucket
from marketpulse.plans.crowds import INFLUENCER_CTES
from marketpulse.plans.moods import _CREDIBILITY, _INFLUENCE, FLOW_CTES, SIGNAL_CTES, _decay, trade_signals
from marketpulse.plans.sqlkit import HOURLY, POSTS, SENTIMENT, rnd, with_
from marketpulse.plans.texts import _fg_ctes, _route, has_word
from marketpulse.session import materialise
from marketpulse.sources import adapters as src
from marketpulse.sources import bars as ba
from marketpulse.sources import feeds as fe
from marketpulse.sources import metrics as me

INGEST = "2024-02-01 00:00:00"
# Every post comes by one of the three text feeds, by its language.
KINDS = {"twitter": "lang = 'en'", "reddit": "lang IN ('de', 'fr')", "news": "lang NOT IN ('en', 'de', 'fr')"}


def _payload(df: DataFrame, *fields) -> DataFrame:
    return df.select(F.lit(INGEST).cast("timestamp").alias("ingest_ts"), F.to_json(F.struct(*fields)).alias("payload"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Every post as a tweet, a forum item or an article, every event as a tick; all as JSON, parsed again."""
    posts = src.posts(spark, sf)
    i = F.col("post_id")
    tweets = _payload(
        posts.where(KINDS["twitter"]), i.cast("string").alias("id"), "text", (i % 50).cast("string").alias("author_id"), "lang",
        F.lit("2024-01-05T10:00:00Z").alias("created_at"),
        F.struct((i % 7).alias("retweet_count"), (i % 11).alias("like_count")).alias("public_metrics"))
    forum = _payload(
        posts.where(KINDS["reddit"]), F.when(i % 2 == 0, "submission").otherwise("comment").alias("item_type"),
        F.lit("Title").alias("title"), F.col("text").alias("selftext"),
        F.when(i % 5 == 0, "[deleted]").otherwise(F.col("text")).alias("body"), (i % 900).alias("score"),
        F.lit("markets").alias("subreddit"), F.lit("/r/x").alias("permalink"))
    news = _payload(
        posts.where(KINDS["news"]), F.lit("Headline").alias("title"), F.col("text").alias("description"),
        F.struct(F.lit("Wire").alias("name")).alias("source"), F.lit("not a date").alias("publishedAt"),
        F.concat(F.lit("https://n/"), i.cast("string")).alias("url"))
    ticks = _payload(
        src.table(spark, sf, "events"), F.concat(F.upper("event_type"), F.lit("-USD")).alias("symbol"),
        F.col("value").alias("price"), F.lit(1000.0).alias("volume_24h"))
    market = fe.flatten_ticks(ticks).withColumn("volume", F.col("volume_24h"))
    articles = fe.flatten_news(news)
    return fe.union_feeds(
        twitter=fe.flatten_tweets(tweets), reddit=fe.flatten_posts(forum), news=articles,
        market=market)


def q_feed_events(spark: SparkSession, sf: str) -> DataFrame:
    routed = fe.route_events(_events(spark, sf))
    return routed.groupBy("data_type", "asset", F.col("ts").cast("timestamp_ntz").alias("ts")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"),
        F.coalesce(F.sum("engagement"), F.lit(0)).alias("engagement"), F.coalesce(F.sum("karma"), F.lit(0)).alias("karma"),
        F.round(F.coalesce(F.sum("bid"), num(0)), 3).alias("bids"),
        F.count_if(F.map_contains_key("metadata", "source_credibility")).alias("credible"),
    )


_ASSET = _route(lambda w: has_word("lower(text)", w), "'BTC'")
SQL_FEED_EVENTS = with_(POSTS, f"""fd AS (
  SELECT 'twitter' AS data_type, text, TIMESTAMP '2024-01-05 10:00:00' AS ts, post_id % 7 + post_id % 11 AS engagement, 0 AS karma,
    0 AS credible FROM posts WHERE {KINDS["twitter"]}
  UNION ALL SELECT 'reddit', CASE WHEN post_id % 2 = 0 THEN 'Title ' || text ELSE text END, TIMESTAMP '2024-02-01', 0, post_id % 900, 0
    FROM posts WHERE {KINDS["reddit"]} AND (post_id % 2 = 0 OR post_id % 5 <> 0)
  UNION ALL SELECT 'news', 'Headline ' || text, TIMESTAMP '2024-02-01', 0, 0, 1 FROM posts WHERE {KINDS["news"]})""", f"""rt AS (
  SELECT *, {_ASSET} AS asset FROM fd WHERE trim(text) <> '')""", """al AS (
  SELECT data_type, asset, ts, count(*) AS n, sum(length(text))::BIGINT AS n_chars, sum(engagement)::BIGINT AS engagement,
    sum(karma)::BIGINT AS karma, 0.0::DOUBLE AS b, sum(credible)::BIGINT AS credible FROM rt GROUP BY 1, 2, 3
  UNION ALL SELECT 'market', upper(event_type), TIMESTAMP '2024-02-01', count(*), 0, 0, 0, sum(value * 0.999), 0
    FROM events WHERE value <> 0 GROUP BY 2)""") + f"""
SELECT data_type, asset, ts, n, n_chars, engagement, karma, {rnd('b', 3, 'bids')}, credible FROM al"""


def q_klines(spark: SparkSession, sf: str) -> DataFrame:
    """Bars as exchange payloads of both kinds, normalised back; one malformed number per payload kind stays NULL."""
    bars = src.bars_hourly(spark, sf)
    s = F.unix_timestamp(F.col("ts").cast("timestamp"))
    text = lambda c: F.col(c).cast("string")
    volume = F.when(F.col("symbol") == "view", F.lit("n/a")).otherwise(text("volume"))
    klines = bars.select("symbol", F.to_json(F.array(F.array(
        (s * 1000).cast("string"), text("open"), text("high"), text("low"), text("close"), volume))).alias("payload"))
    candles = bars.select("symbol", F.to_json(F.array(F.array(
        s.cast("double"), F.col("low"), F.col("high"), F.col("open"), F.col("close"), F.col("volume")))).alias("payload"))
    one = ba.normalise_klines(klines).withColumn("vendor", F.lit("klines"))
    two = ba.normalise_candles(candles).withColumn("vendor", F.lit("candles"))
    both = one.where(F.col("volume").isNotNull()).unionByName(two)
    out = ba.prefer_source(both, ["klines", "candles"])
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


SQL_KLINES = with_(HOURLY) + """
SELECT symbol, ts, open, high, low, close, volume, CASE WHEN symbol = 'view' THEN 'candles' ELSE 'klines' END AS vendor FROM hourly"""


def q_weekly_activity(spark: SparkSession, sf: str) -> DataFrame:
    week = F.unix_timestamp(F.date_trunc("week", "o_orderdate"))
    weeks = src.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("symbol"), week.alias("week")).agg(
        F.count(F.lit(1)).alias("total"))
    # One payload per symbol and half year, as an API would page them.
    pages = weeks.groupBy("symbol", F.floor(F.col("week") / 15_724_800).alias("page")).agg(
        F.to_json(F.collect_list(F.struct("week", "total"))).alias("payload"))
    out = me.parse_weekly_activity(pages, 52)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


SQL_WEEKLY_ACTIVITY = """WITH w AS (
  SELECT o_orderpriority AS symbol, date_trunc('week', o_orderdate)::TIMESTAMP AS ts, count(*) AS commits FROM orders GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM w)
SELECT symbol, ts, commits FROM r WHERE rn <= 52"""


def q_repo_stats(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    packed = src.table(spark, sf, "customer").select(
        F.col("c_name").alias("symbol"),
        F.to_json(F.struct(key.alias("stargazers_count"), F.when(key % 2 == 0, key * 3).alias("forks_count"),
                           F.lit("many").alias("watchers_count"), F.lit("2024-01-02T03:04:05Z").alias("created_at"))).alias("payload"))
    out = me.parse_repo_stats(packed)
    return out.select("symbol", "stars", "forks", "watchers", "open_issues",
                      F.col("created_at").cast("timestamp_ntz").alias("created_at"), F.col("pushed_at").isNull().alias("unpushed"))


SQL_REPO_STATS = """SELECT c_name AS symbol, c_custkey AS stars, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 3 ELSE 0 END AS forks,
  0::BIGINT AS watchers, 0::BIGINT AS open_issues, TIMESTAMP '2024-01-02 03:04:05' AS created_at, true AS unpushed FROM customer"""


def q_aligned_closes(spark: SparkSession, sf: str) -> DataFrame:
    bars = src.bars_hourly(spark, sf).withColumn("value", F.col("close"))
    return jo.align_outer(bars, ["click", "error", "purchase", "signup", "view"])


SQL_ALIGNED_CLOSES = with_(HOURLY) + "SELECT ts, " + ", ".join(
    f"max(close) FILTER (symbol = '{s}') AS {s}" for s in ["click", "error", "purchase", "signup", "view"]) + " FROM hourly GROUP BY 1"


def q_expand_users(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    users = src.table(spark, sf, "customer").select(
        key.alias("author_id"), F.col("c_name").alias("username"), F.pmod(key * 13, F.lit(20000)).alias("followers"),
        (key % 5 == 0).alias("verified"))
    posts = src.sentiment(spark, sf).select("event_id", F.col("user_id").alias("author_id"), "asset")
    return jo.expand_users(posts, users)


SQL_EXPAND_USERS = """SELECT event_id, user_id AS author_id, event_type AS asset, coalesce(c_name, 'user_' || user_id) AS username,
  coalesce((c_custkey * 13) % 20000, 0) AS followers, coalesce(c_custkey % 5 = 0, false) AS verified
FROM events LEFT JOIN customer ON c_custkey = user_id"""


def q_new_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = src.table(spark, sf, "documents").select("doc_id", "lang", "source")
    return jo.new_only(docs, src.table(spark, sf, "labels"), "doc_id")


SQL_NEW_DOCUMENTS = "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


def q_influencer_posts(spark: SparkSession, sf: str) -> DataFrame:
    posts = src.social(spark, sf)
    return jo.posts_of(posts, cw.influencers(posts)).groupBy("asset").agg(
        F.count(F.lit(1)).alias("posts"), F.count_distinct("user_id").alias("users"))


SQL_INFLUENCER_POSTS = with_(*INFLUENCER_CTES) + """
SELECT asset, count(*) AS posts, count(DISTINCT user_id) AS users FROM sentiment WHERE user_id IN (SELECT user_id FROM inf) GROUP BY 1"""


def q_success_rate(spark: SparkSession, sf: str) -> DataFrame:
    events = src.table(spark, sf, "events").select(F.col("event_type").alias("stage"), (F.col("value") < 100).alias("success"))
    return round_columns(se.success_rate(events, by=["stage"]), {"success_rate": 6})


SQL_SUCCESS_RATE = with_("s AS (SELECT event_type AS stage, count(*) AS processed, count(*) FILTER (value >= 100) AS errors FROM events GROUP BY 1)") + f"""
SELECT stage, processed, errors, {rnd('((processed - errors) / processed::DOUBLE)', 6, 'success_rate')} FROM s"""


def q_signals_with_flow(spark: SparkSession, sf: str) -> DataFrame:
    flow = fl.fund_flow(src.bars_hourly(spark, sf)).withColumn("net_flow", F.col("net_flow") * num(1e9))
    rec = materialise(fl.flow_signal(flow).select("symbol", "ts", "flow_strength", "recommendation"), "flow")
    hourly = src.sentiment_hourly(spark, sf).select(
        "symbol", "ts", F.col("sentiment").alias("sentiment_score"), F.col("posts").alias("source_count"))
    out = sg.signals(hourly, min_confidence=0.4, flow=rec, max_per_day=5)
    return round_columns(out.select("symbol", "ts", "action", "confidence"), {"confidence": 6})


SQL_SIGNALS_WITH_FLOW = with_(*FLOW_CTES, *SIGNAL_CTES[:4], """fr AS (
  SELECT symbol, ts, (abs(correlation_score) + least(whale_transactions / 10.0::DOUBLE, 1)) / 2 AS st,
    CASE WHEN net_flow * 1e9 > 0 THEN 1 ELSE -1 END * least(abs(net_flow * 1e9) / 1e9, 1) * abs(correlation_score) AS fs FROM flow)""", """fq AS (
  SELECT *, CASE WHEN fs > 0.3 AND st > 0.5 THEN 'STRONG_BUY' WHEN fs > 0.1 THEN 'BUY' WHEN fs < -0.3 AND st > 0.5 THEN 'STRONG_SELL'
    WHEN fs < -0.1 THEN 'SELL' ELSE 'NEUTRAL' END AS rec FROM fr)""", """bl AS (
  SELECT s.symbol, s.ts, CASE WHEN st > 0.7 AND ((rec IN ('STRONG_BUY', 'BUY') AND action IN ('SELL', 'STRONG_SELL'))
      OR (rec IN ('STRONG_SELL', 'SELL') AND action IN ('BUY', 'STRONG_BUY'))) THEN 'HOLD' ELSE action END AS action,
    CASE WHEN st IS NOT NULL THEN confidence * 0.6 + st * 0.4 ELSE confidence END AS confidence
  FROM s2 s LEFT JOIN fq USING (symbol, ts))""", """dy AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, ts::DATE ORDER BY ts) AS rn FROM bl WHERE confidence >= 0.4)""") + f"""
SELECT symbol, ts, action, {rnd('confidence')} FROM dy WHERE rn <= 5"""


def q_scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    d = src.sentiment(spark, sf)
    age = F.lit(86400.0 * 31 + 1704067200) - timestamp_to_epoch(F.col("ts"))
    price = F.col("k") * num(1234.5)
    temporary, permanent = sc.market_impact(F.col("k") + num(1), num(1000), num(0.02))
    out = d.select(
        "event_id", sc.label(F.col("score")).alias("label"), sc.label(F.col("score"), -0.2, 0.2).alias("wide_label"),
        sc.label(F.col("score"), -0.1, 0.1, inclusive=True).alias("inclusive_label"),
        sc.influence(F.col("followers"), F.col("karma"), F.col("verified")).alias("influence"),
        sc.source_weight(F.col("source"), F.col("verified"), F.col("karma")).alias("source_weight"),
        sc.decay(age).alias("decay"), rescale(F.col("score"), -0.5, 0.5).alias("rescaled"),
        sc.index_label(F.col("k").cast("double")).alias("index_label"), sc.dominance_score(F.col("k").cast("double")).alias("dominance"),
        human_number(price * 10).alias("human"), sc.fill_price(price, F.col("k") % 2 == 0).alias("fill"),
        sc.signed_score(sc.label(F.col("score")), F.abs("score")).alias("signed"),
        temporary.alias("temporary"), permanent.alias("permanent"),
    )
    return round_columns(out, {c: 6 for c in ["influence", "decay", "rescaled", "dominance", "fill", "signed", "temporary", "permanent"]})


SQL_SCALAR_FUNCTIONS = with_(SENTIMENT, f"""f AS (
  SELECT *, {_INFLUENCE} AS influence, {_CREDIBILITY} AS source_weight,
    {_decay("(86400.0 * 31 + 1704067200 - epoch_us(ts) / 1e6)")} AS decay,
    (least(greatest(score, -0.5), 0.5) + 0.5) / 1 * 100 AS rescaled, k * 1234.5::DOUBLE AS price,
    CASE WHEN k >= 70 THEN 0 WHEN k <= 40 THEN 100 ELSE (70 - k) / 30.0::DOUBLE * 100 END::DOUBLE AS dominance,
    0.1::DOUBLE * pow((k + 1) / 1000.0::DOUBLE, 0.6) * 0.02 AS temporary FROM sentiment)""", """g AS (
  SELECT *, CASE WHEN k % 2 = 0 THEN price * 1.0005::DOUBLE ELSE price * 0.9995::DOUBLE END AS fill,
    CASE WHEN score > 0.05 THEN abs(score) WHEN score < -0.05 THEN -abs(score) ELSE 0 END::DOUBLE AS signed FROM f)""") + f"""
SELECT event_id, CASE WHEN score > 0.05 THEN 'positive' WHEN score < -0.05 THEN 'negative' ELSE 'neutral' END AS label,
  CASE WHEN score > 0.2 THEN 'positive' WHEN score < -0.2 THEN 'negative' ELSE 'neutral' END AS wide_label,
  CASE WHEN score >= 0.1 THEN 'positive' WHEN score <= -0.1 THEN 'negative' ELSE 'neutral' END AS inclusive_label,
  {rnd('influence')}, source_weight, {rnd('decay')}, {rnd('rescaled')},
  CASE WHEN k < 25 THEN 'Extreme Fear' WHEN k < 45 THEN 'Fear' WHEN k <= 55 THEN 'Neutral' WHEN k <= 75 THEN 'Greed'
    ELSE 'Extreme Greed' END AS index_label, {rnd('dominance')},
  CASE WHEN price * 10 >= 1e6 THEN printf('%.1fM', price * 10 / 1e6) WHEN price * 10 >= 1e3 THEN printf('%.1fK', price * 10 / 1e3)
    ELSE printf('%.0f', price * 10) END AS human, {rnd('fill')}, {rnd('signed')}, {rnd('temporary')},
  {rnd('(temporary * 0.5)', 6, 'permanent')} FROM g"""


def q_chinese_script(spark: SparkSession, sf: str) -> DataFrame:
    d = src.posts(spark, sf)
    return d.select("post_id", tx.simplified_chinese(F.col("text")).alias("simplified"), tx.text_hash(F.col("text")).alias("hash"))


SQL_CHINESE_SCRIPT = with_(POSTS) + """
SELECT post_id, regexp_matches(text, '[国会来个问题]') OR NOT regexp_matches(text, '[國會來個問題]') AS simplified, md5(text) AS hash
FROM posts"""



def q_event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Posts per tumbling and sliding window and asset, and per session of a user."""
    sent = src.sentiment(spark, sf)

    def count(kind: str, key: str, *args) -> DataFrame:
        d = bucket(sent, kind, *args)
        return d.groupBy("window", F.col(key).cast("string").alias("key")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("k").alias("k")).select(
            F.lit(kind).alias("kind"), "key", F.col("window.start").cast("timestamp_ntz").alias("window_start"), "n", "k")
    both = count("tumbling", "asset", "1 hour").unionByName(count("sliding", "asset", "2 hours", "1 hour"))
    return both.unionByName(count("session", "user_id", "6 hours"))


SQL_EVENT_WINDOWS = with_(SENTIMENT, """gap AS (
  SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM sentiment)""",
    """ses AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM gap)""") + """
SELECT 'tumbling' AS kind, asset AS key, date_trunc('hour', ts)::TIMESTAMP AS window_start, count(*) AS n, sum(k)::BIGINT AS k
FROM sentiment GROUP BY 2, 3
UNION ALL
SELECT 'sliding', asset, ws, count(*), sum(k)::BIGINT FROM (
  SELECT asset, k, unnest([date_trunc('hour', ts)::TIMESTAMP, date_trunc('hour', ts)::TIMESTAMP - INTERVAL 1 HOUR]) AS ws FROM sentiment)
GROUP BY 2, 3
UNION ALL
SELECT 'session', user_id::VARCHAR, min(ts), count(*), sum(k)::BIGINT FROM ses GROUP BY user_id, sid"""


def q_project_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    """Scored posts in the output form, the stored text cut to 100 characters."""
    posts = src.posts(spark, sf)
    scored = fear_greed_score(posts).withColumns({
        "asset": tx.route_asset(F.col("text")), "score": F.col("fg_compound"), "confidence": F.col("fg_confidence"),
        "ts": F.lit("2024-01-01").cast("timestamp_ntz")})
    out = project_sentiment(scored).withColumn("original_text", F.md5("original_text"))
    return round_columns(out, {"sentiment_score": 6, "confidence": 6})


SQL_PROJECT_SENTIMENT = with_(POSTS, _fg_ctes("fg", lambda w: has_word("lower(text)", w), "posts")) + f"""
SELECT {_route(lambda w: has_word('lower(text)', w), "'BTC'")} AS asset, source, {rnd('(fg_up - fg_dn)', 6, 'sentiment_score')},
  {rnd('abs(fg_up - fg_dn)', 6, 'confidence')}, md5(substr(text, 1, 100)) AS original_text, TIMESTAMP '2024-01-01' AS processed_at
FROM fg"""


def q_signal_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Share of buy and sell signals that the next bar confirmed."""
    sides = trade_signals(spark, sf).withColumn("signal", sc.side(F.col("action"))).where("signal <> 0").select("symbol", "ts", "signal")
    bars = src.bars_hourly(spark, sf).select("symbol", "ts", "close").join(sides, ["symbol", "ts"], "left")
    rets = signal_returns(materialise(bars, "bars")).where(F.col("signal_ret").isNotNull())
    out = sg.signal_accuracy(rets.withColumn("correct", F.col("signal_ret") > 0))
    return round_columns(out, {"accuracy": 6})


SQL_SIGNAL_ACCURACY = with_(HOURLY, *SIGNAL_CTES, """nx AS (
  SELECT symbol, ts, lead(close) OVER (PARTITION BY symbol ORDER BY ts) / nullif(close, 0) - 1 AS nr FROM hourly)""", """ac AS (
  SELECT CASE WHEN action IN ('BUY', 'STRONG_BUY') THEN nr ELSE -nr END > 0 AS ok FROM sig JOIN nx USING (symbol, ts)
  WHERE action <> 'HOLD' AND nr IS NOT NULL)""", "s AS (SELECT count(*) AS total, count(*) FILTER (ok) AS hit FROM ac)") + f"""
SELECT total, hit AS right, {rnd('(hit / total::DOUBLE)', 6, 'accuracy')} FROM s"""

QUERIES = {
    "event_windows": (q_event_windows, SQL_EVENT_WINDOWS),
    "project_sentiment": (q_project_sentiment, SQL_PROJECT_SENTIMENT),
    "signal_accuracy": (q_signal_accuracy, SQL_SIGNAL_ACCURACY),
    "feed_events": (q_feed_events, SQL_FEED_EVENTS),
    "klines": (q_klines, SQL_KLINES),
    "weekly_activity": (q_weekly_activity, SQL_WEEKLY_ACTIVITY),
    "repo_stats": (q_repo_stats, SQL_REPO_STATS),
    "aligned_closes": (q_aligned_closes, SQL_ALIGNED_CLOSES),
    "expand_users": (q_expand_users, SQL_EXPAND_USERS),
    "new_documents": (q_new_documents, SQL_NEW_DOCUMENTS),
    "influencer_posts": (q_influencer_posts, SQL_INFLUENCER_POSTS),
    "success_rate": (q_success_rate, SQL_SUCCESS_RATE),
    "signals_with_flow": (q_signals_with_flow, SQL_SIGNALS_WITH_FLOW),
    "scalar_functions": (q_scalar_functions, SQL_SCALAR_FUNCTIONS),
    "chinese_script": (q_chinese_script, SQL_CHINESE_SCRIPT),
}
