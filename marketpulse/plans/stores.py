"""Queries over files: what the sinks write, the sources read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse import schemas
from marketpulse.functions.numeric import round_columns
from marketpulse.plans import trading
from marketpulse.plans.moods import SIGNAL_CTES, trade_signals
from marketpulse.plans.sqlkit import HOURLY, rnd, with_
from marketpulse.session import scratch_path
from marketpulse.sources import adapters as src
from marketpulse.sources import bars as ba
from marketpulse.sources import results as re_

PRICES = ["open", "high", "low", "close", "volume"]
RUNS = ("20240101_000000", "20240102_000000")


def _bars(spark: SparkSession, sf: str) -> DataFrame:
    return src.bars_hourly(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))


def _plain_time(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


def q_bars_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Bars written to the cache and read back."""
    path = scratch_path(spark, "cache")
    ba.write_bars(_bars(spark, sf), path)
    return _plain_time(ba.read_bars(spark, path), "ts").select("symbol", "ts", *PRICES)


SQL_BARS_CACHE = with_(HOURLY) + "SELECT symbol, ts, open, high, low, close, volume FROM hourly"


def q_bars_many(spark: SparkSession, sf: str) -> DataFrame:
    """Bars from two caches and a path that is missing, with vendor names of columns."""
    path = scratch_path(spark, "caches")
    bars = _bars(spark, sf)
    early = F.col("ts") < F.lit("2024-01-08").cast("timestamp")
    ba.write_bars(bars.where(early), f"{path}/early")
    ba.write_bars(bars.where(~early), f"{path}/late")
    many = ba.read_many(spark, [f"{path}/early", f"{path}/missing", f"{path}/late"])
    vendor = many.select(*[F.col(c).alias(c.title()) for c in ("symbol", "ts", *PRICES)], F.lit(0.0).alias("Dividends"))
    low = _plain_time(ba.lower_columns(vendor), "ts")
    return round_columns(low.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.sum("close").alias("closes"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.sum("volume").alias("volume"), F.min_by("open", "ts").alias("open")), {"closes": 4})


SQL_BARS_MANY = with_(HOURLY, """m AS (
  SELECT symbol, count(*) AS bars, min(ts) AS first_ts, max(ts) AS last_ts, sum(close) AS c, max(high) AS high, min(low) AS low,
    sum(volume) AS volume, first(open ORDER BY ts) AS open FROM hourly GROUP BY 1)""") + f"""
SELECT symbol, bars, first_ts, last_ts, {rnd('c', 4, 'closes')}, high, low, volume, open FROM m"""


def q_signals_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Signals written as CSV and read back: eight columns."""
    path = scratch_path(spark, "signals")
    re_.write_signals(trade_signals(spark, sf), path)
    rows = spark.read.schema(schemas.SIGNALS).option("header", True).csv(path)
    numbers = ["strength", "confidence", "position_size", "fear_greed_index", "sentiment_score"]
    return round_columns(_plain_time(rows, "timestamp"), {c: 6 for c in numbers})


SQL_SIGNALS_CSV = with_(*SIGNAL_CTES) + f"""
SELECT ts AS timestamp, symbol, action, {rnd('strength')}, {rnd('confidence')}, {rnd('position_size')},
  {rnd('fgi', 6, 'fear_greed_index')}, {rnd('s', 6, 'sentiment_score')} FROM sig"""


def _runs(spark: SparkSession, sf: str) -> str:
    """Two runs of one backtest below a new path; the later one has all trades and all days."""
    path = scratch_path(spark, "runs")
    trades = trading.done_trades(spark, sf)
    equity = src.bars_daily(spark, sf).groupBy("ts").agg(F.sum("close").alias("balance"))
    summary = trades.agg(F.count(F.lit(1)).alias("trades"))
    re_.write_backtest(summary, equity.limit(1), trades.limit(1), path, RUNS[0])
    re_.write_backtest(summary, equity, trades, path, RUNS[1])
    return f"{path}/backtest_{re_.latest_run(spark, path)}"


def q_stored_trades(spark: SparkSession, sf: str) -> DataFrame:
    """The trades of the latest of two stored runs."""
    rows = re_.read_trades(spark, f"{_runs(spark, sf)}_trades")
    out = _plain_time(rows, "entry_time", "exit_time")
    return round_columns(out, {c: d for c, d in trading.NUMBERS.items() if c in rows.columns})


SQL_STORED_TRADES = with_(*trading.trade_ctes()) + f"""
SELECT entry_time, exit_time, symbol, action, status,
  {', '.join(rnd(c) for c in trading.NUMBERS if f' {c} ' in f' {schemas.TRADES}')} FROM trades"""


def q_stored_equity(spark: SparkSession, sf: str) -> DataFrame:
    """The equity of the latest of two stored runs, under another column name."""
    return round_columns(_plain_time(re_.read_equity(spark, f"{_runs(spark, sf)}_equity"), "ts"), {"equity": 2})


SQL_STORED_EQUITY = """WITH last_order AS (
  SELECT o_orderdate::TIMESTAMP AS ts, o_orderpriority, max_by(o_totalprice, o_orderkey) AS close FROM orders GROUP BY 1, 2), e AS (
  SELECT ts, sum(close) AS s FROM last_order GROUP BY 1)
SELECT 'main' AS portfolio_id, ts, """ + rnd("s", 2, "equity") + " FROM e"


def q_metrics_json(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics per event type written as JSON and read back."""
    path = scratch_path(spark, "metrics")
    events = src.table(spark, sf, "events")
    re_.write_metrics(events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("processed"), F.max("value").alias("top"), F.count_distinct("user_id").alias("users")), path)
    return spark.read.schema("event_type string, processed long, top double, users long").json(path)


SQL_METRICS_JSON = """SELECT event_type, count(*) AS processed, max(value) AS top, count(DISTINCT user_id) AS users
FROM events GROUP BY 1"""


def q_labelled_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled texts written as CSV, whole and with their line feeds and quotes, and read back."""
    path = scratch_path(spark, "labelled")
    mood = F.when(F.col("toxic") == 1, "Very Negative").when(F.col("quality") == 1, "positive").otherwise("Neutral")
    rows = src.table(spark, sf, "documents").join(src.table(spark, sf, "labels"), "doc_id")
    rows.select("text", mood.alias("sentiment")).write.option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    read = re_.read_labelled(spark, path)
    return read.groupBy(F.md5("text").alias("text_md5"), F.col("label").cast("long").alias("label")).agg(
        F.count(F.lit(1)).alias("n"))


SQL_LABELLED_CSV = """SELECT md5(text) AS text_md5,
  CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 2 ELSE 1 END::BIGINT AS label, count(*) AS n
FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2"""

QUERIES = {
    "bars_cache": (q_bars_cache, SQL_BARS_CACHE),
    "bars_many": (q_bars_many, SQL_BARS_MANY),
    "signals_csv": (q_signals_csv, SQL_SIGNALS_CSV),
    "stored_trades": (q_stored_trades, SQL_STORED_TRADES),
    "stored_equity": (q_stored_equity, SQL_STORED_EQUITY),
    "metrics_json": (q_metrics_json, SQL_METRICS_JSON),
    "labelled_csv": (q_labelled_csv, SQL_LABELLED_CSV),
}
