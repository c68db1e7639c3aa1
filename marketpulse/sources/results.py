"""Results on disk: signals, backtests, metrics, labelled texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse import schemas
from marketpulse.operators.models import read_labels

EQUITY_NAMES = ("equity", "portfolio_value", "value", "balance")
SIGNAL_COLUMNS = ("timestamp", "symbol", "action", "strength", "confidence", "position_size", "fear_greed_index",
                  "sentiment_score")


def write_signals(df: DataFrame, path: str) -> None:
    """Signals as CSV with eight columns."""
    out = df.withColumnRenamed("ts", "timestamp").select(*SIGNAL_COLUMNS)
    out.write.mode("overwrite").option("header", True).csv(path)


def write_backtest(summary: DataFrame, equity: DataFrame, trades: DataFrame, path: str, run: str) -> None:
    """backtest_<run>_summary (JSON), _equity and _trades (CSV)."""
    base = f"{path.rstrip('/')}/backtest_{run}"
    summary.write.mode("overwrite").json(f"{base}_summary")
    equity.write.mode("overwrite").option("header", True).csv(f"{base}_equity")
    trades.write.mode("overwrite").option("header", True).csv(f"{base}_trades")


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    """Trades written by ``write_backtest`` or exported elsewhere: columns are matched by name."""
    raw = spark.read.option("header", True).csv(path)
    fields = [f.split() for f in schemas.TRADES.split(", ")]
    return raw.select(*[
        (F.col(n).try_cast(t) if n in raw.columns else F.lit(None).cast(t)).alias(n) for n, t in fields])


def read_equity(spark: SparkSession, path: str, portfolio: str = "main") -> DataFrame:
    """(portfolio_id, ts, equity) from the first equity column that is there."""
    raw = spark.read.option("header", True).csv(path)
    present = [c for c in EQUITY_NAMES if c in raw.columns]
    if not present:
        raise ValueError(f"no equity column in {raw.columns}")
    when = next(c for c in ("ts", "timestamp", raw.columns[0]) if c in raw.columns)
    return raw.select(F.lit(portfolio).alias("portfolio_id"), F.col(when).try_cast("timestamp").alias("ts"),
                      F.col(present[0]).try_cast("double").alias("equity"))


def read_backtest(spark: SparkSession, trades: str, equity: str) -> tuple[DataFrame, DataFrame]:
    return read_trades(spark, trades), read_equity(spark, equity)


def latest_run(spark: SparkSession, path: str) -> str | None:
    """Name of the newest run with trades and equity files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime")
    run = F.regexp_extract("path", r"backtest_(\d+_\d+)_(?:trades|equity)", 1)
    kind = F.regexp_extract("path", r"backtest_\d+_\d+_(trades|equity)", 1)
    runs = files.select(run.alias("run"), kind.alias("kind"), "modificationTime").where(F.col("run") != "")
    whole = runs.groupBy("run").agg(F.count_distinct("kind").alias("_k"), F.max("modificationTime").alias("_t"))
    row = whole.where(F.col("_k") == 2).agg(F.max_by("run", F.struct("_t", "run"))).first()
    return row[0]


def read_labelled(spark: SparkSession, path: str, text_col: str = "text", label_col: str = "sentiment") -> DataFrame:
    """(text, label 0/1/2) from a CSV file."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.select(F.col(text_col).alias("text"), read_labels(F.col(label_col)).alias("label"))
