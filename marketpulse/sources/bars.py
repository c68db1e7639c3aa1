"""OHLCV bars: scans, caches, vendor payloads and bar building."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketpulse import schemas


def build_bars(ticks: DataFrame, symbol: str, ts: str, price: str, tie: str, unit: str = "hour",
               volume: str | None = None) -> DataFrame:
    """Bars of a fixed length from single prices; volume is the number of prices unless given.

    Prices are ordered by time, prices of one microsecond by the whole number ``tie``: one
    decimal, so that the aggregation hashes (a composite order would sort all prices).
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp")).cast("decimal(18,0)")
    # Twice the largest BIGINT and more: ties never reach the next microsecond.
    at = micros * F.lit("20000000000000000000").cast("decimal(20,0)") + F.coalesce(F.col(tie), F.lit(0)).cast("decimal(19,0)")
    size = F.count(F.lit(1)).cast("double") if volume is None else F.sum(volume)
    slot = F.date_trunc(unit, F.col(ts)).cast(ticks.schema[ts].dataType)
    return ticks.groupBy(F.col(symbol).alias("symbol"), slot.alias("ts")).agg(
        F.min_by(price, at).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, at).alias("close"),
        size.alias("volume"),
    )


def day_stats(bars: DataFrame) -> DataFrame:
    """Per symbol and day: high, low, volume, last price and change from the first close in percent."""
    day = F.date_trunc("day", "ts").cast(bars.schema["ts"].dataType)
    stats = bars.groupBy("symbol", day.alias("ts")).agg(
        F.max("high").alias("high_24h"),
        F.min("low").alias("low_24h"),
        F.sum("volume").alias("volume_24h"),
        F.min_by("close", "ts").alias("_first"),
        F.max_by("close", "ts").alias("price"),
    )
    change = F.when(F.col("_first") > 0, (F.col("price") - F.col("_first")) / F.col("_first") * 100)
    return stats.withColumn("price_change_24h", F.coalesce(change, F.lit(0.0))).drop("_first")


def read_bars(spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Bars from cache folders partitioned by symbol (or from ``symbol=`` folders of theirs), or from CSV files named by symbol."""
    paths = [path] if isinstance(path, str) else list(path)
    if fmt == "parquet":
        # One read per cache: folders of one cache share its partition columns.
        caches: dict[str, list[str]] = {}
        for p in paths:
            caches.setdefault(p.split("/symbol=")[0], []).append(p)
        reads = [spark.read.schema(schemas.BARS).option("basePath", root).parquet(*own) if own != [root]
                 else spark.read.schema(schemas.BARS).parquet(root) for root, own in caches.items()]
        return reduce(DataFrame.unionByName, reads).select(*[f.split()[0] for f in schemas.BARS.split(", ")])
    rows = spark.read.schema(schemas.BAR_ROWS).option("header", True).csv(paths)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^([^_.]+)", 1)
    return rows.select(name.alias("symbol"), "*")


def read_many(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """All paths that exist as one long table."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    present = [
        p for p in paths
        if jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p))
    ]
    if not present:
        return spark.createDataFrame([], schemas.BARS)
    return read_bars(spark, present, fmt)


def write_bars(df: DataFrame, path: str) -> None:
    """One folder per symbol and month; its days go to different tasks, so a large symbol is no single task."""
    (
        df.withColumn("month", F.date_format("ts", "yyyy-MM"))
        .repartition("symbol", F.to_date("ts"))
        .write.mode("overwrite").partitionBy("symbol", "month").parquet(path)
    )


def prefer_source(df: DataFrame, order: Sequence[str], level: str = "row") -> DataFrame:
    """Bars of several vendors reduced to the first vendor of ``order`` that has data.

    ``row``: per (symbol, ts). ``symbol``: per symbol.
    """
    rank = F.array_position(F.array(*[F.lit(v) for v in order]), F.col("vendor")).cast("int")
    known = df.withColumn("_rank", rank).where(F.col("_rank") > 0)
    if level == "symbol":
        best = known.groupBy("symbol").agg(F.min("_rank").alias("_best"))
        return known.join(best, "symbol").where(F.col("_rank") == F.col("_best")).drop("_rank", "_best")
    w = Window.partitionBy("symbol", "ts").orderBy("_rank")
    return known.withColumn("_pos", F.row_number().over(w)).where(F.col("_pos") == 1).drop("_rank", "_pos")


def normalise_klines(df: DataFrame, symbol: str = "symbol", payload: str = "payload") -> DataFrame:
    """Exchange klines: JSON arrays of [open ms, o, h, l, c, v, ...] with numbers as text."""
    rows = df.select(F.col(symbol).alias("symbol"),
                     F.explode(F.from_json(payload, "array<array<string>>")).alias("_k"))
    fields = {name: F.get("_k", F.lit(i + 1)).try_cast("double")
              for i, name in enumerate(["open", "high", "low", "close", "volume"])}
    return rows.select(
        "symbol", F.timestamp_millis(F.get("_k", F.lit(0)).try_cast("bigint")).alias("ts"),
        *[c.alias(n) for n, c in fields.items()],
    )


def normalise_candles(df: DataFrame, symbol: str = "symbol", payload: str = "payload") -> DataFrame:
    """Exchange candles: JSON arrays of [epoch s, low, high, open, close, volume]."""
    rows = df.select(F.col(symbol).alias("symbol"),
                     F.explode(F.from_json(payload, "array<array<double>>")).alias("_k"))
    place = {"open": 3, "high": 2, "low": 1, "close": 4, "volume": 5}
    return rows.select(
        "symbol", F.timestamp_seconds(F.get("_k", F.lit(0)).cast("bigint")).alias("ts"),
        *[F.get("_k", F.lit(i)).alias(n) for n, i in place.items()],
    )


def lower_columns(df: DataFrame) -> DataFrame:
    """Lower-case names, OHLCV (and symbol, ts when there) only."""
    low = df.toDF(*[c.lower() for c in df.columns])
    return low.select([c for c in ("symbol", "ts", "open", "high", "low", "close", "volume") if c in low.columns])
