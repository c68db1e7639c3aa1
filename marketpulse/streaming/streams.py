"""Structured Streaming forms of the live pipeline: dedupe, windows, running index, signals, sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from marketpulse.functions import frames as fr
from marketpulse.functions.numeric import clip, div, num, rescale, seconds_between
from marketpulse.functions.scoring import index_label, to_index
from marketpulse.operators.fear_greed import HISTORY, WEIGHTS, combine
from marketpulse.operators.sentiment import point_weight
from marketpulse.operators.signals import signals
from marketpulse.session import scratch_path
from marketpulse.streaming import ordered

DELAY = "10 minutes"
#: The time of the row that ends a stream (the last that pandas can hold).
END = "2262-01-01 00:00:00"
SOURCES = ("twitter", "reddit", "news")


def dedupe_stream(df: DataFrame, key: list[str], ts: str = "ts", memory: str = "1 day", delay: str = DELAY,
                  every: str = "10 minutes") -> DataFrame:
    """The rows of each key that no other row of the key came before, at most ``memory`` earlier in event time.

    Copies keep a key alive: of copies each within ``memory`` of the one before, only the earliest stays, with all its columns (of rows
    equal in time the lowest). The result follows from event times alone, not from how rows fall into batches; only
    rows that come more than ``delay`` late are lost. First each key's rows of ``every`` (not longer than ``memory``)
    are combined, partly before the shuffle, so a key with very many copies is no hot key; then a value state
    holds when the key was last seen, until an event-time timer clears it. Rows come out once their ``every`` is over.
    """
    rest = [c for c in df.columns if c not in key and c != ts]
    parts = df.withWatermark(ts, delay).groupBy(F.window(ts, every).alias("_window"), *key).agg(
        F.min(F.struct(ts, *rest)).alias("_row"), F.max(ts).alias("_until"))
    timed = parts.select(F.window_time("_window").alias("_at"), *key, F.unix_micros(F.col(f"_row.{ts}")).alias("_from"), F.unix_micros("_until").alias("_until"), "_row")
    out = StructType([timed.schema[c] for c in (*key, "_row")])
    micros = int(df.sparkSession.range(1).selectExpr(f"unix_micros(timestamp_micros(0) + interval {memory})").first()[0])
    first = timed.groupBy(*key).transformWithState(ordered.FirstSeen(out.names, micros), out, "Append", "EventTime")
    return first.select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def stream_sentiment(posts: DataFrame, size: str = "1 hour", slide: str = "30 minutes", delay: str = DELAY,
                     half_life: float = 14400.0) -> DataFrame:
    """Per window and asset: the decayed weighted score, measured from the end of the window.

    Late rows are dropped by the watermark; each window is emitted once. Sums per
    window and asset are combined on the map side, so a busy asset is no hot key.
    """
    d = posts.withWatermark("ts", delay).withColumn("window", F.window("ts", size, slide))
    # window.end has the type of ts.
    d = d.withColumn("_w", point_weight(seconds_between(F.col("ts"), F.col("window.end")), half_life))

    def part(name: str) -> Column:
        return F.avg(F.when(F.col("source") == name, F.col("score"))).alias(name)
    out = d.groupBy("window", "asset").agg(
        F.coalesce(div(F.sum(F.col("score") * F.col("_w")), F.sum("_w")), num(0)).alias("_raw"),
        F.count(F.lit(1)).alias("volume"), *[part(s) for s in SOURCES],
    )
    score = clip(F.col("_raw"), -1, 1)
    known = F.array(*[F.when(F.col(s).isNotNull(), F.struct(F.lit(s).alias("key"), F.col(s).alias("value")))
                      for s in SOURCES])
    return out.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "asset",
        score.alias("score"), to_index(score).alias("fear_greed_score"), "volume",
        F.least(F.col("volume") / num(50), num(1)).alias("confidence"),
        F.map_from_entries(F.filter(known, lambda e: e.isNotNull())).alias("breakdown"),
    )


def stream_signals(scored: DataFrame, **options) -> DataFrame:
    """Signals of the emitted windows; a projection without state."""
    rows = scored.select(
        F.col("asset").alias("symbol"), F.col("window_end").alias("ts"), F.col("score").alias("sentiment_score"),
        F.col("fear_greed_score").alias("fear_greed_index"), F.col("volume").alias("source_count"),
    )
    return signals(rows, **options)


def hourly_inputs(posts: DataFrame, size: str = "1 hour", delay: str = DELAY) -> DataFrame:
    """(asset, ts, sentiment, volume, price, mentions) per closed window, from scored posts with a price."""
    out = posts.withWatermark("ts", delay).groupBy(F.window("ts", size).alias("w"), "asset").agg(
        F.avg("score").alias("sentiment"), F.count(F.lit(1)).cast("double").alias("volume"),
        F.max_by("price", "ts").alias("price"), F.count_if(F.col("score").isNotNull()).cast("double").alias("mentions"),
    )
    return out.select("asset", F.col("w.start").cast("timestamp").alias("ts"), "sentiment", "volume", "price", "mentions")


def stream_fgi(inputs: DataFrame, weights: dict[str, float] | None = None, history: int = HISTORY, delay: str = DELAY) -> DataFrame:
    """Running fear/greed index per asset over rows (asset, ts, sentiment, volume, price, mentions).

    The rows are the closed windows of ``hourly_inputs``, one per asset and window, so a batch brings few rows per asset
    however many posts there are. A list state holds rows until the watermark has passed them, and timers release them in
    the order of event times, whatever batch they came in; the last ``history`` values of each asset are state too. The scores are the column
    expressions of the batch index.
    """
    held = inputs.withWatermark("ts", delay).select("asset", "ts", "sentiment", *[F.col(c).cast("double").alias(c) for c in ordered.SERIES])
    kept = held.groupBy("asset").transformWithStateInPandas(
        ordered.History(history), ordered.History.ROW, "Append", "EventTime")

    def mean(values: Column) -> Column:
        return div(F.aggregate(values, num(0), lambda a, v: a + v), F.size(values))

    def ratio(name: str) -> Column:
        return fr.ratio_points(F.element_at(name, -1), mean(F.slice(name, 1, F.greatest(F.size(name) - 1, F.lit(0)))))
    gaps = F.transform("price", lambda v: (v - F.col("_price")) * (v - F.col("_price")))
    d = kept.withColumn("_price", mean(F.col("price"))).withColumns({
        "c_sentiment": rescale(F.col("sentiment")), "c_volume_momentum": ratio("volume"), "c_social_volume": ratio("mentions"),
        "c_volatility": fr.cv_points(F.sqrt(mean(gaps)), F.col("_price"), F.size("price")),
        "c_dominance": num(50), "c_trends": num(50),
    })
    index = combine({k: F.col(f"c_{k}") for k in WEIGHTS}, {**WEIGHTS, **(weights or {})})
    out = d.select("asset", "ts", "c_sentiment", "c_volume_momentum", "c_volatility", "c_social_volume", index.alias("fear_greed_index"))
    return out.withColumn("label", index_label(F.col("fear_greed_index")))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def write_stream(df: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append to parquet; ``every`` is the micro-batch interval, without it all there is is read once.

    State lives in RocksDB, which timers and list states need.
    """
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def each_batch(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str,
               every: str | None = None) -> StreamingQuery:
    """Hand every micro-batch to ``fn`` as a plain DataFrame: history tables, user processors."""
    writer = df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def append_history(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that a retried batch overwrites instead of repeating."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def closing(df: DataFrame, ts: str = "ts") -> tuple[DataFrame, Callable[[], None]]:
    """The stream with a way to end it: calling the second part tells every window and timer that no row will follow.

    The end is a row with a time beyond all others, in a folder that is read beside the stream; its own window never closes,
    so it never comes out. Between two runs of a feed, or when it has been idle for good, this releases what the watermark holds back.
    """
    spark = df.sparkSession
    folder = scratch_path(spark, "end")
    row = spark.range(1).select(*[
        (F.lit(END) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    row.limit(0).write.parquet(folder)
    ends = spark.readStream.schema(df.schema).parquet(folder)
    return df.unionByName(ends), lambda: row.write.mode("append").parquet(folder)


def land(df: DataFrame, name: str, end: Callable[[], None] | None = None) -> str:
    """Run a stream over all there is into a new parquet folder and return its path; with ``end`` it is ended and run again."""
    path = scratch_path(df.sparkSession, name)
    write_stream(df, f"{path}/data", f"{path}/checkpoint").awaitTermination()
    if end is not None:
        end()
        write_stream(df, f"{path}/data", f"{path}/checkpoint").awaitTermination()
    return f"{path}/data"


def drain(df: DataFrame, name: str, end: Callable[[], None] | None = None) -> DataFrame:
    """The landed result of a stream as a table."""
    return df.sparkSession.read.schema(df.schema).parquet(land(df, name, end))
