"""Frames measured in time: rolling means over hours, momentum over minutes.

Both look up a value at a shifted time. No frame is ever held or scanned, so the cost does not depend on how many rows
it has, and no window needs more than five minutes of one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.functions.numeric import div, num
from marketpulse.operators.joins import asof_join
from marketpulse.operators.series import join_same, running
from marketpulse.session import materialise

SECOND = 1_000_000
HOUR = 3600 * SECOND


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def dense(ts: str = "ts") -> Column:
    """Scan chunk of dense series: five minutes of a key per window, one row per five minutes carried over."""
    return F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / 300)


def _earlier(ts: str, seconds: int) -> Column:
    return F.col(ts) - F.make_dt_interval(secs=F.lit(seconds))


def _ends(moments: DataFrame, hours: Sequence[int], by: list[str], width: int) -> DataFrame:
    """Each moment with ``_pre`` and ``_suf``: per frame length the sum and count of its block up to it, and from it on.

    Blocks are as long as the frame and hold whole chunks. A chunk is scanned once for all lengths; the chunks before
    and after it in its block come from a table of totals with a row per chunk.
    """
    keys = [*by, "_chunk"]
    keyed = moments.withColumn("_chunk", F.floor(F.col("_us") / width).cast("long"))
    inside = Window.partitionBy(*keys).orderBy("_us")
    until = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    since = inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    scanned = keyed.withColumns({f"_{x}_{name}": F.sum(x).over(w) for name, w in (("until", until), ("since", since)) for x in ("s", "c")})
    totals = keyed.groupBy(*keys).agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    reach = {}
    for h in hours:
        w = Window.partitionBy(*by, F.floor(F.col("_chunk") * width / (h * HOUR))).orderBy("_chunk")
        for name, some in (("before", w.rowsBetween(Window.unboundedPreceding, -1)), ("after", w.rowsBetween(1, Window.unboundedFollowing))):
            reach |= {f"_{x}_{name}_{h}": F.coalesce(F.sum(x).over(some), F.lit(0)) for x in ("s", "c")}
    d = join_same(scanned, totals.select(*keys, *[e.alias(n) for n, e in reach.items()]), keys)

    def parts(here: str, beyond: str) -> Column:
        return F.array(*[F.struct(*[(F.col(f"_{x}_{beyond}_{h}") + F.col(f"_{x}_{here}")).alias(x) for x in ("s", "c")]) for h in hours])
    return d.select(*by, "_us", parts("until", "before").alias("_pre"), parts("since", "after").alias("_suf"))


def rolling_time_mean(df: DataFrame, col: str, hours: Sequence[int] = (1, 4, 24), by=("asset",), ts: str = "ts",
                      prefix: str = "mean") -> DataFrame:
    """(by..., ts, <prefix>_1h, ...): mean of the values in (ts - h hours, ts], a row per key and time.

    Time is cut into blocks as long as the frame, so a frame is the end of one block and the beginning of the
    next: two sums are added and none is subtracted. Values of any size keep their digits, and no frame is held
    or scanned. The end of the earlier block is that of the first time after ts - h hours, carried back by ``running``.

    Times with NULL values only have a row; a frame without a value has a NULL mean. NULL keys are keys; rows without time are
    left out.
    """
    by, hours = list(by), list(hours)
    moments = df.where(F.col(ts).isNotNull()).groupBy(*by, ts).agg(
        F.coalesce(F.sum(F.col(col).cast("double")), num(0)).alias("s"), F.count(col).alias("c")).withColumn("_us", micros(ts))
    ends = materialise(_ends(moments.select(*by, "_us", "s", "c"), hours, by, 300 * SECOND), "ends")
    asks = ends.select(*by, "_us", F.posexplode("_pre").alias("_i", "_own"))
    asks = asks.withColumn("_span", F.element_at(F.array(*[F.lit(h * HOUR) for h in hours]), F.col("_i") + 1))
    # Time runs backwards; a question comes before an answer of the same time, which lies outside its frame.
    asks = asks.select(*by, (F.col("_span") - F.col("_us")).alias("_back"), F.lit(0).alias("_kind"), "_us", "_i", "_own", "_span")
    answers = ends.select(*by, (-F.col("_us")).alias("_back"), F.lit(1).alias("_kind"), F.struct("_us", "_suf").alias("_next"))
    found = running(asks.unionByName(answers, allowMissingColumns=True), {"_first": ("last", F.col("_next"))}, by, ("_back", "_kind"),
                    F.floor(F.col("_back") / (300 * SECOND))).where("_kind = 0")
    block = F.floor(F.col("_us") / F.col("_span")) * F.col("_span")
    rest = F.when(F.col("_first._us") < block, F.element_at("_first._suf", F.col("_i") + 1))
    mean = div(F.col("_own.s") + F.coalesce(rest["s"], num(0)), (F.col("_own.c") + F.coalesce(rest["c"], F.lit(0))).cast("double"))
    kind = df.schema[ts].dataType
    return found.withColumn("_mean", mean).groupBy(*by, F.timestamp_micros("_us").cast(kind).alias(ts)).agg(
        *[F.max(F.when(F.col("_i") == i, F.col("_mean"))).alias(f"{prefix}_{h}h") for i, h in enumerate(hours)])


def time_momentum(df: DataFrame, col: str = "score", back: int = 900, within: int = 3600, by=("asset",),
                  ts: str = "ts", out: str = "momentum") -> DataFrame:
    """value - the last value at or before ts - back, not older than ``within``; 0 if there is none.

    Expects one row per (key, ts).
    """
    by = list(by)
    df = materialise(df, "series")
    asks = df.withColumn("_at", F.col(ts)).withColumn(ts, _earlier(ts, back))
    past = df.select(*by, ts, F.col(col).alias("_before"))
    found = asof_join(asks, past, ("_before",), by, ts, tolerance=within - back, chunk=dense(ts), bar_ts="_past")
    moved = found.withColumn(ts, F.col("_at")).withColumn(out, F.coalesce(F.col(col) - F.col("_before"), num(0)))
    return moved.drop("_at", "_past", "_before")


def bucket(df: DataFrame, kind: str, size: str, slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Adds ``window``: a tumbling, sliding or session window for a following groupBy."""
    if kind == "tumbling":
        return df.withColumn("window", F.window(ts, size))
    if kind == "sliding":
        return df.withColumn("window", F.window(ts, size, slide))
    if kind == "session":
        return df.withColumn("window", F.session_window(ts, size))
    raise ValueError(f"unknown window: {kind}")
