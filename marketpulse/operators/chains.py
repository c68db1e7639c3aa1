"""Times that keep a distance: the first of a series, then always the first far enough from the one before."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.operators.joins import asof_join
from marketpulse.operators.timeframes import SECOND
from marketpulse.session import materialise


def spaced(candidates: DataFrame, gap: int, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """(by..., _t): of the candidate times ``_t`` (microseconds) of each series the first, then always the first at least ``gap`` later.

    Each time gets its successor by one forward as-of join; reachable times are then
    marked by pointer jumping: a round makes the known part of the chain four times as
    long and is written out. The chain has at most one time per ``gap``, so the
    number of rounds is known, and each round adds new chain positions only.

    NULL keys are a series; candidates without a time are left out; an empty table gives an empty result.
    """
    if gap < 1:
        raise ValueError("the gap must be positive")
    by = list(by)
    times = materialise(candidates.where("_t IS NOT NULL").select(F.struct(*by).alias("_of"), "_t").distinct(), "times")
    # Forward as-of as a backward one on the negated axis: the first time from _t + gap on.
    asks = times.select("_of", (-(F.col("_t") + gap)).alias("_key"), F.col("_t").alias("_from"))
    keys = times.select("_of", (-F.col("_t")).alias("_key"), F.col("_t").alias("_next"))
    chunk = F.floor(F.col("_key") / (300 * SECOND))
    jump = asof_join(asks, keys, ("_next",), ("_of",), "_key", chunk=chunk, bar_ts="_at").select(
        "_of", F.col("_from").alias("_t"), "_next").where(F.col("_next").isNotNull())
    jump = materialise(jump, "jump")
    longest = times.groupBy("_of").agg((F.max("_t") - F.min("_t")).alias("_s")).agg(F.max("_s")).first()[0]
    rounds = max(1, math.ceil(math.log((longest or 0) / gap + 2, 4)))

    def follow(rows: DataFrame, step: DataFrame) -> DataFrame:
        return rows.join(step, ["_of", "_t"]).select("_of", F.col("_next").alias("_t"))

    def twice(a: DataFrame, b: DataFrame) -> DataFrame:
        far = b.select("_of", F.col("_t").alias("_next"), F.col("_next").alias("_far"))
        return a.join(far, ["_of", "_next"]).select("_of", "_t", F.col("_far").alias("_next"))
    reached = times.groupBy("_of").agg(F.min("_t").alias("_t"))
    for i in range(rounds):
        two = twice(jump, jump)
        steps = [follow(reached, jump), follow(reached, two), follow(reached, twice(two, jump))]
        reached = materialise(reduce(DataFrame.unionByName, steps, reached), "reached")
        if i + 1 < rounds:
            jump = materialise(twice(two, two), "jump")
    return reached.select("_of.*", "_t")
