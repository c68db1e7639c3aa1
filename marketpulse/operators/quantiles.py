"""Exact order statistics without sorting a whole group in one task.

``percentile_approx`` brackets each wanted rank, everything below the bracket is
only counted, and the values inside it (a small share of the group, duplicates
collapsed) are ranked exactly. A group with at most ``accuracy`` rows is its own
bracket; for larger ones the rows below and inside each bracket are counted first, and a side
that misses the wanted rank is moved to the end of the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.functions.numeric import num
from marketpulse.operators.joins import join_or_beside
from marketpulse.session import sized

ACCURACY = 100_000
#: Width of a bracket to each side, in parts of the accuracy.
MARGIN = 3.0


def _widened(rows: DataFrame, bounds: DataFrame, by: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``bounds`` with every bracket wide enough for the ranks around its probability."""
    v, lo, hi, n = (F.col(c) for c in ("_v", "_lo", "_hi", "_n"))
    facts = [*by, "_n", "_min", "_max", "_i", "_lo", "_hi"]
    counted = join_or_beside(rows, bounds, by).select(*by, "_n", "_min", "_max", "_v", F.inline("_b")).groupBy(*facts).agg(
        F.count_if(v < lo).alias("_below"), F.count_if(v <= hi).alias("_upto"))
    p = F.element_at(F.array(*[num(x) for x in probs]), F.col("_i") + 1)
    first, last = F.floor(p * (n - 1)), F.least(F.floor(p * n) + 1, n - 1)
    bracket = F.struct("_i", F.when(F.col("_below") > first, F.col("_min")).otherwise(lo).alias("_lo"),
                       F.when(F.col("_upto") <= last, F.col("_max")).otherwise(hi).alias("_hi"))
    return counted.groupBy(*by, "_n", "_min", "_max").agg(F.collect_list(bracket).alias("_b"))


def _ranked(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], accuracy: int) -> DataFrame:
    """Per key and probability: the bracketed values with their 0-based rank range."""
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    margin = MARGIN / accuracy
    lows = [max(p - margin, 0.0) for p in probs]
    highs = [min(p + margin, 1.0) for p in probs]
    sketch = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", lows + highs, accuracy).alias("_q"),
    )
    k = len(probs)
    brackets = F.array(*[
        F.struct(
            F.lit(i).alias("_i"),
            F.when((F.col("_n") <= accuracy) | F.lit(lows[i] <= 0.0), F.col("_min"))
            .otherwise(F.col("_q")[i]).alias("_lo"),
            F.when((F.col("_n") <= accuracy) | F.lit(highs[i] >= 1.0), F.col("_max"))
            .otherwise(F.col("_q")[k + i]).alias("_hi"),
        )
        for i in range(k)
    ])
    bounds = sized(sketch.select(*by, "_n", "_min", "_max", brackets.alias("_b")))
    large = bounds.where(F.col("_n") > accuracy)
    if not large.isEmpty():
        bounds = sized(bounds.where(F.col("_n") <= accuracy).unionByName(_widened(rows, large, by, probs)))
    joined = join_or_beside(rows, bounds, by)
    # Map-side: each row meets the wanted ranks; rows below a bracket share one NULL value.
    hits = (
        joined.select(*by, "_n", "_v", F.inline("_b"))
        .where(F.col("_v") <= F.col("_hi"))
        .withColumn("_v", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")))
    )
    counted = hits.groupBy(*by, "_i", "_v").agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"))
    w = Window.partitionBy(*by, "_i").orderBy(F.col("_v").asc_nulls_first())
    upto = F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counted.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_c"))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float],
                    accuracy: int = ACCURACY) -> DataFrame:
    """(by..., p, q): quantiles with linear interpolation between neighbour ranks."""
    p = F.element_at(F.array(*[num(x) for x in probs]), F.col("_i") + 1)
    ranked = _ranked(df, by, value, probs, accuracy).withColumn("_h", p * (F.col("_n") - 1))
    low = F.floor("_h")
    high = F.least(low + 1, F.col("_n") - 1)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col("_v")))

    picked = ranked.groupBy(*by, "_i").agg(
        at(low).alias("_a"), at(high).alias("_b"), F.max(F.col("_h") - low).alias("_t")
    )
    return picked.select(
        *by, p.alias("p"), (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_t")).alias("q")
    )


def value_at_share(df: DataFrame, by: Sequence[str], value: str, share: float,
                   accuracy: int = ACCURACY) -> DataFrame:
    """(by..., n, rank, q): the value at 0-based rank int(share * n) of the sorted group."""
    ranked = _ranked(df, by, value, [share], accuracy).withColumn(
        "_k", F.least(F.floor(num(share) * F.col("_n")), F.col("_n") - 1)
    )
    here = (F.col("_from") <= F.col("_k")) & (F.col("_k") < F.col("_to"))
    return ranked.groupBy(*by).agg(
        F.max("_n").alias("n"), F.max("_k").alias("rank"), F.max(F.when(here, F.col("_v"))).alias("q")
    )


def median(df: DataFrame, by: Sequence[str], value: str, name: str = "median",
           accuracy: int = ACCURACY) -> DataFrame:
    return exact_quantiles(df, by, value, [0.5], accuracy).select(*by, F.col("q").alias(name))
