"""Windows over long series without a whole series in one task.

A symbol may hold a third of all rows, so ``Window.partitionBy("symbol")`` is not
safe. Two shapes cover every series operator:

* ``over_series``: frames of a fixed number of rows. The rows of each series are
  numbered, cut into blocks of equal length, and the rows near a block edge are
  copied into the neighbour block. The window runs per (series, block).
* ``running``: frames that reach back to the first row. Each calendar chunk is
  scanned alone and the totals of the earlier chunks (one row per chunk) are
  carried in.

NULL is a key like any other, and rows with a NULL order column come first in their series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK_ROWS = 65536


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on equal keys in which NULL keys meet too, so that no row is lost."""
    other = right.select(*[F.col(k).alias(f"_same_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys])
    return left.join(other, same).drop(*[f"_same_{k}" for k in keys])


def _chunk(order: Sequence[str], chunk: Column | None) -> Column:
    return F.to_date(F.col(order[0])) if chunk is None else chunk


def number_rows(df: DataFrame, by=("symbol",), order=("ts",), chunk: Column | None = None,
                name: str = "_rn") -> DataFrame:
    """Row number (from 1) of each row in its series.

    Rows are ranked inside calendar chunks; the number of earlier rows comes from
    the chunk counts. ``chunk`` must grow with ``order`` (default: the day).
    """
    by, order = list(by), list(order)
    keyed = df.withColumn("_chunk", _chunk(order, chunk))
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy(*by, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        *by, "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*by, "_chunk").orderBy(*order)
    ranked = keyed.withColumn("_pos", F.row_number().over(inside))
    return (
        join_same(ranked, offsets, [*by, "_chunk"])
        .withColumn(name, F.col("_before") + F.col("_pos"))
        .drop("_chunk", "_before", "_pos")
    )


def over_series(df: DataFrame, step: Callable[[DataFrame, WindowSpec], DataFrame], lookback: int,
                lookahead: int = 0, by=("symbol",), order=("ts",), chunk: Column | None = None,
                block_rows: int | None = None, numbered: bool = False) -> DataFrame:
    """Apply ``step(df, w)`` where ``w`` sees ``lookback`` rows back and ``lookahead`` ahead.

    ``lookback`` is the total reach of all nested frames in ``step``. The row number
    ``_rn`` is available to ``step`` and kept when ``numbered`` is set.
    """
    size = max(block_rows or BLOCK_ROWS, lookback, lookahead, 1)
    rows = number_rows(df, by, order, chunk)
    block = F.floor((F.col("_rn") - 1) / F.lit(size)).cast("bigint")
    offset = (F.col("_rn") - 1) % F.lit(size)
    first = block - F.when(offset < lookahead, 1).otherwise(0)
    last = block + F.when(offset >= size - lookback, 1).otherwise(0)
    copies = rows.withColumn("_own", block).withColumn("_block", F.explode(F.sequence(first, last)))
    w = Window.partitionBy(*by, "_block").orderBy("_rn")
    out = step(copies, w).where(F.col("_own") == F.col("_block")).drop("_own", "_block")
    return out if numbered else out.drop("_rn")


_TOTAL = {
    "sum": lambda c, key: F.sum(c),
    "max": lambda c, key: F.max(c),
    "min": lambda c, key: F.min(c),
    "count": lambda c, key: F.count(c),
    "last": lambda c, key: F.max_by(c, F.when(c.isNotNull(), key)),
}
_SCAN = {
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "count": F.count,
    "last": lambda c: F.last(c, ignorenulls=True),
}
_CARRY = {**_SCAN, "count": F.sum}
_COMBINE = {
    "sum": lambda before, here: F.coalesce(before + here, here, before),
    "count": lambda before, here: F.coalesce(before, F.lit(0)) + here,
    "max": lambda before, here: F.greatest(before, here),
    "min": lambda before, here: F.least(before, here),
    "last": lambda before, here: F.coalesce(here, before),
}


def running(df: DataFrame, specs: dict[str, tuple[str, Column]], by=("symbol",), order=("ts",),
            chunk: Column | None = None) -> DataFrame:
    """Running sum, count, max, min or last non-NULL value from the first row on.

    ``specs`` maps an output column to (kind, expression).
    """
    by, order = list(by), list(order)
    inputs = {f"_in_{out}": expr for out, (_, expr) in specs.items()}
    keyed = df.withColumns({"_chunk": _chunk(order, chunk), **inputs})
    key = F.struct(*order)
    totals = keyed.groupBy(*by, "_chunk").agg(
        *[_TOTAL[kind](F.col(f"_in_{out}"), key).alias(f"_all_{out}") for out, (kind, _) in specs.items()]
    )
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *by, "_chunk",
        *[_CARRY[kind](F.col(f"_all_{out}")).over(earlier).alias(f"_before_{out}")
          for out, (kind, _) in specs.items()],
    )
    inside = (
        Window.partitionBy(*by, "_chunk").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    scanned = keyed.withColumns(
        {f"_here_{out}": _SCAN[kind](F.col(f"_in_{out}")).over(inside) for out, (kind, _) in specs.items()}
    )
    joined = join_same(scanned, carry, [*by, "_chunk"]).withColumns({
        out: _COMBINE[kind](F.col(f"_before_{out}"), F.col(f"_here_{out}"))
        for out, (kind, _) in specs.items()
    })
    helpers = [f"_{part}_{out}" for out in specs for part in ("in", "before", "here")]
    return joined.drop("_chunk", *helpers)


def last_rows(df: DataFrame, n: int, by=("symbol",), order=("ts",), chunk: Column | None = None) -> DataFrame:
    """The last n rows of each series.

    The newest n rows of each chunk are kept first, so that the final ranking sees
    few rows of a series.
    """
    by, order = list(by), list(order)
    newest = [F.col(c).desc() for c in order]
    per_chunk = Window.partitionBy(*by, "_chunk").orderBy(*newest)
    tails = (
        df.withColumn("_chunk", _chunk(order, chunk))
        .withColumn("_pos", F.row_number().over(per_chunk))
        .where(F.col("_pos") <= n)
    )
    # Chunks with n later rows cannot hold a row of the tail.
    counts = tails.groupBy(*by, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    later = Window.partitionBy(*by).orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.select(
        *by, "_chunk", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_later")
    ).where(F.col("_later") < n)
    return (
        join_same(tails, needed, [*by, "_chunk"])
        .where(F.col("_later") + F.col("_pos") <= n)
        .drop("_chunk", "_pos", "_later")
    )
