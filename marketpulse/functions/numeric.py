"""Small numeric expressions that the operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(value) -> Column:
    """A DOUBLE literal."""
    return F.lit(float(value))


def div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero (ANSI mode would raise)."""
    return F.try_divide(a, b)


def nonzero(x: Column) -> Column:
    """x, or 1 where x is zero."""
    return F.when(x == 0, num(1)).otherwise(x)


def clip(x: Column, lo: float, hi: float) -> Column:
    """x cut to [lo, hi]; NULL stays NULL."""
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(
        F.least(F.greatest(x, num(lo)), num(hi))
    )


def rescale(x: Column, lo=-1.0, hi=1.0, to_lo=0.0, to_hi=100.0) -> Column:
    """Cut x to [lo, hi] and map that range on [to_lo, to_hi]."""
    return num(to_lo) + (clip(x, lo, hi) - lo) / (hi - lo) * (to_hi - to_lo)


def corr(x: Column, y: Column) -> Column:
    """Pearson correlation over the rows where both are set; NULL for a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return div(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def ratio_of_sums(x: Column, w: Column) -> Column:
    """Weighted mean; 0 without weight."""
    return F.coalesce(div(F.sum(x * w), F.sum(w)), num(0))


def tanh_score(features: Column, weights: Column) -> Column:
    """tanh of the dot product of two arrays."""
    products = F.zip_with(features, weights, lambda f, w: f * w)
    return F.tanh(F.aggregate(products, num(0), lambda s, v: s + v))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, for use inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(scores: Column) -> Column:
    """Softmax of an array, shifted by its largest value."""
    shifted = let(F.struct(scores.alias("x"), F.array_max(scores).alias("top")),
                  lambda b: F.transform(b["x"], lambda s: F.exp(s - b["top"])))
    return let(shifted, lambda p: let(
        F.struct(p.alias("p"), F.aggregate(p, num(0), lambda s, v: s + v).alias("total")),
        lambda b: F.transform(b["p"], lambda v: v / b["total"])))


def fixed(x: Column, digits: int) -> Column:
    """Text with a fixed number of digits, rounded from the exact binary value (not from its decimal text)."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits if digits else "0"))


def human_number(x: Column) -> Column:
    """1500000 -> 1.5M, 2300 -> 2.3K, 12 -> 12."""
    return (
        F.when(x >= 1e6, F.concat(fixed(x / 1e6, 1), F.lit("M")))
        .when(x >= 1e3, F.concat(fixed(x / 1e3, 1), F.lit("K")))
        .otherwise(fixed(x, 0))
    )


def epoch_to_timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def timestamp_to_epoch(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / num(1e6)


def seconds_between(start: Column, end: Column) -> Column:
    """Exact seconds from start to end as DOUBLE."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / num(1e6)


def round_columns(df, digits: dict[str, int]):
    """Round the named columns; done at the report edge only."""
    return df.withColumns({c: F.round(F.col(c), n) for c, n in digits.items()})
