"""Column expressions over a window ``w`` that is ordered by time within a series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from marketpulse.functions.numeric import div, nonzero, num


def back(w: WindowSpec, n: int) -> WindowSpec:
    """The current row and the n - 1 rows before it."""
    return w.rowsBetween(-(n - 1), 0)


def strict(agg: Callable[[Column], Column], x: Column, n: int, w: WindowSpec) -> Column:
    """agg over n rows, NULL until n values are there."""
    f = back(w, n)
    return F.when(F.count(x).over(f) >= n, agg(x).over(f))


def sma(x: Column, n: int, w: WindowSpec) -> Column:
    return strict(F.avg, x, n, w)


def std(x: Column, n: int, w: WindowSpec) -> Column:
    return strict(F.stddev_samp, x, n, w)


def total(x: Column, n: int, w: WindowSpec) -> Column:
    return strict(F.sum, x, n, w)


def mean_partial(x: Column, n: int, w: WindowSpec) -> Column:
    """Mean of up to n rows, from the first row on."""
    return F.avg(x).over(back(w, n))


def change(x: Column, n: int, w: WindowSpec) -> Column:
    """x / (x n rows before) - 1."""
    return div(x, F.lag(x, n).over(w)) - 1


def diff(x: Column, w: WindowSpec) -> Column:
    return x - F.lag(x).over(w)


def volume_ratio(v: Column, n: int, w: WindowSpec) -> Column:
    return v / nonzero(sma(v, n, w))


def momentum(x: Column, n: int, w: WindowSpec) -> Column:
    """(x - x before) / abs(x before); 0 when there is none or it is zero."""
    before = F.lag(x, n).over(w)
    return F.coalesce(div(x - before, F.abs(before)), num(0))


def ratio_points(x: Column, mean: Column) -> Column:
    """x against a mean, on 0-100; 50 without a mean."""
    r = div(x, mean)
    score = (
        F.when(r < 0.5, num(0)).when(r > 2.0, num(100)).otherwise((r - 0.5) / 1.5 * 100.0)
    )
    return F.when(r.isNull(), num(50)).otherwise(score)


def cv_points(spread: Column, mean: Column, count: Column) -> Column:
    """Coefficient of variation on 100-0 (5 % and more is 0); 50 below 5 values."""
    cv = div(spread, mean)
    score = F.when(cv >= 0.05, num(0)).otherwise((1 - cv / 0.05) * 100.0)
    return F.when((count < 5) | cv.isNull(), num(50)).otherwise(score)


def ratio_score(x: Column, n: int, w: WindowSpec) -> Column:
    """x against the mean of the up to n - 1 rows before it, on 0-100; 50 if there are none."""
    return ratio_points(x, F.avg(x).over(w.rowsBetween(-(n - 1), -1)))


def cv_score(x: Column, n: int, w: WindowSpec) -> Column:
    """Coefficient of variation of the up to n last rows on 100-0 (5 % and more is 0); 50 below 5 rows."""
    f = back(w, n)
    return cv_points(F.stddev_pop(x).over(f), F.avg(x).over(f), F.count(x).over(f))


def geometric(x: Column, at: Column, rn: Column, span: int, w: WindowSpec) -> Column:
    """Bias-corrected exponential mean with alpha = 2 / (span + 1).

    ``at`` counts the rows from the start of the block: the powers are scaled from
    there, so blocks must be short. ``rn`` is the row number in the whole series.
    """
    keep = 1.0 - 2.0 / (span + 1)
    f = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weighted = F.sum(x * F.pow(num(1 / keep), at)).over(f) * F.pow(num(keep), at)
    return weighted * (1 - keep) / (1 - F.pow(num(keep), rn))
