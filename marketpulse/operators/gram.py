"""Regressions per series from sums of products, refitted as a series goes on.

A fit needs only the number of rows and the sums of the columns and of their products. Such sums are added up per series
and chunk of time by one aggregate, then over the earlier chunks, and each chunk gets coefficients
from what was known before it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.functions.numeric import num

# Functions that run in Python workers are sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed value: a column counts as constant if its variance is below this share of its mean square.
CONSTANT = 1e-12


def solved(sums: np.ndarray, width: int, ridge: float) -> np.ndarray:
    """Coefficients and intercept of each row of sums: count, columns, target, products of columns, products with the target.

    The columns are scaled to deviation 1 and ``ridge`` is added to the correlations; a constant column has no part.
    """
    n = sums[:, :1]
    mean, target = sums[:, 1 : width + 1] / n, sums[:, width + 1 : width + 2] / n
    upper = np.triu_indices(width)
    products = np.zeros((len(sums), width, width))
    products[:, upper[0], upper[1]] = sums[:, width + 2 : width + 2 + len(upper[0])] / n
    products = products + np.triu(products, 1).transpose(0, 2, 1)
    square = np.diagonal(products, axis1=1, axis2=2)
    spread = products - mean[:, :, None] * mean[:, None, :]
    variance = np.diagonal(spread, axis1=1, axis2=2)
    used = variance > CONSTANT * square
    scale = np.where(used, np.sqrt(np.where(used, variance, 1.0)), np.inf)
    with_target = (sums[:, width + 2 + len(upper[0]) :] / n - mean * target) / scale
    left = spread / scale[:, :, None] / scale[:, None, :] + ridge * np.eye(width)
    lower = np.linalg.cholesky(left)
    half = np.linalg.solve(lower, with_target[:, :, None])
    slopes = np.linalg.solve(lower.transpose(0, 2, 1), half)[:, :, 0] / scale
    return np.column_stack([slopes, target[:, 0] - (slopes * mean).sum(1)])


def running_fits(known: DataFrame, asked: DataFrame, columns: Sequence[str], target: str, by: Sequence[str], chunk: str,
                 ridge: float = 0.01, least: int = 50) -> DataFrame:
    """(by, chunk, n, coefficients) for each chunk of ``asked`` (by, chunk): the fit on all rows of ``known`` with an earlier chunk.

    ``chunk`` of a row of ``known`` says when its target became known. ``coefficients`` are those of the columns and the
    intercept. Rows with a NULL in a column or the target are left out, and fits on fewer than ``least`` rows. NULL keys are keys.
    """
    by, width = list(by), len(columns)
    full = known.dropna(subset=[*columns, target]).select(*by, chunk, *columns, target)
    none = asked.select(*by, chunk, *[F.lit(None).cast("double").alias(c) for c in [*columns, target]])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]] + [(c, target) for c in columns]
    parts: dict[str, Column] = {"n": F.count(target)}
    parts |= {f"s{i}": F.sum(c) for i, c in enumerate([*columns, target])}
    parts |= {f"p{i}": F.sum(F.col(a) * F.col(b)) for i, (a, b) in enumerate(pairs)}
    per_chunk = full.unionByName(none).groupBy(*by, chunk).agg(*[c.alias(f"_{name}") for name, c in parts.items()])
    earlier = Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = per_chunk.select(*by, chunk, F.sum("_n").over(earlier).alias("n"), F.array(
        *[F.sum(f"_{name}").over(earlier).cast("double") for name in parts]).alias("sums")).where(F.col("n") >= least)
    names = [*by, chunk, "n"]
    kinds = ", ".join(f"`{c}` {sums.schema[c].dataType.simpleString()}" for c in names)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = solved(np.array(batch.column("sums").to_pylist(), float), width, ridge)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in names], pa.array(list(found), pa.list_(pa.float64()))], [*names, "coefficients"])

    return sums.mapInArrow(solve, f"{kinds}, coefficients array<double>")


def fitted(columns: Sequence[str], coefficients: str = "coefficients") -> Column:
    """The value that a fit gives for a row."""
    products = F.zip_with(F.array(*[F.col(c) for c in columns], num(1)), coefficients, lambda a, b: a * b)
    return F.aggregate(products, num(0), lambda a, b: a + b)
