"""Arrow batches of texts in steps of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def steps(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch whose values in a binary column have about ``size`` bytes; a longer value is alone."""
    lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
    start = taken = 0
    for at, length in enumerate(lengths):
        if at > start and taken + (length or 0) > size:
            yield batch.slice(start, at - start)
            start, taken = at, 0
        taken += length or 0
    if start < len(lengths):
        yield batch.slice(start)
