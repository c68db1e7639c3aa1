"""Hashes of words and word shingles of whole texts, and MinHash signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Words to a shingle.
WIDTH = 5
#: Hashes in a signature.
HASHES = 96
_STEP = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: bytes) -> np.ndarray:
    """The hash of each word in order; long texts are read a stretch at a time."""
    out, start = [], 0
    while start < len(text):
        end = min(start + _STEP, len(text))
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        words = text[start:end].split()
        out.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        start = end
    return out[0] if len(out) == 1 else np.concatenate([np.empty(0, np.uint64), *out])


def shingles(words: np.ndarray) -> np.ndarray:
    """The hash of each run of WIDTH words in order; a shorter text is one shingle, a text without words none."""
    n = len(words)
    if n == 0:
        return words
    width = min(WIDTH, n)
    acc = words[: n - width + 1].copy()
    for i in range(1, width):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + words[i : n - width + 1 + i]
    return mixed(acc + np.uint64(width))


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
    return seeds[:HASHES] | np.uint64(1), seeds[HASHES:]


def signature(distinct: np.ndarray) -> np.ndarray:
    """The MinHash signature of a set of shingles: HASHES unsigned 32-bit integers."""
    a, b = _coefficients()
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(distinct), 2048):
        low = np.minimum(low, (distinct[i : i + 2048, None] * a + b).min(axis=0))
    return (low >> np.uint64(32)).astype("<u4")


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches sorted by integer ``keys``, with the first row of each group and the end."""
    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if carry is None else pa.concat_tables([carry, table])
        starts = group_starts(table, keys)
        if len(starts) > 1:
            yield table.slice(0, starts[-1]).combine_chunks(), starts
        carry = table.slice(starts[-1])
    if carry is not None and carry.num_rows:
        yield carry.combine_chunks(), np.array([0, carry.num_rows])


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in keys:
        column = table.column(k).to_numpy()
        change[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(change)


def binaries(table: pa.Table, column: str) -> list[bytes]:
    return table.column(column).to_pylist()


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index of each of n nodes' component."""
    label = np.arange(n)
    while len(left):
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    return label
