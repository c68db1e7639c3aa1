"""Best-fit packing of documents into sequences after dominance reduction."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.llm.common import running_totals, text_of
from marketpulse.llm.tokens import encoder
from marketpulse.session import materialise


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, known: int | None = None) -> DataFrame:
    """The pieces of every document: ``rid``, ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``.

    A document is the ids of its whole text and the end id. One longer than ``capacity`` is cut into pieces
    of that length; only the first may be shorter. Encoded where the text is read, nothing shuffled.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer, known)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rids, doc_ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, found in tool.steps(batch.column(2).to_pylist()):
                rows = []
                for i, ids in enumerate(found, first):
                    ids += end
                    n = len(ids) // 4
                    head = n % capacity or capacity
                    starts = [0, *range(head, n, capacity)]
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                        rows.append((rids[i], doc_ids[i], k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
                columns = list(zip(*rows))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], ["rid", "doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(cut, "rid long, doc_id long, piece int, start long, length long, ids_crc32 long")


class _Lengths:
    """Counts of pieces by length, and the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: n for k, n in counts.items() if n}
        self.order = sorted(self.counts)

    def take(self, pattern: tuple[int, ...], times: int) -> None:
        for k in pattern:
            self.counts[k] -= times
        for k in set(pattern):
            if not self.counts[k]:
                del self.counts[k]
                self.order.pop(bisect_left(self.order, k))

    def times(self, pattern: tuple[int, ...]) -> int:
        """How often the pattern can be taken."""
        return min(self.counts.get(k, 0) // pattern.count(k) for k in set(pattern))

    def largest(self, most: int, used: tuple[int, ...]) -> int | None:
        """The largest length up to ``most`` of which a piece is left beside ``used``."""
        i = bisect_right(self.order, most) - 1
        while i >= 0 and self.counts[self.order[i]] <= used.count(self.order[i]):
            i -= 1
        return self.order[i] if i >= 0 else None

    def smallest(self, n: int, used: tuple[int, ...]) -> list[int]:
        """The n smallest pieces beside ``used``."""
        out: list[int] = []
        for k in self.order:
            out += [k] * min(n - len(out), self.counts[k] - used.count(k))
            if len(out) == n:
                break
        return out


def dominating_set(left: _Lengths, item: int, capacity: int) -> tuple[int, ...] | None:
    """A set with ``item`` that dominates every other feasible set with it (Martello and Toth), if one of at most three is found.

    A set dominates another if the other's pieces can be put into groups, each no longer than a
    piece of its own; exchanging the sets then never costs a sequence, so it can be fixed for good.
    """
    room = capacity - item
    few = left.smallest(3, (item,))
    if not few or few[0] > room:
        return (item,)
    best = left.largest(room, (item,))
    if best == room:
        return (item, best)  # whatever else fits beside the item fits in this piece's place
    if len(few) < 2 or few[0] + few[1] > room:
        return (item, best)
    if len(few) == 3 and sum(few) <= room:
        return None
    # At most two others fit. Pairs (r, s), s <= r, must fit in best's place together, or s in second's.
    second = left.largest(room - best, (item, best)) or 0
    for i in range(bisect_right(left.order, room // 2) - 1, -1, -1):
        s = left.order[i]
        if s <= second:
            break
        r = left.largest(room - s, (item, s))
        if r is not None and r >= s and r + s > best:
            return None
    return (item, best, second) if second else (item, best)


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences have each; all pieces are placed.

    Sets that dominate are fixed until none is left, as many times as the counts allow; the rest
    is packed best fit, longest first, a class of equal lengths at a time. The work depends on the
    number of different lengths (``capacity`` at most), not on the number of pieces.
    """
    left = _Lengths(counts)
    fixed: list[tuple[tuple[int, ...], int]] = []

    def fix(pattern: tuple[int, ...]) -> None:
        n = left.times(pattern)
        fixed.append((tuple(sorted(pattern, reverse=True)), n))
        left.take(pattern, n)

    changed = True
    while changed:
        changed = False
        for item in reversed(list(left.order)):
            while left.counts.get(item):
                pattern = dominating_set(left, item, capacity)
                if pattern is None:
                    break
                fix(pattern)
                changed = True
    open_bins: dict[int, list[list]] = {}  # room left: [pattern, sequences]
    rooms: list[int] = []

    def put(pattern: tuple[int, ...], n: int) -> None:
        room = capacity - sum(pattern)
        if n and room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        if n:
            open_bins[room].append([pattern, n])

    for item in reversed(left.order):
        n = left.counts[item]
        while n:
            i = bisect_left(rooms, item)
            if i == len(rooms):
                fit = capacity // item
                put((item,) * fit, n // fit)
                put((item,) * (n % fit), 1 if n % fit else 0)
                break
            room = rooms[i]
            pattern, bins = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(i)
            fit = room // item
            full = min(bins, n // fit)
            put(pattern + (item,) * fit, full)
            n -= full * fit
            if full < bins and n:
                put(pattern + (item,) * n, 1)
                full, n = full + 1, 0
            put(pattern, bins - full)
    return fixed + [(tuple(p), n) for groups in open_bins.values() for p, n in groups]


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (gapless from 0) to ``pieces`` (rid, piece, length, ...).

    Pieces of one length are interchangeable, so the whole instance is a count per length: at most
    ``capacity`` rows go to the driver, and as many patterns as these allow come back as ranges of
    ranks. Each piece finds its place by its rank among the pieces of its length; ranks are counted
    in ranges, so a length that holds a third of all pieces is no single task.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, taken, base = [], dict.fromkeys(counts, 0), 0
    for pattern, n in pack_lengths(counts, capacity):
        offset = 0
        for length in pattern:
            slots.append((length, taken[length], taken[length] + n, base, offset))
            taken[length] += n
            offset += length
        base += n
    places = spark.createDataFrame(slots, "_length long, _from long, _to long, _base long, offset long")
    ranked = running_totals(pieces, "length", ["rid", "piece"], ["length"])
    here = (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_to"))
    # Bounded by the patterns of ``capacity`` lengths.
    return ranked.join(F.broadcast(places), here).select(
        *pieces.columns, (F.col("_base") + F.col("rank") - F.col("_from")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, known: int | None = None) -> DataFrame:
    """One row per piece of every document with its place: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    ``known`` bounds the words that a worker's encoder remembers, and so its memory; results do not depend on it.

    NULL texts are empty: the end id alone. Repeated rows and NULL ids are packed row by row. An empty
    table gives no rows. Other columns are ignored. ``docs`` must be a table read from files.
    """
    pieces = materialise(token_pieces(docs, tokenizer, end_id, capacity, known), "pieces")
    return pack(pieces, capacity).drop("rid")
