"""Maximal periodic runs of words by an enhanced suffix array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.llm.arrow_steps import steps
from marketpulse.llm.common import text_of

#: Bytes of text whose suffixes are sorted at a time.
STEP = 2 << 20
#: Suffixes that are tested at a time.
TESTS = 1 << 20


class SuffixArray:
    """Suffix array, its inverse and the longest common prefixes of many texts, each for itself.

    ``ids`` are the word numbers of all texts one after another, ``sizes`` the texts' words. Suffixes are sorted by
    prefix doubling: ``levels[k]`` ranks the first 2**k words at each place, and only suffixes that are
    still tied are sorted again. Places of different texts never tie. ``lcp[k]`` belongs to the suffixes in slots k-1 and k.
    """

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        n = self.n = len(ids)
        ends = np.cumsum(sizes)
        self.first, self.end = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
        key = np.repeat(np.arange(len(sizes)), sizes) * (int(ids.max(initial=0)) + 1) + ids
        self.sa = np.argsort(key, kind="stable")
        slots = np.arange(n)
        rank = np.full(n + 1, -1, np.int64)
        tied = self._rank(rank, slots, key[self.sa])
        self.levels = [rank]
        while len(tied):
            step, rank = 1 << (len(self.levels) - 1), rank.copy()
            at = self.sa[tied]
            after = np.where(at + step < self.end[at], self.levels[-1][np.minimum(at + step, n)], -1)
            key = rank[at] * (n + 1) + after + 1
            order = np.argsort(key, kind="stable")
            self.sa[tied] = at[order]
            tied = self._rank(rank, tied, key[order])
            self.levels.append(rank)
        self.isa = rank
        self.lcp = self._common()

    def _rank(self, rank: np.ndarray, slots: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Give the suffixes in ``slots``, sorted by ``keys``, the first slot of their key; returns the slots still tied."""
        new = np.ones(len(slots) + 1, bool)
        new[1:-1] = keys[1:] != keys[:-1]
        heads = np.flatnonzero(new[:-1])
        rank[self.sa[slots]] = np.repeat(slots[heads], np.diff(np.append(heads, len(slots))))
        return slots[~(new[:-1] & new[1:])]

    def _common(self) -> np.ndarray:
        lcp = np.zeros(self.n + 1, np.int64)
        if not self.n:
            return lcp
        low = self.levels[0]
        at = np.flatnonzero(low[self.sa[1:]] == low[self.sa[:-1]]) + 1
        a, b = self.sa[at - 1].copy(), self.sa[at].copy()
        for k in reversed(range(len(self.levels))):
            same = (self.levels[k][a] == self.levels[k][b]) << k
            a += same
            b += same
            lcp[at] += same
        return lcp

    def nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots k with a common prefix, and the interval [low, high) of slots that share it; of equal ones the first spans all."""
        lcp, at = self.lcp, np.flatnonzero(self.lcp)
        low, high = np.arange(-1, self.n), np.arange(1, self.n + 2)
        todo = at
        while len(todo):
            todo = todo[lcp[low[todo]] > lcp[todo]]
            low[todo] = low[low[todo]]
        todo = at
        while len(todo):
            todo = todo[lcp[high[todo]] >= lcp[todo]]
            high[todo] = high[high[todo]]
        return at, low[at], high[at]

    def squares(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, period) of all branching tandem repeats: two equal stretches side by side whose next words differ.

        The slots of an interval of depth d are split in two at a slot of that depth. Each suffix i of the smaller side is tested: is
        the suffix at i + d or at i - d in the other side? Sides at least double upwards, so a suffix is tested log n times at most.
        """
        at, low, high = self.nodes()
        depth = self.lcp[at]
        left = at - low <= high - at
        start, size = np.where(left, low, at), np.where(left, at - low, high - at)
        other, other_end = np.where(left, at, low), np.where(left, high, at)
        total = np.cumsum(size)
        cut = 0
        while cut < len(at):
            stop = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + TESTS, "right")))
            node = np.repeat(np.arange(cut, stop), size[cut:stop])
            ahead = np.cumsum(size[cut:stop]) - size[cut:stop]
            i = self.sa[np.repeat(start[cut:stop] - ahead, size[cut:stop]) + np.arange(len(node))]
            for sign in (1, -1):
                j = i + sign * depth[node]
                fits = np.flatnonzero((j < self.end[i]) & (j >= self.first[i]))
                slot, of = self.isa[j[fits]], node[fits]
                met = fits[(slot >= other[of]) & (slot < other_end[of])]
                yield np.minimum(i[met], j[met]), depth[node[met]]
            cut = stop

    def rotated(self, place: np.ndarray, period: np.ndarray) -> np.ndarray:
        """The first place to which each square can be rotated to the left, word by word; moved by powers of two."""
        place = place.copy()
        for k in reversed(range(len(self.levels))):
            todo = np.arange(len(place))
            while len(todo):
                to = place[todo] - (1 << k)
                todo, to = todo[fits := to >= self.first[place[todo]]], to[fits]
                same = self.levels[k][to] == self.levels[k][to + period[todo]]
                todo, to = todo[same], to[same]
                place[todo] = to
        return place

    def runs(self, least: int, times: int) -> np.ndarray:
        """Rows (start, length, period) of all runs of at least ``least`` words and ``times`` periods, in the order of places."""
        found = [np.zeros((0, 3), np.int64)]
        for place, period in self.squares():
            start = self.rotated(place, period)
            length = place + 2 * period - start
            long = length >= np.maximum(least, times * period)
            found.append(np.column_stack([start, length, period])[long])
        runs = np.concatenate(found)
        runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
        # A stretch found with multiples of its period keeps the smallest.
        first = np.ones(len(runs), bool)
        first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
        runs = runs[first]
        return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of(texts: list[bytes], least: int, times: int) -> tuple[list[int], np.ndarray, np.ndarray, list[bytes]]:
    """Of many texts: words of each, runs (start in the text, length, period) of all, runs of each, and the collapsed texts."""
    words = [t.split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = pa.array([w for some in words for w in some], pa.large_binary()).dictionary_encode()
    index = SuffixArray(flat.indices.to_numpy().astype(np.int64), sizes)
    runs = index.runs(least, times)
    ends = np.cumsum(sizes)
    owner = np.searchsorted(ends, runs[:, 0], "right")
    counts = np.bincount(owner, minlength=len(texts))
    depth = np.zeros(index.n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(depth) == 0
    out = []
    for k, (some, n, end) in enumerate(zip(words, counts.tolist(), ends.tolist())):
        if n:
            some = [w for w, stays in zip(some, kept[end - len(some) : end].tolist()) if stays]
        out.append(b" ".join(some))
    runs[:, 0] -= ends[owner] - sizes[owner]
    return sizes.tolist(), runs, counts, out


RUNS = "array<struct<start:long,length:long,period:long>>"


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4, key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` and ``collapsed`` of each text.

    A run is a stretch of at least ``least`` words and ``times`` periods in which words one period apart are identical,
    which no neighbouring word extends, with its smallest period. ``runs`` holds (start, length, period) by start, then
    period; words are split at ASCII white space and numbered from 0. ``collapsed`` joins by a blank the words that lie in no run
    after its first period.

    Texts are handled where they are read, without a shuffle, in steps of STEP bytes; a longer text is a step of its own, whose
    arrays take some hundred bytes a word. Work is n log n in the words of a text, whatever repeats.

    NULL and empty texts have no words, no runs and an empty collapsed text. Repeated rows and NULL keys are
    handled row by row. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, 1, STEP):
                sizes, runs, counts, texts = runs_of(step.column(1).to_pylist(), least, times)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                entries = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in runs.T], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [step.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, entries),
                     pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.encode(text_of(), "UTF-8").alias("text"))
    return rows.mapInArrow(find, f"doc_id long, n_words long, runs {RUNS}, collapsed string")
