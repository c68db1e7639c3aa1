"""Similarity join of texts on word shingles with Bayesian pruning of candidates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.llm.common import components, partitions, text_of, with_rows
from marketpulse.llm.shingles import HASHES, binaries, shingles, signature, sorted_groups, roots, word_hashes
from marketpulse.session import materialise

#: Hashes to a band. A pair of similarity .8 shares one of the 24 bands but for 3 in a million.
ROWS = 4
#: Hashes compared at a time.
ROUND = 16
#: A pair is dropped if it reaches the threshold with less than this probability.
TOLERANCE = 1e-4
#: Documents to a block; groups are compared block by block.
BLOCK = 256


def least_matches(compared: int, threshold: float, tolerance: float) -> int:
    """Fewest equal hashes among ``compared`` with which a pair may still reach ``threshold``.

    With an even prior the similarity's posterior is Beta(m + 1, n - m + 1), and the probability that it
    reaches t is that of at most m successes in n + 1 draws with chance t.
    """
    total, n = 0.0, compared + 1
    for m in range(compared + 1):
        total += comb(n, m) * threshold**m * (1 - threshold) ** (n - m)
        if total >= tolerance:
            return m
    return compared


def bounds(threshold: float, tolerance: float) -> list[int]:
    """``least_matches`` after each round; made on the driver and sent to the tasks."""
    return [least_matches(h + ROUND, threshold, tolerance) for h in range(0, HASHES, ROUND)]


def survivors(signs: np.ndarray, left: np.ndarray, right: np.ndarray, least: list[int]):
    """The pairs that remain when hashes are compared ROUND by ROUND and pairs with fewer than ``least`` equal ones are dropped after each."""
    keep_left, keep_right = [], []
    for i in range(0, len(left), 100_000):
        a, b = left[i : i + 100_000], right[i : i + 100_000]
        equal = np.zeros(len(a), np.int32)
        for h, fewest in zip(range(0, HASHES, ROUND), least):
            equal += (signs[a, h : h + ROUND] == signs[b, h : h + ROUND]).sum(axis=1)
            alive = equal >= fewest
            a, b, equal = a[alive], b[alive], equal[alive]
            if not len(a):
                break
        keep_left.append(a)
        keep_right.append(b)
    return np.concatenate(keep_left), np.concatenate(keep_right)


_TRIANGLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _triangle(n: int):
    """All pairs of n rows; kept by each worker for the few sizes that blocks have."""
    if n not in _TRIANGLES:
        if len(_TRIANGLES) > 2 * BLOCK:
            _TRIANGLES.clear()
        _TRIANGLES[n] = np.triu_indices(n, 1)
    return _TRIANGLES[n]


def pairs_of(start: int, end: int, block: np.ndarray, lo: int, hi: int):
    """Row numbers of the pairs of a group: all of one block, or those across two."""
    if lo == hi:
        a, b = _triangle(end - start)
        return a + start, b + start
    here = block[start:end]
    a, b = np.flatnonzero(here == lo) + start, np.flatnonzero(here == hi) + start
    return np.repeat(a, len(b)), np.tile(b, len(a))


def in_runs(starts: np.ndarray, block: np.ndarray, lo: np.ndarray, hi: np.ndarray, most: int = 500_000):
    """The pairs of consecutive groups, about ``most`` at a time."""
    left, right, size = [], [], 0
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
        a, b = pairs_of(s, e, block, lo[s], hi[s])
        left.append(a)
        right.append(b)
        size += len(a)
        if size > most:
            yield np.concatenate(left), np.concatenate(right)
            left, right, size = [], [], 0
    if size:
        yield np.concatenate(left), np.concatenate(right)


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Exact test of pairs of sorted sets: is the Jaccard similarity ``threshold`` or more?

    Few pairs are intersected one by one. Many pairs of few sets are counted with a matrix product over the
    elements that occur in two sets or more, some thousand elements at a time.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    used = np.unique(np.concatenate([left, right])) if len(left) else np.empty(0, np.int64)
    if len(left) < 3 * len(used):
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left.tolist(), right.tolist())], np.int64)
    else:
        place = np.full(len(sets), -1)
        place[used] = np.arange(len(used))
        owner = np.repeat(np.arange(len(used)), sizes[used])
        elements, column, times = np.unique(np.concatenate([sets[i] for i in used.tolist()]), return_inverse=True, return_counts=True)
        shared = times[column] > 1
        owner, column = owner[shared], column[shared]
        number = np.cumsum(times > 1) - 1
        column = number[column]
        total = np.zeros((len(used), len(used)), np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            x, y = np.searchsorted(column, [first, first + 4096])
            has = np.zeros((len(used), 4096), np.float32)
            has[owner[x:y], column[x:y] - first] = 1
            total += has @ has.T
        common = total[place[left], place[right]].astype(np.int64)
    union = sizes[left] + sizes[right] - common
    return common >= threshold * union - 1e-9


def signed(docs: DataFrame) -> DataFrame:
    """Per document: ``rid``, ``doc_id``, ``n`` (distinct shingles), ``d1``, ``d2`` (digest of the set) and ``sign``."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, signs = [], [], [], []
            for text in batch.column(2).to_pylist():
                found = np.unique(shingles(word_hashes(text)))
                digest = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), "<i8")
                n.append(len(found))
                d1.append(int(digest[0]))
                d2.append(int(digest[1]))
                signs.append(signature(found).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(signs, pa.binary())],
                ["rid", "doc_id", "n", "d1", "d2", "sign"])

    rows = with_rows(docs).select(F.col("_row_id").alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.encode(text_of(), "UTF-8").alias("text"))
    return rows.mapInArrow(sign, "rid long, doc_id long, n long, d1 long, d2 long, sign binary")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (rid, ...) with ``items``, the sorted distinct shingles of the document as 64-bit integers."""
    columns = wanted.columns

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [np.unique(shingles(word_hashes(t))).tobytes() for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(items, pa.binary())], [*columns, "items"])

    texts = with_rows(docs).select(F.col("_row_id").alias("rid"), F.encode(text_of(), "UTF-8").alias("_text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema) + ", items binary"
    return texts.join(wanted, "rid").select(*columns, "_text").mapInArrow(hash_all, schema)


def in_blocks(members: DataFrame, key: str, count: str) -> DataFrame:
    """A row for each member and pair of blocks (lo, hi) of its group that it takes part in, dealt and sorted by them.

    A group of n members has n / BLOCK blocks by hash, so no task sees more than two blocks of it.
    """
    blocks = F.ceil(F.col(count) / F.lit(BLOCK)).cast("int")
    own = members.withColumn("block", F.pmod(F.xxhash64("rid"), blocks).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other")
    n = partitions(members.sparkSession)
    return dealt.repartition(n, key, "lo", "hi").sortWithinPartitions(key, "lo", "hi", "rid")


def candidate_groups(reps: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(rid, root): documents that survive the pruning with others of a band, in connected groups."""
    spread = reps.select("rid", "sign", F.posexplode(F.array(*[F.substring("sign", 4 * ROWS * j + 1, 4 * ROWS) for j in range(HASHES // ROWS)])).alias("j", "part"))
    banded = spread.select("rid", F.xxhash64("j", "part").alias("band"))
    counts = banded.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = banded.join(counts, "band").join(reps.select("rid", "sign"), "rid")
    least = bounds(threshold, tolerance)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in sorted_groups(batches, ["band", "lo", "hi"]):
            rids, block = table.column("rid").to_numpy(), table.column("block").to_numpy()
            lo, hi = table.column("lo").to_numpy(), table.column("hi").to_numpy()
            signs = np.frombuffer(b"".join(binaries(table, "sign")), "<u4").reshape(-1, HASHES)
            for left, right in in_runs(starts, block, lo, hi):
                a, b = survivors(signs, left, right, least)
                root = roots(len(rids), a, b)
                moved = np.flatnonzero(root != np.arange(len(rids)))
                yield pa.RecordBatch.from_arrays([pa.array(rids[root[moved]]), pa.array(rids[moved])], ["a", "b"])

    edges = in_blocks(members, "band", "members").mapInArrow(prune, "a long, b long").distinct()
    return components(edges).select(F.col("node").alias("rid"), "root")


def link_counts(docs: DataFrame, reps: DataFrame, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(rid, links) and the edges (a, b) that hold linked documents together, all verified on whole texts."""
    groups = materialise(candidate_groups(reps, threshold, tolerance), "groups")
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    wanted = groups.join(sizes, "root").join(reps.select("rid", "sign"), "rid").select("rid", "root", "members", "sign")
    dealt = in_blocks(shingle_sets(docs, wanted), "root", "members")
    least = bounds(threshold, tolerance)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in sorted_groups(batches, ["root", "lo", "hi"]):
            rids, block = table.column("rid").to_numpy(), table.column("block").to_numpy()
            lo, hi = table.column("lo").to_numpy(), table.column("hi").to_numpy()
            signs = np.frombuffer(b"".join(binaries(table, "sign")), "<u4").reshape(-1, HASHES)
            items = binaries(table, "items")
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                left, right = pairs_of(0, e - s, block[s:e], lo[s], hi[s])
                a, b = survivors(signs[s:e], left, right, least) if len(left) else (left, right)
                linked = similar([np.frombuffer(x, "<u8") for x in items[s:e]], a, b, threshold) if len(a) else np.zeros(0, bool)
                a, b = a[linked], b[linked]
                links = np.bincount(a, minlength=e - s) + np.bincount(b, minlength=e - s)
                root = roots(e - s, a, b)
                here = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rids[s + here]), pa.array(rids[s + root[here]]), pa.array(links[here], pa.int64())], ["rid", "root", "links"])

    found = materialise(dealt.mapInArrow(verify, "rid long, root long, links long"), "links")
    return found.groupBy("rid").agg(F.sum("links").alias("links")), found.where("rid <> root").select(F.col("root").alias("a"), F.col("rid").alias("b")).distinct()


def similar_groups(docs: DataFrame, threshold: float = 0.8, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: ``rid``, ``doc_id``, ``class_id``, ``text_id``, ``n_copies``, ``n_links`` and ``kept``.

    Documents with the same set of five-word shingles are one text: ``text_id`` is the smallest doc_id
    among them and ``n_copies`` their number. ``n_links`` is the number of other texts whose Jaccard
    similarity is ``threshold`` or more, ``class_id`` the smallest doc_id of all documents connected by
    links. The document with the smallest doc_id (NULL last), then the first row, of each class is ``kept``.

    Texts that share a band of their MinHash signatures are compared in blocks, round by round, and
    dropped when the posterior probability of reaching the threshold falls below ``tolerance``. What
    is left falls into groups; within these, pairs that survive the same pruning are verified on the
    whole sets of shingles. Pairs never leave a task: it returns link counts and a row per document for what
    hangs together. No task sees more than two blocks of a group, and no partner is left out.

    A text of less than five words is one shingle. NULL and empty texts are one text without links.
    Repeated rows and doc_ids are documents of their own. An empty table gives no rows. Other columns are
    ignored. ``docs`` must be a table read from files.
    """
    rows = materialise(signed(docs), "signed")
    classes = materialise(
        rows.groupBy("d1", "d2", "n").agg(
            F.min("rid").alias("rep"), F.min("doc_id").alias("text_id"), F.count(F.lit(1)).alias("n_copies")), "classes")
    reps = materialise(rows.where("n > 0").join(classes.select(F.col("rep").alias("rid")), "rid", "left_semi").select("rid", "sign"), "reps")
    counts, edges = link_counts(docs, reps, threshold, tolerance)
    linked = components(edges).select(F.col("node").alias("rep"), "root")
    texts = materialise(
        classes.join(counts.select(F.col("rid").alias("rep"), "links"), "rep", "left").join(linked, "rep", "left")
        .withColumns({"group": F.coalesce("root", "rep"), "n_links": F.coalesce("links", F.lit(0))}), "texts")
    members = materialise(
        rows.select("rid", "doc_id", "d1", "d2", "n").join(texts.select("d1", "d2", "n", "text_id", "n_copies", "n_links", "group"), ["d1", "d2", "n"])
        .drop("d1", "d2", "n"), "members")
    first = members.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "rid")).alias("first"))
    # Written, so that the join has two plain sides and a hot class can be split.
    first = materialise(first, "first")
    return members.join(first, "group").select(
        "rid", "doc_id", F.col("first.doc_id").alias("class_id"), "text_id", "n_copies", "n_links", (F.col("rid") == F.col("first.rid")).alias("kept"))


def without_similar(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, with all its columns."""
    gone = similar_groups(docs, **options).where("NOT kept").select(F.col("rid").alias("_rid"))
    whole = with_rows(docs).select(F.col("_row_id").alias("_rid"), F.struct(*[f"`{c}`" for c in docs.columns]).alias("_doc"))
    return whole.join(gone, "_rid", "left_anti").select("_doc.*")
