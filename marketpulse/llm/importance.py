"""Target-distribution importance resampling on hashed runs of words."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.llm.arrow_steps import steps
from marketpulse.llm.common import running_totals, text_of
from marketpulse.llm.scratch import Scratch
from marketpulse.session import materialise

#: Fixed value: a word, in text whose letters A-Z are lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Longest run of words that is a feature.
RUN = 3
#: Bytes of text that are cut into words at a time.
STEP = 4 << 20
#: Distinct pieces that are cut into words as one text.
JOINT = 200
#: Zero bytes up to which a checksum is moved on by one table.
NEAR = 64

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class Checksums:
    """CRC-32 of joined strings from the checksums of their parts.

    Appending n zero bytes to a string is a linear map of its checksum, so that
    crc(a + b) = zeros(len(b), crc(a)) ^ crc(b). The map of n bytes is kept as four tables of 256.
    """

    def __init__(self):
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        one = np.array([zlib.crc32(b"\0", int(b)) for b in bits], np.uint32) ^ np.uint32(zlib.crc32(b"\0"))
        near, now = [bits], bits
        for _ in range(NEAR):
            now = self._apply(one, now)
            near.append(now)
        self.near = np.stack([self._table(m) for m in near])
        # Maps of 64, 128, 256 ... zero bytes for long words.
        self.far, now = [], near[NEAR]
        for _ in range(26):
            self.far.append(self._table(now))
            now = self._apply(now, now)

    @staticmethod
    def _apply(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros_like(values)
        for bit in range(32):
            out ^= np.where(values >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
        return out

    @classmethod
    def _table(cls, matrix: np.ndarray) -> np.ndarray:
        byte = np.arange(256, dtype=np.uint32)
        return np.stack([cls._apply(matrix, byte << np.uint32(8 * k)) for k in range(4)])

    def zeros(self, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The checksums ``values`` moved on by ``sizes`` zero bytes each."""
        rest, many = sizes % NEAR, sizes // NEAR
        flat = self.near.reshape(-1)
        base = rest * 1024
        out = flat[base + (values & 255)]
        for k in range(1, 4):
            out ^= flat[base + 256 * k + (values >> np.uint32(8 * k) & np.uint32(255))]
        for k, table in enumerate(self.far):
            if not many.any():
                break
            at = np.flatnonzero(many & 1)
            v = out[at]
            out[at] = table[0][v & 255] ^ table[1][v >> np.uint32(8) & 255] ^ table[2][v >> np.uint32(16) & 255] ^ table[3][v >> np.uint32(24)]
            many = many >> 1
        return out


class WordCutter:
    """The words of texts by an untrained Split of the tokenizers library.

    White space is never part of a word, so a text is cut at it first and only the distinct pieces of a step go
    through Split, many joined by line feeds; the offset pairs say which piece a word belongs to.
    """

    def __init__(self):
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(WORD), "removed", invert=True).pre_tokenize_str

    def words(self, pieces: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """The words of all pieces one after another, and how many each piece has."""
        words: list[bytes] = []
        counts = np.zeros(len(pieces), np.int64)
        for start in range(0, len(pieces), JOINT):
            some = [p.decode() for p in pieces[start : start + JOINT]]
            found = self.split("\n".join(some))
            words += [w.encode() for w, _ in found]
            ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)
            firsts = np.fromiter((pair[0] for _, pair in found), np.int64, len(found))
            counts[start : start + len(some)] = np.bincount(np.searchsorted(ends, firsts, "right"), minlength=len(some))
        return words, counts


def parts(text: bytes, size: int) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes that end before white space."""
    start = 0
    while len(text) - start > size:
        cut = min((k for c in b" \n\t\r\x0b\x0c" if (k := text.find(bytes([c]), start + size)) >= 0), default=len(text))
        yield text[start:cut]
        start = cut
    yield text[start:]


class Features:
    """Bucket numbers of all runs of one to RUN words of texts."""

    def __init__(self, n_buckets: int):
        self.sums, self.cutter, self.n_buckets = Checksums(), WordCutter(), n_buckets
        self.kind = np.dtype("<u2" if n_buckets <= 1 << 16 else "<u4")

    def _checked(self, chunks: list[list[bytes]]) -> tuple[np.ndarray, ...]:
        """Per word its checksum, that of a blank and the word, and the size of both; and the words of each chunk."""
        flat = pa.array([p for c in chunks for p in c], pa.large_binary()).dictionary_encode()
        words, counts = self.cutter.words(flat.dictionary.to_pylist())
        plain = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        spaced = np.fromiter(map(zlib.crc32, words, repeat(zlib.crc32(b" "))), np.uint32, len(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        piece = flat.indices.to_numpy()
        many = counts[piece]
        bounds = np.concatenate([[0], np.cumsum(many)])
        firsts = np.cumsum(counts) - counts
        at = np.repeat(firsts[piece] - bounds[:-1], many) + np.arange(bounds[-1])
        chunk_ends = np.cumsum([len(c) for c in chunks], dtype=np.int64)
        return plain[at], spaced[at], sizes[at], np.diff(bounds[chunk_ends], prepend=0)

    def of(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """Per text its bucket numbers as little-endian integers, and its number of words."""
        chunks, owner, found, size = [], [], [], 0
        for k, text in enumerate(texts):
            for part in parts(text.translate(_LOWER), STEP):
                if chunks and size + len(part) > STEP:
                    found.append(self._checked(chunks))
                    chunks, size = [], 0
                chunks.append(part.split())
                owner.append(k)
                size += len(part)
        found.append(self._checked(chunks))
        plain, spaced, sizes, per_chunk = (np.concatenate(a) for a in zip(*found))
        n_words = np.bincount(owner, per_chunk, len(texts)).astype(np.int64)
        ends = np.cumsum(n_words)
        levels, now = [self._buckets(plain)], plain
        for k in range(1, RUN):
            now = self.sums.zeros(sizes[k:], now[:-1]) ^ spaced[k:] if len(now) > 1 else now[:0]
            levels.append(self._buckets(now))
        # A run that would reach into the next text is left out.
        coded = [b"".join(level[b - n : max(b - n, b - k)].tobytes() for k, level in enumerate(levels))
                 for b, n in zip(ends.tolist(), n_words.tolist())]
        return coded, n_words

    def _buckets(self, checksums: np.ndarray) -> np.ndarray:
        return (checksums % np.uint32(self.n_buckets)).astype(self.kind)


def coded(docs: DataFrame, key: str, n_buckets: int) -> DataFrame:
    """``doc_id``, ``n_words`` and ``buckets`` (the bucket numbers of all features as little-endian integers) of each text."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(n_buckets)
        for batch in batches:
            for step in steps(batch, 1, STEP):
                found, n_words = features.of(step.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [step.column(0), pa.array(n_words, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "n_words", "buckets"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.encode(text_of(), "UTF-8").alias("text"))
    return rows.mapInArrow(code, "doc_id long, n_words long, buckets binary")


def histogram(rows: DataFrame, n_buckets: int) -> np.ndarray:
    """How many features fall into each bucket: a row per bucket reaches the driver."""
    kind = np.dtype("<u2" if n_buckets <= 1 << 16 else "<u4")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for one in batch.column(0):
                total += np.bincount(np.frombuffer(one.as_buffer(), kind), minlength=n_buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], ["bucket", "n"])

    out = np.zeros(n_buckets, np.int64)
    for r in rows.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket 1000 times the log-ratio of its smoothed shares in the target and in the corpus, rounded down."""
    n = len(corpus)
    return np.floor(1000 * np.log((target + 1) * float(corpus.sum() + n) / ((corpus + 1) * float(target.sum() + n)))).astype(np.int64)


def weighted(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight`` (sum of the gains of all features) of each row of ``coded``."""
    kind = np.dtype("<u2" if len(table) <= 1 << 16 else "<u4")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(one.as_buffer(), kind) for one in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(f) for f in found], pa.int64()),
                 pa.array([int(table[f].sum()) for f in found], pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return rows.select("doc_id", "n_words", "buckets").mapInArrow(add, "doc_id long, n_words long, n_features long, weight long")


def draw(key: Column, seed: int) -> Column:
    """A Gumbel draw in thousandths that follows from the seed and the key alone."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, n_buckets: int = 10000, percent: int = 5, least_words: int = 20,
             seed: int = 42, key: str = "doc_id") -> DataFrame:
    """Every document with its importance for the target and, if drawn, its rank.

    Words are cut by an untrained Split of the tokenizers library over lower-cased text; features are all runs of
    one to three words, joined by a blank and hashed by CRC-32 into ``n_buckets``. A bucket's gain is the log-ratio of its share in the
    texts of ``target`` and in all ``docs``, in thousandths; ``weight`` sums the gains of a document's features and
    ``score`` adds a Gumbel draw, so that taking the ``percent`` highest scores of the documents with ``least_words``
    words samples them without replacement by weight. Returns ``doc_id``, ``n_words``, ``n_features``, ``weight``,
    ``score`` and ``rank`` (1, 2, 3... of the drawn; else NULL).

    Texts are read once: bucket numbers (2 bytes a feature) are written, counted and summed, then deleted; only narrow rows are
    sorted, by ranges. The driver holds two numbers per bucket.

    NULL and empty texts have no features and weight 0. A NULL key draws like an empty one and comes first among equal scores;
    repeated rows are scored and drawn row by row. An empty table gives no rows, an empty target smoothed
    shares. Other columns are ignored, whatever their names.
    """
    with Scratch(docs.sparkSession) as scratch:
        own = scratch.keep(coded(docs, key, n_buckets), "features")
        table = gains(histogram(own, n_buckets), histogram(coded(target.withColumn("_none", F.lit(None)), "_none", n_buckets), n_buckets))
        scored = materialise(weighted(own, table).withColumn("score", F.col("weight") + draw(F.col("doc_id"), seed)), "weights")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    ranked = running_totals(able.select(*names, (-F.col("score")).alias("fall")), "n_words", ["fall", "doc_id", "n_words", "n_features", "weight"])
    place = F.col("rank") + 1
    return ranked.select(*names, F.when(place <= drawn, place).alias("rank")).union(
        scored.where(F.col("n_words") < least_words).select(*names, F.lit(None).cast("long").alias("rank")))
