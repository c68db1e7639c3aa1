"""Language identification by string kernels, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.llm.arrow_steps import steps
from marketpulse.llm.common import text_of
from marketpulse.llm.scratch import Scratch

#: Learned from: about so many documents of each language, chosen by hash, and so many of them as landmarks.
SAMPLE, LANDMARKS = 1500, 40
#: Languages that are learned, the most frequent ones; letters that are told apart, likewise.
LANGUAGES, LETTERS = 100, 126
#: Longest n-gram of the spectrum.
LONGEST = 3
#: Ridge as a share of the documents, and the least eigenvalue of the landmarks' kernel that is inverted.
RIDGE, LEAST_EIGENVALUE = 1e-3, 1e-6
#: Bytes of text, and documents, that are turned into one matrix.
STEP, ROWS = 1 << 20, 64

UNKNOWN = "und"


def parts(text: str) -> Iterator[str]:
    """A text in parts of about STEP characters, cut at blanks."""
    start = 0
    while len(text) - start > STEP and (cut := text.find(" ", start + STEP)) >= 0:
        yield text[start:cut]
        start = cut
    yield text[start:]


class Spectrum:
    """Presence of letter n-grams of 1 to LONGEST in texts, in any case; a blank stands for anything that is no letter.

    N-grams lie in one word, which begins and ends with a blank. ``letters`` are the code points told apart, all others
    are one letter. ``grams`` are the numbers of the n-grams that make the columns; without it every n-gram is one.
    """

    def __init__(self, letters: list[int], grams: np.ndarray | None = None):
        self.base = len(letters) + 2
        self.table = np.zeros(0x110000, np.int32)
        place = {c: k + 1 for k, c in enumerate(letters)}
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and (sign := chr(c)).isalpha():
                self.table[c] = place.get(ord(sign.lower()[0]), self.base - 1)
        self.size = self.base**LONGEST
        self.column = None
        if grams is not None:
            self.column = np.full(LONGEST * self.size, -1, np.int32)
            self.column[grams] = np.arange(len(grams), dtype=np.int32)

    def places(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, n-gram number) of each n-gram, with repeats, in parts of about STEP characters."""
        many = [(k, part) for k, t in enumerate(texts) for part in parts(t)]
        start = 0
        while start < len(many):
            end, size = start, 0
            while end < len(many) and (end == start or size + len(many[end][1]) <= STEP):
                size += len(many[end][1])
                end += 1
            yield from self._places(many[start:end])
            start = end

    def _places(self, part: list[tuple[int, str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        joined = "\n" + "\n".join(t for _, t in part) + "\n"
        signs = self.table[np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")]
        sizes = np.fromiter((len(t) + 1 for _, t in part), np.int64, len(part))
        rows = np.repeat(np.fromiter((k for k, _ in part), np.int64, len(part)), sizes)
        code, full = signs, signs > 0
        yield rows[full[:-1]], code[:-1][full[:-1]].astype(np.int64)
        for n in range(2, LONGEST + 1):
            code = code[:-1] * self.base + signs[n - 1 :]
            # No blank inside: all signs between the first and the last are letters, and one of the ends is.
            inner = np.ones(len(code), bool)
            for k in range(1, n - 1):
                inner &= signs[k : k + len(code)] > 0
            if n == 2:
                inner &= code > 0
            at = np.flatnonzero(inner)
            yield rows[at], code[at].astype(np.int64) + (n - 1) * self.size

    def presence(self, texts: list[str]) -> np.ndarray:
        """A row per text with a one for each of its n-grams that is a column."""
        width = int(self.column.max(initial=-1)) + 1
        out = np.zeros((len(texts), width), np.float32)
        flat = out.reshape(-1)
        for rows, grams in self.places(texts):
            column = self.column[grams]
            met = column >= 0
            flat[rows[met] * width + column[met]] = 1
        return out


def unit(presence: np.ndarray) -> np.ndarray:
    """Rows of length one, so that products are the normalised kernel; rows without n-grams stay zero."""
    return presence / np.sqrt(np.maximum(presence.sum(1, keepdims=True), 1)).astype(np.float32)


@dataclass
class Model:
    """What executors need to score: the n-grams of the landmarks, the landmarks, and weights per landmark and language."""

    languages: list[str]
    letters: list[int]
    grams: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray

    def outputs(self, spectrum: Spectrum, texts: list[str]) -> np.ndarray:
        """Per text and language the one-versus-rest regression: kernels with the landmarks times the weights."""
        return (unit(spectrum.presence(texts)) @ self.landmarks.T).astype(np.float64) @ self.weights


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text is 1 mod 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def letter_counts(sample: DataFrame) -> list[int]:
    """The LETTERS most frequent letters, in lower case."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, 0, STEP):
                signs = np.frombuffer("".join(t.decode() for t in step.column(0).to_pylist()).encode("utf-32-le", "replace"), "<u4")
                met, n = np.unique(signs, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(n, pa.int64())], ["sign", "n"])

    rows = sample.select("text").mapInArrow(count, "sign long, n long").groupBy("sign").agg(F.sum("n").alias("n"))
    total: dict[int, int] = {}
    for r in rows.collect():  # one row for each distinct code point
        if (sign := chr(r["sign"])).isalpha():
            low = ord(sign.lower()[0])
            total[low] = total.get(low, 0) + r["n"]
    return sorted(sorted(total, key=lambda c: (-total[c], c))[:LETTERS])


def landmark_grams(sample: DataFrame, letters: list[int]) -> list[tuple[str, np.ndarray]]:
    """The distinct n-grams of each landmark, whose number has a bound, however long the text."""
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum = Spectrum(letters)
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column(1)[row].as_py().decode()
                met = np.zeros(LONGEST * spectrum.size, bool)
                for _, numbers in spectrum.places([text]):
                    met[numbers] = True
                found = np.flatnonzero(met).astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([found], pa.binary())], ["lang", "grams"])

    rows = sample.select("lang", "text").mapInArrow(grams, "lang string, grams binary").collect()
    return sorted(((r["lang"], np.frombuffer(bytes(r["grams"]), "<i4")) for r in rows), key=lambda x: (x[0], x[1].tobytes()))


def sums(sample: DataFrame, letters: list[int], grams: np.ndarray, landmarks: np.ndarray, whiten: np.ndarray,
         languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of the Nyström features of all sampled texts: sums of outer products, and of products with the languages' targets.

    Each task adds up its texts; the rows of its sums are added by number, so the driver gets one matrix.
    """
    n, width = whiten.shape[1], whiten.shape[1] + len(languages)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum, total = Spectrum(letters, grams), np.zeros((n, width))
        place = {k: i for i, k in enumerate(languages)}
        for batch in batches:
            for step in steps(batch, 1, STEP):
                for part in range(0, step.num_rows, ROWS):
                    some = step.slice(part, ROWS)
                    kernel = unit(spectrum.presence([t.decode() for t in some.column(1).to_pylist()])) @ landmarks.T
                    features = kernel.astype(np.float64) @ whiten
                    truth = -np.ones((len(features), len(languages)))
                    truth[np.arange(len(features)), [place[k] for k in some.column(0).to_pylist()]] = 1
                    total += features.T @ np.column_stack([features, truth])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int64()), pa.array(list(total), pa.list_(pa.float64()))], ["row", "sums"])

    parts = sample.select("lang", "text").mapInArrow(add, "row long, sums array<double>")
    added = parts.groupBy("row").agg(*[F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(width)]).orderBy("row").collect()
    total = np.array([r[1:] for r in added], float)
    return total[:, :n], total[:, n:]


def fit(docs: DataFrame, key: str) -> Model | None:
    """Learn from the sampled texts of the documents that are not held out; None if there are none with a language.

    The sample takes each language's documents by a hash below a threshold that its count sets, so its size is bounded (up to
    chance) without sorting. The landmarks are those of the lowest hashes.
    """
    usable = docs.select(
        F.col(key).alias("_id"), F.col("lang").cast("string").alias("lang"), text_of().alias("text")
    ).where(~held_out(F.col("_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashed = F.pmod(F.xxhash64(F.lit("language"), "_id", F.crc32("text")), F.lit(1 << 30))
    with Scratch(docs.sparkSession) as scratch:
        counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
        if not counts:
            return None
        shares = docs.sparkSession.createDataFrame(
            [(r["lang"], int((1 << 30) * min(1.0, SAMPLE / r["count"])), int((1 << 30) * min(1.0, LANDMARKS / r["count"]))) for r in counts],
            "lang string, below long, landmark long")
        drawn = usable.join(F.broadcast(shares), "lang").where(hashed < F.col("below"))  # LANGUAGES rows at most
        sample = scratch.keep(drawn.select("lang", F.encode("text", "UTF-8").alias("text"), (hashed < F.col("landmark")).alias("landmark")), "sample")
        letters = letter_counts(sample)
        marks = landmark_grams(sample.where("landmark"), letters)
        if not marks:
            marks = landmark_grams(sample.limit(LANDMARKS), letters)
        grams = np.unique(np.concatenate([g for _, g in marks]))
        rows = np.zeros((len(marks), len(grams)), np.float32)
        for k, (_, own) in enumerate(marks):
            rows[k, np.searchsorted(grams, own)] = 1
        landmarks = unit(rows)
        languages = sorted(r["lang"] for r in counts)
        values, vectors = np.linalg.eigh(landmarks.astype(np.float64) @ landmarks.T)
        good = values > LEAST_EIGENVALUE * values.max()
        whiten = vectors[:, good] / np.sqrt(values[good])
        products, targets = sums(sample, letters, grams, landmarks, whiten, languages)
        ridge = RIDGE * max(np.trace(products) / len(products), 1e-12)
        return Model(languages, letters, grams, landmarks, whiten @ np.linalg.solve(products + ridge * np.eye(len(products)), targets))


def predict(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` (0 to 1) of every whole text.

    Texts are compared by the letter n-grams that they have, repeats not counted (blended-spectrum presence kernel, normalised).
    The Nyström method replaces the kernel of all texts by products with landmark texts; one ridge regression per
    language learns from them. Scoring multiplies the presence matrix of a batch with the landmarks and with the weights. ``score`` is the
    winner's regression value, -1 to 1, moved to 0 to 1.

    Learned from are the documents with a language whose crc32(id as text) is not 1 mod 3, about SAMPLE of each of the LANGUAGES most
    frequent languages. The driver holds the landmarks' n-grams and sums of a size that the landmarks
    set. Texts are scored where they are read, without a shuffle.

    NULL texts and texts without a letter are ``und`` with score 0; so is every text if nothing can be learned from. A NULL
    id is not held out. Equal outputs go to the language first by code point. Repeated rows are scored row by row. An empty table gives
    no rows. Other columns are ignored, whatever their names.
    """
    model = fit(docs, key)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum = Spectrum(model.letters, model.grams) if model else None
        names = np.array(model.languages if model else [UNKNOWN], object)
        for batch in batches:
            for step in steps(batch, 2, STEP):
                for start in range(0, step.num_rows, ROWS):
                    some = step.slice(start, ROWS)
                    texts = [t.decode() for t in some.column(2).to_pylist()]
                    out = model.outputs(spectrum, texts) if model else np.full((len(texts), 1), -1.0)
                    best = out.argmax(1)
                    known = np.array(some.column(3).to_pylist(), bool) & (model is not None)
                    high = np.clip((out[np.arange(len(texts)), best] + 1) / 2, 0, 1)
                    yield pa.RecordBatch.from_arrays(
                        [some.column(0), some.column(1), pa.array(np.where(known, names[best], UNKNOWN), pa.string()),
                         pa.array(np.where(known, high, 0.0), pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    text = text_of()
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(F.col(key)).alias("held_out"),
                       F.encode(text, "UTF-8").alias("text"), text.rlike(r"\p{L}").alias("lettered"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")
