"""Toxicity by compression distance to two zstandard dictionaries."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.llm.common import text_of

#: Words to a window.
WINDOW = 8
#: Labelled documents of each class that the classifier is fitted on, chosen by hash, and the
#: longest of them in bytes: what the driver holds is bounded by their product.
SAMPLE = 2000
SAMPLE_BYTES = 16384
#: Size of the dictionary of ordinary text.
ORDINARY_BYTES = 112640
#: Least likelihood ratio statistic of a string that counts as toxic, and its least share of the highest one.
CONTRAST, CONTRAST_SHARE = 12.0, 0.06
#: The share of toxic texts that have such a string is more than so many times that of ordinary ones.
TIMES = 8.0
#: A window counts as a hit if the toxic dictionary saves so many bytes.
HIT = 3


def windows(text: bytes) -> list[bytes]:
    """The whole text in lower case as windows of WINDOW words; one empty window for an empty text."""
    words = text.lower().split()
    return [b" ".join(words[i : i + WINDOW]) for i in range(0, len(words), WINDOW)] or [b""]


@lru_cache(200_000)
def strings(word: bytes) -> tuple[bytes, ...]:
    """The substrings of 4 to 9 bytes of a word with a blank before it."""
    word = b" " + word
    return tuple({word[i : i + n] for n in range(4, 10) for i in range(len(word) - n + 1)})


def likelihood_ratio(a: int, n: int, b: int, m: int) -> float:
    """Twice the log-likelihood by which a of n and b of m are likelier with shares of their own than with a common one."""
    def fit(k: int, of: int, share: float) -> float:
        return (k * math.log(share) if k else 0.0) + ((of - k) * math.log(1 - share) if of > k else 0.0)
    common = (a + b) / (n + m)
    return 2 * (fit(a, n, a / n) + fit(b, m, b / m) - fit(a, n, common) - fit(b, m, common))


def toxic_words(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Words of toxic texts with a string that is far more common in them than in ordinary ones, rarest first.

    zstandard's trainer looks for frequent strings, and those are the same in both kinds of text.
    So its toxic samples are the words that hold strings whose share of toxic documents stands out: by the
    likelihood ratio of both counts, and as TIMES the share of ordinary ones. A few ordinary texts that have a
    string, quoting or mislabelled, do not take it away. Equal texts count once.
    """
    toxic, ordinary = sorted({t.lower() for t in toxic}), sorted({t.lower() for t in ordinary})
    here, there = Counter(), Counter()
    for t in toxic:
        here.update({g for w in set(t.split()) for g in strings(w)})
    known = {g for g, n in here.items() if n >= 3}
    for t in ordinary:
        there.update({g for w in set(t.split()) for g in strings(w)} & known)
    contrast = {g: likelihood_ratio(here[g], len(toxic), there[g], len(ordinary))
                for g in known if ordinary and here[g] * len(ordinary) > TIMES * there[g] * len(toxic)}
    least = max(CONTRAST, CONTRAST_SHARE * max(contrast.values(), default=0.0))
    strong = {g for g, x in contrast.items() if x >= least}
    words = Counter(w for t in toxic for w in t.split() if not strong.isdisjoint(strings(w)))
    return [w for w, _ in sorted(words.items(), key=lambda x: (x[1], x[0]))]


def trained(samples: list[bytes], size: int) -> bytes:
    """zstandard's dictionary of the samples, or the samples themselves if they are too few for it."""
    joined = b" ".join(samples)
    if len(joined) < 8 * size:
        return joined[-size:]
    return zs.train_dictionary(size, samples, level=3).as_bytes()


class Model:
    """Two dictionaries and a logistic function of what the toxic one saves."""

    def __init__(self, toxic: bytes, ordinary: bytes, weights: list[float]):
        self.toxic, self.ordinary, self.weights = toxic, ordinary, weights

    def lengths(self):
        """Compressors of a window with the ordinary dictionary, and with the toxic one after it."""
        def one(content: bytes):
            rules = zs.ZstdCompressionParameters(
                strategy=zs.STRATEGY_GREEDY, min_match=5, hash_log=18, chain_log=18, search_log=7, window_log=18,
                target_length=64, write_content_size=False, write_checksum=False, write_dict_id=False)
            if not content:
                return zs.ZstdCompressor(compression_params=rules).compress
            return zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=rules).compress
        return one(self.ordinary), one(self.ordinary + b" " + self.toxic + b" ")

    def measures(self, texts: list[bytes]) -> np.ndarray:
        """Per text: highest saving of a window, the two highest together, hits, log of the windows."""
        plain, other = self.lengths()
        out = np.empty((len(texts), 4))
        for k, text in enumerate(texts):
            saved = np.array([len(plain(w)) - len(other(w)) for w in windows(text)])
            top = np.sort(saved)[-2:]
            out[k] = top[-1], top.sum(), min((saved >= HIT).sum(), 50), math.log1p(len(saved))
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x = self.measures(texts)
        w = np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Weights of a logistic regression (Newton steps, a small ridge)."""
    spread = np.where(x.std(0) > 0, x.std(0), 1.0)
    z = np.column_stack([np.ones(len(x)), x / spread])
    w = np.zeros(z.shape[1])
    ridge = np.diag([1e-6, *[0.1] * x.shape[1]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return [float(w[0]), *(w[1:] / spread).tolist()]


def dictionaries(rows: list[tuple[bytes, int]], weights: list[float]) -> Model:
    toxic, ordinary = ([t for t, y in rows if y == k] for k in (1, 0))
    words = toxic_words(toxic, ordinary) if toxic and ordinary else []
    plain = [w for t in ordinary for w in windows(t)]
    return Model(trained([b" " + w for w in words], 1 << 14), trained(plain, ORDINARY_BYTES), weights)


def fit(rows: list[tuple[bytes, int]]) -> Model:
    """Dictionaries from all labelled texts, calibrated on measures by dictionaries that lack the measured text.

    Each half of the texts is measured with the dictionaries of the other half. Without toxic or
    without ordinary texts, every text gets the share of toxic ones.
    """
    share = (sum(y for _, y in rows) + 0.5) / (len(rows) + 1)
    prior = [math.log(share / (1 - share)), 0.0, 0.0, 0.0, 0.0]
    halves = rows[::2], rows[1::2]
    if any({y for _, y in half} != {0, 1} for half in halves):
        return Model(b"", b"", prior)
    x = [dictionaries(a, prior).measures([t for t, _ in b]) for a, b in (halves, halves[::-1])]
    y = np.array([k for half in halves[::-1] for _, k in half], float)
    return dictionaries(rows, logistic(np.vstack(x), y))


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are not learned from: crc32 of the id as text is 2 mod 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> list[tuple[bytes, int]]:
    """At most ``most`` labelled texts of each class that are not held out, in the order of a hash.

    A sample of ids is drawn from the labels first (its size is bounded, so it is broadcast), four times as
    many as are wanted, as long texts are left out.
    """
    usable = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id")))
    order = (F.xxhash64("doc_id"), "doc_id")
    picked = [usable.where(F.col("toxic") == k).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(*order).limit(4 * most) for k in (0, 1)]
    ids = picked[0].union(picked[1]).select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic"))
    texts = docs.select(F.col("doc_id").alias("_doc"), text_of().alias("_text")).where(F.octet_length("_text") <= SAMPLE_BYTES)
    met = texts.join(F.broadcast(ids), F.col("_doc") == F.col("_id"))
    halves = [met.where(F.col("_toxic") == k).orderBy(F.xxhash64("_id"), "_id", "_text").limit(most) for k in (0, 1)]
    rows = halves[0].union(halves[1]).select("_id", F.encode("_text", "UTF-8").alias("t"), "_toxic").collect()
    return [(bytes(r["t"]), int(r["_toxic"])) for r in sorted(rows, key=lambda r: (hash((r["_id"], 7)), bytes(r["t"])))]


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1, higher: toxic likelier) and ``predicted`` of every whole text.

    Each window of a text is compressed with a dictionary of ordinary text and with the toxic
    dictionary added; the bytes that this saves are turned into a score by weights that are
    calibrated across two halves of the labelled texts. Only the sample reaches the driver; texts are scored where
    they are read, without a shuffle. Labels serve for fitting alone.

    NULL and empty texts are one empty window. Labels that are NULL, neither 0 nor 1, held out or of
    unknown documents are not used; of contradicting labels the toxic one counts. Without labels
    every text has the same score. Repeated rows and NULL ids are scored row by row (NULL is not held
    out). An empty table gives no rows. Other columns are ignored.
    """
    model = fit(labelled_sample(docs, labels))
    toxic, ordinary, weights = model.toxic, model.ordinary, model.weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(toxic, ordinary, weights)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(own.scores(texts), pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.encode(text_of(), "UTF-8").alias("text"))
    scored = rows.mapInArrow(score, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
