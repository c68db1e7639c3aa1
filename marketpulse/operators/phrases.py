"""Mentions of the names of a table, however many, found by word runs instead of a pattern of all names."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.functions.text import WORD
from marketpulse.session import sized

# Functions that run in Python workers are sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bits of the map that tells which hashes occur: 2**23, one MB.
BITS = 23
#: Fixed value: bits of one row that bitmap_construct_agg makes.
PAGE = 32768


def name_table(names: DataFrame, name: str = "name") -> DataFrame:
    """(name, n_words): distinct names in lower case with at least one word."""
    low = names.select(F.lower(F.trim(F.col(name))).alias("name")).where("name IS NOT NULL").distinct()
    return low.withColumn("n_words", F.regexp_count("name", F.lit(f"{WORD}+"))).where("n_words > 0")


def name_starts(names: DataFrame) -> DataFrame:
    """(name): the first one, two, ... words of each name, with one letter for both small sigmas.

    Small sigma alone has another form at the end of a word, which a name cut short may end with.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(r"\w+")
        for batch in batches:
            starts = {name[: m.end()].replace("\u03c2", "\u03c3") for name in batch.column(0).to_pylist() for m in word.finditer(name)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(starts), pa.string())], ["name"])

    return names.select("name").mapInArrow(cut, "name string").distinct()


def hash_map(names: DataFrame) -> bytes:
    """One bit per hash value that a name has; its size does not depend on the number of names."""
    pages = names.select(F.pmod(F.xxhash64("name"), F.lit(1 << BITS)).alias("p")).groupBy(F.expr(f"p div {PAGE}").alias("page")).agg(
        F.bitmap_construct_agg(F.col("p") % PAGE).alias("bits")).collect()  # 2**23 / 32768 rows at most
    whole = bytearray((1 << BITS) // 8)
    for r in pages:
        start = r["page"] * (PAGE // 8)
        whole[start : start + len(r["bits"])] = r["bits"]
    return bytes(whole)


def word_runs(posts: DataFrame, most: int, bits: bytes, starts_bits: bytes, key: str, col: str) -> DataFrame:
    """(key, start, end, name): runs of one to ``most`` words whose hash a name has, with what stands between the words.

    A run grows while its hash is that of the start of a name (``starts_bits``). A pass over the words of each post where it is read; the hash is Spark's ``xxhash64``.
    """
    kind = posts.schema[key].dataType.simpleString()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, last = re.compile(r"\w+"), (len(bits) << 3) - 1
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                spans = [m.span() for m in word.finditer(text or "")]
                for i, (start, _) in enumerate(spans):
                    for _, end in spans[i : i + most]:
                        name = text[start:end].lower()
                        at = xxhash.xxh64_intdigest(name.replace("\u03c2", "\u03c3").encode(), seed=42) & last
                        if not starts_bits[at >> 3] >> (at & 7) & 1:
                            break
                        at = xxhash.xxh64_intdigest(name.encode(), seed=42) & last
                        if bits[at >> 3] >> (at & 7) & 1:
                            rows.append(row)
                            found.append((start, end, name))
            starts, ends, names = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(names, pa.string())],
                ["_key", "start", "end", "name"])

    return posts.select(key, col).mapInArrow(probe, f"_key {kind}, start int, end int, name string")


def longest_first(found: Column) -> Column:
    """Of overlapping runs the one that begins first stays, of those that begin together the longest."""
    order = F.transform(found, lambda r: F.struct(r["start"].alias("start"), (-r["end"]).alias("last"), r["name"].alias("name")))
    kind = "array<struct<start:int,end:int,name:string>>"
    begin = F.struct(F.lit(0).alias("reach"), F.array().cast(kind).alias("kept"))

    def step(state, r):
        free = r["start"] >= state["reach"]
        one = F.struct(r["start"].alias("start"), (-r["last"]).alias("end"), r["name"].alias("name"))
        return F.struct(F.when(free, -r["last"]).otherwise(state["reach"]).alias("reach"),
                        F.when(free, F.array_append(state["kept"], one)).otherwise(state["kept"]).alias("kept"))
    return F.aggregate(F.array_sort(order), begin, step, lambda state: state["kept"])


def phrase_mentions(posts: DataFrame, names: DataFrame, most: int | None = None, key: str = "post_id", col: str = "text") -> DataFrame:
    """(key, name, start, end) of each name of ``names`` (name) that a post holds as whole words, in any case.

    Runs of up to ``most`` words (default: of the longest name), grown while they begin a name, are hashed and looked up in a bit map of the names' hashes; only runs
    that hit leave the post as narrow rows and are joined to the names by their whole text, so the cost does not grow with the
    number of names, and no text is shuffled. Overlaps are resolved from the left, longer names first.

    NULL and empty texts and NULL or empty names have no mention; equal names count once; names without a letter, digit or underscore
    at both ends are never met. Rows of posts with equal keys are one post only if they are equal: keys should be unique.
    """
    table = sized(name_table(names))
    longest = most or table.agg(F.max("n_words")).first()[0] or 1
    met = word_runs(posts, longest, hash_map(table), hash_map(name_starts(table)), key, col).join(table.select("name"), "name")
    kept = met.groupBy("_key").agg(longest_first(F.collect_set(F.struct("start", "end", "name"))).alias("_kept"))
    return kept.select(F.col("_key").alias(key), F.inline("_kept")).select(key, "name", "start", "end")
