"""Quality rules: simple counts of a text and a hashed n-gram likelihood ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.llm.common import WORD, text_of
from marketpulse.session import materialise

#: Buckets of the hashed n-grams: the size of both multinomials, whatever the corpus.
BUCKETS = 8192
#: Bits of the map that tells which hashes the trusted ids have: 2**24, in at most 2**18 rows.
BITS = 24
#: A document is dropped if its ratio lies this many standard deviations below the trusted mean.
DEVIATIONS = 6.0
#: Pseudo-count of every bucket.
SMOOTHING = 1.0


def measured(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with the base counts and ``_hashes``, the hashes of its words in order.

    Word windows are compared by a 64-bit hash. Repeated windows are neighbours after sorting;
    the words that they cover are summed over their sorted places, three at most from each. Texts
    without a repeated window are not sorted.
    """
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(WORD)))
    words = docs.withColumns({
        "_words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    })
    hashed = words.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
    }).drop("_words")
    windows = hashed.withColumn("_windows", F.transform(
        F.slice("_hashes", F.lit(1), F.greatest(F.size("_hashes") - 2, F.lit(0))),
        lambda h, i: F.xxhash64(h, F.get("_hashes", i + 1), F.get("_hashes", i + 2))))
    ordered = windows.withColumn(
        "_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"),
                          F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))
    same = lambda x, i: (x["h"] == F.get("_sorted", i - 1)["h"]) | (x["h"] == F.get("_sorted", i + 1)["h"])
    places = ordered.withColumn(
        "_places", F.sort_array(F.transform(F.filter("_sorted", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["p"])))
    covered = F.aggregate(
        F.transform("_places", lambda p, i: F.least(F.coalesce(F.get("_places", i + 1) - p, F.lit(3)), F.lit(3))),
        F.lit(0), lambda s, x: s + x)
    out = places.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_windows", "_sorted", "_places")


def features(buckets: int) -> Column:
    """Buckets of the words and of the pairs of neighbouring words in ``_hashes``."""
    pairs = F.transform(
        F.slice("_hashes", F.lit(1), F.greatest(F.size("_hashes") - 1, F.lit(0))),
        lambda h, i: F.xxhash64(h, F.get("_hashes", i + 1)))
    return F.transform(F.concat("_hashes", pairs), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def chosen(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(doc_id, _text) of all rows of ``docs`` whose id is trusted, written out: both rules are learned from them.

    A bit map of the hashes of the ids, of the same size for any number of them, is sent to all tasks. Only texts
    whose id meets a bit are shuffled; they are joined to the ids themselves.
    """
    ids = trusted.select(F.col("doc_id").alias("_trusted")).where("_trusted IS NOT NULL").distinct()
    ids = materialise(ids, "trusted_ids")
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << BITS))
    bit = lambda c: F.expr(f"shiftleft(1L, cast({c} % 64 AS int))")
    bits = ids.select(spot(F.col("_trusted").cast("long")).alias("_at")).groupBy(F.expr("_at div 64").alias("_group")).agg(F.bit_or(bit("_at")).alias("_bits"))
    own = docs.select("doc_id", text_of().alias("_text"), spot(F.col("doc_id").cast("long")).alias("_spot"))
    near = own.join(F.broadcast(bits), F.expr("_spot div 64 = _group")).where(F.col("_bits").bitwiseAND(bit("_spot")) != 0)
    # The ids are distinct, so this join keeps rows as a semi join does; that one the optimizer moves below the bit map.
    return materialise(near.join(ids.hint("merge"), F.col("doc_id") == F.col("_trusted")).select("doc_id", "_text"), "trusted")


def bucket_counts(texts: DataFrame, text: Column, buckets: int, out: str) -> DataFrame:
    """(bucket, ``out``): words and word pairs of all ``texts`` by bucket."""
    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    hashed = texts.select(words.alias("_hashes")).select(F.explode(features(buckets)).alias("bucket"))
    return hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias(out))


def ratio_table(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: ``ratios``, the log ratio of target to corpus probability of each bucket.

    Both multinomials are smoothed by one count. The corpus counts all documents, the target all
    documents with ``trusted`` ids.
    """
    return ratios_of(docs, chosen(docs, trusted), buckets)


def ratios_of(docs: DataFrame, own: DataFrame, buckets: int) -> DataFrame:
    """``ratio_table`` of the documents and the rows that ``chosen`` found."""
    raw = bucket_counts(docs, text_of(), buckets, "raw")
    target = bucket_counts(own, F.col("_text"), buckets, "target")
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    # Both counts have at most ``buckets`` rows.
    filled = every.join(F.broadcast(raw), "bucket", "left").join(F.broadcast(target), "bucket", "left").select(
        "bucket", (F.coalesce("raw", F.lit(0)) + SMOOTHING).alias("raw"), (F.coalesce("target", F.lit(0)) + SMOOTHING).alias("target"))
    lists = filled.agg(
        F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"),
        F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("r"))
    ratio = lambda x: F.log(x["target"] / F.col("all_target")) - F.log(x["raw"] / F.col("all_raw"))
    return materialise(lists.select(F.transform("r", ratio).alias("ratios"), F.lit(0).alias("_one")), "ratios")


def scores(docs: DataFrame, ratios: DataFrame, buckets: int) -> DataFrame:
    """``docs`` (doc_id, _text, ...) with the base counts and ``score``. ``ratios`` is one row of ``buckets`` doubles."""
    counted = measured(docs, F.col("_text")).withColumns({"_features": features(buckets), "_one": F.lit(0)})
    met = counted.join(F.broadcast(ratios), "_one")
    total = F.aggregate("_features", F.lit(0.0), lambda s, b: s + F.get("ratios", b))
    scored = met.withColumn("score", F.when(F.size("_features") > 0, total / F.size("_features")).otherwise(F.lit(0.0)))
    return scored.drop("_features", "_hashes", "ratios", "_one", "_text")


def judge(docs: DataFrame, trusted: DataFrame, keep: list[str] | None = None, buckets: int = BUCKETS,
          deviations: float = DEVIATIONS) -> DataFrame:
    """One row per document: ``doc_id``, the base counts, ``base_failed``, ``score``, ``threshold``, ``kept``, ``_row``.

    ``_row`` holds the columns of ``docs`` (or those in ``keep``), so their names cannot clash. ``score`` is
    the log-likelihood ratio of a document's words and word pairs between the trusted and the corpus
    multinomial, divided by their number. The threshold lies ``deviations`` standard deviations below
    the mean of all trusted documents that pass the base rules: one number for every document, from
    the data alone. ``kept`` needs the base rules and the threshold.

    NULL and empty texts have no words and fail the base rules. Without trusted documents no document
    falls below the threshold. Repeated rows and NULL ids are judged row by row.
    """
    own = chosen(docs, trusted)
    ratios = ratios_of(docs, own, buckets)
    passed = F.when(~F.col("base_failed"), F.col("score"))
    low = scores(own, ratios, buckets).agg(
        F.coalesce(F.avg(passed) - deviations * F.stddev_pop(passed), F.lit(float("-inf"))).alias("threshold"))
    both = materialise(low.withColumn("_one", F.lit(0)).join(ratios, "_one"), "rules")
    rows = docs.select("doc_id", text_of().alias("_text"), F.struct(*(keep or ["*"])).alias("_row"))
    verdict = ~F.col("base_failed") & (F.col("score") >= F.col("threshold"))
    # Always true; a column that is not deterministic keeps the optimizer from moving a filter on
    # ``kept`` below the steps above, where it would repeat all of them inside one expression.
    once = F.monotonically_increasing_id() >= 0
    return scores(rows, both, buckets).withColumn("kept", once & verdict)


def good_documents(docs: DataFrame, trusted: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with all their columns."""
    return judge(docs, trusted, **options).where("kept").select("_row.*")
