"""Exact duplicates by deterministic block naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.llm.common import SPACE, partitions, text_of, with_rows
from marketpulse.session import materialise


def normalised(text: Column) -> Column:
    """The text without any white space."""
    return F.regexp_replace(text, SPACE + "+", "")


def blocks_of(text: Column, width: int) -> Column:
    """Consecutive blocks of ``width`` code points; none for an empty text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))


def _keys(block: Column, bits: int) -> Column:
    """Two 64-bit hashes of a block, cut to ``bits`` bits (tests cut them to force collisions)."""
    cut = 64 - bits
    return F.struct(F.shiftright(F.xxhash64(block), cut).alias("k1"), F.shiftright(F.xxhash64(F.lit(1), block), cut).alias("k2"))


def _named(distinct: DataFrame, columns: list[str]) -> DataFrame:
    """Give distinct rows different integer names: their places in the sorted order of one of n buckets."""
    n = partitions(distinct.sparkSession)
    bucketed = distinct.withColumn("_bucket", F.pmod(F.xxhash64(*columns), F.lit(n)))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*columns))
    return bucketed.select(*columns, (F.col("_bucket") + (place - 1).cast("long") * n).alias("name"))


def name_documents(docs: DataFrame, width: int = 16384, hash_bits: int = 64) -> DataFrame:
    """One collision-free identity per normalised text.

    Returns a row per document: ``rid``, ``doc_id``, ``chars`` (code points of the original text),
    ``text_sha256`` (of the normalised text), ``n_blocks`` and ``name``. Two documents have equal
    (n_blocks, name) if and only if their normalised texts are equal.

    The normalised text is cut into blocks. Distinct blocks are found by their whole content, copies
    being combined before the shuffle, so a group of copies is a row per task. A block's key is a
    pair of hashes; keys of more than one content get a number per content, so that (k1, k2, variant)
    stands for exactly one content. These are sorted into integer names, and neighbouring names are
    paired and named again until one is left: log2 rounds over narrow rows.

    NULL counts as empty; all empty texts share n_blocks 0. ``docs`` must be a table read from files.
    """
    text = normalised(text_of())
    cut = docs.select(F.explode(blocks_of(text, width)).alias("block")).withColumn("k", _keys(F.col("block"), hash_bits))
    contents = cut.select("k.k1", "k.k2", "block").distinct()
    keys = materialise(contents.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("contents")), "keys")
    shared = keys.where("contents > 1")
    collide = not shared.isEmpty()

    rows = with_rows(docs).select(
        F.col("_row_id").alias("rid"), "doc_id", F.char_length(text_of()).alias("chars"), text.alias("plain"))
    rows = rows.select("rid", "doc_id", "chars", F.sha2("plain", 256).alias("text_sha256"), blocks_of(F.col("plain"), width).alias("blocks"))
    if not collide:
        rows = materialise(rows.select(
            "rid", "doc_id", "chars", "text_sha256",
            F.transform("blocks", lambda b: F.struct(_keys(b, hash_bits)["k1"].alias("k1"), _keys(b, hash_bits)["k2"].alias("k2"))).alias("keys")), "rows")
        parts = rows.select("rid", F.size("keys").alias("n_blocks"), F.posexplode("keys").alias("pos", "k"))
        parts = parts.select("rid", "n_blocks", "pos", "k.k1", "k.k2", F.lit(0).alias("variant"))
    else:
        order = Window.partitionBy("k1", "k2").orderBy("block")
        variants = materialise(
            contents.join(shared.select("k1", "k2"), ["k1", "k2"]).withColumn("variant", F.row_number().over(order)), "variants")
        whole = rows.select("rid", "doc_id", "chars", "text_sha256", F.size("blocks").alias("n_blocks"), F.posexplode_outer("blocks").alias("pos", "block"))
        whole = whole.withColumn("k", _keys(F.col("block"), hash_bits)).select("*", "k.k1", "k.k2").drop("k")
        parts = materialise(whole.join(variants, ["k1", "k2", "block"], "left").select(
            "rid", "doc_id", "chars", "text_sha256", "n_blocks", "pos", "k1", "k2", F.coalesce("variant", F.lit(0)).alias("variant")), "parts")
        rows = parts.where("pos IS NULL OR pos = 0")
        parts = parts.where("pos IS NOT NULL").select("rid", "n_blocks", "pos", "k1", "k2", "variant")

    def join_names(parts: DataFrame, columns: list[str]) -> DataFrame:
        names = materialise(_named(parts.select(*columns).distinct(), columns), "names")
        return parts.join(names, columns).select("rid", "n_blocks", "pos", "name")

    level = materialise(join_names(parts, ["k1", "k2", "variant"]), "level")
    done, left = [level.where("n_blocks = 1")], level.where("n_blocks > 1")
    longest = left.agg(F.max("n_blocks")).first()[0] or 1
    reach = 1
    while reach < longest:
        reach *= 2
        odd = F.col("pos") % 2 == 1
        pairs = left.groupBy("rid", "n_blocks", F.expr("pos div 2").cast("int").alias("half")).agg(
            F.max(F.when(~odd, F.col("name"))).alias("first"),
            F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(-1)).alias("second"))
        pairs = materialise(pairs.withColumnRenamed("half", "pos"), "pairs")
        level = materialise(join_names(pairs, ["first", "second"]), "level")
        done.append(level.where(F.col("n_blocks") <= reach))
        left = level.where(F.col("n_blocks") > reach)
    named = done[0]
    for d in done[1:]:
        named = named.union(d)
    return rows.select("rid", "doc_id", "chars", "text_sha256").join(named.select("rid", "n_blocks", "name"), "rid", "left").select(
        "rid", "doc_id", "chars", "text_sha256", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), F.coalesce("name", F.lit(-1)).alias("name"))


def exact_groups(docs: DataFrame, width: int = 16384, hash_bits: int = 64) -> DataFrame:
    """One row per document with its group of equal texts and whether it stays.

    Returns ``rid``, ``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``. Of equal texts the
    row with the most code points in the original text stays, then the smallest doc_id (NULL last),
    then the first row: exactly one, also if doc_ids repeat. Empty tables give empty results; other
    columns are ignored.
    """
    named = materialise(name_documents(docs, width, hash_bits), "named")
    first = F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("n"), "doc_id", "rid"))
    groups = named.groupBy("n_blocks", "name").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first"))
    # Written, so that the join has two plain sides and a hot group can be split.
    groups = materialise(groups, "groups")
    return named.join(groups, ["n_blocks", "name"]).select(
        "rid", "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("first.rid")).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with all their columns."""
    gone = exact_groups(docs, **options).where("NOT kept").select(F.col("rid").alias("_rid"))
    whole = with_rows(docs).select(F.col("_row_id").alias("_rid"), F.struct(*[f"`{c}`" for c in docs.columns]).alias("_doc"))
    return whole.join(gone, "_rid", "left_anti").select("_doc.*")
