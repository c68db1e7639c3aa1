"""Contiguous shards of equal bytes from global prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.llm.common import partitions, running_totals, text_of


def measures() -> tuple[Column, Column]:
    """Size of a row (UTF-8 bytes of its text + 1) and checksum of its text."""
    text = text_of()
    return F.octet_length(text).cast("long") + 1, F.crc32(text)


def assign_shards(docs: DataFrame, n_shards: int = 8, order: Sequence[str] = ("doc_id",), together: bool = False) -> DataFrame:
    """Shards 0 to n-1, each a contiguous run of the rows in ``order``, with byte sums as equal as whole rows allow.

    ``together`` orders by checksum and size first, so that equal texts lie side by side: a group of them is in one shard unless one of
    the n-1 cuts falls into it. A group may hold a third of all bytes and is cut then; sizes come first.

    Returns a row per document: the ``order`` columns, ``size`` (UTF-8 bytes + 1), ``text_crc32``,
    ``shard``, ``slot`` (place in the shard, gapless from 0) and ``start_byte`` (bytes before it).

    The text is read where it lies; only its size and checksum are shuffled. A row goes to the shard
    in which its middle byte falls: shard k ends within half a row of byte (k + 1) * total / n.

    NULL and empty texts have size 1 and checksum 0. NULL order values come first. Rows with equal
    order values follow by checksum and size; wholly equal rows are interchangeable. An empty table
    gives an empty result. Other columns are ignored, whatever their names.
    """
    size, checksum = measures()
    rows = docs.select(*order, size.alias("size"), checksum.alias("text_crc32"))
    content = ["text_crc32", "size"]
    placed = running_totals(rows, "size", [*content, *order] if together else [*order, *content])
    total = rows_total(placed)
    at = placed.join(F.broadcast(total), placed["size"] > 0).withColumn(
        "shard", F.expr(f"cast(least(((2 * before + size) * {n_shards}) div (2 * total), {n_shards - 1}) as int)"))
    # One row per shard.
    first = at.groupBy("shard").agg(F.min("rank").alias("first_rank"))
    return at.join(F.broadcast(first), "shard").select(
        *order, "size", "text_crc32", "shard", (F.col("rank") - F.col("first_rank")).alias("slot"),
        F.col("before").alias("start_byte"))


def rows_total(placed: DataFrame) -> DataFrame:
    """One row: the sum of all sizes."""
    return placed.agg(F.max(F.col("before") + F.col("size")).alias("total"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, key: str = "doc_id", together: bool = False) -> str:
    """Write the documents with all their columns to ``path/shard=k`` and return the name of the shard column.

    Shards are ranges of the key (with ``together`` of checksum, size and key), so the first one of each shard (n rows) routes every
    document without joining texts to the assignment. Rows equal in it stay in one shard, the last that begins with them. A shard
    is written by several tasks. NULL keys come first. If the documents have a column ``shard``, in any case, theirs is kept and the
    new one has underscores added. An empty table leaves an empty folder without shards.
    """
    size, checksum = measures()
    content = [checksum.alias("text_crc32"), size.alias("size")] if together else []
    own = {c.lower() for c in docs.columns}
    column = "shard"
    while column in own:
        column = f"_{column}"
    place = F.struct(*content, F.col(key).alias("key"))
    firsts = assign_shards(docs, n_shards, (key,), together).withColumn(
        "_place", F.struct(*(["text_crc32", "size"] if together else []), F.col(key).alias("key")))
    first = firsts.groupBy("shard").agg(F.min("_place").alias("_first")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("_first"), F.col("shard")))).alias("_firsts"))
    # The last shard that begins at or before the row; shards without rows do not occur.
    routed = docs.withColumn("_place", place).join(F.broadcast(first)).withColumn(
        column, F.element_at(F.filter("_firsts", lambda x: x["_first"] <= F.col("_place")), -1)["shard"])
    tasks = partitions(docs.sparkSession)
    parts = -(-tasks // n_shards)
    dealt = routed.repartition(tasks, F.col(column), F.pmod(F.xxhash64("_place"), F.lit(parts)))
    dealt.drop("_firsts", "_place").write.partitionBy(column).parquet(path)
    return column
