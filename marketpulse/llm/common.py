"""Shapes that several operators share: whole texts, prefix sums over blocks, components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketpulse.session import materialise, sized

#: White space and words of all contracts.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Files whose numbers are broadcast (some 100 MB).
FILES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    """The text; NULL counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def with_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row_id``, a number for each row: that of its file, in the order of paths, and its place in it.

    Numbers follow from the files alone: another number of executors, another split of the files or a second
    scan gives the same ones. ``docs`` must be read from Parquet files. The table of files is
    broadcast up to FILES rows; beyond it the planner chooses.
    """
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    except AnalysisException as error:
        raise ValueError("rows have no stable place: write the table to Parquet files and read it") from error
    # One row per file.
    numbers = sized(placed.select("_file").distinct().select(
        "_file", (F.row_number().over(Window.orderBy("_file")) - 1).cast("long").alias("_number")))
    if numbers.count() <= FILES:
        numbers = F.broadcast(numbers)
    return placed.join(numbers, "_file").select(
        *[f"`{c}`" for c in docs.columns], (F.shiftleft("_number", 40) + F.col("_index")).alias("_row_id"))


def running_totals(rows: DataFrame, size: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Add ``before`` (sum of ``size`` over the earlier rows of the same ``by``) and ``rank`` (their number).

    Rows are dealt into ranges of (by, order) and written with the number of their range, so that
    the ranges stay as they are. Totals per range are summed over the earlier ranges (a row per
    range and ``by``), and each range is scanned alone: no group is read by one task, however large.
    Rows that are equal in ``by`` and ``order`` should be equal altogether.
    """
    by, order = list(by), list(order)
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *by, *order)
    dealt = materialise(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        dealt.groupBy(*by, "_range").agg(F.sum(size).alias("_sum"), F.count(F.lit(1)).alias("_count"))
        .select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_by_range"),
                F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum_base"),
                F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_count_base"))
    )
    here = Window.partitionBy(*by, "_range").orderBy(*order)
    scanned = dealt.withColumns({
        "_rank": F.row_number().over(here),
        "_sum": F.sum(size).over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    })
    same = F.col("_range") == F.col("_by_range")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return scanned.join(bases, same).select(
        *rows.columns,
        (F.col("_sum_base") + F.col("_sum") - F.col(size)).alias("before"),
        (F.col("_count_base") + F.col("_rank") - 1).alias("rank"),
    )


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each connected component of ``edges`` (a, b).

    Each round gives every node the smallest label of its neighbours and then that label's own
    label, so that chains shrink by half. Labels are written between the rounds; a node's
    neighbours are combined before the shuffle, so hubs do no harm.
    """
    both = materialise(
        edges.select(F.col("a").alias("node"), F.col("b").alias("to"))
        .union(edges.select(F.col("b").alias("node"), F.col("a").alias("to"))).distinct(), "edges")
    labels = materialise(
        both.groupBy("node").agg(F.min("to").alias("low"))
        .select("node", F.least("node", "low").alias("root")), "labels")
    for _ in range(rounds):
        near = (
            both.join(labels.select(F.col("node").alias("to"), F.col("root").alias("via")), "to")
            .groupBy("node").agg(F.min("via").alias("via"))
        )
        lower = labels.join(near, "node").select("node", "root", F.least("root", "via").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("root").alias("top"))
        moved = materialise(
            lower.join(up, "low").select("node", F.least("low", "top").alias("new"), "root"), "labels")
        labels = moved.select("node", F.col("new").alias("root"))
        if moved.where("new <> root").isEmpty():
            return labels
    raise RuntimeError("the components did not settle")
