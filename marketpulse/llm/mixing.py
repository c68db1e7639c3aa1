"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.llm.common import WORD, running_totals, text_of, with_rows
from marketpulse.session import materialise

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Relative weight of a source at the start, the middle and the end of training, by the source's
#: place among the others, repeating: even, fading out, coming in.
SCHEDULES = ((1.0, 1.0, 1.0), (1.5, 1.0, 0.5), (0.5, 1.0, 1.5))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """Targets of the sources in ``sizes`` (source, source_size): ``share`` of all words, by weight.

    No target passes ``most`` times its source; what is over goes to the others by weight until
    none is over. A source is full if even the level of all sources that fill up later fills it, so
    one pass over the sources in order of size / weight finds them. Adds ``place`` (code point
    order, NULL last) and ``target``. One row per source: the only table that one task reads whole.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("place", F.row_number().over(order) - 1)
    array = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(array, (F.col("place") % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(float(most))
    fill = Window.orderBy(cap / F.col("weight"), "place")
    upto = fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    steps = ranked.select(
        "*", cap.alias("cap"),
        F.coalesce(F.sum(cap).over(upto) - cap, F.lit(0.0)).alias("full"),
        (F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight")).alias("open"),
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("total"),
    ).withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    # The first source that its level does not fill sets the level of all that follow.
    holds = F.col("level") * F.col("weight") < F.col("cap")
    settled = steps.withColumn("final", F.min_by("level", F.when(holds, F.struct(cap / F.col("weight"), "place"))).over(everything))
    return settled.select(
        "source", "source_size", "place",
        F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target"))


def curriculum_position(share: Column, knots: Column) -> Column:
    """The time in [0, 1] at which a source has met ``share`` of its demand.

    ``knots`` (array) is the weight at equally spaced times, linear between them. The demand is its
    integral: trapezoids up to a knot and a quadratic within one, which is inverted in closed form.
    """
    steps = F.size(knots) - 1
    area = F.transform(F.slice(knots, 1, steps), lambda a, i: (a + F.get(knots, i + 1)) / (2 * steps))
    whole = F.aggregate(area, F.lit(0.0), lambda s, a: s + a)
    start = F.struct(F.lit(0.0).alias("left"), F.lit(-1.0).alias("at"), F.lit(0).alias("i"))

    def step(s, a):
        left = s["left"]
        need = share * whole
        w0, w1 = F.get(knots, s["i"]), F.get(knots, s["i"] + 1)
        rest = F.greatest(need - left, F.lit(0.0)) * steps
        root = w0 + F.sqrt(F.greatest(w0 * w0 + 2 * (w1 - w0) * rest, F.lit(0.0)))
        inside = F.when(root > 0, F.least(2 * rest / root, F.lit(1.0))).otherwise(F.lit(0.0))
        here = (s["at"] < 0) & ((need <= left + a) | (s["i"] == steps - 1))
        return F.struct((left + a).alias("left"),
                        F.when(here, (s["i"] + inside) / steps).otherwise(s["at"]).alias("at"),
                        (s["i"] + 1).alias("i"))

    return F.aggregate(area, start, step)["at"]


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: int = 2,
        schedules: Sequence[Sequence[float]] = SCHEDULES, seed: int = 7) -> DataFrame:
    """One row per document and pass (0 to most - 1) with the words the mix takes and its training position.

    Returns ``rid``, ``doc_id``, ``source``, ``size`` (words), ``source_size``, ``target``, ``pass``,
    ``words`` (taken in this pass, 0 if none) and ``position`` (0 to 1; NULL if nothing is taken).

    The documents of a source lie one after another in the order of a seeded hash. The words before
    a document are the demand that must have come up when its turn comes; the inverse of the
    integrated weight schedule turns them into a position. Sources smaller than their target go
    round again. Only the document at which the demand ends is taken in part, so a source's words
    are its target cut to a whole number.

    NULL and empty texts have no words and are never taken. A NULL source is a source, the last one.
    Rows that are equal in doc_id and text are interchangeable. Reruns give the same mix. An empty
    table gives no rows. Other columns are ignored. ``docs`` must be a table read from files.
    """
    text = text_of()
    rows = with_rows(docs).select(
        F.col("_row_id").alias("rid"), "doc_id", F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), text).alias("draw"))
    placed = running_totals(rows, "size", ["draw", "doc_id", "rid"], ["source"])
    placed = materialise(placed, "placed")
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialise(source_targets(sizes, weights, share, most), "targets")
    target = targets.select(F.col("source").alias("_source"), "source_size", "place", "target")
    joined = placed.join(target, F.col("source").eqNullSafe(F.col("_source")))
    passes = joined.select("*", F.explode(F.array(*[F.lit(i) for i in range(most)])).alias("pass"))
    start = F.col("before") + F.col("pass") * F.col("source_size")
    words = F.greatest(F.least(F.floor("target") - start, F.col("size")), F.lit(0))
    knots = F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in schedules]),
                         (F.col("place") % len(schedules) + 1).cast("int"))
    taken = passes.select("rid", "doc_id", "source", "size", "source_size", "target", "pass",
                          words.cast("long").alias("words"), start.alias("_start"), knots.alias("_knots"))
    position = curriculum_position(F.try_divide(F.col("_start").cast("double"), F.col("target")), F.col("_knots"))
    return taken.withColumn("position", F.when(F.col("words") > 0, position)).drop("_start", "_knots")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents in training order with all their columns: repeated, left out and sorted by position.

    Documents are not cut: one whose demand ends within it is taken if at least half of it is wanted.
    """
    takes = mix(docs, **options).where("words > 0 AND 2 * words >= size").select(
        F.col("rid").alias("_rid"), "position", "pass")
    whole = with_rows(docs).select(F.col("_row_id").alias("_rid"), F.struct(*[f"`{c}`" for c in docs.columns]).alias("_doc"))
    found = whole.join(takes, "_rid")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartitionByRange(n, "position", "_rid").sortWithinPartitions("position", "_rid").select("_doc.*")
