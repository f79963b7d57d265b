"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are shuffled (by a hash of their id and the
seed) and offered up to three times over, in packets of at most :data:`PACKET` words.  A packet's
virtual finish time is the source's words served so far, this packet included, divided by the
source's weight.  All packets are then put in the order of these times by ranges, and the mix is cut at
the total budget: what stands before the cut is taken.  That cut alone decides; a source whose
three rounds end before it leaves its share to the others, so that each source ends within a packet
of its target (:func:`targets`, computed beside it).

Running sums go over two levels: sums of hash (or time) ranges, then rows
within a range, so that a source with a third of all rows is spread over
many tasks.  Null text has size 0; a null source is a source of its own, last in order.
Documents of size 0 take nothing.  Rows with equal ids are documents of
their own; equal hashes are ordered by id, then size.  An empty table gives an empty mix.
Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tables import broadcast_if_small, quoted, text_or_empty

#: Weights by a source's place in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source is taken at most so many times over.
MOST_REPEATS = 3
#: Words of a document that are served at once.
PACKET = 128
#: Rows that one range of a running sum is meant to hold, and the fewest ranges.
RANGE_ROWS, LEAST_RANGES = 50_000, 1_024
WORD = r"[^\x20\x09-\x0D]+"


def size_column(text: str) -> Column:
    """Number of words of the text (long)."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``source``, ``source_size``, ``weight``, ``target``: all sizes shared by weight, none above ``most`` times its own.

    Sorted by ``most * size / weight``, the sources up to some place are at
    their limit and the rest share what is left by weight; running sums over
    the sources (one row each) find the place.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") - 1) % len(weights) + 1)
    limited = (sources.withColumn("place", place).withColumn("weight", weight)
               .withColumn("limit", F.lit(float(most)) * F.col("source_size"))
               .withColumn("level", F.col("limit") / F.col("weight")))
    every = Window.partitionBy()
    below = Window.orderBy("level", "place").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(below), F.lit(0.0))
    shared = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))
    tried = limited.withColumn("rate", left / shared)
    # the first source whose own limit is not below the rate of all that follow sets the rate
    rate = F.min(F.when(F.col("rate") <= F.col("level"), F.struct("level", "place", "rate"))).over(every)["rate"]
    return tried.select("source", "source_size", "weight",
                        F.least("limit", F.coalesce(rate, F.lit(float("inf"))) * F.col("weight")).alias("target"))


def running_sum(rows: DataFrame, amount: str, out: str, by: list[str], span: Column, order: list) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` over this and all earlier rows of the same ``by``.

    ``span`` numbers ranges of the order, ascending.
    """
    rows = rows.withColumn("__span", span)
    keys = [*by, "__span"]
    sums = rows.groupBy(*keys).agg(F.sum(amount).alias("__sum"))
    earlier = Window.partitionBy(*by).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"__of_{k}") for k in keys],
                       F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("__inside", F.sum(amount).over(inside))
    return (summed.join(sums, same).withColumn(out, F.col("__before") + F.col("__inside"))
            .drop("__span", "__before", "__inside", *[f"__of_{k}" for k in keys]))


def sized_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``row`` (number of the row), ``doc_id``, ``source``, ``size``: narrow, written once."""
    return cut_lineage(docs.select(quoted(key).alias("doc_id"), quoted(source).cast("string").alias("source"),
                                   size_column(text).alias("size"))
                       .withColumn("row", F.monotonically_increasing_id()))


def mix(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = 5,
        budget: int | None = None) -> DataFrame:
    """The mix: a row per document and repeat that is taken.

    ``row, doc_id, source, size, source_size, target, repeat`` (from 0),
    ``finish`` (virtual finish time of its last packet), ``take`` (words taken) and ``position``
    (words of the mix up to and with it).  ``budget`` is all sizes when not given.
    """
    goals = cut_lineage(targets(sized, weights, most))
    totals = sized.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    last = goals.agg(F.max(most * F.col("source_size") / F.col("weight"))).first()[0] or 1.0
    ranges = max(LEAST_RANGES, 1 << (int(totals["n"] + totals["words"] // PACKET) // RANGE_ROWS).bit_length())
    bits = min(ranges.bit_length() - 1, 30)
    goal = totals["words"] if budget is None else budget
    # 60 bits of a hash of id and seed
    text = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))
    place = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    rows = sized.join(goals.withColumnRenamed("source", "__source"),
                      F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn("place", place)
    served = running_sum(rows, "size", "served", ["source"], F.shiftright("place", 60 - bits),
                         ["place", "doc_id", "size", "row"])
    # an offer is a packet of a repeat: all repeats of a source are served one after the other
    parts = F.sequence(F.lit(0), F.ceil(F.col("size") / PACKET).cast("int") - 1)
    offers = (served.where("size > 0").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
              .withColumn("packet", F.explode(parts))
              .withColumn("offer", F.least(F.lit(PACKET), F.col("size") - F.col("packet") * PACKET).cast("long"))
              .withColumn("until", F.col("served") - F.col("size") + F.col("repeat") * F.col("source_size")
                          + F.col("packet") * PACKET + F.col("offer"))
              .withColumn("finish", F.col("until") / F.col("weight"))
              .select("row", "doc_id", "source", "size", "source_size", "target", "repeat", "until", "offer", "finish"))
    ordered = running_sum(offers, "offer", "position", [], F.floor(F.col("finish") * (16.0 * ranges / last)),
                          ["finish", "source", "until"])
    taken = ordered.withColumn("take", F.col("offer") - F.greatest(F.col("position") - goal, F.lit(0))).where(F.col("take") > 0)
    return (taken.groupBy("row", "doc_id", "source", "size", "source_size", "target", "repeat")
            .agg(F.max("finish").alias("finish"), F.sum("take").alias("take"), F.max(F.least("position", F.lit(goal))).alias("position")))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
                    weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = 5) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns, whole texts.

    A document that is taken in part stays if the part is half of it or more.
    Rows that share id, source and size all stay as often as the one of them that is taken most.
    """
    sized = sized_documents(docs, key, text, source)
    took = (mix(sized, weights, most, seed).where(2 * F.col("take") >= F.col("size"))
            .groupBy("row", "doc_id", "source", "size").count()
            .groupBy("doc_id", "source", "size").agg(F.max("count").cast("int").alias("copies")))
    took = cut_lineage(took.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"),
                                   F.col("size").alias("__size"), F.col("copies").alias("__copies")))
    same = (quoted(key).eqNullSafe(F.col("__id")) & quoted(source).cast("string").eqNullSafe(F.col("__source"))
            & (F.col("__words") == F.col("__size")))
    return (docs.withColumn("__words", size_column(text)).join(broadcast_if_small(took, took.count()), same)
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies")))
            .select(*[quoted(c) for c in docs.columns]))
