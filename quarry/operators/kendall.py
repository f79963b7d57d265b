"""Kendall's tau-b (E8), exact and without comparing pairs of rows.

Rows collapse to distinct ``(x, y)`` with counts, and both columns to dense
ranks.  Two points are discordant if the one with the larger y has the smaller x; such a
pair parts at one bit of the y ranks, so for every bit the points that share
the higher bits form a group, and in it each point whose bit is 0 counts the
points with bit 1 and a smaller x.  That is one running sum per group, taken
over ranges of x first and within a range after, so no group is one task.
Ties enter through group sizes alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rowindex import with_row_index

_WHOLE = "decimal(38,0)"


def _pairs_among(count: Column) -> Column:
    return F.coalesce(F.sum((count.cast("decimal(19,0)") * (count - 1).cast("decimal(18,0)")).cast(_WHOLE)),
                      F.lit(0).cast(_WHOLE))


def _ranked(points: DataFrame, column: str) -> DataFrame:
    values = points.select(F.col(column).alias("v")).distinct()
    ranks = with_row_index(values, ["v"], "r").select("v", (F.col("r") - 1).alias(f"r{column}"))
    return points.join(ranks, points[column] == ranks["v"]).drop("v")


def kendall_tau(df: DataFrame, x: str, y: str) -> float | None:
    """Tau-b over the rows where both are present; None if either is constant or there are no two rows."""
    points = (df.select(F.col(f"`{x}`").cast("double").alias("x"), F.col(f"`{y}`").cast("double").alias("y"))
              .where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
              .groupBy("x", "y").agg(F.count(F.lit(1)).alias("c")))
    n = points.agg(F.sum("c")).first()[0] or 0
    both = points.agg(_pairs_among(F.col("c"))).first()[0]
    tied_x = points.groupBy("x").agg(F.sum("c").alias("c")).agg(_pairs_among(F.col("c"))).first()[0]
    tied_y = points.groupBy("y").agg(F.sum("c").alias("c")).agg(_pairs_among(F.col("c"))).first()[0]
    every = n * (n - 1)
    if every == tied_x or every == tied_y:
        return None
    ranked = _ranked(_ranked(points, "x"), "y").select("rx", "ry", "c")
    top = ranked.agg(F.max("rx").alias("x"), F.max("ry").alias("y")).first()
    bits, width = max(1, int(top["y"]).bit_length()), (int(top["x"]).bit_length() + 1) // 2
    at_bit = ranked.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    # shifts by a column: powers of two from a literal array
    powers = F.array(*[F.lit(1 << b).cast("long") for b in range(bits + 1)])
    half = F.floor(F.col("ry") / F.element_at(powers, F.col("bit") + 1)).cast("long")
    sides = (at_bit.select("bit", F.floor(half / 2).cast("long").alias("group"), "rx",
                           F.when(half % 2 == 1, F.col("c")).otherwise(0).alias("upper"),
                           F.when(half % 2 == 0, F.col("c")).otherwise(0).alias("lower"))
             .groupBy("bit", "group", "rx").agg(F.sum("upper").alias("upper"), F.sum("lower").alias("lower"))
             .withColumn("span", F.shiftright("rx", width)))
    spans = sides.groupBy("bit", "group", "span").agg(F.sum("upper").alias("sum"))
    earlier = Window.partitionBy("bit", "group").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.coalesce(F.sum("sum").over(earlier), F.lit(0))).drop("sum")
    inside = Window.partitionBy("bit", "group", "span").orderBy("rx").rowsBetween(Window.unboundedPreceding, -1)
    smaller = sides.withColumn("within", F.coalesce(F.sum("upper").over(inside), F.lit(0)))
    counted = smaller.join(spans, ["bit", "group", "span"]).where("lower > 0")
    discordant = counted.agg(F.sum((F.col("lower").cast("decimal(18,0)")
                                    * (F.col("before") + F.col("within")).cast("decimal(19,0)")).cast(_WHOLE))).first()[0]
    # twice the concordant minus twice the discordant pairs
    score = every - int(tied_x) - int(tied_y) + int(both) - 4 * int(discordant or 0)
    return score / (float(every - int(tied_x)) ** 0.5 * float(every - int(tied_y)) ** 0.5)


def kendall_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """``var1, var2, correlation`` for all pairs, both ways, and 1 on the diagonal (null for a constant)."""
    rows = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            tau = kendall_tau(df, a, b)
            rows += [(a, b, tau)] if a == b else [(a, b, tau), (b, a, tau)]
    return df.sparkSession.createDataFrame(rows, "var1 string, var2 string, correlation double")
