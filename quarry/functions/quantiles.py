"""Exact quantiles (R type 7 = DuckDB ``quantile_cont``) at any scale, for any number of groups.

1. A sketch brackets every wanted quantile: ``percentile_approx`` has a rank error of at
   most ``n / accuracy``, so the values three such errors below and above hold it between
   them.  Keys of at most ``accuracy`` rows take their whole range.
2. One counted pass: rows below an interval are counted, values within it are counted
   by value, and a running sum finds the order statistics.  A value that a third of all rows
   hold is one counted value.
3. Before that, intervals that would still hold more than ``fetch`` values are narrowed: a sketch of what
   lies within, cut at the two of :data:`GRID` steps around the wanted rank.

The count also proves the bracket; a key whose bracket failed is done again from its whole range.  Rows meet the
intervals of their column and group by a join, so the number of groups has no limit; it is a
broadcast only while the keys are few.

Type 7: h = (n-1) p, value = x[floor h] + (h - floor h) (x[floor h + 1] - x[floor h]).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .hotjoin import broadcast_if_small
from .roles import col

#: Inverse of the sketch's rank error, values of an interval that a window takes, steps of a narrowing.
ACCURACY, FETCH, GRID = 10_000, 1_000_000, 1_000


def long_values(df: DataFrame, cols: list[str], by: str | None = None) -> DataFrame:
    """(cid, [g,] v) for the present, non-NaN values of ``cols``."""
    structs = []
    for i, c in enumerate(cols):
        parts = [F.lit(i).alias("cid")]
        if by is not None:
            parts.append(col(by).alias("g"))
        parts.append(col(c).cast("double").alias("v"))
        structs.append(F.struct(*parts))
    out = df.select(F.inline(F.array(*structs)))
    return out.where(F.col("v").isNotNull() & ~F.isnan("v"))


def quantiles(df: DataFrame, cols: list[str], probs: list[float], by: str | None = None, accuracy: int = ACCURACY,
              fetch: int = FETCH) -> dict:
    """{col: [q(p) ...]} or, with ``by``, {(col, group): [...]}: :func:`quantile_table` on the driver, for few groups.

    A column without values has nulls; a group without has no entry.
    """
    if not cols:
        return {}
    rows = quantile_table(df, cols, probs, by, accuracy, fetch).collect()
    if by is not None:
        return {(cols[r["cid"]], r["g"]): list(r["q"]) for r in rows}
    found = {cols[r["cid"]]: list(r["q"]) for r in rows}
    return {c: found.get(c, [None] * len(probs)) for c in cols}


def quantile_table(df: DataFrame, cols: list[str], probs: list[float], by: str | None = None, accuracy: int = ACCURACY,
                   fetch: int = FETCH) -> DataFrame:
    """``cid`` (place in ``cols``), with ``by`` also ``g``, ``n`` (values) and ``q`` (array in the order of ``probs``)."""
    values = long_values(df, cols, by)
    keys = ["cid"] if by is None else ["cid", "g"]
    probs = [float(p) for p in probs]
    apart = 3.0 / accuracy
    asked = [max(p - apart, 0.0) for p in probs] + [min(p + apart, 1.0) for p in probs]
    k = len(probs)
    whole = F.col("n") <= accuracy
    sketch = values.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
                                       F.percentile_approx("v", asked, accuracy).alias("near"))
    brackets = cut_lineage(sketch.select(
        *keys, "n", "lo", "hi", F.when(whole, F.array_repeat("lo", k)).otherwise(F.slice("near", 1, k)).alias("los"),
        F.when(whole, F.array_repeat("hi", k)).otherwise(F.slice("near", k + 1, k)).alias("his")))
    size = brackets.agg(F.count(F.lit(1)).alias("keys"), F.max("n").alias("n")).first()
    held = min(size["n"] or 0, max(accuracy, 2 * apart * (size["n"] or 0)))
    found = cut_lineage(_counted(values, brackets, keys, probs, size["keys"], held, accuracy, fetch))
    lost = found.where("NOT sure")
    if not lost.isEmpty():
        again = brackets.join(lost.select(*[F.col(c).alias(f"_{c}") for c in keys]), _same(keys, "_"), "left_semi")
        again = again.withColumns({"los": F.array_repeat("lo", k), "his": F.array_repeat("hi", k)})
        found = found.where("sure").unionByName(_counted(values, again, keys, probs, size["keys"], size["n"], accuracy, fetch))
    return found.select(*keys, "n", "q")


def _same(keys: list[str], mark: str) -> Column:
    """Rows of one key; a null group is a group."""
    out = F.col("cid") == F.col(f"{mark}cid")
    return out if len(keys) == 1 else out & F.col("g").eqNullSafe(F.col(f"{mark}g"))


def _marked(brackets: DataFrame, keys: list[str], size: int) -> DataFrame:
    named = brackets.select(*[F.col(c).alias(f"_{c}") for c in keys], "n", "los", "his")
    return broadcast_if_small(named, size)


def _within(values: DataFrame, brackets: DataFrame, keys: list[str], k: int, size: int) -> DataFrame:
    """``keys, n, t, val, lo, hi``: for each interval ``t`` a row holds its value, or null from below; none from above."""
    met = values.join(_marked(brackets, keys, size), _same(keys, "_"))
    each = [F.struct(F.lit(t).alias("t"), F.when(F.col("v") >= F.col("los")[t], F.col("v")).alias("val"),
                     (F.col("v") <= F.col("his")[t]).alias("here")) for t in range(k)]
    return met.select(*keys, "n", F.inline(F.array(*each))).where("here").drop("here")


def _rank(probs: list[float]) -> Column:
    """0-based (n - 1) p of the interval ``t``."""
    return (F.col("n") - 1) * F.array(*[F.lit(p) for p in probs])[F.col("t")]


def _counted(values: DataFrame, brackets: DataFrame, keys: list[str], probs: list[float], size: int, held: float,
             accuracy: int, fetch: int) -> DataFrame:
    """``keys, n, q, sure``: the counted pass over the brackets, narrowed until ``held`` values are few."""
    k = len(probs)
    while held > fetch:
        brackets = cut_lineage(_narrowed(values, brackets, keys, probs, size, accuracy))
        held = held * 6 / GRID
    counts = _within(values, brackets, keys, k, size).groupBy(*keys, "n", "t", "val").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(*keys, "t").orderBy(F.col("val").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    low = F.floor(_rank(probs))
    high = F.least(low + 1, F.col("n") - 1)
    summed = counts.withColumn("upto", F.sum("c").over(upto))
    stats = summed.groupBy(*keys, "n", "t").agg(
        F.min(F.when(F.col("upto") > low, F.col("val"))).alias("a"), F.min(F.when(F.col("upto") > high, F.col("val"))).alias("b"),
        F.coalesce(F.max(F.when(F.col("val").isNull(), F.col("upto"))), F.lit(0)).alias("below"))
    share = _rank(probs) - low
    value = F.when((share > 0) & (F.col("b") != F.col("a")), F.col("a") + share * (F.col("b") - F.col("a"))).otherwise(F.col("a"))
    done = stats.select(*keys, "n", "t", value.alias("value"), ((F.col("below") <= low) & F.col("b").isNotNull()).alias("sure"))
    return done.groupBy(*keys, "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "value"))), lambda s: s["value"]).alias("q"),
                                        (F.min("sure") & (F.count(F.lit(1)) == k)).alias("sure"))


def _narrowed(values: DataFrame, brackets: DataFrame, keys: list[str], probs: list[float], size: int, accuracy: int) -> DataFrame:
    """The brackets, each cut at the two of :data:`GRID` even steps of its content around the wanted rank."""
    inside = (_within(values, brackets, keys, len(probs), size).groupBy(*keys, "n", "t")
              .agg(F.count_if(F.col("val").isNull()).alias("below"), F.count("val").alias("held"),
                   F.percentile_approx("val", [i / GRID for i in range(GRID + 1)], max(accuracy, 10 * GRID)).alias("steps")))
    at = F.floor((F.floor(_rank(probs)) - F.col("below")) / F.col("held") * GRID).cast("int")
    # small contents stay as they are: a step would be less than a row
    few = F.col("held") <= 10 * GRID
    lo = F.col("steps")[F.when(few, 0).otherwise(F.least(F.greatest(at - 1, F.lit(0)), F.lit(GRID)))]
    hi = F.col("steps")[F.when(few, GRID).otherwise(F.least(F.greatest(at + 3, F.lit(0)), F.lit(GRID)))]
    cut = inside.select(*keys, "n", F.struct("t", lo.alias("lo"), hi.alias("hi")).alias("s"))
    return cut.groupBy(*keys, "n").agg(F.sort_array(F.collect_list("s")).alias("s")).select(
        *keys, "n", F.col("s.lo").alias("los"), F.col("s.hi").alias("his"))
