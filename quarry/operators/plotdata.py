"""Statistics behind each chart (G1-G9); drawing is left to the caller.

Grouped aggregates over bins or values: the result size is the number of
bins / levels / grid points.  Only projections (scatter points, outlier rows)
and Q-Q points have as many rows as the table has.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hotjoin import broadcast_if_small
from ..functions.quantiles import quantile_table, quantiles
from ..functions.roles import FLOAT_TYPES, col, dtype_of, roles
from ..functions.rowindex import with_row_index
from ..functions.special import norm_ppf
from ..session import cut_lineage
from .profile import _prefix_sum

#: Most Q-Q points that one row of counts is expanded to in a piece.
QQ_PIECE = 10_000


def _num(df, c):
    x = col(c)
    if isinstance(dtype_of(df, c), FLOAT_TYPES):
        x = F.when(~F.isnan(x), x)
    return x.cast("double")


def histogram(df: DataFrame, c: str, bins: int = 30) -> DataFrame:
    """G1: equal-width bins on [min, max], empty bins included; text -> value counts."""
    if c not in roles(df)[0]:
        return bar_counts(df, c)
    if not 5 <= bins <= 100:
        raise ValueError("bins must be within 5..100")
    x = _num(df, c)
    r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).collect()[0]
    lo, hi = r["lo"], r["hi"]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, lower double, upper double, count long")
    w = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(w)), F.lit(bins - 1)).cast("int")
    counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(w)).alias("lower"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(w)).alias("upper"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("count")))


def bar_counts(df: DataFrame, c: str) -> DataFrame:
    """Count per value (missing is a value)."""
    return df.groupBy(col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))


def box_stats(df: DataFrame, y: str, by: str | None = None) -> DataFrame:
    """q1, median, q3, whiskers (extreme values within 1.5 IQR of the box), outlier count."""
    x = _num(df, y)
    g = col(by).cast("string") if by else F.lit("all")
    data = df.select(g.alias("grp"), x.alias("v")).where("v IS NOT NULL")
    table = cut_lineage(quantile_table(data, ["v"], [0.25, 0.5, 0.75], by="grp"))
    fences = table.select(F.col("g").alias("of"), *[F.col("q")[k].alias(c) for k, c in enumerate(("q1", "median", "q3"))])
    j = data.join(broadcast_if_small(fences, fences.count()), F.col("grp").eqNullSafe(F.col("of"))).drop("of")
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    out = j.groupBy("grp", "q1", "median", "q3").agg(
        F.min(F.when(F.col("v") >= lo, F.col("v"))).alias("whisker_low"),
        F.max(F.when(F.col("v") <= hi, F.col("v"))).alias("whisker_high"),
        F.count_if((F.col("v") < lo) | (F.col("v") > hi)).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"))
    return out.withColumnRenamed("grp", by or "group")


def box_outliers(df: DataFrame, y: str, by: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The outlier rows themselves (a filter; as many as there are)."""
    st = box_stats(df, y, by)
    key = by or "group"
    g = col(by).cast("string") if by else F.lit("all")
    data = df.select(*[col(c) for c in (keep or [])], g.alias("__g"), _num(df, y).alias("value"))
    f = cut_lineage(st.select(F.col(key).alias("__f"), "q1", "q3"))
    j = data.join(broadcast_if_small(f, f.count()), F.col("__g").eqNullSafe(F.col("__f"))).drop("__f")
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    return j.where((F.col("value") < lo) | (F.col("value") > hi)).drop("q1", "q3") \
        .withColumnRenamed("__g", key)


def density(df: DataFrame, c: str, n: int = 512, grid_bins: int = 4096, by: str | None = None) -> DataFrame:
    """Gaussian kernel density at n points, bandwidth 0.9 min(sd, IQR/1.34) n^-1/5.

    Values are first counted on a fine grid (grouped aggregate), so the
    kernel sum runs over at most ``grid_bins`` weighted points per group;
    the evaluation grid x fine-grid product is bounded (n x grid_bins).
    The grid runs over [min - 3 bw, max + 3 bw] as R's density does.
    """
    x = _num(df, c)
    keys = [col(by).cast("string").alias("grp")] if by else [F.lit("all").alias("grp")]
    base = df.select(*keys, x.alias("v")).where("v IS NOT NULL")
    st = base.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd"),
                                 F.min("v").alias("lo"), F.max("v").alias("hi"))
    table = quantile_table(base, ["v"], [0.25, 0.75], by="grp").select(
        F.col("g").alias("of"), ((F.col("q")[1] - F.col("q")[0]) / 1.34).alias("iq"))
    least = F.least("sd", "iq")
    spread = (F.when(least > 0, least).when(F.col("sd") > 0, F.col("sd")).when(F.col("iq") > 0, F.col("iq"))
              .when(F.col("lo") != 0, F.abs("lo")).otherwise(F.lit(1.0)))
    # a null group is a group
    pdf = cut_lineage(st.join(table, F.col("grp").eqNullSafe(F.col("of"))).withColumn("bw", 0.9 * spread * F.pow("n", F.lit(-0.2)))
                      .select("grp", "bw", (F.col("lo") - 3 * F.col("bw")).alias("a"), (F.col("hi") + 3 * F.col("bw")).alias("b"), "n"))
    groups = pdf.count()
    fw = (F.col("b") - F.col("a")) / grid_bins
    fine = (base.withColumnRenamed("grp", "of").join(broadcast_if_small(pdf, groups), F.col("of").eqNullSafe(F.col("grp")))
            .groupBy("of", F.floor((F.col("v") - F.col("a")) / fw).alias("k"))
            .agg(F.count(F.lit(1)).alias("w"), F.avg("v").alias("m")))
    # evaluation points x occupied fine bins: bounded by n * grid_bins per group
    ev = pdf.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(
        "x", F.col("a") + F.col("i") * (F.col("b") - F.col("a")) / (n - 1))
    z = (F.col("x") - F.col("m")) / F.col("bw")
    dens = (ev.join(fine, F.col("grp").eqNullSafe(F.col("of")))
            .groupBy("grp", "i", "x", "bw", "n")
            .agg(F.sum(F.col("w") * F.exp(-0.5 * z * z)).alias("s"))
            .select("grp", "i", "x", (F.col("s") / (F.col("n") * F.col("bw") * math.sqrt(2 * math.pi))).alias("density")))
    return dens.withColumnRenamed("grp", by or "group")


def scatter_bins(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """2-D bin counts of (x, y) for any number of points."""
    xx, yy = _num(df, x), _num(df, y)
    r = df.agg(F.min(xx).alias("x0"), F.max(xx).alias("x1"), F.min(yy).alias("y0"), F.max(yy).alias("y1")).collect()[0]
    wx = (r["x1"] - r["x0"]) / bins if r["x1"] > r["x0"] else 1.0
    wy = (r["y1"] - r["y0"]) / bins if r["y1"] > r["y0"] else 1.0
    bx = F.least(F.floor((xx - F.lit(r["x0"])) / F.lit(wx)), F.lit(bins - 1)).cast("int")
    by = F.least(F.floor((yy - F.lit(r["y0"])) / F.lit(wy)), F.lit(bins - 1)).cast("int")
    return (df.where(xx.isNotNull() & yy.isNotNull()).groupBy(bx.alias("bin_x"), by.alias("bin_y"))
            .agg(F.count(F.lit(1)).alias("count"))
            .withColumn("x_low", F.lit(r["x0"]) + F.col("bin_x") * F.lit(wx))
            .withColumn("y_low", F.lit(r["y0"]) + F.col("bin_y") * F.lit(wy)))


def scatter_points(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """The points themselves (a projection)."""
    cols = [col(x), col(y)] + ([col(color)] if color else [])
    return df.select(*cols)


def qq_points(df: DataFrame, c: str) -> DataFrame:
    """Normal Q-Q points, one per row, plus the line through the quartiles.

    The sorted sample at plotting positions (i - a)/(n + 1 - 2a), a = 3/8
    for n <= 10 else 1/2 (R's ppoints), whatever n is.  Values are counted
    first and their positions come from running counts; those of a frequent
    value are dealt out in pieces of ``QQ_PIECE``.
    """
    x = _num(df, c)
    per = df.select(x.alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    n = df.where(x.isNotNull()).count()
    if not n:
        return df.sparkSession.createDataFrame([], "theoretical double, sample double, line_slope double, "
                                                   "line_intercept double")
    a = 3 / 8 if n <= 10 else 0.5
    q1, q3 = quantiles(df, [c], [0.25, 0.75])[c]
    z1, z3 = norm_ppf(0.25), norm_ppf(0.75)
    slope = (q3 - q1) / (z3 - z1)
    intercept = q1 - slope * z1

    @F.arrow_udf("double")
    def normal_quantile(p: pa.Array) -> pa.Array:
        return pa.array([norm_ppf(q) for q in p.to_pylist()], pa.float64())

    cum = _prefix_sum(with_row_index(per, ["v"], "__i"), "__i", "c")
    pieces = (cum.select("v", "c", "before", F.explode(F.sequence(F.lit(0), F.floor((F.col("c") - 1) / QQ_PIECE))).alias("k"))
              .select("v", (F.col("before") + F.col("k") * QQ_PIECE).alias("lo"),
                      (F.col("before") + F.least(F.col("c"), (F.col("k") + 1) * QQ_PIECE)).alias("hi"))
              .repartition("lo"))
    points = pieces.select("v", F.explode(F.sequence(F.col("lo") + 1, F.col("hi"))).alias("i"))
    return points.select(normal_quantile((F.col("i") - F.lit(a)) / F.lit(n + 1 - 2 * a)).alias("theoretical"),
                         F.col("v").alias("sample"), F.lit(float(slope)).alias("line_slope"),
                         F.lit(float(intercept)).alias("line_intercept"))


def missing_bars(df: DataFrame) -> DataFrame:
    """Columns with missing values, by percent (desc)."""
    from .profile import missing_summary
    return missing_summary(df).where("missing > 0").select("variable", "missing", "missing_pct")
