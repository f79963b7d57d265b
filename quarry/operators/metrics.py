"""Model metrics over prediction columns.

Each metric is one aggregate over ``(actual, predicted)`` columns of one
DataFrame; the confusion matrix and ROC group by class / score first, so
nothing per-row reaches the driver.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.roles import col
from .levels import class_counts, pair_counts


def _pairs(df, y, p):
    ok = col(y).isNotNull() & col(p).isNotNull() & ~F.isnan(col(y).cast("double")) & \
        ~F.isnan(col(p).cast("double"))
    return df.where(ok).select(col(y).cast("double").alias("y"), col(p).cast("double").alias("p"))


def regression_metrics(df: DataFrame, y: str, p: str, warn: bool = True) -> DataFrame:
    """RMSE, MAE, R2 (one row); pairs with a missing side are ignored.

    R2 is missing when the total sum of squares is 0. One pass: the total
    sum of squares comes from ``var_pop * n``.
    """
    d = _pairs(df, y, p)
    e = F.col("y") - F.col("p")
    out = d.agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
                F.sum(e * e).alias("ss_res"), (F.var_pop("y") * F.count(F.lit(1))).alias("ss_tot"))
    if warn:
        dropped = df.where(col(y).isNull() | col(p).isNull()).limit(1).count()
        if dropped:
            warnings.warn("NA values ignored.")
    return out.select(F.sqrt("mse").alias("RMSE"), F.col("mae").alias("MAE"),
                      F.when(F.col("ss_tot") > 0, 1 - F.col("ss_res") / F.col("ss_tot")).alias("R2"))


def adjusted_r2(r2: float, n: int, p: int) -> float | None:
    """1 - (1 - R2)(n - 1)/(n - p - 1)."""
    if r2 is None or n - p - 1 <= 0:
        return None
    return 1 - (1 - r2) * (n - 1) / (n - p - 1)


def mape(df: DataFrame, y: str, p: str) -> DataFrame:
    """mean abs percent error over non-zero actuals; missing if none."""
    d = _pairs(df, y, p)
    return d.agg((F.avg(F.when(F.col("y") != 0, F.abs((F.col("y") - F.col("p")) / F.col("y")))) * 100)
                 .alias("MAPE"))


def information_criteria(rss: float, n: int, k_coef: int) -> tuple[float, float]:
    """Gaussian AIC/BIC of a linear fit with ``k_coef`` coefficients (incl. intercept).

    -2 logLik = n (log 2 pi + log(RSS/n) + 1); sigma counts as one more parameter.
    """
    m2ll = n * (math.log(2 * math.pi) + math.log(rss / n) + 1)
    return m2ll + 2 * (k_coef + 1), m2ll + math.log(n) * (k_coef + 1)


def predictions_table(df: DataFrame, y: str, p: str, keep: list[str] | None = None) -> DataFrame:
    """F8: actual, predicted, residual."""
    return df.select(*[col(c) for c in (keep or [])], col(y).cast("double").alias("actual"),
                     col(p).cast("double").alias("predicted"),
                     (col(y).cast("double") - col(p).cast("double")).alias("residual"))


# ---- classification ---------------------------------------------------------

#: Classes above which a matrix with its empty cells is refused; :func:`pair_counts` has no limit.
MOST_CLASSES = 1000


def class_levels(df: DataFrame, *cols: str, max_levels: int = MOST_CLASSES) -> list[str]:
    vals = None
    for c in cols:
        v = df.select(col(c).cast("string").alias("v")).where("v IS NOT NULL").distinct()
        vals = v if vals is None else vals.union(v)
    got = [r["v"] for r in vals.distinct().limit(max_levels + 1).collect()]
    if len(got) > max_levels:
        raise ValueError(f"more than {max_levels} classes")
    return sorted(got)


def confusion_matrix(df: DataFrame, actual: str, predicted: str, levels: list[str] | None = None) -> DataFrame:
    """Counts for every (predicted, actual) pair of levels, zero cells included."""
    levels = levels or class_levels(df, actual, predicted)
    spark = df.sparkSession
    grid = spark.createDataFrame([(p, a) for p in levels for a in levels], "predicted string, actual string")
    counts = (df.select(col(predicted).cast("string").alias("predicted"), col(actual).cast("string").alias("actual"))
              .groupBy("predicted", "actual").agg(F.count(F.lit(1)).alias("n")))
    # levels x levels grid is bounded by the level cap
    return (F.broadcast(grid).join(counts, ["predicted", "actual"], "left")
            .select("predicted", "actual", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def classification_metrics(df: DataFrame, actual: str, predicted: str,
                           levels: list[str] | None = None) -> DataFrame:
    """C11: accuracy; binary precision/recall for the second level; multi-class
    macro means over classes where defined; F1 = 2PR/(P+R) from those values."""
    pairs = pair_counts(df.where(col(actual).isNotNull() & col(predicted).isNotNull()), actual, predicted)
    if levels:
        pairs = pairs.where(F.col("predicted").isin(levels) & F.col("actual").isin(levels))
    classes = class_counts(pairs).withColumns({"precision": F.try_divide("tp", "pred_n"), "recall": F.try_divide("tp", "actual_n")})
    # one row: of two classes the second counts, of more all do
    positive = F.max(F.struct("cls", "precision", "recall")) if not levels or len(levels) != 2 else \
        F.max(F.when(F.col("cls") == levels[1], F.struct("cls", "precision", "recall")))
    two = F.lit(len(levels) == 2) if levels else F.col("k") == 2
    one = classes.agg(F.sum("tp").alias("correct"), F.sum("actual_n").alias("total"), F.count(F.lit(1)).alias("k"),
                      positive.alias("second"), F.avg("precision").alias("mp"), F.avg("recall").alias("mr"))
    out = one.select((F.col("correct") / F.col("total")).alias("accuracy"),
                     F.when(two, F.col("second.precision")).otherwise(F.col("mp")).alias("precision"),
                     F.when(two, F.col("second.recall")).otherwise(F.col("mr")).alias("recall"))
    return out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _score_table(df: DataFrame, score: str, label: str, positive) -> DataFrame:
    pos = (col(label) == F.lit(positive)) if positive is not None else col(label).cast("boolean")
    return (df.where(col(score).isNotNull() & col(label).isNotNull())
            .select(col(score).cast("double").alias("s"), pos.cast("int").alias("y")))


def roc_direction(df: DataFrame, score: str, label: str, positive=None) -> int:
    """+1 if positives score higher (by class medians), else -1 (pROC's rule)."""
    from ..functions.quantiles import quantiles
    st = _score_table(df, score, label, positive)
    med = quantiles(st, ["s"], [0.5], by="y")
    mp, mn = med.get(("s", 1), [None])[0], med.get(("s", 0), [None])[0]
    if mp is None or mn is None:
        return 1
    return 1 if mp >= mn else -1


def roc_curve(df: DataFrame, score: str, label: str, positive=None, direction: int | None = None) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, high to low.

    Counts per distinct score (partial aggregation), then running sums over
    the scores in order by blocks (no window over all rows).
    """
    from .profile import _prefix_sum
    from ..functions.rowindex import with_row_index
    d = direction if direction is not None else roc_direction(df, score, label, positive)
    st = _score_table(df, score, label, positive).withColumn("s", F.col("s") * F.lit(float(d)))
    per = st.groupBy("s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    tot = per.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).collect()[0]
    idx = with_row_index(per, [F.col("s").desc()], "__i", bucket_key=-F.col("s"))
    cp = _prefix_sum(idx, "__i", "pos").withColumnRenamed("before", "pos_before")
    cn = _prefix_sum(cp, "__i", "neg").withColumnRenamed("before", "neg_before")
    return cn.select((F.col("s") * F.lit(float(d))).alias("threshold"),
                     F.try_divide(F.col("neg_before") + F.col("neg"), F.lit(float(tot["N"] or 0))).alias("fpr"),
                     F.try_divide(F.col("pos_before") + F.col("pos"), F.lit(float(tot["P"] or 0))).alias("tpr"))


def auc(df: DataFrame, score: str, label: str, positive=None, direction: int | None = None) -> DataFrame:
    """AUC by Mann-Whitney: (sum of positive ranks - P(P+1)/2) / (P N); ties averaged."""
    from .profile import _value_ranks
    d = direction if direction is not None else roc_direction(df, score, label, positive)
    st = _score_table(df, score, label, positive).withColumn("s", F.col("s") * F.lit(float(d)))
    per = st.groupBy("s").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("c"))
    ranks = _value_ranks(per.select(F.col("s").alias("v"), "c"))
    j = per.join(ranks.withColumnRenamed("v", "s"), "s")
    return j.agg(F.sum(F.col("pos") * F.col("rank")).alias("rs"), F.sum("pos").alias("P"),
                 F.sum(F.col("c") - F.col("pos")).alias("N")).select(
        F.try_divide(F.col("rs") - F.col("P") * (F.col("P") + 1) / 2, F.col("P") * F.col("N")).alias("auc"))


def prediction_check(df: DataFrame, actual: str, predicted: str, keep: list[str] | None = None) -> DataFrame:
    """C14: actual, predicted, correct."""
    return df.select(*[col(c) for c in (keep or [])], col(actual).cast("string").alias("actual"),
                     col(predicted).cast("string").alias("predicted"),
                     (col(actual).cast("string") == col(predicted).cast("string")).alias("correct"))

