"""Outliers (T16-T18) and column filters (T14 near-zero variance, T15 high correlation)."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..functions.roles import FLOAT_TYPES, col, dtype_of, roles


def _num(df, c):
    x = col(c)
    if isinstance(dtype_of(df, c), FLOAT_TYPES):
        x = F.when(~F.isnan(x), x)
    return x.cast("double")


@dataclass
class OutlierParams:
    method: str
    bounds: dict = field(default_factory=dict)   # column -> (low, high) inclusive keep range


def fit_outliers(df: DataFrame, cols: list[str], method: str = "iqr", z: float = 3.0) -> OutlierParams:
    """T16 (exact quartiles, 1.5 IQR fences) / T17 (abs z > 3, sample sd)."""
    num = set(roles(df)[0])
    valid = [c for c in cols if c in num]
    if not valid:
        raise ValueError("fit_outliers: no numeric column among those named")
    p = OutlierParams(method)
    if method == "iqr":
        qs = quantiles(df, valid, [0.25, 0.75])
        for c in valid:
            q1, q3 = qs[c]
            if q1 is not None:
                iq = q3 - q1
                p.bounds[c] = (q1 - 1.5 * iq, q3 + 1.5 * iq)
    elif method == "zscore":
        r = df.agg(*[F.avg(_num(df, c)).alias(f"m{i}") for i, c in enumerate(valid)],
                   *[F.stddev_samp(_num(df, c)).alias(f"s{i}") for i, c in enumerate(valid)]).collect()[0]
        for i, c in enumerate(valid):
            m, s = r[f"m{i}"], r[f"s{i}"]
            if m is not None and s is not None and s > 0:
                p.bounds[c] = (m, s, z)
    else:
        raise ValueError(f"Unknown method: {method}")
    return p


def outlier_expr(df: DataFrame, p: OutlierParams):
    """True where any chosen column is an outlier; missing is never one."""
    flag = F.lit(False)
    for c, b in p.bounds.items():
        x = _num(df, c)
        if p.method == "iqr":
            lo, hi = b
            hit = (x < F.lit(lo)) | (x > F.lit(hi))
        else:
            m, s, z = b
            hit = F.abs((x - F.lit(m)) / F.lit(s)) > F.lit(z)
        flag = flag | F.coalesce(hit, F.lit(False))
    return flag


def handle_outliers(df: DataFrame, cols: list[str], method: str = "iqr", action: str = "flag",
                    flag_col: str = "outlier_flag") -> DataFrame:
    """Add a boolean flag column, or remove the flagged rows."""
    p = fit_outliers(df, cols, method)
    e = outlier_expr(df, p)
    if action == "flag":
        return df.withColumn(flag_col, e)
    if action == "remove":
        return df.where(~e)
    raise ValueError(f"Unknown action: {action}")


# ---- T14: near-zero variance ------------------------------------------------

def near_zero_variance(df: DataFrame, freq_cut: float = 95 / 5, unique_cut: float = 10.0) -> DataFrame:
    """Per column: freq_ratio, percent_unique, zero_var, nzv (caret's rule).

    freq_ratio = count(top value) / count(second value) over present values
    (0 if one value); percent_unique = 100 * distinct / rows; zero_var =
    one distinct value or all missing; nzv = (freq_ratio > freq_cut and
    percent_unique <= unique_cut) or zero_var.  Long form -> counts per
    value -> the two largest counts per column by a bounded top-k.
    """
    cols = df.columns
    structs = [F.struct(F.lit(c).alias("variable"),
                        (_num(df, c).cast("string") if c in roles(df)[0] else col(c).cast("string")).alias("v"))
               for c in cols]
    lv = df.select(F.inline(F.array(*structs)))
    counts = lv.groupBy("variable", "v").agg(F.count(F.lit(1)).alias("c"))
    rows = counts.groupBy("variable").agg(F.sum("c").alias("rows"))
    present = counts.where(F.col("v").isNotNull())
    # the two largest counts per column, by a bounded top-k per column (no window over all values)
    from .profile import _top_per_variable
    top2 = _top_per_variable(present.select("variable", F.col("v").alias("value"), F.col("c").alias("count")),
                             cols, 2)
    top = top2.groupBy("variable").agg(F.max(F.when(F.col("rank") == 1, F.col("count"))).alias("c1"),
                                       F.max(F.when(F.col("rank") == 2, F.col("count"))).alias("c2"))
    uniq = present.groupBy("variable").agg(F.count(F.lit(1)).alias("u"))
    out = (rows.join(uniq, "variable", "left").join(top, "variable", "left")
           .select("variable",
                   F.when(F.col("c2").isNull(), F.lit(0.0))
                   .otherwise(F.col("c1") / F.col("c2")).alias("freq_ratio"),
                   (100.0 * F.coalesce(F.col("u"), F.lit(0)) / F.col("rows")).alias("percent_unique"),
                   (F.coalesce(F.col("u"), F.lit(0)) <= 1).alias("zero_var")))
    return out.withColumn("nzv", ((F.col("freq_ratio") > freq_cut) & (F.col("percent_unique") <= unique_cut))
                          | F.col("zero_var"))


def remove_near_zero_variance(df: DataFrame, freq_cut: float = 95 / 5, unique_cut: float = 10.0) -> DataFrame:
    drop = {r["variable"] for r in near_zero_variance(df, freq_cut, unique_cut).where("nzv").collect()}
    return df.select(*[col(c) for c in df.columns if c not in drop])


# ---- T15: high correlation filter -------------------------------------------

def find_correlated(names: list[str], m: list[list[float]], cutoff: float = 0.90) -> list[str]:
    """Of each pair above the cutoff, the column with the larger mean absolute correlation goes.

    Pairs are met in the order of the columns' first means, largest first; the means
    are those over the columns still there (ties: the later column of the pair goes).
    """
    r = np.abs(np.array([[np.nan if v is None else v for v in row] for row in m], dtype=float))
    np.fill_diagonal(r, np.nan)

    def mean_with(column: int, there: list[int]) -> float:
        seen = r[column, there]
        seen = seen[~np.isnan(seen)]
        return float(seen.mean()) if len(seen) else -1.0

    there = list(range(len(names)))
    ranked = sorted(there, key=lambda c: -mean_with(c, there))
    gone = []
    for x, y in combinations(ranked, 2):
        if x in there and y in there and r[x, y] > cutoff:
            worse = x if mean_with(x, there) > mean_with(y, there) else y
            there.remove(worse)
            gone.append(worse)
    return [names[c] for c in ranked if c in gone]


def remove_correlated(df: DataFrame, threshold: float = 0.90) -> tuple[DataFrame, list[str]]:
    """Pairwise-complete correlation matrix in one pass, greedy drop on the driver."""
    from .profile import correlation_matrix
    num = roles(df)[0]
    if len(num) < 2:
        return df, []
    long = correlation_matrix(df, num, "pearson", "pairwise").collect()
    pos = {c: i for i, c in enumerate(num)}
    m = [[None] * len(num) for _ in num]
    for r in long:
        m[pos[r["var1"]]][pos[r["var2"]]] = r["correlation"]
    drop = set(find_correlated(num, m, threshold))
    return df.select(*[col(c) for c in df.columns if c not in drop]), sorted(drop)
