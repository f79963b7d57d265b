"""Interaction plot data and refits for linear models.

The grids are small by construction (100 points x 3 moderator levels, or
level x level, bounded by the level cap) and are built from Python lists;
predictions use the fitted model's column expression.  The all-pairs
lines over the training rows (R26) copy each row three times with the
moderator fixed (a bounded ``explode``) and fit a straight line per level
with ``regr_slope``/``regr_intercept`` -- one grouped aggregate.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.roles import col, roles
from . import linear as L
from . import plotdata as G

LEVEL_LABELS = ("Low (-1SD)", "Mean", "High (+1SD)")


def residual_points(df: DataFrame, fit: L.OLSFit, keep: list[str] | None = None) -> DataFrame:
    """Actual, predicted and residual per row (points of both plots)."""
    pred = fit.prediction()
    y = col(fit.design.target).cast("double")
    return df.select(*[col(c) for c in (keep or [])], y.alias("actual"), pred.alias("predicted"),
                     (y - pred).alias("residual")).where("actual IS NOT NULL AND predicted IS NOT NULL")


def residual_histogram(df: DataFrame, fit: L.OLSFit, bins: int = 30) -> DataFrame:
    """Residual histogram (30 bins)."""
    return G.histogram(residual_points(df, fit), "residual", bins)


def residual_qq(df: DataFrame, fit: L.OLSFit) -> DataFrame:
    """Residual normal Q-Q points."""
    return G.qq_points(residual_points(df, fit), "residual")


def _base_row(df: DataFrame, fit: L.OLSFit) -> dict:
    """Other variables: numeric at their mean, text at their first sorted level."""
    d = fit.design
    vars_ = d.variables()
    num = set(roles(df)[0])
    nums = [v for v in vars_ if v in num]
    base = {}
    if nums:
        r = df.agg(*[F.avg(col(v)).alias(f"m{i}") for i, v in enumerate(nums)]).collect()[0]
        base.update({v: float(r[f"m{i}"]) for i, v in enumerate(nums)})
    for v in vars_:
        if v not in num:
            base[v] = d.levels[v][0] if d.levels.get(v) else None
    return base


def interaction_grid(df: DataFrame, fit: L.OLSFit, v1: str, v2: str, n: int = 100) -> DataFrame:
    """Predictions over v1 x v2 with the other variables held fixed.

    numeric x numeric: n points of v1 over its range, v2 at mean - sd, mean, mean + sd;
    numeric x text: one line per level of v2; text x text: every level pair.
    """
    d = fit.design
    num = set(roles(df)[0])
    base = _base_row(df, fit)
    rows = []
    if v1 in num:
        r = df.agg(F.min(col(v1)).alias("lo"), F.max(col(v1)).alias("hi"), F.avg(col(v2)).alias("m")
                   if v2 in num else F.lit(None).alias("m"),
                   F.stddev_samp(col(v2)).alias("s") if v2 in num else F.lit(None).alias("s")).collect()[0]
        lo, hi = float(r["lo"]), float(r["hi"])
        xs = [lo + i * ((hi - lo) / (n - 1)) for i in range(n - 1)] + [hi]
        if v2 in num:
            levels = list(zip(LEVEL_LABELS, (r["m"] - r["s"], r["m"], r["m"] + r["s"])))
        else:
            levels = [(lv, lv) for lv in d.levels[v2]]
        for lab, lv in levels:
            for x in xs:
                rows.append({**base, v1: x, v2: lv, "level": lab})
    else:
        for a in d.levels[v1]:
            for b in (d.levels[v2] if v2 not in num else [base[v2]]):
                rows.append({**base, v1: a, v2: b, "level": str(b)})
    vars_ = list(base.keys())
    schema = ", ".join(f"`{v}` {'double' if v in num else 'string'}" for v in vars_) + ", level string"
    grid = df.sparkSession.createDataFrame([tuple(r[v] for v in vars_) + (r["level"],) for r in rows], schema)
    return grid.select(col(v1).alias("x"), "level", fit.prediction().alias("pred"))


def interaction_lines(df: DataFrame, fit: L.OLSFit, v1: str, v2: str) -> DataFrame:
    """Per moderator level, the straight line of predictions against v1 over the training rows."""
    r = df.agg(F.avg(col(v2)).alias("m"), F.stddev_samp(col(v2)).alias("s")).collect()[0]
    levels = F.array(*[F.struct(F.lit(lab).alias("level"), F.lit(float(v)).alias("v"))
                       for lab, v in zip(LEVEL_LABELS, (r["m"] - r["s"], r["m"], r["m"] + r["s"]))])
    tmp = df.withColumn("__lv", F.explode(levels))
    tmp = tmp.withColumn(v2, F.col("__lv.v")).withColumn("level", F.col("__lv.level")).drop("__lv")
    pred = fit.prediction()
    x = col(v1).cast("double")
    return (tmp.select("level", x.alias("x"), pred.alias("pred"))
            .groupBy("level").agg(F.regr_slope("pred", "x").alias("slope"),
                                  F.regr_intercept("pred", "x").alias("intercept"),
                                  F.count(F.lit(1)).alias("n")))


def interaction_refit(df: DataFrame, target: str, features: list[str], vars_: list[str]):
    """R26 (D16): refit with all pairwise a*b terms of ``vars_``; returns (fit, coefficient table)."""
    pairs = [f"{a} * {b}" for a, b in combinations(vars_, 2)]
    formula = f"{target} ~ " + " + ".join(list(features) + pairs)
    fit = L.fit_ols(df, formula)
    return fit, L.coefficient_table(fit)
