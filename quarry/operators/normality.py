"""Normality tests.

* Jarque-Bera: population moments from one aggregate (any size).
* Kolmogorov-Smirnov against N(mean, sd): Spark ML's distributed test.
* Anderson-Darling: needs each value's rank; counts per distinct value,
  running counts by blocks, then one aggregate of rank-weighted log CDFs.
* Shapiro-Wilk: defined for at most 5,000 values (as the reference): a
  seeded hash sample of 5,000 per column (top-k by hash, bounded per
  task) and Royston's (1995) approximation in ``applyInPandas``, one
  group per column, so many columns run in parallel.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.roles import FLOAT_TYPES, col, dtype_of
from ..functions.special import log_norm_cdf, norm_cdf


def _num(df, c):
    x = col(c)
    if isinstance(dtype_of(df, c), FLOAT_TYPES):
        x = F.when(~F.isnan(x), x)
    return x.cast("double")


def jarque_bera(df: DataFrame, cols: list[str]) -> DataFrame:
    """JB = n/6 (S^2 + K^2/4) with population skewness S and excess kurtosis K."""
    structs = []
    for c in cols:
        x = _num(df, c)
        n = F.count(x).cast("double")
        jb = n / 6.0 * (F.pow(F.skewness(x), 2) + F.pow(F.kurtosis(x), 2) / 4.0)
        structs.append(F.struct(F.lit(c).alias("variable"), F.lit("Jarque-Bera").alias("test"),
                                jb.alias("statistic"), F.exp(-jb / 2.0).alias("p_value")))
    return df.agg(F.array(*structs).alias("a")).select(F.inline("a"))


def ks_test(df: DataFrame, cols: list[str]) -> DataFrame:
    """One-sample KS against the normal with the sample's mean and sd."""
    from pyspark.ml.stat import KolmogorovSmirnovTest
    spark = df.sparkSession
    rows = []
    for c in cols:
        x = df.select(_num(df, c).alias("x")).where("x IS NOT NULL")
        r = x.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).collect()[0]
        if r["s"] is None or r["s"] == 0:
            rows.append((c, "Kolmogorov-Smirnov", None, None))
            continue
        t = KolmogorovSmirnovTest.test(x, "x", "norm", float(r["m"]), float(r["s"])).collect()[0]
        rows.append((c, "Kolmogorov-Smirnov", float(t["statistic"]), float(t["pValue"])))
    return spark.createDataFrame(rows, "variable string, test string, statistic double, p_value double")


def _ad_pvalue(aa: float) -> float:
    # fixed values: D'Agostino & Stephens (1986) piecewise p-value for A*
    if aa < 0.2:
        return 1 - math.exp(-13.436 + 101.14 * aa - 223.73 * aa ** 2)
    if aa < 0.34:
        return 1 - math.exp(-8.318 + 42.796 * aa - 59.938 * aa ** 2)
    if aa < 0.6:
        return math.exp(0.9177 - 4.279 * aa - 1.38 * aa ** 2)
    if aa < 10:
        return math.exp(1.2937 - 5.709 * aa + 0.0186 * aa ** 2)
    return 3.7e-24


def _log_norm_cdf_series(z: pd.Series) -> pd.Series:
    return pd.Series(log_norm_cdf(z.to_numpy(dtype=float)))


def _log_norm_cdf(z):
    """log Phi(z) as an Arrow-batched pandas UDF (Spark SQL has no erf)."""
    return F.pandas_udf(_log_norm_cdf_series, "double")(z)


def anderson_darling(df: DataFrame, cols: list[str]) -> DataFrame:
    """A = -n - (1/n) sum_i [(2i-1) log F(x_i) + (2n-2i+1) log(1 - F(x_i))],
    A* = A (1 + 0.75/n + 2.25/n^2); needs n >= 8."""
    from .profile import _prefix_sum
    from ..functions.rowindex import with_row_index
    spark = df.sparkSession
    rows = []
    for c in cols:
        x = df.select(_num(df, c).alias("v")).where("v IS NOT NULL")
        st = x.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).collect()[0]
        n, m, s = st["n"], st["m"], st["s"]
        if n < 8 or not s:
            rows.append((c, "Anderson-Darling", None, None))
            continue
        per = x.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
        idx = with_row_index(per, ["v"], "__i")
        pre = _prefix_sum(idx, "__i", "c")  # before = values strictly smaller
        z = (F.col("v") - F.lit(m)) / F.lit(s)
        sb, cc = F.col("before"), F.col("c")
        w1 = (sb + cc) * (sb + cc) - sb * sb                                 # sum of (2i - 1)
        w2 = (F.lit(n) - sb) * (F.lit(n) - sb) - (F.lit(n) - sb - cc) * (F.lit(n) - sb - cc)
        h = pre.select((w1 * _log_norm_cdf(z) + w2 * _log_norm_cdf(-z)).alias("h")).agg(F.sum("h")).collect()[0][0]
        a = -n - h / n
        aa = a * (1 + 0.75 / n + 2.25 / n ** 2)
        rows.append((c, "Anderson-Darling", float(a), _ad_pvalue(aa)))
    return spark.createDataFrame(rows, "variable string, test string, statistic double, p_value double")


# ---- Shapiro-Wilk (Royston 1995) --------------------------------------------

def _poly(c, x):
    return sum(ci * x ** i for i, ci in enumerate(c))


def shapiro_wilk_w(x: np.ndarray) -> tuple[float, float]:
    """W and p-value for 3 <= n <= 5000 sorted or unsorted values."""
    from statistics import NormalDist
    x = np.sort(np.asarray(x, dtype=float))
    n = len(x)
    if n < 3:
        return float("nan"), float("nan")
    if x[-1] - x[0] == 0:
        return float("nan"), float("nan")
    nd = NormalDist()
    # fixed values: Royston (1995) polynomial coefficients
    c1 = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
    c2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
    m = np.array([nd.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm = float(m @ m)
    u = 1.0 / math.sqrt(n)
    a = np.zeros(n)
    if n == 3:
        a[-1] = math.sqrt(0.5)
        a[0] = -a[-1]
    else:
        an = m[-1] / math.sqrt(mm) + _poly(c1, u)
        if n > 5:
            an1 = m[-2] / math.sqrt(mm) + _poly(c2, u)
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2)
            a[2:n - 2] = m[2:n - 2] / math.sqrt(phi)
            a[-1], a[-2], a[0], a[1] = an, an1, -an, -an1
        else:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * an ** 2)
            a[1:n - 1] = m[1:n - 1] / math.sqrt(phi)
            a[-1], a[0] = an, -an
    xm = x - x.mean()
    w = float((a @ x) ** 2 / (xm @ xm))
    w = min(w, 1.0)
    if n == 3:
        p = 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, max(p, 0.0)
    ln_n = math.log(n)
    if n <= 11:
        gamma = 0.459 * n - 2.273
        mu = _poly([0.5440, -0.39978, 0.025054, -0.0006714], n)
        sigma = math.exp(_poly([1.3822, -0.77857, 0.062767, -0.0020322], n))
        z = (-math.log(gamma - math.log1p(-w)) - mu) / sigma
    else:
        mu = _poly([-1.5861, -0.31082, -0.083751, 0.0038915], ln_n)
        sigma = math.exp(_poly([-0.4803, -0.082676, 0.0030302], ln_n))
        z = (math.log1p(-w) - mu) / sigma
    return w, 1 - norm_cdf(z)


def shapiro_wilk(df: DataFrame, cols: list[str], max_n: int = 5000, seed: int = 42,
                 key: list[str] | None = None) -> DataFrame:
    """Above ``max_n`` values a seeded sample of ``max_n`` rows is tested.

    Rows are chosen by a hash of ``key`` (all columns of ``df`` when not
    given), so the sample is one of rows, whatever values repeat.
    """
    row = F.xxhash64(*[col(c).cast("string") for c in (key or df.columns)], F.lit(seed))
    structs = [F.struct(F.lit(c).alias("variable"), _num(df, c).alias("v"), row.alias("__row")) for c in cols]
    lv = df.select(F.inline(F.array(*structs))).where("v IS NOT NULL")
    lv = lv.withColumn("__h", F.xxhash64(F.col("variable"), F.col("__row"))).drop("__row")
    parts = []
    for c in cols:
        # top-k by hash: each task keeps at most max_n rows
        parts.append(lv.where(F.col("variable") == c).orderBy("__h", "v").limit(max_n))
    sample = parts[0]
    for p in parts[1:]:
        sample = sample.unionByName(p)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro_wilk_w(pdf["v"].to_numpy())
        return pd.DataFrame({"variable": [pdf["variable"].iloc[0]], "test": ["Shapiro-Wilk"],
                             "statistic": [w], "p_value": [p], "n": [len(pdf)]})
    return sample.groupBy("variable").applyInPandas(
        test, "variable string, test string, statistic double, p_value double, n long")


def normality_tests(df: DataFrame, cols: list[str], tests=("sw", "ks", "ad", "jb")) -> DataFrame:
    """Union of the chosen tests, with per-variable 'k of m reject' at p < 0.05."""
    parts = []
    if "sw" in tests:
        parts.append(shapiro_wilk(df, cols).drop("n"))
    if "ks" in tests:
        parts.append(ks_test(df, cols))
    if "ad" in tests:
        parts.append(anderson_darling(df, cols))
    if "jb" in tests:
        parts.append(jarque_bera(df, cols))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    from pyspark.sql import Window
    w = Window.partitionBy("variable")
    return (out.withColumn("n_reject", F.sum((F.col("p_value") < 0.05).cast("int")).over(w))
            .withColumn("n_tests", F.count("p_value").over(w)))

