"""Linear regression and its diagnostics from moment passes.

Fit = two distributed passes over the design columns: means, then the
centred cross-product (Gram) matrix of [X, y].  Everything else --
coefficients, standard errors, t and p values, R2, AIC/BIC, VIF, nested
model F tests, slopes and marginal effects -- is p x p algebra on the
driver.  Diagnostics that need residuals (Breusch-Pagan, Durbin-Watson,
leverage) are one more pass each, with the fitted coefficients as
literals.  Aliased (collinear) columns are dropped in order and reported
as missing coefficients, as R does.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..functions.roles import col
from .design import Design, apply_design, column_expr, fit_design, parse_formula


@dataclass
class OLSFit:
    design: Design
    names: list                      # "(Intercept)" + design names
    coef: np.ndarray                 # NaN where aliased
    se: np.ndarray
    n: int
    rss: float
    tss: float
    means: np.ndarray                # of design columns
    ymean: float
    vcov: np.ndarray                 # over kept coefficients (incl. intercept), order = kept
    kept: list = field(default_factory=list)   # indices into names

    @property
    def k(self) -> int:
        return len(self.kept)

    @property
    def df_resid(self) -> int:
        return self.n - self.k

    @property
    def sigma(self) -> float:
        return math.sqrt(self.rss / self.df_resid) if self.df_resid > 0 else float("nan")

    @property
    def r2(self) -> float:
        return 1 - self.rss / self.tss if self.tss > 0 else float("nan")

    @property
    def adj_r2(self) -> float:
        p = self.k - 1
        return 1 - (1 - self.r2) * (self.n - 1) / (self.n - p - 1) if self.n - p - 1 > 0 else float("nan")

    @property
    def aic(self) -> float:
        return self.n * (math.log(2 * math.pi) + math.log(self.rss / self.n) + 1) + 2 * (self.k + 1)

    @property
    def bic(self) -> float:
        return self.n * (math.log(2 * math.pi) + math.log(self.rss / self.n) + 1) + math.log(self.n) * (self.k + 1)

    def t(self):
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.coef / self.se

    def p(self):
        return np.array([special.t_sf2(t, self.df_resid) if t == t else float("nan") for t in self.t()])

    def prediction(self) -> F.Column:
        """Lazy prediction expression over the raw columns."""
        e = F.lit(float(self.coef[0]))
        for (name, _, combo), b in zip(self.design.columns, self.coef[1:]):
            if b == b and b != 0:
                e = e + column_expr(combo) * F.lit(float(b))
        return e


def _moments(data: DataFrame, names: list[str]):
    """Pass 1: n and means; pass 2: centred cross products (upper triangle)."""
    r = data.agg(F.count(F.lit(1)).alias("n"), *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(names)]) \
        .collect()[0]
    n = r["n"]
    means = np.array([r[f"m{i}"] or 0.0 for i in range(len(names))], dtype=float)
    if len(names) > GRAM_AGG_LIMIT:
        return n, means, _gram_by_partition(data, names, means)
    cen = [col(c) - F.lit(float(m)) for c, m in zip(names, means)]
    aggs = []
    for i in range(len(names)):
        for j in range(i, len(names)):
            aggs.append(F.sum(cen[i] * cen[j]).alias(f"g{i}_{j}"))
    g = data.agg(*aggs).collect()[0]
    G = np.zeros((len(names), len(names)))
    for i in range(len(names)):
        for j in range(i, len(names)):
            G[i, j] = G[j, i] = g[f"g{i}_{j}"] or 0.0
    return n, means, G


GRAM_AGG_LIMIT = 40   # above this many columns the p^2 sums would not fit one generated method


def _gram_by_partition(data: DataFrame, names: list[str], means: np.ndarray) -> np.ndarray:
    """Centred X'X per partition in Arrow batches (numpy); one p x p row per partition is summed."""
    import pandas as pd
    mu = means.copy()
    cols = list(names)

    def part(it):
        G = np.zeros((len(cols), len(cols)))
        for pdf in it:
            if len(pdf):
                X = pdf[cols].to_numpy(dtype=float) - mu
                G += X.T @ X
        yield pd.DataFrame({"g": [G.ravel().tolist()]})
    safe = data.select(*[col(c).alias(f"__g{i}") for i, c in enumerate(cols)])
    cols = [f"__g{i}" for i in range(len(names))]
    rows = safe.mapInPandas(part, "g array<double>").collect()
    G = np.zeros((len(cols), len(cols)))
    for r in rows:
        G += np.asarray(r["g"]).reshape(len(cols), len(cols))
    return G


def _pivot_keep(G: np.ndarray, tol: float = 1e-7) -> list[int]:
    """Columns kept in order; a column whose residual after the kept ones is tiny is aliased."""
    kept = []
    for j in range(G.shape[0]):
        if G[j, j] <= 0:
            continue
        if kept:
            A = G[np.ix_(kept, kept)]
            b = G[kept, j]
            resid = G[j, j] - b @ np.linalg.solve(A, b)
        else:
            resid = G[j, j]
        if resid > tol * G[j, j]:
            kept.append(j)
    return kept


def training_adj_r2(fit: OLSFit) -> float:
    """adjusted R2 of the training rows, by the number of chosen features (a factor is one)."""
    free = fit.n - len(fit.design.variables()) - 1
    return 1 - (1 - fit.r2) * (fit.n - 1) / free if free > 0 else float("nan")


def fit_ols(df: DataFrame, formula: str, design: Design | None = None) -> OLSFit:
    """Ordinary least squares with an intercept."""
    d = design or fit_design(df, formula)
    data = apply_design(df, d)
    names = d.names + ["__y"]
    n, means, G = _moments(data, names)
    p = len(d.names)
    Gx, gxy, gyy = G[:p, :p], G[:p, p], G[p, p]
    kept = _pivot_keep(Gx)
    coef = np.full(p + 1, np.nan)
    se = np.full(p + 1, np.nan)
    if kept:
        A = Gx[np.ix_(kept, kept)]
        beta = np.linalg.solve(A, gxy[kept])
        rss = float(gyy - beta @ gxy[kept])
    else:
        beta = np.array([])
        rss = float(gyy)
    rss = max(rss, 0.0)
    ymean = float(means[p])
    intercept = ymean - (beta @ means[kept] if kept else 0.0)
    k = len(kept) + 1
    sigma2 = rss / (n - k) if n > k else float("nan")
    # covariance of (intercept, kept slopes): sigma^2 (X'X)^-1 with the intercept block
    if kept:
        Ainv = np.linalg.inv(A)
        mk = means[kept]
        v_int = sigma2 * (1.0 / n + mk @ Ainv @ mk)
        v_cross = -sigma2 * (Ainv @ mk)
        V = np.zeros((k, k))
        V[0, 0] = v_int
        V[0, 1:] = V[1:, 0] = v_cross
        V[1:, 1:] = sigma2 * Ainv
    else:
        V = np.array([[sigma2 / n]])
    coef[0] = intercept
    se[0] = math.sqrt(V[0, 0]) if V[0, 0] == V[0, 0] else float("nan")
    for idx, j in enumerate(kept):
        coef[j + 1] = beta[idx]
        se[j + 1] = math.sqrt(V[idx + 1, idx + 1])
    return OLSFit(design=d, names=["(Intercept)"] + d.names, coef=coef, se=se, n=n, rss=rss, tss=float(gyy),
                  means=means[:p], ymean=ymean, vcov=V, kept=[0] + [j + 1 for j in kept])


def coefficient_table(fit: OLSFit) -> DataFrame:
    """(term, estimate, std_error, t_value, p_value, significance, order)."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    t, p = fit.t(), fit.p()
    rows = []
    for i, name in enumerate(fit.names):
        rows.append((name, _f(fit.coef[i]), _f(fit.se[i]), _f(t[i]), _f(p[i]), special.stars(p[i]),
                     name.count(":") + 1 if i else 0))
    return spark.createDataFrame(rows, "term string, estimate double, std_error double, t_value double, "
                                       "p_value double, significance string, order int")


def _f(x):
    x = float(x)
    return None if math.isnan(x) else x


def interaction_terms(fit: OLSFit) -> DataFrame:
    """The coefficient rows of interaction terms, with stars and order."""
    return coefficient_table(fit).where(F.col("term").contains(":"))


def fit_summary(fit: OLSFit) -> dict:
    return dict(n=fit.n, k=fit.k, r2=fit.r2, adj_r2=fit.adj_r2, sigma=fit.sigma, rss=fit.rss,
                aic=fit.aic, bic=fit.bic, df_resid=fit.df_resid)


def base_formula(formula: str) -> str:
    """Main effects only."""
    target, terms = parse_formula(formula)
    return f"{target} ~ " + " + ".join(t[0] for t in terms if len(t) == 1)


def compare_models(df: DataFrame, formula: str) -> DataFrame:
    """Base (main effects) vs full: R2, adj R2, AIC, BIC, delta R2, F change, p.

    Both fits use the rows complete for the full model, as ``anova`` needs.
    """
    full_d = fit_design(df, formula)
    from .cleaning import drop_incomplete
    complete = drop_incomplete(df, [full_d.target] + full_d.variables())
    full = fit_ols(complete, formula, full_d)
    base = fit_ols(complete, base_formula(formula))
    df_num = full.k - base.k
    fchg = ((base.rss - full.rss) / df_num) / (full.rss / full.df_resid) if df_num > 0 else float("nan")
    pchg = special.f_sf(fchg, df_num, full.df_resid) if df_num > 0 else float("nan")
    spark = df.sparkSession
    return spark.createDataFrame([
        ("Base (Main Effects)", base.r2, base.adj_r2, base.aic, base.bic, None, None, None),
        ("Full (With Interactions)", full.r2, full.adj_r2, full.aic, full.bic, full.r2 - base.r2, _f(fchg), _f(pchg)),
    ], "model string, r2 double, adj_r2 double, aic double, bic double, delta_r2 double, f_change double, "
       "p_f_change double")


def _coef_of(fit: OLSFit, name: str):
    if name in fit.names:
        v = fit.coef[fit.names.index(name)]
        return 0.0 if v != v else float(v)
    return 0.0


def _interaction_name(fit: OLSFit, a: str, b: str):
    for nm in (f"{a}:{b}", f"{b}:{a}"):
        if nm in fit.names:
            return nm
    return None


def simple_slopes(fit: OLSFit, df: DataFrame, predictor: str, moderator: str) -> DataFrame:
    """b1 + b3 m at m = mean - sd, mean, mean + sd of the moderator."""
    r = df.agg(F.avg(col(moderator)).alias("m"), F.stddev_samp(col(moderator)).alias("s")).collect()[0]
    b1 = _coef_of(fit, predictor)
    nm = _interaction_name(fit, predictor, moderator)
    b3 = _coef_of(fit, nm) if nm else 0.0
    rows = [(lab, float(v), b1 + b3 * v) for lab, v in
            (("Low (-1 SD)", r["m"] - r["s"]), ("Mean", r["m"]), ("High (+1 SD)", r["m"] + r["s"]))]
    return df.sparkSession.createDataFrame(rows, "moderator_level string, mod_value double, slope double")


def marginal_effects(fit: OLSFit, df: DataFrame, predictor: str, moderator: str, n_points: int = 50) -> DataFrame:
    """b1 + b3 m over n points min..max of the moderator, 95% band by the delta method."""
    r = df.agg(F.min(col(moderator)).alias("lo"), F.max(col(moderator)).alias("hi")).collect()[0]
    lo, hi = float(r["lo"]), float(r["hi"])
    grid = [lo + i * ((hi - lo) / (n_points - 1)) for i in range(n_points - 1)] + [hi]
    b1 = _coef_of(fit, predictor)
    nm = _interaction_name(fit, predictor, moderator)
    b3 = _coef_of(fit, nm) if nm else 0.0
    kept_names = [fit.names[i] for i in fit.kept]

    def v(a, b):
        if a in kept_names and b in kept_names:
            return float(fit.vcov[kept_names.index(a), kept_names.index(b)])
        return 0.0
    v11 = v(predictor, predictor)
    v33 = v(nm, nm) if nm else 0.0
    v13 = v(predictor, nm) if nm else 0.0
    rows = []
    for m in grid:
        me = b1 + b3 * m
        se = math.sqrt(max(v11 + m * m * v33 + 2 * m * v13, 0.0))
        rows.append((m, me, me - 1.96 * se, me + 1.96 * se))
    return df.sparkSession.createDataFrame(
        rows, "moderator_value double, marginal_effect double, lower_ci double, upper_ci double")


def vif(df: DataFrame, fit: OLSFit) -> DataFrame:
    """(generalised) VIF per term from the predictors' correlation matrix.

    GVIF = det(R11) det(R22) / det(R), R11 = the term's columns; equals
    the VIF for a one-column term. Needs >= 2 terms.
    """
    d = fit.design
    if len(d.terms) < 2:
        raise ValueError("At least 2 variables are required for VIF.")
    data = apply_design(df, d)
    _, _, G = _moments(data, d.names)
    sd = np.sqrt(np.diag(G))
    R = G / np.outer(sd, sd)
    det_all = np.linalg.det(R)
    rows = []
    for ti, t in enumerate(d.terms):
        idx = [i for i, c in enumerate(d.columns) if c[1] == ti]
        rest = [i for i in range(len(d.columns)) if i not in idx]
        g = np.linalg.det(R[np.ix_(idx, idx)]) * (np.linalg.det(R[np.ix_(rest, rest)]) if rest else 1.0) / det_all
        status = "High (>10)" if g > 10 else ("Moderate (5-10)" if g > 5 else "OK (<5)")
        rows.append((":".join(t), float(g), status))
    return df.sparkSession.createDataFrame(rows, "variable string, vif double, status string")


def breusch_pagan(df: DataFrame, fit: OLSFit) -> DataFrame:
    """Studentised Breusch-Pagan: n * R2 of e^2 on the regressors, chi-square(p)."""
    d = fit.design
    data = apply_design(df, d).withColumn("__e2", F.pow(F.col("__y") - _pred_design(fit), 2))
    n, means, G = _moments(data, d.names + ["__e2"])
    p = len(d.names)
    kept = _pivot_keep(G[:p, :p])
    A = G[np.ix_(kept, kept)]
    b = G[kept, p]
    r2 = float(b @ np.linalg.solve(A, b) / G[p, p]) if G[p, p] > 0 else float("nan")
    stat = n * r2
    dfree = len(kept)
    return df.sparkSession.createDataFrame([(float(stat), dfree, special.chi2_sf(stat, dfree))],
                                           "bp double, df int, p_value double")


#: Rows that one window of neighbouring rows holds.
CHUNK = 100_000


def durbin_watson(df: DataFrame, fit: OLSFit, order_by: str) -> DataFrame:
    """``dw`` = sum (e_t - e_{t-1})^2 / sum e_t^2 in ``order_by`` order, with its moments under independence.

    Rows get a global position; runs of :data:`CHUNK` positions, each with the row before and the row
    after it, are windows of their own, so that neither a self-join nor one task sees all rows.  The same pass
    sums what ``expected`` and ``variance`` of the statistic need: with A the matrix of squared differences,
    X'AX and (AX)'(AX) (Durbin and Watson 1950).  ``p_value`` is one-sided (positive autocorrelation), by the normal approximation.
    """
    from pyspark.sql import Window

    from ..functions.rowindex import with_row_index
    d = fit.design
    used = [i - 1 for i in fit.kept[1:]]
    names = [d.names[j] for j in used]
    p = len(names)
    data = apply_design(df, d, keep=[order_by])
    rows = data.select(col(order_by).alias("__o"), (F.col("__y") - _pred_design(fit)).alias("e"),
                       F.array(*[col(c) - F.lit(float(fit.means[j])) for c, j in zip(names, used)]).cast("array<double>").alias("x"))
    placed = with_row_index(rows, ["__o"], "t").select("t", "e", "x")
    own = F.floor((F.col("t") - 1) / CHUNK)
    runs = F.array_distinct(F.array(own, F.floor((F.col("t") - 2) / CHUNK), F.floor(F.col("t") / CHUNK)))
    near = placed.withColumn("own", own).withColumn("run", F.explode(runs)).where("run >= 0")
    order = Window.partitionBy("run").orderBy("t")
    seen = near.select("e", "x", "run", "own", *[f(F.col(c)).over(order).alias(f"{c}{k}") for c in ("e", "x") for k, f in ((0, F.lag), (1, F.lead))])
    back = [F.col("x")[j] - F.col("x0")[j] for j in range(p)]  # null in the first row
    ax = [F.coalesce(back[j], F.lit(0.0)) + F.coalesce(F.col("x")[j] - F.col("x1")[j], F.lit(0.0)) for j in range(p)]
    sums = {"num": F.pow(F.col("e") - F.col("e0"), 2), "den": F.pow(F.col("e"), 2)}
    sums |= {f"b{i}_{j}": back[i] * back[j] for i in range(p) for j in range(i, p)}
    sums |= {f"c{i}_{j}": ax[i] * ax[j] for i in range(p) for j in range(i, p)}
    r = seen.where("run = own").agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(k) for k, v in sums.items()]).first()

    def matrix(letter):
        return np.array([[r[f"{letter}{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]).reshape(p, p)

    n, k = fit.n, fit.k
    inverse = fit.vcov[1:, 1:] / fit.sigma ** 2 if p else np.zeros((0, 0))
    turned = matrix("b") @ inverse
    trace = 2 * (n - 1) - float(np.trace(turned))
    square = 2 * (3 * n - 4) - 2 * float(np.trace(matrix("c") @ inverse)) + float(np.trace(turned @ turned))
    free = n - k
    expected = trace / free
    variance = 2 * (square - trace * expected) / (free * (free + 2))
    dw = r["num"] / r["den"] if r["den"] else float("nan")
    p_value = special.norm_cdf((dw - expected) / math.sqrt(variance)) if variance > 0 else float("nan")
    return df.sparkSession.createDataFrame([(float(dw), p_value, expected, variance)],
                                           "dw double, p_value double, expected double, variance double")


def _pred_design(fit: OLSFit):
    pred = F.lit(float(fit.coef[0]))
    for name, b in zip(fit.design.names, fit.coef[1:]):
        if b == b and b != 0:
            pred = pred + col(name) * F.lit(float(b))
    return pred


def scale_location(df: DataFrame, fit: OLSFit, bins: int = 30) -> DataFrame:
    """Fitted vs sqrt(|standardised residual|), leverage h = x'(X'X)^-1 x with the
    small inverse as literals; the smooth line is the mean per fitted-value bin."""
    d = fit.design
    data = apply_design(df, d)
    kept = [i - 1 for i in fit.kept[1:]]
    # (X'X)^-1 with intercept = V / sigma^2
    s2 = fit.sigma ** 2
    Xi = fit.vcov / s2
    xs = [F.lit(1.0)] + [col(d.names[j]) for j in kept]
    h = None
    for a in range(len(xs)):
        for b in range(len(xs)):
            term = xs[a] * xs[b] * F.lit(float(Xi[a, b]))
            h = term if h is None else h + term
    fitted = _pred_design(fit)
    pts = data.select(fitted.alias("fitted"),
                      F.sqrt(F.abs((F.col("__y") - fitted) / (F.lit(fit.sigma) * F.sqrt(1 - h)))).alias("y"))
    r = pts.agg(F.min("fitted").alias("lo"), F.max("fitted").alias("hi")).collect()[0]
    w = (r["hi"] - r["lo"]) / bins if r["hi"] > r["lo"] else 1.0
    b = F.least(F.floor((F.col("fitted") - F.lit(r["lo"])) / F.lit(w)), F.lit(bins - 1)).cast("int")
    return (pts.groupBy(b.alias("bin")).agg(F.avg("fitted").alias("fitted"), F.avg("y").alias("smooth"),
                                             F.count(F.lit(1)).alias("n")).orderBy("bin"))


def predict(df: DataFrame, fit: OLSFit, out: str = "prediction") -> DataFrame:
    """Lazy prediction column."""
    return df.withColumn(out, fit.prediction())
