"""Registered queries: design matrix and linear regression with diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import design as D
from ..operators import linear as L
from . import fixtures as fx
from . import ols_sql as SQL
from .registry import register, rounded, rsql


@register("f3_design_matrix_treatment", """
SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS o_orderstatusO,
  CAST(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS o_orderstatusP,
  CAST(o_custkey AS DOUBLE) AS o_custkey,
  CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END * CAST(o_custkey AS DOUBLE) AS o_orderstatusO_x_o_custkey,
  CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END * CAST(o_custkey AS DOUBLE) AS o_orderstatusP_x_o_custkey,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END * CAST(o_custkey AS DOUBLE)
    AS o_orderpriority1_URGENT_x_o_custkey
FROM orders""")
def f3_design_matrix(spark, sf):
    from ..operators.formula import build_formula
    o = fx.t(spark, sf, "orders").withColumn(
        "o_orderpriority", F.when(F.col("o_orderpriority") == "1-URGENT", "1_URGENT").otherwise("0_other"))
    f = build_formula("o_totalprice", ["o_orderstatus", "o_custkey"], True, ["o_orderstatus", "o_custkey"])
    f += " + o_orderpriority:o_custkey"
    d = D.fit_design(o, f)
    m = D.apply_design(o, d, keep=["o_orderkey"], with_target=False)
    m = m.drop("o_orderpriority0_other:o_custkey")
    return m.select(*[F.col(f"`{c}`").alias(c.replace(":", "_x_")) for c in m.columns])


LIN_SQL = f"(SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS x, {fx.LIN_TARGET} AS y FROM lineitem)"


def lin_frame(spark, sf):
    return fx.t(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
        F.col("l_quantity").cast("double").alias("x"), F.expr(fx.LIN_TARGET).alias("y"))


def _ols1_sql(src):
    return f"""
WITH s AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_count(y, x) AS n, regr_sxx(y, x) AS sxx,
                  regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, regr_avgx(y, x) AS mx FROM {src} AS d),
r AS (SELECT *, (syy - b * sxy) / (n - 2) AS s2 FROM s)"""


@register("r1_ols_coefficients_one_feature", rsql(_ols1_sql(LIN_SQL) + """
SELECT '(Intercept)' AS term, a AS estimate, sqrt(s2 * (1.0 / n + mx * mx / sxx)) AS std_error,
  a / sqrt(s2 * (1.0 / n + mx * mx / sxx)) AS t_value FROM r
UNION ALL SELECT 'x', b, sqrt(s2 / sxx), b / sqrt(s2 / sxx) FROM r""", ["estimate", "std_error", "t_value"], 4))
def r1_ols_one(spark, sf):
    fit = L.fit_ols(lin_frame(spark, sf), "y ~ x")
    return rounded(L.coefficient_table(fit).select("term", "estimate", "std_error", "t_value"), 4)


@register("r1_ols_planted_three_features", rsql(
    SQL.ols(f"(SELECT l_quantity, l_discount, l_linenumber, {fx.LIN_TARGET} AS y FROM lineitem)",
            ["l_quantity", "l_discount", "l_linenumber"])
    + SQL.coefficient_rows(["l_quantity", "l_discount", "l_linenumber"]), ["estimate", "std_error", "t_value"], 4))
def r1_ols_planted(spark, sf):
    fit = L.fit_ols(lin_frame(spark, sf), "y ~ l_quantity + l_discount + l_linenumber")
    return rounded(L.coefficient_table(fit).select("term", "estimate", "std_error", "t_value"), 4)


@register("r9_ols_predictions", rsql(_ols1_sql(LIN_SQL) + f"""
SELECT l_orderkey, l_linenumber, y, a + b * x AS prediction FROM {LIN_SQL} AS d, r""", ["y", "prediction"], 4))
def r9_predict(spark, sf):
    df = lin_frame(spark, sf)
    fit = L.fit_ols(df, "y ~ x")
    return rounded(L.predict(df, fit).select("l_orderkey", "l_linenumber", "y", "prediction"), 4)


@register("f5_f7_fit_statistics", rsql(
    SQL.ols(f"(SELECT l_quantity, l_discount, l_linenumber, {fx.LIN_TARGET} AS y FROM lineitem)",
            ["l_quantity", "l_discount", "l_linenumber"])
    + f" SELECT {SQL.statistics(3)}, sqrt(s2) AS sigma FROM fit", ["r2", "adj_r2", "aic", "bic", "sigma"], 4))
def f5_f7_fit_stats(spark, sf):
    df = lin_frame(spark, sf)
    fit = L.fit_ols(df, "y ~ l_quantity + l_discount + l_linenumber")
    s = L.fit_summary(fit)
    return rounded(spark.createDataFrame([tuple(float(s[k]) for k in ("r2", "adj_r2", "aic", "bic", "sigma"))],
                                         "r2 double, adj_r2 double, aic double, bic double, sigma double"), 4)


DW_SQL = "(SELECT event_id, CAST(event_id % 10 AS DOUBLE) AS x, value AS y FROM events)"


def dw_frame(spark, sf):
    return fx.t(spark, sf, "events").select("event_id", F.expr("CAST(event_id % 10 AS DOUBLE)").alias("x"),
                                            F.col("value").alias("y"))


@register("r15_durbin_watson", rsql(_ols1_sql(DW_SQL) + f"""
, e AS (SELECT event_id, y - (a + b * x) AS e FROM {DW_SQL} AS d, r)
SELECT sum(CASE WHEN ep IS NOT NULL THEN (e - ep) * (e - ep) END) / sum(e * e) AS dw
FROM (SELECT e, lag(e) OVER (ORDER BY event_id) AS ep FROM e) AS z""", ["dw"]))
def r15_dw(spark, sf):
    df = dw_frame(spark, sf)
    fit = L.fit_ols(df, "y ~ x")
    return rounded(L.durbin_watson(df, fit, "event_id").select("dw"))


# one centred regressor v: X'AX is the sum of squared steps of v, (AX)'(AX) that of its second differences
@register("r15_durbin_watson_moments", rsql(_ols1_sql(DW_SQL) + f"""
, e AS (SELECT event_id, x, y - (a + b * x) AS e FROM {DW_SQL} AS d, r),
z AS (SELECT e, x, lag(e) OVER w AS ep, lag(x) OVER w AS xp, lead(x) OVER w AS xn FROM e WINDOW w AS (ORDER BY event_id)),
q AS (SELECT count(*) AS m, sum((e - ep) * (e - ep)) / sum(e * e) AS dw, var_pop(x) * count(*) AS sxx, sum((x - xp) * (x - xp)) AS b,
    sum(power(coalesce(x - xp, 0) + coalesce(x - xn, 0), 2)) AS c FROM z),
t AS (SELECT *, (2 * (m - 1) - b / sxx) / (m - 2) AS expected, 2 * (3 * m - 4) - 2 * c / sxx + power(b / sxx, 2) AS square FROM q)
SELECT dw, expected, 2 * (square - (2 * (m - 1) - b / sxx) * expected) / ((m - 2) * CAST(m AS DOUBLE)) AS variance FROM t""",
                                               ["dw", "expected", "variance"], 8))
def r15_moments(spark, sf):
    df = dw_frame(spark, sf)
    return rounded(L.durbin_watson(df, L.fit_ols(df, "y ~ x"), "event_id").drop("p_value"), 8)


@register("f5_training_adj_r2_with_factor", rsql(
    SQL.ols("(SELECT l_quantity, l_discount, (l_returnflag = 'N')::INT AS fn, (l_returnflag = 'R')::INT AS fr, "
            f"{fx.LIN_TARGET} AS y FROM lineitem)", ["l_quantity", "l_discount", "fn", "fr"])
    + " SELECT 1 - rss / tss AS r2, 1 - (rss / tss) * (n - 1) / (n - 3 - 1) AS adj_r2 FROM fit", ["r2", "adj_r2"], 8))
def f5_factor(spark, sf):
    """A factor with three levels is one chosen feature."""
    df = fx.t(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_returnflag", F.expr(fx.LIN_TARGET).alias("y"))
    fit = L.fit_ols(df, "y ~ l_quantity + l_discount + l_returnflag")
    return rounded(spark.createDataFrame([(float(fit.r2), L.training_adj_r2(fit))], "r2 double, adj_r2 double"), 8)


@register("r14_breusch_pagan", rsql(_ols1_sql(DW_SQL) + f"""
, e AS (SELECT x, power(y - (a + b * x), 2) AS e2 FROM {DW_SQL} AS d, r)
SELECT count(*) * power(corr(e2, x), 2) AS bp, 1 AS df FROM e""", ["bp"]))
def r14_bp(spark, sf):
    df = dw_frame(spark, sf)
    fit = L.fit_ols(df, "y ~ x")
    return rounded(L.breusch_pagan(df, fit).select("bp", "df"))


VIF_SQL = "(SELECT CAST(l_quantity AS DOUBLE) AS a, l_quantity + 300 * l_discount + l_tax * 50 AS b, l_tax AS c, " \
          f"{fx.LIN_TARGET} AS y FROM lineitem)"


@register("r13_vif", rsql(f"""
WITH r AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM {VIF_SQL} AS s),
d AS (SELECT *, 1 - ab * ab - ac * ac - bc * bc + 2 * ab * ac * bc AS det FROM r)
SELECT 'a' AS variable, (1 - bc * bc) / det AS vif FROM d
UNION ALL SELECT 'b', (1 - ac * ac) / det FROM d UNION ALL SELECT 'c', (1 - ab * ab) / det FROM d""", ["vif"], 4))
def r13_vif(spark, sf):
    df = fx.t(spark, sf, "lineitem").select(
        F.col("l_quantity").cast("double").alias("a"),
        (F.col("l_quantity") + 300 * F.col("l_discount") + F.col("l_tax") * 50).alias("b"),
        F.col("l_tax").alias("c"), F.expr(fx.LIN_TARGET).alias("y"))
    fit = L.fit_ols(df, "y ~ a + b + c")
    return rounded(L.vif(df, fit).select("variable", "vif"), 4)


INTER_F = "y ~ l_quantity * l_linenumber + l_tax"
INTER_X = ["l_quantity", "l_linenumber", "l_tax", "l_quantity * l_linenumber"]
INTER_NAMES = ["l_quantity", "l_linenumber", "l_tax", "l_quantity:l_linenumber"]
INTER_SQL = f"(SELECT l_quantity, l_linenumber, l_tax, {fx.INTER_TARGET} AS y FROM lineitem)"
INTER_FIT = SQL.ols(INTER_SQL, INTER_X)
# moderator values: mean and a standard deviation to both sides
INTER_MOD = """, md AS (SELECT avg(l_linenumber) AS mm, stddev_samp(l_linenumber) AS ms, min(l_linenumber) AS lo,
  max(l_linenumber) AS hi, min(l_quantity) AS qlo, max(l_quantity) AS qhi, avg(l_tax) AS mt, regr_slope(l_tax, l_quantity) AS rt, avg(l_quantity) AS mq FROM lineitem),
lv AS (SELECT 'Low (-1 SD)' AS level, mm - ms AS v FROM md UNION ALL SELECT 'Mean', mm FROM md
       UNION ALL SELECT 'High (+1 SD)', mm + ms FROM md)
"""


def inter_frame(spark, sf):
    return fx.t(spark, sf, "lineitem").select(
        "l_quantity", "l_linenumber", "l_tax", F.expr(fx.INTER_TARGET).alias("y"))


@register("r17_r18_interaction_terms", rsql(INTER_FIT + SQL.coefficient_rows(INTER_NAMES, 4),
                                             ["estimate", "std_error", "t_value"], 4))
def r18_interactions(spark, sf):
    fit = L.fit_ols(inter_frame(spark, sf), INTER_F)
    return rounded(L.interaction_terms(fit).select("term", "estimate", "std_error", "t_value"), 4)


@register("r17_coefficient_summary", rsql(INTER_FIT + SQL.coefficient_rows(INTER_NAMES),
                                           ["estimate", "std_error", "t_value"], 4))
def r17_summary(spark, sf):
    fit = L.fit_ols(inter_frame(spark, sf), INTER_F)
    return rounded(L.coefficient_table(fit).select("term", "estimate", "std_error", "t_value"), 4)


@register("r17_p_values_and_stars")
def r17_p_values(spark, sf):
    fit = L.fit_ols(inter_frame(spark, sf), INTER_F)
    return rounded(L.coefficient_table(fit), 6)


def _compare_sql():
    full = f"({INTER_FIT} SELECT n, rss, tss, {SQL.statistics(4)} FROM fit)"
    base = f"({SQL.ols(INTER_SQL, INTER_X[:3])} SELECT n, rss, tss, {SQL.statistics(3)} FROM fit)"
    return f"""
SELECT 'Base (Main Effects)' AS model, b.r2, b.adj_r2, b.aic, b.bic, NULL::DOUBLE AS delta_r2, NULL::DOUBLE AS f_change
FROM {base} AS b
UNION ALL SELECT 'Full (With Interactions)', f.r2, f.adj_r2, f.aic, f.bic, f.r2 - b.r2,
  (b.rss - f.rss) / (f.rss / (f.n - 5)) FROM {base} AS b, {full} AS f"""


@register("r19_r20_compare_models", rsql(_compare_sql(), ["r2", "adj_r2", "aic", "bic", "delta_r2", "f_change"], 1))
def r20_compare_closed(spark, sf):
    return rounded(L.compare_models(inter_frame(spark, sf), INTER_F).drop("p_f_change"), 1)


@register("r19_r20_compare_base_full")
def r20_compare(spark, sf):
    return rounded(L.compare_models(inter_frame(spark, sf), INTER_F), 4)


@register("r21_simple_slopes", rsql(INTER_FIT + INTER_MOD + """
SELECT level AS moderator_level, v AS mod_value, b1 + b4 * v AS slope FROM fit, lv""", ["mod_value", "slope"], 4))
def r21_slopes(spark, sf):
    df = inter_frame(spark, sf)
    fit = L.fit_ols(df, INTER_F)
    return rounded(L.simple_slopes(fit, df, "l_quantity", "l_linenumber"), 4)


@register("r22_marginal_effects", rsql(INTER_FIT + INTER_MOD.rstrip() + f""",
g AS (SELECT lo + i * ((hi - lo) / 49.0) AS v FROM md, range(50) AS r(i)),
e AS (SELECT v, b1 + b4 * v AS me, sqrt(s2 * ({SQL.c(1, 1)} + v * v * {SQL.c(4, 4)} + 2 * v * {SQL.c(1, 4)})) AS se
      FROM g, fit)
SELECT v AS moderator_value, me AS marginal_effect, me - 1.96 * se AS lower_ci, me + 1.96 * se AS upper_ci FROM e""",
                                       ["moderator_value", "marginal_effect", "lower_ci", "upper_ci"], 4))
def r22_marginal(spark, sf):
    df = inter_frame(spark, sf)
    fit = L.fit_ols(df, INTER_F)
    return rounded(L.marginal_effects(fit, df, "l_quantity", "l_linenumber"), 4)


@register("r16_scale_location", rsql(INTER_FIT + f""",
h AS (SELECT b0 + b1 * x1 + b2 * x2 + b3 * x3 + b4 * x4 AS fitted, oy, s2,
    1.0 / n + {" + ".join(f"(x{i} - m{i}) * (x{j} - m{j}) * {SQL.c(i, j)}" for i in range(1, 5) for j in range(1, 5))} AS lev
  FROM o0, fit),
q AS (SELECT fitted, sqrt(abs((oy - fitted) / (sqrt(s2) * sqrt(1 - lev)))) AS y FROM h),
w AS (SELECT min(fitted) AS lo, (max(fitted) - min(fitted)) / 30 AS w FROM q)
SELECT CAST(least(floor((fitted - lo) / w), 29) AS INTEGER) AS bin, avg(fitted) AS fitted, avg(y) AS smooth, count(*) AS n
FROM q, w GROUP BY 1""", ["fitted", "smooth"], 4))
def r16_scale_location(spark, sf):
    df = inter_frame(spark, sf)
    fit = L.fit_ols(df, INTER_F)
    return rounded(L.scale_location(df, fit), 4)


# ---- residual and interaction plot data (R11, R12, R23-R26) -----------------

from ..operators import interactions as I  # noqa: E402


@register("r11_residual_points", rsql(_ols1_sql(LIN_SQL) + f"""
SELECT l_orderkey, l_linenumber, y AS actual, a + b * x AS predicted, y - (a + b * x) AS residual
FROM {LIN_SQL} AS d, r""", ["actual", "predicted", "residual"], 4))
def r11_points(spark, sf):
    df = lin_frame(spark, sf)
    fit = L.fit_ols(df, "y ~ x")
    return rounded(I.residual_points(df, fit, keep=["l_orderkey", "l_linenumber"]), 4)


@register("r12_residual_histogram", rsql(_ols1_sql(LIN_SQL) + f"""
, e AS (SELECT y - (a + b * x) AS e FROM {LIN_SQL} AS d, r),
m AS (SELECT min(e) AS lo, max(e) AS hi FROM e),
c AS (SELECT CAST(least(floor((e - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, count(*) AS n FROM e, m GROUP BY 1)
SELECT CAST(g.range AS INTEGER) AS bin, lo + g.range * ((hi - lo) / 30) AS lower,
  lo + (g.range + 1) * ((hi - lo) / 30) AS upper, coalesce(c.n, 0) AS count
FROM range(30) AS g, m LEFT JOIN c ON c.bin = g.range""", ["lower", "upper"], 3))
def r12_histogram(spark, sf):
    df = lin_frame(spark, sf)
    fit = L.fit_ols(df, "y ~ x")
    return rounded(I.residual_histogram(df, fit), 3)


@register("r12_residual_qq")
def r12_qq(spark, sf):
    df = lin_frame(spark, sf)
    fit = L.fit_ols(df, "y ~ x")
    return rounded(I.residual_qq(df, fit), 6)


@register("r23_interaction_grid_numeric", rsql(INTER_FIT + INTER_MOD + """
SELECT qlo + i * ((qhi - qlo) / 99.0) AS x, replace(level, ' SD', 'SD') AS level,
  b0 + b1 * (qlo + i * ((qhi - qlo) / 99.0)) + b2 * v + b3 * mt + b4 * (qlo + i * ((qhi - qlo) / 99.0)) * v AS pred
FROM fit, md, lv, range(100) AS r(i)""", ["x", "pred"], 4))
def r23_grid(spark, sf):
    df = inter_frame(spark, sf)
    fit = L.fit_ols(df, INTER_F)
    return rounded(I.interaction_grid(df, fit, "l_quantity", "l_linenumber"), 4)


def _cat_inter_frame(spark, sf):
    return fx.t(spark, sf, "lineitem").select("l_quantity", "l_returnflag", "l_linestatus",
                                               F.expr(fx.INTER_TARGET).alias("y"))


CAT_SQL = f"(SELECT l_quantity, l_returnflag, l_linestatus, {fx.INTER_TARGET} AS y FROM lineitem)"
_N, _R, _O = "(l_returnflag = 'N')::INT", "(l_returnflag = 'R')::INT", "(l_linestatus = 'O')::INT"


@register("r24_interaction_grid_numeric_by_level", rsql(
    SQL.ols(CAT_SQL, ["l_quantity", _N, _R, _O, f"l_quantity * {_N}", f"l_quantity * {_R}"]) + """,
g AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
p AS (SELECT lo + i * ((hi - lo) / 99.0) AS x FROM g, range(100) AS r(i))
SELECT x, f AS level, b0 + b1 * x + (CASE f WHEN 'N' THEN b2 + b5 * x WHEN 'R' THEN b3 + b6 * x ELSE 0 END) AS pred
FROM p, fit, (VALUES ('A'), ('N'), ('R')) AS l(f)""", ["x", "pred"], 4))
def r24_grid(spark, sf):
    df = _cat_inter_frame(spark, sf)
    fit = L.fit_ols(df, "y ~ l_quantity * l_returnflag + l_linestatus")
    return rounded(I.interaction_grid(df, fit, "l_quantity", "l_returnflag"), 4)


@register("r25_interaction_grid_level_pairs", rsql(
    SQL.ols(CAT_SQL, [_N, _R, _O, "l_quantity", f"{_N} * {_O}", f"{_R} * {_O}"]) + """
SELECT f AS x, s AS level, b0 + b4 * m4 + (CASE f WHEN 'N' THEN b1 WHEN 'R' THEN b2 ELSE 0 END)
  + (CASE s WHEN 'O' THEN b3 + (CASE f WHEN 'N' THEN b5 WHEN 'R' THEN b6 ELSE 0 END) ELSE 0 END) AS pred
FROM fit, (VALUES ('A'), ('N'), ('R')) AS l(f), (VALUES ('F'), ('O')) AS k(s)""", ["pred"], 4))
def r25_grid(spark, sf):
    df = _cat_inter_frame(spark, sf)
    fit = L.fit_ols(df, "y ~ l_returnflag * l_linestatus + l_quantity")
    return rounded(I.interaction_grid(df, fit, "l_returnflag", "l_linestatus"), 4)


@register("r26_interaction_lines_and_refit", rsql(INTER_FIT + INTER_MOD + """
SELECT replace(level, ' SD', 'SD') AS level, b1 + b4 * v + b3 * rt AS slope, b0 + b2 * v + b3 * (mt - rt * mq) AS intercept,
  CAST(n AS BIGINT) AS n FROM fit, md, lv""",
                                                   ["slope", "intercept"], 4))
def r26_lines(spark, sf):
    df = inter_frame(spark, sf)
    fit, table = I.interaction_refit(df, "y", ["l_quantity", "l_linenumber", "l_tax"], ["l_quantity", "l_linenumber"])
    lines = I.interaction_lines(df, fit, "l_quantity", "l_linenumber")
    return rounded(lines, 4)


@register("f5_f7_fit_statistics_one_feature", rsql(_ols1_sql(LIN_SQL) + """
, f AS (SELECT *, syy - b * sxy AS rss FROM r)
SELECT 1 - rss / syy AS r2, 1 - (rss / syy) * (n - 1) / (n - 1 - 1) AS adj_r2,
  n * (ln(2 * pi()) + ln(rss / n) + 1) + 2 * (2 + 1) AS aic,
  n * (ln(2 * pi()) + ln(rss / n) + 1) + ln(n) * (2 + 1) AS bic, sqrt(rss / (n - 2)) AS sigma FROM f""",
                                                   ["r2", "adj_r2", "aic", "bic", "sigma"], 4))
def f5_f7_one(spark, sf):
    fit = L.fit_ols(lin_frame(spark, sf), "y ~ x")
    s = L.fit_summary(fit)
    return rounded(spark.createDataFrame([tuple(float(s[k]) for k in ("r2", "adj_r2", "aic", "bic", "sigma"))],
                                         "r2 double, adj_r2 double, aic double, bic double, sigma double"), 4)


def _ols3_sql():
    # three regressors: beta = S^-1 s_xy by Cramer's rule on the sample covariance matrix
    return f"""
WITH d AS (SELECT CAST(l_quantity AS DOUBLE) AS a, l_discount AS b, CAST(l_linenumber AS DOUBLE) AS c,
                  {fx.LIN_TARGET} AS y FROM lineitem),
m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(y) AS my,
             covar_samp(a, a) AS s11, covar_samp(a, b) AS s12, covar_samp(a, c) AS s13,
             covar_samp(b, b) AS s22, covar_samp(b, c) AS s23, covar_samp(c, c) AS s33,
             covar_samp(a, y) AS t1, covar_samp(b, y) AS t2, covar_samp(c, y) AS t3 FROM d),
k AS (SELECT *, s11 * (s22 * s33 - s23 * s23) - s12 * (s12 * s33 - s23 * s13) + s13 * (s12 * s23 - s22 * s13) AS det
      FROM m),
b AS (SELECT *,
  (t1 * (s22 * s33 - s23 * s23) - s12 * (t2 * s33 - s23 * t3) + s13 * (t2 * s23 - s22 * t3)) / det AS b1,
  (s11 * (t2 * s33 - t3 * s23) - t1 * (s12 * s33 - s23 * s13) + s13 * (s12 * t3 - t2 * s13)) / det AS b2,
  (s11 * (s22 * t3 - s23 * t2) - s12 * (s12 * t3 - t2 * s13) + t1 * (s12 * s23 - s22 * s13)) / det AS b3 FROM k)
SELECT '(Intercept)' AS term, my - b1 * ma - b2 * mb - b3 * mc AS estimate FROM b
UNION ALL SELECT 'l_quantity', b1 FROM b UNION ALL SELECT 'l_discount', b2 FROM b
UNION ALL SELECT 'l_linenumber', b3 FROM b"""


@register("r1_ols_coefficients_three_features", rsql(_ols3_sql(), ["estimate"], 6))
def r1_ols_three(spark, sf):
    fit = L.fit_ols(lin_frame(spark, sf), "y ~ l_quantity + l_discount + l_linenumber")
    return rounded(L.coefficient_table(fit).select("term", "estimate"), 6)
