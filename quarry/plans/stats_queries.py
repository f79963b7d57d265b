"""Registered queries: plot statistics and normality tests (G*, E24-E28)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import normality as N
from ..operators import plotdata as G
from . import fixtures as fx
from .registry import register, rounded, rsql


@register("g1_histogram_30_bins", rsql("""
WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
c AS (SELECT CAST(least(floor((value - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, count(*) AS n
      FROM events, r GROUP BY 1)
SELECT CAST(g.range AS INTEGER) AS bin, lo + g.range * ((hi - lo) / 30) AS lower,
  lo + (g.range + 1) * ((hi - lo) / 30) AS upper, coalesce(c.n, 0) AS count
FROM range(30) AS g, r LEFT JOIN c ON c.bin = g.range""", ["lower", "upper"]))
def g1_histogram(spark, sf):
    return rounded(G.histogram(fx.t(spark, sf, "events"), "value", 30))


@register("g3_bar_counts", "SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1")
def g3_bar(spark, sf):
    return G.bar_counts(fx.t(spark, sf, "events"), "event_type")


@register("g4_box_stats_by_group", rsql("""
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                  quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT e.event_type, q1, median, q3,
  min(CASE WHEN value >= q1 - 1.5 * (q3 - q1) THEN value END) AS whisker_low,
  max(CASE WHEN value <= q3 + 1.5 * (q3 - q1) THEN value END) AS whisker_high,
  count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_outliers,
  count(*) AS n
FROM events e JOIN q USING (event_type) GROUP BY e.event_type, q1, median, q3""",
                                           ["q1", "median", "q3", "whisker_low", "whisker_high"]))
def g4_box(spark, sf):
    return rounded(G.box_stats(fx.t(spark, sf, "events"), "value", "event_type"))


@register("g4_box_outlier_rows", rsql("""
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, 'all' AS "group", value FROM events, q
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""", ["value"]))
def g4_outliers(spark, sf):
    return rounded(G.box_outliers(fx.t(spark, sf, "events"), "value", keep=["event_id"]))


@register("g6_scatter_2d_bins", rsql("""
WITH r AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0,
                  max(l_extendedprice) AS y1 FROM lineitem),
b AS (SELECT CAST(least(floor((l_quantity - x0) / ((x1 - x0) / 20)), 19) AS INTEGER) AS bin_x,
             CAST(least(floor((l_extendedprice - y0) / ((y1 - y0) / 20)), 19) AS INTEGER) AS bin_y
      FROM lineitem, r)
SELECT bin_x, bin_y, count(*) AS count, x0 + bin_x * ((x1 - x0) / 20) AS x_low, y0 + bin_y * ((y1 - y0) / 20) AS y_low
FROM b, r GROUP BY bin_x, bin_y, x0, x1, y0, y1""", ["x_low", "y_low"]))
def g6_scatter_bins(spark, sf):
    li = fx.t(spark, sf, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("double"))
    return rounded(G.scatter_bins(li, "l_quantity", "l_extendedprice", 20))


@register("g9_missing_bars", rsql(f"""
SELECT * FROM (
  SELECT 'price_na' AS variable, count(*) - count(price_na) AS missing,
    CAST(count(*) - count(price_na) AS DOUBLE) * 100 / count(*) AS missing_pct FROM {fx.ORD_SQL} AS s
  UNION ALL SELECT 'status_na', count(*) - count(status_na),
    CAST(count(*) - count(status_na) AS DOUBLE) * 100 / count(*) FROM {fx.ORD_SQL} AS s
  UNION ALL SELECT 'mostly_na', count(*) - count(mostly_na),
    CAST(count(*) - count(mostly_na) AS DOUBLE) * 100 / count(*) FROM {fx.ORD_SQL} AS s) AS t
WHERE missing > 0""", ["missing_pct"]))
def g9_missing_bars(spark, sf):
    return rounded(G.missing_bars(fx.ords(spark, sf)))


@register("g2_density_512")
def g2_density(spark, sf):
    return rounded(G.density(fx.t(spark, sf, "events"), "value"), 8)


@register("g5_violin_density_by_group")
def g5_violin(spark, sf):
    return rounded(G.density(fx.t(spark, sf, "events"), "value", n=128, by="event_type"), 8)


@register("g7_qq_points")
def g7_qq(spark, sf):
    return rounded(G.qq_points(fx.t(spark, sf, "events"), "value"), 6)


def _jb_sql(cols, src):
    parts = []
    for c in cols:
        parts.append(f"""
SELECT '{c}' AS variable, 'Jarque-Bera' AS test, jb AS statistic, exp(-jb / 2) AS p_value FROM (
  SELECT count(x) / 6.0 * (power(avg(power(x - m, 3)) / power(avg(power(x - m, 2)), 1.5), 2)
       + power(avg(power(x - m, 4)) / power(avg(power(x - m, 2)), 2) - 3, 2) / 4) AS jb
  FROM (SELECT CAST({c} AS DOUBLE) AS x, avg(CAST({c} AS DOUBLE)) OVER () AS m FROM {src} AS s) AS z) AS j""")
    return " UNION ALL ".join(parts)


@register("e27_jarque_bera", rsql(_jb_sql(["value", "user_id"], "events"), ["statistic", "p_value"], 6))
def e27_jb(spark, sf):
    return rounded(N.jarque_bera(fx.t(spark, sf, "events"), ["value", "user_id"]), 6)


@register("e25_kolmogorov_smirnov")
def e25_ks(spark, sf):
    return rounded(N.ks_test(fx.t(spark, sf, "events"), ["value"]), 6)


@register("e26_anderson_darling")
def e26_ad(spark, sf):
    return rounded(N.anderson_darling(fx.t(spark, sf, "events"), ["value", "user_id"]), 6)


@register("e24_shapiro_wilk_sampled")
def e24_sw(spark, sf):
    return rounded(N.shapiro_wilk(fx.t(spark, sf, "events"), ["value", "user_id"]), 6)


@register("e28_normality_summary")
def e28_all(spark, sf):
    return rounded(N.normality_tests(fx.t(spark, sf, "events"), ["value"]), 6)
