"""Registered queries: sources, profiling and EDA statistics (S*, E*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from . import fixtures as fx
from .registry import register, rounded, rsql

DESC_DOUBLES = ["mean", "median", "sd", "iqr", "skewness", "kurtosis", "min", "max", "missing_pct"]


def _desc_sql(src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(f"""
SELECT '{c}' AS variable, count(x) AS n, avg(x) AS mean, quantile_cont(x, 0.5) AS median,
  stddev_samp(x) AS sd, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr,
  CASE WHEN count(x) >= 3 AND stddev_samp(x) > 0
       THEN avg(power(x - m, 3)) / power(stddev_samp(x), 3) END AS skewness,
  CASE WHEN count(x) >= 4 AND stddev_samp(x) > 0
       THEN avg(power(x - m, 4)) / power(stddev_samp(x), 4) - 3 END AS kurtosis,
  min(x) AS min, max(x) AS max, count(*) - count(x) AS missing,
  CAST(count(*) - count(x) AS DOUBLE) * 100 / count(*) AS missing_pct
FROM (SELECT CAST({c} AS DOUBLE) AS x, avg(CAST({c} AS DOUBLE)) OVER () AS m FROM {src} AS s) AS z""")
    return " UNION ALL ".join(parts)


# the reference shows these tables rounded to 3 decimals
@register("e2_describe_extended", rsql(_desc_sql(fx.LI_SQL, fx.LI_COLS), DESC_DOUBLES, 3))
def e2_describe_extended(spark, sf):
    return rounded(P.describe(fx.li(spark, sf), fx.LI_COLS), 3)


def _e1_sql():
    inner = _desc_sql(fx.LI_SQL, fx.LI_COLS)
    return rsql(f"SELECT variable, mean, median, sd, min, max, missing FROM ({inner}) AS d",
                ["mean", "median", "sd", "min", "max"], 3)


@register("e1_describe", _e1_sql())
def e1_describe(spark, sf):
    return rounded(P.describe(fx.li(spark, sf), fx.LI_COLS, extended=False), 3)


ORD_NUM = ["o_orderkey", "o_custkey", "price_na", "mostly_na"]


@register("e5_describe_full_orders", rsql(_desc_sql(fx.ORD_SQL, ORD_NUM), DESC_DOUBLES, 3))
def e5_describe_full_orders(spark, sf):
    return rounded(P.describe(fx.ords(spark, sf)), 3)


def _var_types_sql(src: str, cols: list[tuple[str, str]]) -> str:
    parts = []
    for name, typ in cols:
        parts.append(f"SELECT '{name}' AS variable, '{typ}' AS type, "
                     f"count(DISTINCT {name}) AS n_unique, count(*) - count({name}) AS n_missing, "
                     f"CAST(count(*) - count({name}) AS DOUBLE) * 100 / count(*) AS pct_missing "
                     f"FROM {src} AS s")
    return " UNION ALL ".join(parts)


ORD_TYPES = [("o_orderkey", "integer"), ("o_custkey", "integer"), ("price_na", "numeric"),
             ("status_na", "character"), ("o_orderpriority", "character"), ("mostly_na", "numeric")]


@register("e7_variable_types", rsql(_var_types_sql(fx.ORD_SQL, ORD_TYPES), ["pct_missing"]))
def e7_variable_types(spark, sf):
    return rounded(P.variable_types(fx.ords(spark, sf)))


def _s6_sql():
    inner = _var_types_sql(fx.ORD_SQL, ORD_TYPES)
    return (f"SELECT variable, type, n_missing AS missing, "
            f"n_unique + CASE WHEN n_missing > 0 THEN 1 ELSE 0 END AS unique "
            f"FROM ({inner}) AS v")


@register("s6_variable_info", _s6_sql())
def s6_variable_info(spark, sf):
    return P.variable_info(fx.ords(spark, sf))


def _t5_sql():
    parts = []
    for name, typ in ORD_TYPES:
        parts.append(f"SELECT '{name}' AS variable, '{typ}' AS type, count(*) - count({name}) AS missing, "
                     f"CAST(count(*) - count({name}) AS DOUBLE) * 100 / count(*) AS missing_pct, "
                     f"count({name}) AS complete FROM {fx.ORD_SQL} AS s")
    return rsql(" UNION ALL ".join(parts), ["missing_pct"])


@register("t5_missing_summary", _t5_sql())
def t5_missing_summary(spark, sf):
    return rounded(P.missing_summary(fx.ords(spark, sf)))


def _overview_sql(src, cols, n_num, n_cat):
    miss = " + ".join(f"(count(*) - count({c}))" for c in cols)
    collist = ", ".join(cols)
    return rsql(f"""
SELECT a.n_rows, CAST({len(cols)} AS BIGINT) AS n_cols, CAST({n_num} AS BIGINT) AS n_numeric,
  CAST({n_cat} AS BIGINT) AS n_categorical, a.total_missing,
  CAST(a.total_missing AS DOUBLE) * 100 / (a.n_rows * {len(cols)}) AS missing_pct, d.duplicate_rows
FROM (SELECT count(*) AS n_rows, CAST({miss} AS BIGINT) AS total_missing FROM {src} AS s) AS a,
     (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicate_rows
      FROM (SELECT count(*) AS c FROM {src} AS s GROUP BY {collist}) AS g) AS d""", ["missing_pct"])


@register("e6_overview_events_dup", _overview_sql(fx.EV_DUP_SQL, ["event_id", "user_id", "event_type", "value"], 3, 1))
def e6_overview(spark, sf):
    return rounded(P.overview(fx.ev_dup(spark, sf)))


@register("e13_missing_share_orders",
          _overview_sql(fx.ORD_SQL, [c for c, _ in ORD_TYPES], 4, 2))
def e13_missing_share(spark, sf):
    return rounded(P.overview(fx.ords(spark, sf)))


@register("t6_duplicate_count", """
SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS c FROM (SELECT event_id, user_id, event_type, value FROM events UNION ALL
      SELECT event_id, user_id, event_type, value FROM events WHERE event_id % 20 = 0) AS s
      GROUP BY event_id, user_id, event_type, value) AS g""")
def t6_duplicate_count(spark, sf):
    return P.duplicate_rows(fx.ev_dup(spark, sf))


@register("e11_constant_columns", """
SELECT variable FROM (
  SELECT 'one' AS variable, count(DISTINCT one) AS u FROM (SELECT o_orderkey, 1 AS one, o_orderstatus FROM orders) AS s
  UNION ALL SELECT 'o_orderkey', count(DISTINCT o_orderkey) FROM orders
  UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus) FROM orders
  UNION ALL SELECT 'mostly_na', count(DISTINCT mostly_na) FROM """ + fx.ORD_SQL + """ AS s2
) AS t WHERE u = 1""")
def e11_constant_columns(spark, sf):
    o = fx.t(spark, sf, "orders")
    df = o.select("o_orderkey", F.lit(1).alias("one"), "o_orderstatus",
                  F.expr("CASE WHEN o_orderkey % 10 = 0 THEN CAST(1 AS DOUBLE) END").alias("mostly_na"))
    return P.constant_columns(df)


def _high_missing_sql(th):
    parts = [f"SELECT '{c}' AS variable, CAST(count(*) - count({c}) AS DOUBLE) * 100 / count(*) AS missing_pct "
             f"FROM {fx.ORD_SQL} AS s" for c, _ in ORD_TYPES]
    return rsql(f"SELECT * FROM ({' UNION ALL '.join(parts)}) AS t WHERE missing_pct > {th}", ["missing_pct"])


@register("e12_high_missing_columns", _high_missing_sql(10.0))
def e12_high_missing(spark, sf):
    return rounded(P.high_missing_columns(fx.ords(spark, sf), 10.0))


def _skew_sql(src, cols):
    parts = []
    for c in cols:
        parts.append(f"""
SELECT '{c}' AS variable,
  CASE WHEN count(x) >= 3 AND stddev_samp(x) > 0 THEN avg(power(x - m, 3)) / power(stddev_samp(x), 3) END AS skewness,
  CASE WHEN count(x) >= 4 AND stddev_samp(x) > 0 THEN avg(power(x - m, 4)) / power(stddev_samp(x), 4) - 3 END AS kurtosis
FROM (SELECT CAST({c} AS DOUBLE) AS x, avg(CAST({c} AS DOUBLE)) OVER () AS m FROM {src} AS s) AS z""")
    return " UNION ALL ".join(parts)


EV_SRC = "(SELECT value, event_id, user_id, value * value AS value_sq, -value AS neg_value FROM events)"
EV_COLS = ["value", "event_id", "user_id", "value_sq", "neg_value"]


def ev_num(spark, sf):
    e = fx.t(spark, sf, "events")
    return e.select("value", "event_id", "user_id", (F.col("value") * F.col("value")).alias("value_sq"),
                    (-F.col("value")).alias("neg_value"))


@register("e3_e4_skewness_kurtosis", rsql(_skew_sql(EV_SRC, EV_COLS), ["skewness", "kurtosis"]))
def e3_e4_skew(spark, sf):
    return rounded(P.skewness_table(ev_num(spark, sf), EV_COLS))


@register("e15_skewed_columns", rsql(
    "SELECT variable, skewness, CASE WHEN skewness > 0 THEN 'right' ELSE 'left' END AS direction "
    f"FROM ({_skew_sql(EV_SRC, EV_COLS)}) AS s WHERE abs(skewness) > 1", ["skewness"]))
def e15_skewed(spark, sf):
    return rounded(P.skewed_columns(ev_num(spark, sf), EV_COLS))


@register("e16_zero_variance", """
SELECT variable FROM (
 SELECT 'value' AS variable, var_samp(value) AS v FROM events
 UNION ALL SELECT 'const', var_samp(CAST(1 AS DOUBLE)) FROM events
 UNION ALL SELECT 'rare', var_samp(CASE WHEN event_id % 500 = 0 THEN 1.0 ELSE 0.0 END) FROM events) AS t
WHERE v = 0""")
def e16_zero_variance(spark, sf):
    e = fx.t(spark, sf, "events").select(
        "value", F.lit(1.0).alias("const"),
        F.expr("CASE WHEN event_id % 500 = 0 THEN 1.0 ELSE 0.0 END").alias("rare"))
    return P.zero_variance_columns(e)


def _outlier_share_sql(src, cols):
    parts = []
    for c in cols:
        parts.append(f"""
SELECT '{c}' AS variable, count(x) AS n,
  avg(CASE WHEN x IS NOT NULL THEN CASE WHEN x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)
      THEN 1.0 ELSE 0.0 END END) AS outlier_share
FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {src} AS s) AS z,
     (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3
      FROM {src} AS s2) AS qq""")
    return " UNION ALL ".join(parts)


@register("e17_outlier_prone_columns", rsql(
    f"SELECT variable, outlier_share FROM ({_outlier_share_sql(EV_SRC, EV_COLS)}) AS o "
    "WHERE n >= 10 AND outlier_share > 0.05", ["outlier_share"]))
def e17_outlier_prone(spark, sf):
    return rounded(P.outlier_prone_columns(ev_num(spark, sf), EV_COLS))


def _var_rank_sql(src, cols):
    parts = [f"SELECT '{c}' AS variable, CASE WHEN count({c}) >= 2 THEN var_samp(CAST({c} AS DOUBLE)) / "
             f"(max(CAST({c} AS DOUBLE)) - min(CAST({c} AS DOUBLE)) + 1e-10) END AS score FROM {src} AS s"
             for c in cols]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) AS t WHERE score IS NOT NULL"


@register("e19_variance_ranking_top5", rsql(
    f"SELECT * FROM ({_var_rank_sql(fx.LI_SQL, fx.LI_COLS)}) AS r ORDER BY score DESC, variable LIMIT 5",
    ["score"], 4))
def e19_variance_ranking(spark, sf):
    return rounded(P.variance_ranking(fx.li(spark, sf), fx.LI_COLS, top=5), 4)


def _cat_summary_sql(src, cols, top=5):
    parts = [f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS value FROM {src} AS s" for c in cols]
    lv = " UNION ALL ".join(parts)
    return f"""
WITH lv AS ({lv}),
counts AS (SELECT variable, value, count(*) AS cnt FROM lv GROUP BY variable, value),
ranked AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY cnt DESC, value ASC NULLS LAST) AS rank
           FROM counts),
uniq AS (SELECT variable, count(value) AS n_unique FROM counts GROUP BY variable)
SELECT r.variable, u.n_unique, r.rank, r.value, r.cnt AS count
FROM ranked r JOIN uniq u USING (variable) WHERE r.rank <= {top}"""


@register("e20_categorical_summary", _cat_summary_sql(fx.ORD_SQL, ["status_na", "o_orderpriority"]))
def e20_categorical_summary(spark, sf):
    return P.categorical_summary(fx.ords(spark, sf), ["status_na", "o_orderpriority"])


CORR_SRC = ("(SELECT l_quantity, l_discount, 2 * l_quantity + l_discount AS q2, l_tax, "
            "nullif(l_discount, 0.0) AS disc_na FROM lineitem)")
CORR_COLS = ["l_quantity", "l_discount", "q2", "l_tax", "disc_na"]


def corr_frame(spark, sf):
    return fx.t(spark, sf, "lineitem").select(
        "l_quantity", "l_discount", (2 * F.col("l_quantity") + F.col("l_discount")).alias("q2"),
        "l_tax", F.expr("nullif(l_discount, 0.0)").alias("disc_na"))


def _corr_sql(src, cols, complete: bool):
    where = " WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in cols) if complete else ""
    parts = []
    for a in cols:
        for b in cols:
            if a == b:
                parts.append(f"SELECT '{a}' AS var1, '{b}' AS var2, CASE WHEN stddev_samp({a}) > 0 THEN "
                             f"CAST(1 AS DOUBLE) END AS correlation FROM d")
            else:
                parts.append(f"SELECT '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS correlation FROM d")
    return f"WITH d AS (SELECT * FROM {src} AS s{where}) " + " UNION ALL ".join(parts)


@register("e8_correlation_complete", rsql(_corr_sql(CORR_SRC, CORR_COLS, True), ["correlation"]))
def e8_corr_complete(spark, sf):
    return rounded(P.correlation_matrix(corr_frame(spark, sf), CORR_COLS, "pearson", "complete"))


@register("e9_correlation_pairwise", rsql(_corr_sql(CORR_SRC, CORR_COLS, False), ["correlation"]))
def e9_corr_pairwise(spark, sf):
    return rounded(P.correlation_matrix(corr_frame(spark, sf), CORR_COLS, "pearson", "pairwise"))


def _spearman_sql():
    cols = ["l_quantity", "l_discount", "l_tax"]
    ranks = ", ".join(f"CAST(rank() OVER (ORDER BY {c}) AS DOUBLE) - 1 + "
                      f"(count(*) OVER (PARTITION BY {c}) + 1) / 2.0 AS {c}" for c in cols)
    src = f"(SELECT {ranks} FROM lineitem)"
    return rsql(_corr_sql(src, cols, True), ["correlation"])


@register("e8_correlation_spearman", _spearman_sql())
def e8_corr_spearman(spark, sf):
    df = fx.t(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax")
    return rounded(P.correlation_matrix(df, ["l_quantity", "l_discount", "l_tax"], "spearman", "complete"))


@register("e18_high_correlation_pairs", rsql(f"""
WITH m AS ({_corr_sql(CORR_SRC, CORR_COLS, True)}),
o AS (SELECT * FROM (VALUES {", ".join(f"('{c}', {i})" for i, c in enumerate(CORR_COLS))}) AS v(v, i))
SELECT m.var1, m.var2, m.correlation, printf('%s ~ %s (r = %.2f)', m.var1, m.var2, m.correlation) AS label
FROM m JOIN o o1 ON m.var1 = o1.v JOIN o o2 ON m.var2 = o2.v
WHERE o1.i < o2.i AND abs(m.correlation) > 0.8""", ["correlation"]))
def e18_high_corr(spark, sf):
    return rounded(P.high_correlation_pairs(corr_frame(spark, sf), CORR_COLS))


@register("s5_structure", """
SELECT column_name AS variable, CAST(ordinal_position AS INTEGER) AS position,
  CASE WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'integer' WHEN data_type = 'DOUBLE' THEN 'numeric'
       WHEN data_type = 'VARCHAR' THEN 'character' ELSE 'timestamp' END AS type,
  CASE WHEN data_type = 'BIGINT' THEN 'bigint' WHEN data_type = 'INTEGER' THEN 'int'
       WHEN data_type = 'DOUBLE' THEN 'double' WHEN data_type = 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END
       AS spark_type,
  (SELECT count(*) FROM orders) AS n_rows, (SELECT count(*) FROM information_schema.columns
       WHERE table_name = 'orders') AS n_cols
FROM information_schema.columns WHERE table_name = 'orders'""")
def s5_structure(spark, sf):
    from ..sources.tables import structure
    return structure(fx.t(spark, sf, "orders"))


@register("s4_preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100")
def s4_preview(spark, sf):
    from ..sources.tables import preview
    return preview(fx.t(spark, sf, "orders"), 100, ["o_orderkey"])


@register("e21_auto_eda_bundle")
def e21_auto_eda(spark, sf):
    return P.auto_eda(fx.ords(spark, sf))


@register("e22_insights")
def e22_insights(spark, sf):
    return P.insights(fx.ords(spark, sf))


_KENDALL = ["l_quantity", "l_linenumber", "l_discount"]


def _kendall_sql(a: str, b: str) -> str:
    # all pairs of distinct points, weighted by their counts
    return f"""SELECT '{a}' AS var1, '{b}' AS var2,
  sum(p.c * q.c * sign(p.x - q.x) * sign(p.y - q.y)) / sqrt(sum(p.c * q.c * abs(sign(p.x - q.x))))
    / sqrt(sum(p.c * q.c * abs(sign(p.y - q.y)))) AS correlation
FROM (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y, count(*) AS c FROM lineitem GROUP BY 1, 2) AS p,
     (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y, count(*) AS c FROM lineitem GROUP BY 1, 2) AS q"""


@register("e8_correlation_kendall", rsql(" UNION ALL ".join(_kendall_sql(a, b) for a in _KENDALL for b in _KENDALL),
                                          ["correlation"], 9))
def e8_kendall(spark, sf):
    return rounded(P.correlation_matrix(fx.t(spark, sf, "lineitem"), _KENDALL, "kendall"), 9)


@register("s2_tab_text_roundtrip", f"SELECT * FROM {fx.ORD_SQL} AS s")
def s2_tab_text(spark, sf):
    """Tab-separated text."""
    import os
    from ..session import ensure_checkpoint_dir
    from ..sources.tables import load, write_predictions
    path = os.path.join(ensure_checkpoint_dir(spark), f"tab_{os.getpid()}_{abs(hash(sf)) % 10**8}.txt")
    df = fx.ords(spark, sf)
    write_predictions(df, path, "csv", sep="\t")
    return load(spark, path, sep="\t", schema=df.schema)


@register("s1_s3_s8_csv_roundtrip", f"SELECT * FROM {fx.ORD_SQL} AS s")
def s1_csv_roundtrip(spark, sf):
    import os
    from ..session import ensure_checkpoint_dir
    from ..sources.tables import load, write_predictions
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, f"csv_roundtrip_{os.getpid()}_{abs(hash(sf)) % 10**8}")
    df = fx.ords(spark, sf)
    write_predictions(df, path, "csv", sep=";")
    return load(spark, path, fmt="csv", sep=";", schema=df.schema)
