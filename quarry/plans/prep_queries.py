"""Registered queries: projections, cleaning, scaling, encoding, binning, outliers (P*, T*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..operators import columns as K
from ..operators import levels as LV
from ..operators import outliers as O
from ..operators import transform as X
from . import fixtures as fx
from .registry import register, rounded, rsql

ORD = "orders"


@register("p1_drop_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def p1_drop_columns(spark, sf):
    return K.drop_columns(fx.t(spark, sf, ORD), ["o_orderdate", "not_a_column"])


@register("p2_drop_columns_by_position", "SELECT o_custkey, o_orderdate, o_orderpriority FROM orders")
def p2_drop_by_position(spark, sf):
    return K.drop_columns_by_position(fx.t(spark, sf, ORD), "1, 4:3, 99, x, 1")


@register("p3_drop_rows_by_position", """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS rn FROM events) AS e
WHERE rn NOT IN (1, 5) AND rn NOT BETWEEN 10 AND 20""")
def p3_drop_rows(spark, sf):
    return K.drop_rows(fx.t(spark, sf, "events"), [1, 5, (20, 10), 10 ** 12], ["event_id"])


@register("p4_rename_column", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice AS total_price, "
                              "o_orderdate, o_orderpriority FROM orders")
def p4_rename(spark, sf):
    return K.rename_column(fx.t(spark, sf, ORD), "o_totalprice", "  total_price ")


@register("p5_convert_to_numeric", """
SELECT o_orderkey, TRY_CAST(trim(o_orderpriority) AS DOUBLE) AS o_orderpriority,
  TRY_CAST(trim(p1) AS DOUBLE) AS p1, CAST(o_custkey AS VARCHAR) AS o_custkey
FROM (SELECT o_orderkey, o_orderpriority, substr(o_orderpriority, 1, 1) AS p1, o_custkey FROM orders) AS s""")
def p5_convert(spark, sf):
    o = fx.t(spark, sf, ORD).select("o_orderkey", "o_orderpriority",
                                    F.substring("o_orderpriority", 1, 1).alias("p1"), "o_custkey")
    o = K.convert_type(o, ["o_orderpriority", "p1"], "numeric")
    return K.convert_type(o, ["o_custkey"], "character")


@register("p6_drop_incomplete_rows", rsql(
    f"SELECT * FROM {fx.ORD_SQL} AS s WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL AND "
    "price_na IS NOT NULL AND status_na IS NOT NULL AND o_orderpriority IS NOT NULL AND mostly_na IS NOT NULL",
    ["price_na", "mostly_na"]))
def p6_drop_incomplete(spark, sf):
    return rounded(C.drop_incomplete(fx.ords(spark, sf)))


@register("p7_drop_sparse_columns", rsql(
    f"SELECT o_orderkey, o_custkey, price_na, status_na, o_orderpriority FROM {fx.ORD_SQL} AS s", ["price_na"]))
def p7_drop_sparse(spark, sf):
    return rounded(C.drop_sparse_columns(fx.ords(spark, sf), 0.5))


@register("p8_prepare_complete_cases", rsql(
    f"SELECT price_na, o_custkey, status_na FROM {fx.ORD_SQL} AS s "
    "WHERE price_na IS NOT NULL AND o_custkey IS NOT NULL AND status_na IS NOT NULL", ["price_na"]))
def p8_prepare(spark, sf):
    return rounded(C.prepare(fx.ords(spark, sf), "price_na", ["o_custkey", "status_na"]))


@register("p9_training_projection", rsql(
    "SELECT l_quantity, l_discount, l_tax, l_linenumber FROM lineitem", ["l_quantity", "l_discount", "l_tax"]))
def p9_training_projection(spark, sf):
    li = fx.t(spark, sf, "lineitem")
    return rounded(C.prepare(li, "l_quantity", ["l_discount", "l_tax", "l_linenumber", "l_quantity"]))


@register("p10_select_numeric", rsql(f"SELECT o_orderkey, o_custkey, price_na, mostly_na FROM {fx.ORD_SQL} AS s",
                                     ["price_na", "mostly_na"]))
def p10_select_numeric(spark, sf):
    return rounded(K.select_numeric(fx.ords(spark, sf)))


@register("p10_select_categorical", f"SELECT status_na, o_orderpriority FROM {fx.ORD_SQL} AS s")
def p10_select_categorical(spark, sf):
    return K.select_categorical(fx.ords(spark, sf))


@register("p11_factor_base_level", """
WITH lv AS (SELECT v, row_number() OVER (ORDER BY CASE WHEN v = '3-MEDIUM' THEN 0 ELSE 1 END, v) AS code
            FROM (SELECT DISTINCT o_orderpriority AS v FROM orders WHERE o_orderpriority <> '5-LOW') AS d)
SELECT o.o_orderkey, lv.v AS prio, CAST(lv.code AS BIGINT) AS prio_code
FROM (SELECT o_orderkey, o_orderpriority FROM orders) AS o LEFT JOIN lv ON o.o_orderpriority = lv.v""")
def p11_factor(spark, sf):
    o = fx.t(spark, sf, ORD).select("o_orderkey", F.col("o_orderpriority").alias("prio"))
    levels = K.factor_levels(o.where("prio <> '5-LOW'"), "prio", base="3-MEDIUM")
    return K.apply_factor(o, "prio", levels, code_col="prio_code")


# as many levels as there are parts
_PART_CODES = """SELECT l_orderkey, l_linenumber, l_returnflag, CAST(l_partkey AS VARCHAR) AS part,
  dense_rank() OVER (ORDER BY CAST(l_partkey AS VARCHAR)) AS code, dense_rank() OVER (ORDER BY l_returnflag) AS flag FROM lineitem"""


def _parts(spark, sf):
    return fx.t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_partkey").cast("string").alias("part"))


@register("p11_codes_of_many_levels", f"SELECT l_orderkey, l_linenumber, part, code AS part_code FROM ({_PART_CODES}) AS c")
def p11_many(spark, sf):
    df = _parts(spark, sf).drop("l_returnflag")
    return LV.coded(df, "part", LV.level_table(df, "part"), "part_code")


@register("t13_sparse_one_hot_of_many_levels", f"""
SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN code > 1 THEN CAST(code - 1 AS VARCHAR) END,
  CASE WHEN flag > 1 THEN CAST(flag - 1 + (SELECT max(code) - 1 FROM ({_PART_CODES}) AS m) AS VARCHAR) END) AS ones
FROM ({_PART_CODES}) AS c""")
def t13_many(spark, sf):
    rows, _ = LV.sparse_one_hot(_parts(spark, sf), ["part", "l_returnflag"])
    return rows.select("l_orderkey", "l_linenumber", F.array_join(F.col("ones").cast("array<string>"), ",").alias("ones"))


def _impute_sql(fill_price: str, fill_mostly: str, fill_status: str | None = None) -> str:
    status = f"coalesce(status_na, {fill_status})" if fill_status else "status_na"
    return rsql(f"""
SELECT o_orderkey, o_custkey, coalesce(price_na, {fill_price}) AS price_na, {status} AS status_na,
  o_orderpriority, coalesce(mostly_na, {fill_mostly}) AS mostly_na FROM {fx.ORD_SQL} AS s""",
                ["price_na", "mostly_na"])


def _agg(fn, c):
    return f"(SELECT {fn}({c}) FROM {fx.ORD_SQL} AS a)"


def _mode(c):
    return f"(SELECT {c} FROM {fx.ORD_SQL} AS a WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@register("t1_impute_mean", _impute_sql(_agg("avg", "price_na"), _agg("avg", "mostly_na")))
def t1_impute_mean(spark, sf):
    return rounded(C.impute(fx.ords(spark, sf), "mean"))


@register("t2_impute_median", _impute_sql(f"(SELECT quantile_cont(price_na, 0.5) FROM {fx.ORD_SQL} AS a)",
                                          f"(SELECT quantile_cont(mostly_na, 0.5) FROM {fx.ORD_SQL} AS a)"))
def t2_impute_median(spark, sf):
    return rounded(C.impute(fx.ords(spark, sf), "median"))


@register("t3_impute_mode", _impute_sql(_mode("price_na"), _mode("mostly_na"), _mode("status_na")))
def t3_impute_mode(spark, sf):
    return rounded(C.impute(fx.ords(spark, sf), "mode"))


@register("t4_impute_none_threshold", rsql(
    f"SELECT o_orderkey, o_custkey, price_na, status_na, o_orderpriority FROM {fx.ORD_SQL} AS s", ["price_na"]))
def t4_impute_none(spark, sf):
    return rounded(C.impute(fx.ords(spark, sf), "none", col_thresh=0.5))


@register("t7_remove_duplicates_all", rsql(f"SELECT DISTINCT * FROM {fx.EV_DUP_SQL} AS s", ["value"]))
def t7_dedup_all(spark, sf):
    return rounded(C.remove_duplicates(fx.ev_dup(spark, sf)))


@register("t8_remove_duplicates_subset", rsql("""
SELECT event_id, user_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) AS e
WHERE rn = 1""", ["value"]))
def t8_dedup_subset(spark, sf):
    e = fx.t(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return rounded(C.remove_duplicates(e, ["user_id", "event_type", "nope"], order_by=["event_id"]))


LI_SCALE_SQL = "(SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag FROM lineitem)"


def li_scale(spark, sf):
    return fx.t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                              "l_discount", "l_returnflag")


@register("t9_scale_zscore", rsql(f"""
SELECT l_orderkey, l_linenumber, (l_quantity - (SELECT avg(l_quantity) FROM lineitem))
   / (SELECT stddev_samp(l_quantity) FROM lineitem) AS l_quantity,
  (l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem))
   / (SELECT stddev_samp(l_extendedprice) FROM lineitem) AS l_extendedprice, l_discount, l_returnflag
FROM {LI_SCALE_SQL} AS s""", ["l_quantity", "l_extendedprice", "l_discount"]))
def t9_zscore(spark, sf):
    return rounded(X.scale(li_scale(spark, sf), ["l_quantity", "l_extendedprice", "l_returnflag"], "zscore"))


@register("t10_scale_minmax", rsql("""
SELECT l_orderkey, l_linenumber, l_quantity,
  (l_extendedprice - (SELECT min(l_extendedprice) FROM lineitem))
   / ((SELECT max(l_extendedprice) FROM lineitem) - (SELECT min(l_extendedprice) FROM lineitem)) AS l_extendedprice,
  l_discount, l_returnflag, one
FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag,
             CAST(1 AS DOUBLE) AS one FROM lineitem) AS s""", ["l_quantity", "l_extendedprice", "l_discount", "one"]))
def t10_minmax(spark, sf):
    df = li_scale(spark, sf).withColumn("one", F.lit(1.0))
    return rounded(X.scale(df, ["l_extendedprice", "one"], "minmax"))


@register("t11_scale_log", rsql("""
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag,
  CASE WHEN centred IS NOT NULL THEN ln(1 + greatest(centred, 0.0)) END AS centred
FROM (SELECT *, nullif(l_quantity - 25, 0) AS centred FROM (SELECT l_orderkey, l_linenumber, l_quantity,
      l_extendedprice, l_discount, l_returnflag FROM lineitem) AS a) AS s""",
                                  ["l_quantity", "l_extendedprice", "l_discount", "centred"]))
def t11_log(spark, sf):
    df = li_scale(spark, sf)
    df = df.withColumn("centred", F.expr("nullif(l_quantity - 25, 0)").cast("double"))
    return rounded(X.scale(df, ["centred"], "log"))


@register("t12_scale_then_encode", rsql("""
SELECT l_orderkey, l_linenumber, (l_quantity - (SELECT avg(l_quantity) FROM lineitem))
   / (SELECT stddev_samp(l_quantity) FROM lineitem) AS l_quantity, l_extendedprice, l_discount,
  CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END AS l_returnflag_N,
  CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS l_returnflag_R
FROM lineitem""", ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag_N", "l_returnflag_R"]))
def t12_scale_encode(spark, sf):
    df, errs = X.scale_and_encode(li_scale(spark, sf), ["l_quantity"], "zscore", ["l_returnflag"])
    if errs:
        raise RuntimeError("; ".join(errs))
    return rounded(df)


def _dummy(col, level, name):
    return f"CASE WHEN {col} IS NULL THEN NULL WHEN {col} = '{level}' THEN 1.0 ELSE 0.0 END AS {name}"


# fixed values: TPC-H order status and priority levels (sorted)
STATUS_LEVELS = ["F", "O"]
PRIORITY_LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("t13_one_hot_full_rank", rsql(f"""
SELECT o_orderkey, {_dummy('status_na', 'O', 'status_na_O')},
  {", ".join(_dummy('o_orderpriority', lv, X.clean_name('o_orderpriority.' + lv)) for lv in PRIORITY_LEVELS[1:])}
FROM {fx.ORD_SQL} AS s""", ["status_na_O"] + [X.clean_name('o_orderpriority.' + lv) for lv in PRIORITY_LEVELS[1:]]))
def t13_encode_full_rank(spark, sf):
    o = fx.ords(spark, sf).select("o_orderkey", "status_na", "o_orderpriority")
    return rounded(X.encode(o, ["status_na", "o_orderpriority"], full_rank=True))


@register("t13_one_hot_all_levels", rsql(f"""
SELECT o_orderkey, {", ".join(_dummy('status_na', lv, 'status_na_' + lv) for lv in STATUS_LEVELS)}
FROM {fx.ORD_SQL} AS s""", ["status_na_" + lv for lv in STATUS_LEVELS]))
def t13_encode_all(spark, sf):
    o = fx.ords(spark, sf).select("o_orderkey", "status_na")
    return rounded(X.encode(o, ["status_na"], full_rank=False))


NZV_SQL = ("(SELECT CAST(1 AS DOUBLE) AS const, CASE WHEN event_id % 500 = 0 THEN 1 ELSE 0 END AS rare, "
           "value, event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS user_na FROM events)")


def nzv_frame(spark, sf):
    return fx.t(spark, sf, "events").select(
        F.lit(1.0).alias("const"), F.expr("CASE WHEN event_id % 500 = 0 THEN 1 ELSE 0 END").alias("rare"),
        "value", "event_type", F.expr("CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END").alias("user_na"))


def _nzv_sql():
    ctes, parts = [], []
    for i, c in enumerate(["const", "rare", "value", "event_type", "user_na"]):
        ctes.append(f"c{i} AS (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS c FROM {NZV_SQL} AS s GROUP BY 1)")
        parts.append(f"""
SELECT '{c}' AS variable,
  CASE WHEN (SELECT count(*) FROM c{i} WHERE v IS NOT NULL) < 2 THEN 0.0 ELSE
    CAST((SELECT c FROM c{i} WHERE v IS NOT NULL ORDER BY c DESC, v LIMIT 1) AS DOUBLE) /
    (SELECT c FROM c{i} WHERE v IS NOT NULL ORDER BY c DESC, v LIMIT 1 OFFSET 1) END AS freq_ratio,
  100.0 * (SELECT count(*) FROM c{i} WHERE v IS NOT NULL) / (SELECT sum(c) FROM c{i}) AS percent_unique,
  (SELECT count(*) FROM c{i} WHERE v IS NOT NULL) <= 1 AS zero_var""")
    inner = "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(parts)
    return rsql(f"SELECT *, (freq_ratio > 19 AND percent_unique <= 10) OR zero_var AS nzv FROM ({inner}) AS t",
                ["freq_ratio", "percent_unique"])


@register("t14_near_zero_variance", _nzv_sql())
def t14_nzv(spark, sf):
    return rounded(O.near_zero_variance(nzv_frame(spark, sf)))


@register("t14_remove_near_zero_variance", rsql(f"SELECT value, event_type, user_na FROM {NZV_SQL} AS s",
                                                ["value"]))
def t14_remove_nzv(spark, sf):
    return rounded(O.remove_near_zero_variance(nzv_frame(spark, sf)))


@register("t15_remove_correlated_features")
def t15_remove_correlated(spark, sf):
    from .eda_queries import corr_frame
    df, _ = O.remove_correlated(corr_frame(spark, sf), 0.9)
    return rounded(df)


EV_OUT_SQL = "(SELECT event_id, value, user_id FROM events)"


@register("t16_t18_outliers_iqr_flag", rsql(f"""
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
                  quantile_cont(CAST(user_id AS DOUBLE), 0.25) AS u1, quantile_cont(CAST(user_id AS DOUBLE), 0.75) AS u3
           FROM events)
SELECT e.event_id, e.value, e.user_id,
  coalesce(e.value < q1 - 1.5 * (q3 - q1) OR e.value > q3 + 1.5 * (q3 - q1), false)
  OR coalesce(e.user_id < u1 - 1.5 * (u3 - u1) OR e.user_id > u3 + 1.5 * (u3 - u1), false) AS outlier_flag
FROM {EV_OUT_SQL} AS e, q""", ["value"]))
def t16_outliers_iqr(spark, sf):
    e = fx.t(spark, sf, "events").select("event_id", "value", "user_id")
    return rounded(O.handle_outliers(e, ["value", "user_id"], "iqr", "flag"))


@register("t17_t18_outliers_zscore_remove", rsql(f"""
SELECT e.event_id, e.value, e.user_id FROM {EV_OUT_SQL} AS e,
  (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) AS z
WHERE NOT coalesce(abs((e.value - m) / s) > 3, false)""", ["value"]))
def t17_outliers_z(spark, sf):
    e = fx.t(spark, sf, "events").select("event_id", "value", "user_id")
    return rounded(O.handle_outliers(e, ["value"], "zscore", "remove"))


def _bin_sql():
    # 4 equal-width bins of l_quantity: edges from min/max, outer edges widened by range/1000
    return rsql("""
WITH r AS (SELECT CAST(min(l_quantity) AS DOUBLE) AS lo, CAST(max(l_quantity) AS DOUBLE) AS hi FROM lineitem),
b AS (SELECT lo - (hi - lo) / 1000 AS b0, lo + 1 * ((hi - lo) / 4) AS b1, lo + 2 * ((hi - lo) / 4) AS b2,
             lo + 3 * ((hi - lo) / 4) AS b3, hi + (hi - lo) / 1000 AS b4 FROM r)
SELECT l_orderkey, l_linenumber, l_quantity,
  CASE WHEN l_quantity >= b0 AND l_quantity <= b1 THEN '[' || printf('%.3g', b0) || ',' || printf('%.3g', b1) || ']'
       WHEN l_quantity > b1 AND l_quantity <= b2 THEN '(' || printf('%.3g', b1) || ',' || printf('%.3g', b2) || ']'
       WHEN l_quantity > b2 AND l_quantity <= b3 THEN '(' || printf('%.3g', b2) || ',' || printf('%.3g', b3) || ']'
       WHEN l_quantity > b3 AND l_quantity <= b4 THEN '(' || printf('%.3g', b3) || ',' || printf('%.3g', b4) || ']'
  END AS l_quantity_bin
FROM lineitem, b""", ["l_quantity"])


@register("t19_bin_equal_width", _bin_sql())
def t19_bin(spark, sf):
    li = fx.t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return rounded(X.bin_variable(li, "l_quantity", 4))


@register("t20_bin_custom_breaks", rsql("""
SELECT l_orderkey, l_linenumber, l_quantity,
  CASE WHEN l_quantity >= 5 AND l_quantity <= 10 THEN 'low' WHEN l_quantity > 10 AND l_quantity <= 25 THEN 'mid'
       WHEN l_quantity > 25 AND l_quantity <= 45 THEN 'high' END AS l_quantity_bin
FROM lineitem""", ["l_quantity"]))
def t20_bin_custom(spark, sf):
    li = fx.t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return rounded(X.bin_variable(li, "l_quantity", breaks=[10, 5, 25, 45], labels=["low", "mid", "high"]))
