"""Registered queries: split, formula, metrics, task detection, ranking (F*, C10-C14, A1-A10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import levels as LV
from ..operators import metrics as M
from ..operators import runs as R
from ..operators import split as S
from ..operators import transform as X
from . import fixtures as fx
from .registry import register, rounded, rsql


def _split_sql(ratio, seed, first="train", rest="test"):
    return (f"SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':{seed}'), "
            f"o_orderkey) <= floor({ratio} * count(*) OVER ()) THEN '{first}' ELSE '{rest}' END AS split FROM orders")


@register("f1_split_exact_seeded", _split_sql(0.8, 42))
def f1_split(spark, sf):
    o = fx.t(spark, sf, "orders").select("o_orderkey")
    return S.split_labels(o, "o_orderkey", 0.8, 42)


@register("f2_automl_split", _split_sql(0.25, 123, "test", "train"))
def f2_automl_split(spark, sf):
    o = fx.t(spark, sf, "orders").select("o_orderkey")
    tr, te = S.automl_split(o, "o_orderkey", 25, 123)
    return tr.withColumn("split", F.lit("train")).unionByName(te.withColumn("split", F.lit("test")))


PRED_SQL = ("(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS y, "
            "o_totalprice * 1.1 AS p FROM orders)")


def pred_frame(spark, sf):
    return fx.t(spark, sf, "orders").select(
        "o_orderkey", F.expr("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END").alias("y"),
        (F.col("o_totalprice") * 1.1).alias("p"))


@register("f4_regression_metrics", rsql(f"""
SELECT sqrt(avg((y - p) * (y - p))) AS RMSE, avg(abs(y - p)) AS MAE,
  CASE WHEN var_pop(y) * count(*) > 0 THEN 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) END AS R2
FROM {PRED_SQL} AS s WHERE y IS NOT NULL AND p IS NOT NULL""", ["RMSE", "MAE", "R2"], 4))
def f4_metrics(spark, sf):
    return rounded(M.regression_metrics(pred_frame(spark, sf), "y", "p", warn=False), 4)


@register("f6_mape", rsql(f"""
SELECT avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END) * 100 AS MAPE
FROM {PRED_SQL} AS s WHERE y IS NOT NULL AND p IS NOT NULL""", ["MAPE"]))
def f6_mape(spark, sf):
    return rounded(M.mape(pred_frame(spark, sf), "y", "p"))


@register("f8_predictions_table", rsql(f"""
SELECT o_orderkey, y AS actual, p AS predicted, y - p AS residual FROM {PRED_SQL} AS s""",
                                       ["actual", "predicted", "residual"], 4))
def f8_predictions(spark, sf):
    return rounded(M.predictions_table(pred_frame(spark, sf), "y", "p", keep=["o_orderkey"]), 4)


CLS_SQL = ("(SELECT o_orderkey, o_orderstatus AS actual, CASE WHEN o_orderkey % 5 IN (0, 1) THEN 'F' "
           "WHEN o_orderkey % 5 IN (2, 3) THEN 'O' ELSE 'P' END AS predicted FROM orders)")


def cls_frame(spark, sf):
    return fx.t(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("actual"),
        F.expr("CASE WHEN o_orderkey % 5 IN (0, 1) THEN 'F' WHEN o_orderkey % 5 IN (2, 3) THEN 'O' ELSE 'P' END")
        .alias("predicted"))


@register("c10_confusion_matrix", f"""
WITH lv AS (SELECT DISTINCT actual AS v FROM {CLS_SQL} AS a UNION SELECT DISTINCT predicted FROM {CLS_SQL} AS b),
c AS (SELECT predicted, actual, count(*) AS n FROM {CLS_SQL} AS s GROUP BY 1, 2)
SELECT p.v AS predicted, a.v AS actual, coalesce(c.n, 0) AS n
FROM lv p CROSS JOIN lv a LEFT JOIN c ON c.predicted = p.v AND c.actual = a.v""")
def c10_confusion(spark, sf):
    return M.confusion_matrix(cls_frame(spark, sf), "actual", "predicted")


def _cls_metrics_sql(src, binary_pos=None):
    per = f"""
WITH s AS (SELECT * FROM {src} AS x),
lv AS (SELECT DISTINCT actual AS cls FROM s UNION SELECT DISTINCT predicted FROM s),
k AS (SELECT cls, (SELECT count(*) FROM s WHERE predicted = cls AND actual = cls) AS tp,
             (SELECT count(*) FROM s WHERE predicted = cls) AS pred_n,
             (SELECT count(*) FROM s WHERE actual = cls) AS actual_n FROM lv),
pr AS (SELECT cls, CASE WHEN pred_n > 0 THEN CAST(tp AS DOUBLE) / pred_n END AS precision,
              CASE WHEN actual_n > 0 THEN CAST(tp AS DOUBLE) / actual_n END AS recall FROM k),
agg AS ({"SELECT precision, recall FROM pr WHERE cls = '" + binary_pos + "'" if binary_pos else
         "SELECT avg(precision) AS precision, avg(recall) AS recall FROM pr"})
SELECT (SELECT CAST(count(*) FILTER (WHERE actual = predicted) AS DOUBLE) / count(*) FROM s) AS accuracy,
  precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1
FROM agg"""
    return rsql(per, ["accuracy", "precision", "recall", "f1"])


@register("c11_classification_metrics_multiclass", _cls_metrics_sql(CLS_SQL))
def c11_multiclass(spark, sf):
    return rounded(M.classification_metrics(cls_frame(spark, sf), "actual", "predicted"))


BIN_SQL = ("(SELECT event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'yes' ELSE 'no' END AS actual, "
           "CASE WHEN value > 40 THEN 'yes' ELSE 'no' END AS predicted, value AS score FROM events)")


def bin_frame(spark, sf):
    return fx.t(spark, sf, "events").select(
        "event_id", F.expr("CASE WHEN event_type IN ('purchase', 'signup') THEN 'yes' ELSE 'no' END").alias("actual"),
        F.expr("CASE WHEN value > 40 THEN 'yes' ELSE 'no' END").alias("predicted"), F.col("value").alias("score"))


@register("c11_classification_metrics_binary", _cls_metrics_sql(BIN_SQL, "yes"))
def c11_binary(spark, sf):
    return rounded(M.classification_metrics(bin_frame(spark, sf), "actual", "predicted"))


# two thousand classes and more
MANY_SQL = "(SELECT CAST(l_partkey AS VARCHAR) AS actual, CAST(l_partkey - l_orderkey % 2 AS VARCHAR) AS predicted FROM lineitem)"


def many_frame(spark, sf):
    return fx.t(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("actual"),
                                              F.expr("CAST(l_partkey - l_orderkey % 2 AS STRING)").alias("predicted"))


@register("c11_metrics_of_many_classes", _cls_metrics_sql(MANY_SQL))
def c11_many(spark, sf):
    return rounded(M.classification_metrics(many_frame(spark, sf), "actual", "predicted"))


@register("c10_pair_counts_of_many_classes", f"SELECT predicted, actual, count(*) AS n FROM {MANY_SQL} AS s GROUP BY predicted, actual")
def c10_many(spark, sf):
    return LV.pair_counts(many_frame(spark, sf), "actual", "predicted")


@register("c14_prediction_check", f"""
SELECT o_orderkey, actual, predicted, actual = predicted AS correct FROM {CLS_SQL} AS s""")
def c14_check(spark, sf):
    return M.prediction_check(cls_frame(spark, sf), "actual", "predicted", keep=["o_orderkey"])


@register("c12_roc_curve", rsql(f"""
WITH s AS (SELECT score, CASE WHEN actual = 'yes' THEN 1 ELSE 0 END AS y FROM {BIN_SQL} AS x),
c AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY score),
t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM c)
SELECT score AS threshold, CAST(sum(neg) OVER (ORDER BY score DESC) AS DOUBLE) / N AS fpr,
  CAST(sum(pos) OVER (ORDER BY score DESC) AS DOUBLE) / P AS tpr FROM c, t""", ["threshold", "fpr", "tpr"]))
def c12_roc(spark, sf):
    return rounded(M.roc_curve(bin_frame(spark, sf), "score", "actual", "yes", direction=1))


@register("c12_auc", rsql(f"""
WITH s AS (SELECT score, CASE WHEN actual = 'yes' THEN 1 ELSE 0 END AS y FROM {BIN_SQL} AS x),
r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM s)
SELECT (sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc
FROM r""", ["auc"]))
def c12_auc(spark, sf):
    return rounded(M.auc(bin_frame(spark, sf), "score", "actual", "yes", direction=1))


@register("a1_task_detection", """
SELECT 'o_totalprice' AS target, CASE WHEN (SELECT count(DISTINCT o_totalprice) FROM orders) > 10
  THEN 'regression' ELSE 'classification' END AS task
UNION ALL SELECT 'l_linenumber', CASE WHEN (SELECT count(DISTINCT l_linenumber) FROM lineitem) > 10
  THEN 'regression' ELSE 'classification' END
UNION ALL SELECT 'l_returnflag', 'classification'""")
def a1_task(spark, sf):
    o = fx.t(spark, sf, "orders")
    li = fx.t(spark, sf, "lineitem")
    a = R.task_table(o, ["o_totalprice"])
    b = R.task_table(li, ["l_linenumber", "l_returnflag"])
    return a.unionByName(b)


@register("a2_train_only_scaling", rsql("""
WITH s AS (SELECT o_orderkey, o_totalprice, CASE WHEN row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR)
  || ':7'), o_orderkey) <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM orders),
st AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd FROM s WHERE split = 'train')
SELECT o_orderkey, split, (o_totalprice - m) / CASE WHEN sd = 0 OR sd IS NULL THEN 1 ELSE sd END AS o_totalprice
FROM s, st""", ["o_totalprice"]))
def a2_train_scaling(spark, sf):
    o = fx.t(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    lab = S.split_labels(o, "o_orderkey", 0.8, 7)
    p = X.fit_scale(lab.where("split = 'train'"), ["o_totalprice"], "zscore", sd_zero_to_one=True)
    return rounded(X.apply_scale(lab, p))


ALGOS = [("scaled_up", "o_totalprice * 1.1"), ("scaled_down", "o_totalprice * 0.95"),
         ("shifted", "o_totalprice + 1000")]


def _algo_scores(df, group=None):
    parts = []
    for pos, (name, expr) in enumerate(ALGOS):
        d = df.withColumn("p", F.expr(expr))
        keys = [group] if group else []
        agg = d.groupBy(*keys).agg(F.sqrt(F.avg((F.col("o_totalprice") - F.col("p")) ** 2)).alias("score"))
        parts.append(agg.withColumn("algorithm", F.lit(name)).withColumn("position", F.lit(pos)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _algo_sql(group=None):
    g = f", {group}" if group else ""
    gb = f" GROUP BY {group}" if group else ""
    return " UNION ALL ".join(
        f"SELECT '{n}' AS algorithm, {i} AS position{g}, sqrt(avg((o_totalprice - ({e})) * (o_totalprice - ({e})))) "
        f"AS score FROM orders{gb}" for i, (n, e) in enumerate(ALGOS))


@register("a5_a6_ranking_table", rsql(f"""
SELECT algorithm, score, 'RMSE' AS metric, CAST(row_number() OVER (ORDER BY score, position) AS INTEGER) AS rank,
  row_number() OVER (ORDER BY score, position) = 1 AS best FROM ({_algo_sql()}) AS s""", ["score"], 4))
def a6_ranking(spark, sf):
    o = fx.t(spark, sf, "orders").select("o_totalprice")
    return rounded(R.ranking(_algo_scores(o), "regression"), 4)


def _runs(spark, sf):
    o = fx.t(spark, sf, "orders").select("o_totalprice", "o_orderstatus")
    sc = _algo_scores(o, "o_orderstatus").withColumn("run_id", F.concat(F.lit("run_"), F.col("o_orderstatus")))
    # run P did not train the third learner: its cell stays missing
    sc = sc.where(~((F.col("run_id") == "run_P") & (F.col("algorithm") == "shifted")))
    from pyspark.sql import Window
    w = Window.partitionBy("run_id").orderBy("score", "position")
    return sc.select("run_id", F.lit("regression").alias("task"), "algorithm", "score", F.lit("RMSE").alias("metric"),
                     (F.row_number().over(w) == 1).alias("best"), F.lit(None).cast("string").alias("error"))


RUNS_SQL = f"""(SELECT 'run_' || o_orderstatus AS run_id, algorithm, score,
  row_number() OVER (PARTITION BY o_orderstatus ORDER BY score, position) = 1 AS best
  FROM ({_algo_sql('o_orderstatus')}) AS s WHERE NOT (o_orderstatus = 'P' AND algorithm = 'shifted'))"""


@register("a9_run_summary", rsql(f"""
SELECT 'regression' AS task, max(CASE WHEN best THEN algorithm END) AS best_algorithm,
  max(CASE WHEN best THEN score END) AS best_score, count(score) AS n_models
FROM {RUNS_SQL} AS r WHERE run_id = 'run_O'""", ["best_score"], 4))
def a9_summary(spark, sf):
    return rounded(R.run_summary(_runs(spark, sf), "run_O"), 4)


@register("a10_score_matrix", rsql(f"""
SELECT algorithm, max(CASE WHEN run_id = 'run_F' THEN score END) AS run_F,
  max(CASE WHEN run_id = 'run_O' THEN score END) AS run_O, max(CASE WHEN run_id = 'run_P' THEN score END) AS run_P
FROM {RUNS_SQL} AS r GROUP BY algorithm""", ["run_F", "run_O", "run_P"], 4))
def a10_matrix(spark, sf):
    return rounded(R.score_matrix(_runs(spark, sf), ["run_F", "run_O", "run_P"]), 4)
