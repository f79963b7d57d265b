"""Registered queries: learners, AutoML, explanation and model bundles (R2-R10, C1-C13, A3-A8, X*, S7-S10, V*).

Learners train on planted targets over ``events`` (key ``event_id``) with
the exact seeded split, and report the test predictions. Iterative and
randomised learners have no SQL oracle (rows-only check); naive Bayes is
a closed form and has one.
"""

from __future__ import annotations

import itertools
import os

from pyspark.sql import functions as F

from ..operators import automl as AM
from ..operators import explain as XP
from ..operators import learners as LR
from ..operators import metrics as M
from ..operators import penalised as PN
from ..operators.design import fit_design
from ..operators.split import train_test_split
from ..sources.tables import load_table
from ..session import ensure_checkpoint_dir
from ..sources import bundles as B
from . import fixtures as fx
from . import ols_sql as SQL
from .registry import register, rounded, rsql

FEATS = ["value", "user_id", "event_type"]
#: Numbers the folders that queries of one process write.
_STREAM_RUNS = itertools.count()


# event types in order, the first being the base level
_TYPES = ("click", "error", "purchase", "signup", "view")
_SPLIT_SQL = f"""(SELECT event_id, value, user_id, event_type, {fx.EV_Y} AS y,
  row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR) || ':42'), event_id) <= floor(0.8 * count(*) OVER ()) AS train
  FROM events)"""


def _linear_sql(columns: str) -> str:
    """Predictions of the linear model, fitted on the train rows, for the test rows."""
    levels = [f"(event_type = '{t}')::INT" for t in _TYPES[1:]]
    terms = ["value", "user_id", *levels]
    predicted = "b0 + " + " + ".join(f"b{j} * {x}" for j, x in enumerate(terms, 1))
    return (SQL.ols(f"(SELECT * FROM {_SPLIT_SQL} AS t WHERE train)", terms)
            + f" SELECT {columns}, {predicted} AS prediction FROM {_SPLIT_SQL} AS t, fit WHERE NOT train")


def _ridge_sql(penalty: float) -> str:
    """Ridge as least squares: a pair of rows at plus and minus ``sqrt(n lambda / 2)`` for each standardised feature."""
    levels = [f"(event_type = '{t}')::INT" for t in _TYPES[1:]]
    terms = ["value", "user_id", *levels]
    k = len(terms)
    train = f"(SELECT y, {', '.join(f'CAST({x} AS DOUBLE) AS v{j}' for j, x in enumerate(terms, 1))} FROM {_SPLIT_SQL} AS t WHERE train)"
    moments = "SELECT count(*) AS cnt, avg(y) AS ay, stddev_pop(y) AS sy, " + ", ".join(
        f"avg(v{j}) AS a{j}, stddev_pop(v{j}) AS d{j}" for j in range(1, k + 1)) + f" FROM {train} AS t"
    scaled = ", ".join(f"(v{j} - a{j}) / d{j} AS v{j}" for j in range(1, k + 1))
    extra = " UNION ALL ".join(
        f"SELECT 0.0 AS y, {', '.join(f'{sign}sqrt(cnt * {penalty} / sy / 2) AS v{i}' if i == j else f'0.0 AS v{i}' for i in range(1, k + 1))} FROM m"
        for j in range(1, k + 1) for sign in ("", "-"))
    rows = f"(WITH m AS ({moments}) SELECT (y - ay) / sy AS y, {scaled} FROM {train} AS t, m UNION ALL {extra})"
    predicted = "ay + sy * (" + " + ".join(f"fit.b{j} * ({x} - a{j}) / d{j}" for j, x in enumerate(terms, 1)) + ")"
    return (SQL.ols(rows, [f"v{j}" for j in range(1, k + 1)])
            + f" SELECT event_id, y AS actual, {predicted} AS prediction FROM {_SPLIT_SQL} AS t, fit, ({moments}) AS m WHERE NOT train")


def _split(spark, sf):
    return train_test_split(fx.ev_learn(spark, sf), "event_id", 0.8, 42)


def _reg_query(algo, params=None):
    def q(spark, sf):
        tr, te = _split(spark, sf)
        t = LR.train(tr, "y", FEATS, algo, task="regression", params=params)
        return rounded(t.predict(te, keep=["event_id", "y"]).withColumnRenamed("y", "actual"), 4)
    return q


# settings as the reference starts with them
for _name, _algo, _p in [
        ("r1_linear_test_predictions", "linear", None),
        ("r2_ridge_test_predictions", "ridge", {"lambda": 0.1}),
        ("r3_lasso_test_predictions", "lasso", {"lambda": 0.1}),
        ("r4_tree_test_predictions", "tree", {"depth": 5, "cp": 0.01}),
        ("r5_forest_test_predictions", "rf", {"trees": 100, "mtry": 2}),
        ("r6_svm_regression_test_predictions", "svm", {"kernel": "radial", "cost": 1.0, "epsilon": 0.1}),
        ("r7_boosting_test_predictions", "gbm", {"trees": 100, "depth": 3, "shrinkage": 0.1}),
        ("r8_network_regression_test_predictions", "nnet", {"size": 5, "decay": 0.01, "iters": 200})]:
    _sql = {"linear": _linear_sql("event_id, y AS actual"), "ridge": _ridge_sql(0.1)}.get(_algo)
    register(_name, rsql(_sql, ["actual", "prediction"], 4) if _sql else None)(_reg_query(_algo, _p))


# two features: with u = c - lambda * sign(c) both stay if the signs of their solution agree with those of c, else the one with the larger |c|
_PATH = (0.1, 2.0, 10.0, 25.0, 60.0)


@register("r3_lasso_path_two_features", rsql(f"""
WITH m AS (SELECT count(*) AS n, stddev_pop(value) AS s1, stddev_pop(user_id) AS s2, stddev_pop(y) AS sy, corr(value, user_id) AS r,
    corr(value, y) AS c1, corr(user_id, y) AS c2 FROM (SELECT value, user_id, {fx.EV_Y} AS y FROM events) AS e),
l AS (SELECT m.*, penalty, penalty / sy AS pen FROM m, (VALUES {", ".join(f"({v})" for v in _PATH)}) AS p(penalty)),
u AS (SELECT *, c1 - pen * sign(c1) AS u1, c2 - pen * sign(c2) AS u2 FROM l),
b AS (SELECT *, (u1 - r * u2) / (1 - r * r) AS f1, (u2 - r * u1) / (1 - r * r) AS f2 FROM u),
o AS (SELECT *, CASE WHEN f1 * c1 > 0 AND f2 * c2 > 0 THEN f1 WHEN abs(c1) >= abs(c2) AND abs(c1) > pen THEN u1 ELSE 0 END AS b1,
    CASE WHEN f1 * c1 > 0 AND f2 * c2 > 0 THEN f2 WHEN abs(c1) < abs(c2) AND abs(c2) > pen THEN u2 ELSE 0 END AS b2 FROM b)
SELECT CAST(penalty AS DOUBLE) AS penalty, 'value' AS term, b1 * sy / s1 AS estimate FROM o
UNION ALL SELECT CAST(penalty AS DOUBLE), 'user_id', b2 * sy / s2 FROM o""", ["penalty", "estimate"]))
def r3_path(spark, sf):
    df = fx.ev_learn(spark, sf)
    fit = PN.fit_path(df, fit_design(df, "y ~ value + user_id"), list(_PATH), 1.0)
    rows = [(penalty, term, float(b)) for penalty, bs in zip(fit.lambdas, fit.path) for term, b in zip(fit.design.names, bs)]
    return rounded(spark.createDataFrame(rows, "penalty double, term string, estimate double"))


def _cls_query(algo, target, params=None):
    def q(spark, sf):
        tr, te = _split(spark, sf)
        t = LR.train(tr, target, FEATS, algo, task="classification", params=params)
        out = t.predict(te, keep=["event_id", target]).withColumnRenamed(target, "actual")
        return rounded(out, 4)
    return q


_NB_TEST_SQL = f"""
WITH d AS (SELECT *, CASE WHEN y < 70 THEN 'a_low' WHEN y < 130 THEN 'b_mid' ELSE 'c_high' END AS cls FROM {_SPLIT_SQL} AS t),
st AS (SELECT cls, count(*) AS n, avg(value) AS mv, stddev_samp(value) AS sv, avg(user_id) AS mu,
              stddev_samp(user_id) AS su FROM d WHERE train GROUP BY cls),
ct AS (SELECT cls, event_type, count(*) AS c FROM d WHERE train GROUP BY cls, event_type),
l AS (SELECT d.event_id, d.cls AS actual, st.cls, st.n, ct.c, (SELECT sum(n) FROM st) AS total,
        -0.5 * power((d.value - mv) / sv, 2) - ln(sv * sqrt(2 * pi())) AS lv,
        -0.5 * power((d.user_id - mu) / su, 2) - ln(su * sqrt(2 * pi())) AS lu
      FROM d CROSS JOIN st LEFT JOIN ct ON ct.cls = st.cls AND ct.event_type = d.event_type WHERE NOT d.train),
s AS (SELECT event_id, actual, cls, ln(CAST(n AS DOUBLE) / total) + (CASE WHEN exp(lv) > 0 THEN lv ELSE ln(0.001) END)
        + (CASE WHEN exp(lu) > 0 THEN lu ELSE ln(0.001) END) + coalesce(ln(CAST(c AS DOUBLE) / n), ln(0.001)) AS s FROM l)
SELECT event_id, actual, cls AS prediction FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY s DESC, cls) AS rn FROM s) AS r WHERE rn = 1"""


for _name, _algo, _t, _p in [
        ("c1_logistic_binary_test_predictions", "logistic", "y2", None),
        ("c1_logistic_multinomial_test_predictions", "logistic", "y3", None),
        ("c2_tree_classifier_test_predictions", "tree", "y3", {"depth": 5, "cp": 0.01}),
        ("c3_forest_classifier_test_predictions", "rf", "y2", {"trees": 100, "mtry": 2}),
        ("c4_svm_classifier_test_predictions", "svm", "y2", {"kernel": "radial", "cost": 1.0}),
        ("c6_naive_bayes_test_predictions", "nb", "y3", None),
        ("c7_boosting_classifier_test_predictions", "gbm", "y2", {"trees": 100, "depth": 3, "shrinkage": 0.1}),
        ("c4_svm_multiclass_test_predictions", "svm", "y3", {"kernel": "radial", "cost": 1.0}),
        ("c7_boosting_multiclass_test_predictions", "gbm", "y3", {"trees": 100, "depth": 3, "shrinkage": 0.1}),
        ("c8_network_classifier_test_predictions", "nnet", "y3", {"size": 5, "iters": 200})]:
    register(_name, _NB_TEST_SQL if _algo == "nb" else None)(_cls_query(_algo, _t, _p))


# steps by a set of levels and by a number; what is added is too small for any further split to pay cp
_STEPS = "(CASE WHEN l_returnflag IN ('A', 'R') THEN 10.0 ELSE 0.0 END + CASE WHEN l_quantity > 25 THEN 5.0 ELSE 0.0 END)"
_NEAR_STEPS = f"({_STEPS} + ((l_partkey % 13) - 6) / 10.0)"
_RANK_OF_STEP = f"(CASE WHEN l_partkey % 40 = 0 THEN 'other' WHEN {_STEPS} < 5 THEN 'p' WHEN {_STEPS} < 10 THEN 'q' WHEN {_STEPS} < 15 THEN 'r' ELSE 's' END)"
_STEP_FEATURES = ["l_discount", "l_returnflag", "l_quantity"]


def _stepped(spark, sf):
    return load_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", *_STEP_FEATURES, F.expr(_NEAR_STEPS).alias("y"), F.expr(_RANK_OF_STEP).alias("cls"))


@register("r4_tree_leaves_of_planted_steps", rsql(f"""
SELECT avg({_NEAR_STEPS}) AS prediction, count(*) AS n FROM lineitem GROUP BY {_STEPS}""", ["prediction"], 6))
def r4_leaves(spark, sf):
    """Leaf means and counts of the pruned tree; a split by a set of levels is one split."""
    df = _stepped(spark, sf)
    t = LR.train(df, "y", _STEP_FEATURES, "tree", task="regression", params={"depth": 5, "cp": 0.01})
    return rounded(t.predict(df).groupBy("prediction").agg(F.count(F.lit(1)).alias("n")), 6)


@register("c2_tree_leaves_of_planted_steps", f"""
SELECT mode({_RANK_OF_STEP} ORDER BY l_orderkey) AS prediction, count(*) AS n, count(*) FILTER ({_RANK_OF_STEP} = 'other') AS others
FROM lineitem GROUP BY {_STEPS}""")
def c2_leaves(spark, sf):
    df = _stepped(spark, sf)
    t = LR.train(df, "cls", _STEP_FEATURES, "tree", task="classification", params={"depth": 5, "cp": 0.01})
    return t.predict(df, keep=["cls"]).groupBy("prediction").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("cls") == "other").alias("others"))


# without drawing rows a full tree parts all rows that differ, however deep that is
@register("r5_forest_of_full_trees", rsql(f"""
SELECT l_orderkey, l_linenumber, avg({_NEAR_STEPS}) OVER (PARTITION BY l_extendedprice) AS prediction
FROM lineitem""", ["prediction"], 8))
def r5_full(spark, sf):
    df = _stepped(spark, sf)
    t = LR.train(df, "y", ["l_extendedprice"], "rf", task="regression",
                 params={"trees": 3, "mtry": 1, "bootstrap": False, "min_split": 2})
    return rounded(t.predict(df, keep=["l_orderkey", "l_linenumber"]), 8)


@register("c3_forest_of_full_trees", f"""
WITH n AS (SELECT l_extendedprice, {_RANK_OF_STEP} AS cls, count(*) AS n FROM lineitem GROUP BY ALL),
m AS (SELECT l_extendedprice, cls FROM n QUALIFY row_number() OVER (PARTITION BY l_extendedprice ORDER BY n DESC, cls) = 1)
SELECT l_orderkey, l_linenumber, cls AS prediction FROM lineitem JOIN m USING (l_extendedprice)""")
def c3_full(spark, sf):
    df = _stepped(spark, sf)
    t = LR.train(df, "cls", ["l_extendedprice"], "rf", task="classification",
                 params={"trees": 3, "mtry": 1, "bootstrap": False})
    return t.predict(df, keep=["l_orderkey", "l_linenumber"])


def _knn_sql(target: str, k: int = 5) -> str:
    """All pairs: every train row at the k-th distance or nearer votes; a draw goes to the smallest class."""
    return f"""
WITH d AS (SELECT event_id, value, user_id, train, {target} AS cls FROM {_SPLIT_SQL} AS t),
p AS (SELECT q.event_id, q.cls AS actual, r.cls, (q.value - r.value) * (q.value - r.value)
        + (q.user_id - r.user_id) * (q.user_id - r.user_id) AS squared
      FROM d AS q JOIN d AS r ON NOT q.train AND r.train),
k AS (SELECT event_id, list_extract(min(squared, {k}), {k}) AS reach FROM p GROUP BY event_id),
v AS (SELECT event_id, actual, p.cls, count(*) AS n FROM p JOIN k USING (event_id) WHERE squared <= reach GROUP BY ALL)
SELECT event_id, actual, cls AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY n DESC, cls) = 1"""


@register("c5_knn_test_predictions", _knn_sql("CASE WHEN y < 70 THEN 'a_low' WHEN y < 130 THEN 'b_mid' ELSE 'c_high' END"))
def c5_knn(spark, sf):
    tr, te = _split(spark, sf)
    t = LR.train(tr, "y3", ["value", "user_id"], "knn", task="classification", params={"k": 5})
    return t.predict(te, keep=["event_id", "y3"]).withColumnRenamed("y3", "actual")


NB_SQL = f"""
WITH d AS (SELECT event_id, value, user_id, event_type, {fx.EV_CLS2} AS y FROM events),
st AS (SELECT y, count(*) AS n, avg(value) AS mv, stddev_samp(value) AS sv, avg(user_id) AS mu,
              stddev_samp(user_id) AS su FROM d GROUP BY y),
tot AS (SELECT sum(n) AS total FROM st),
ct AS (SELECT y, event_type, count(*) AS c FROM d GROUP BY y, event_type),
sc AS (SELECT d.event_id, st.y AS cls,
  ln(CAST(st.n AS DOUBLE) / tot.total)
  + (CASE WHEN exp(-0.5 * power((d.value - mv) / sv, 2) - ln(sv * sqrt(2 * pi()))) > 0
          THEN -0.5 * power((d.value - mv) / sv, 2) - ln(sv * sqrt(2 * pi())) ELSE ln(0.001) END)
  + (CASE WHEN exp(-0.5 * power((d.user_id - mu) / su, 2) - ln(su * sqrt(2 * pi()))) > 0
          THEN -0.5 * power((d.user_id - mu) / su, 2) - ln(su * sqrt(2 * pi())) ELSE ln(0.001) END)
  + coalesce(ln(CAST(ct.c AS DOUBLE) / st.n), ln(0.001)) AS s
  FROM d CROSS JOIN st CROSS JOIN tot LEFT JOIN ct ON ct.y = st.y AND ct.event_type = d.event_type)
SELECT event_id, cls AS prediction FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY s DESC, cls) AS rn FROM sc) AS r WHERE rn = 1"""


@register("c6_naive_bayes_closed_form", NB_SQL)
def c6_nb_closed(spark, sf):
    df = fx.ev_learn(spark, sf)
    t = LR.train(df, "y2", FEATS, "nb", task="classification")
    return t.predict(df, keep=["event_id"]).select("event_id", "prediction")


NB_WIDE_SQL = """
WITH d AS (SELECT o_orderkey, o_totalprice AS x, CASE WHEN o_totalprice > 150000 THEN 'hi' ELSE 'lo' END AS y
           FROM orders),
st AS (SELECT y, count(*) AS n, avg(x) AS m, stddev_samp(x) AS s FROM d GROUP BY y),
sc AS (SELECT d.o_orderkey, st.y AS cls, ln(CAST(st.n AS DOUBLE) / (SELECT count(*) FROM d))
         + (CASE WHEN exp(-0.5 * power((d.x - m) / s, 2) - ln(s * sqrt(2 * pi()))) > 0
                 THEN -0.5 * power((d.x - m) / s, 2) - ln(s * sqrt(2 * pi())) ELSE ln(0.001) END) AS v
       FROM d CROSS JOIN st)
SELECT o_orderkey, cls AS prediction FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY v DESC, cls) AS rn FROM sc) AS r WHERE rn = 1"""


@register("c6_naive_bayes_wide_feature", NB_WIDE_SQL)
def c6_nb_wide(spark, sf):
    """A feature with a standard deviation in the tens of thousands decides the class."""
    df = load_table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("x"),
        F.when(F.col("o_totalprice") > 150000, "hi").otherwise("lo").alias("y"))
    t = LR.train(df, "y", ["x"], "nb", task="classification")
    return t.predict(df, keep=["o_orderkey"]).select("o_orderkey", "prediction")


@register("c9_levels_and_label_mapping", """
SELECT y3 AS level, CAST(row_number() OVER (ORDER BY y3) - 1 AS DOUBLE) AS label_index
FROM (SELECT DISTINCT """ + fx.EV_CLS3 + """ AS y3 FROM events) AS d""")
def c9_levels(spark, sf):
    df = fx.ev_learn(spark, sf)
    t = LR.train(df, "y3", ["value"], "nb", task="classification")
    return spark.createDataFrame([(lv, float(i)) for i, lv in enumerate(t.levels)], "level string, label_index double")


@register("c12_learner_roc_auc")
def c12_learner_roc(spark, sf):
    tr, te = _split(spark, sf)
    t = LR.train(tr, "y2", FEATS, "logistic", task="classification")
    pred = t.predict(te, keep=["event_id", "y2"])
    return rounded(M.auc(pred, "score", "y2", t.levels[1]), 6)


@register("c10_c11_learner_confusion")
def c10_learner_confusion(spark, sf):
    tr, te = _split(spark, sf)
    t = LR.train(tr, "y3", FEATS, "logistic", task="classification")
    pred = t.predict(te, keep=["y3"])
    return M.confusion_matrix(pred, "y3", "prediction", t.levels)


@register("r10_c13_native_importance")
def r10_importance(spark, sf):
    tr, _ = _split(spark, sf)
    parts = []
    for algo, task, target, p in [("linear", "regression", "y", None), ("rf", "regression", "y", {"trees": 100}),
                                  ("logistic", "classification", "y2", None)]:
        t = LR.train(tr, target, FEATS, algo, task=task, params=p)
        parts.append(XP.native_importance(t).withColumn("algorithm", F.lit(algo)))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return rounded(out, 6)


def _automl(spark, sf, target="y"):
    """A whole AutoML run: all learners with their default settings."""
    df = fx.ev_learn(spark, sf).select("event_id", target, *FEATS)
    return AM.run_automl(df, target, FEATS, key="event_id", test_pct=20)


@register("a3_a6_automl_regression_ranking")
def a3_automl(spark, sf):
    return rounded(_automl(spark, sf).ranking, 4)


@register("a3_a6_automl_classification_ranking")
def a3_automl_cls(spark, sf):
    return rounded(_automl(spark, sf, "y2").ranking, 4)


@register("a7_automl_best_predictions")
def a7_best(spark, sf):
    return rounded(_automl(spark, sf).best_predictions(keep=["event_id"]), 4)


@register("a8_run_registry")
def a8_registry(spark, sf):
    """A run is appended to the stored registry, failed learners with their error, and read back."""
    df = fx.ev_learn(spark, sf).select("event_id", "y", *FEATS)
    run = AM.run_automl(df, "y", FEATS, key="event_id", algos=("glm", "tree", "no_such_learner"))
    path = f"{ensure_checkpoint_dir(spark)}/runs_{os.getpid()}_{next(_STREAM_RUNS)}"
    AM.append_runs([run], path)
    return rounded(AM.read_runs(spark, path).drop("run_id"), 4)


@register("x2_x3_permutation_importance_top")
def x2_permutation(spark, sf):
    tr, te = _split(spark, sf)
    t = LR.train(tr, "y", FEATS, "linear", task="regression")
    imp = XP.permutation_importance(t, te, "event_id", n_perm=20)
    return rounded(XP.top_features(imp, 3), 6)


@register("x1_importance_without_a_native_one")
def x1_fallback(spark, sf):
    """A learner without its own importance is asked by shuffling."""
    tr, te = _split(spark, sf)
    t = LR.train(tr, "y2", FEATS, "nb", task="classification")
    return rounded(XP.native_importance(t, te, "event_id"), 6)


@register("s9_s10_v1_bundle_roundtrip_scoring")
def s9_bundle(spark, sf):
    tr, te = _split(spark, sf)
    t = LR.train(tr, "y2", FEATS, "rf", task="classification", params={"trees": 10})
    path = os.path.join(ensure_checkpoint_dir(spark), f"bundle_rf_{os.getpid()}")
    B.save_bundle(t, path, schema_of=tr)
    t2, meta = B.load_bundle(path)
    return B.score(te, t2, meta, keep=["event_id"]).select("event_id", "prediction")


@register("s7_v1_score_csv_file", rsql(_linear_sql("event_id"), ["prediction"], 4))
def s7_score_file(spark, sf):
    """S7 + V1 + S8: a CSV scoring file read with the bundle, scored and written as CSV."""
    tr, te = _split(spark, sf)
    t = LR.train(tr, "y", FEATS, "linear", task="regression")
    base = ensure_checkpoint_dir(spark)
    tag = f"{os.getpid()}_{abs(hash(sf)) % 10**8}"
    bundle = os.path.join(base, f"bundle_linear_{tag}")
    B.save_bundle(t, bundle, schema_of=tr)
    from ..sources.tables import write_predictions
    src = os.path.join(base, f"score_input_{tag}")
    write_predictions(te.select("event_id", *FEATS), src, "csv")
    pred = B.score_file(spark, src, bundle, out_path=os.path.join(base, f"score_output_{tag}"),
                        keep=["event_id"], fmt="csv")
    return rounded(pred.withColumn("event_id", F.col("event_id").cast("long")), 4)


# the stream scores with the same closed-form model as c6, so the same SQL is its oracle
@register("v1_stream_scoring_of_table_files", NB_SQL)
def v1_stream_scoring(spark, sf):
    """V1 on a stream: the events table read as a file stream, scored by a saved bundle
    (naive Bayes, a pure column expression), written by the file sink and read back."""
    from ..streaming.scoring import score_stream
    df = fx.ev_learn(spark, sf)
    t = LR.train(df, "y2", FEATS, "nb", task="classification")
    base = ensure_checkpoint_dir(spark)
    tag = f"{os.getpid()}_{abs(hash(sf)) % 10**8}_{next(_STREAM_RUNS)}"
    bundle = os.path.join(base, f"bundle_nb_stream_{tag}")
    B.save_bundle(t, bundle, schema_of=df)
    schema = spark.read.parquet(os.path.join(sf, "events.parquet")).schema
    out = os.path.join(base, f"scored_events_{tag}")
    # a file stream watches a folder or a glob: the glob names exactly the events file
    score_stream(spark, os.path.join(sf, "events.parq*"), schema, bundle, out, keep=["event_id"], fmt="parquet",
                 trigger_once=True).awaitTermination()
    return spark.read.parquet(out).select("event_id", "prediction")
