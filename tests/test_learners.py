"""Planted-truth checks for the learners (the given tables carry no signal of their own)."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import learners as LR
from quarry.operators import metrics as M
from quarry.operators.split import train_test_split
from quarry.plans import fixtures as fx

SF = "/root/testdata/sf0.01"
FEATS = ["value", "user_id", "event_type"]


@pytest.fixture(scope="module")
def split(spark):
    tr, te = train_test_split(fx.ev_learn(spark, SF), "event_id", 0.8, 42)
    return tr.cache(), te.cache()


@pytest.mark.parametrize("algo,params,min_r2", [("linear", None, 0.999), ("ridge", {"lambda": 0.01}, 0.99),
                                                ("rf", {"trees": 20}, 0.9), ("gbm", {"trees": 20}, 0.95)])
def test_regressors_recover_planted_signal(spark, split, algo, params, min_r2):
    tr, te = split
    t = LR.train(tr, "y", FEATS, algo, task="regression", params=params)
    r = M.regression_metrics(t.predict(te, keep=["y"]), "y", "prediction", warn=False).collect()[0]
    assert r.R2 > min_r2


@pytest.mark.parametrize("algo,target,min_acc", [("logistic", "y2", 0.97), ("logistic", "y3", 0.95),
                                                 ("tree", "y2", 0.9), ("nb", "y2", 0.8)])
def test_classifiers_recover_planted_signal(spark, split, algo, target, min_acc):
    tr, te = split
    t = LR.train(tr, target, FEATS, algo, task="classification")
    r = M.classification_metrics(t.predict(te, keep=[target]), target, "prediction", t.levels).collect()[0]
    assert r.accuracy > min_acc


def test_linear_coefficients_and_importance(spark, split):
    tr, _ = split
    t = LR.train(tr, "y", FEATS, "linear", task="regression")
    coef = dict(zip(t.model.names, t.model.coef))
    assert abs(coef["value"] - 2) < 0.01 and abs(coef["event_typepurchase"] - 30) < 0.5
    imp = LR.importance(t)
    assert imp[0][0] == "value"


def test_automl_reports_and_skips_a_failing_learner(spark):
    from quarry.operators import automl as AM
    df = fx.ev_learn(spark, "/root/testdata/sf0.001").select("event_id", "y", *FEATS)
    res = AM.run_automl(df, "y", FEATS, key="event_id", algos=("glm", "tree", "nope"))
    assert "nope" in res.errors
    assert {r.algorithm for r in res.ranking.collect()} == {"glm", "tree"}
    assert res.best in ("glm", "tree") and res.run_id.startswith(res.best + "_")


def test_boosting_passes_over_few_parts(spark, split, monkeypatch):
    """A pass starts a task for each part, so parts of few rows made the passes slow."""
    many = split[0].repartition(60)
    parts, fit = [], LR.GBTRegressor.fit
    monkeypatch.setattr(LR.GBTRegressor, "fit", lambda self, rows: parts.append((rows.rdd.getNumPartitions(), rows.count())) or fit(self, rows))
    t = LR.train(many, "y", FEATS, "gbm", task="regression", params={"trees": 3})
    assert parts == [(spark.sparkContext.defaultParallelism, many.count())]
    monkeypatch.setattr(LR, "PASS_ROWS", 500)
    more = LR.train(many, "y", FEATS, "gbm", task="regression", params={"trees": 3})
    assert parts[1] == (-(-many.count() // 500), many.count())
    apart = t.predict(split[1], keep=["event_id"]).join(
        more.predict(split[1], keep=["event_id"]).withColumnRenamed("prediction", "other"), "event_id")
    assert apart.where(F.abs(F.col("prediction") - F.col("other")) > 1e-6).isEmpty()
