"""Model bundles: every learner family saves, loads and predicts identically."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import learners as LR
from quarry.operators.transform import fit_scale
from quarry.plans import fixtures as fx
from quarry.sources import bundles as B

SF = "/root/testdata/sf0.001"
FEATS = ["value", "user_id", "event_type"]
CASES = [("linear", "regression", "y", None), ("rf", "regression", "y", {"trees": 5}),
         ("svm", "regression", "y", {"kernel": "linear"}), ("nnet", "regression", "y", {"iters": 10}),
         ("nb", "classification", "y3", None), ("logistic", "classification", "y2", None),
         ("svm", "classification", "y2", {"kernel": "radial", "n_features": 20}),
         ("gbm", "classification", "y3", {"trees": 3})]


@pytest.mark.parametrize("algo,task,target,params", CASES)
def test_bundle_roundtrip(spark, tmp_path, algo, task, target, params):
    df = fx.ev_learn(spark, SF)
    t = LR.train(df, target, FEATS, algo, task=task, params=params)
    path = str(tmp_path / f"{algo}_{task}")
    B.save_bundle(t, path, schema_of=df)
    t2, meta = B.load_bundle(path)
    assert meta["algo"] == algo and meta["task"] == task and meta["features"] == FEATS
    a = t.predict(df, keep=["event_id"]).withColumnRenamed("prediction", "p1")
    b = B.score(df, t2, meta, keep=["event_id"]).withColumnRenamed("prediction", "p2")
    j = a.join(b.select("event_id", "p2"), "event_id")
    if task == "regression":
        diff = j.agg(F.max(F.abs(F.col("p1") - F.col("p2")))).collect()[0][0]
        assert diff < 1e-9
    else:
        assert j.where("p1 <> p2").count() == 0


def test_bundle_carries_scaling(spark, tmp_path):
    df = fx.ev_learn(spark, SF)
    sc = fit_scale(df, ["value", "user_id"], "zscore")
    from quarry.operators.transform import apply_scale
    t = LR.train(apply_scale(df, sc), "y", FEATS, "linear", task="regression")
    B.save_bundle(t, str(tmp_path / "b"), schema_of=df, scaler=sc)
    t2, meta = B.load_bundle(str(tmp_path / "b"))
    raw = B.score(df, t2, meta, keep=["event_id", "y"])
    err = raw.agg(F.max(F.abs(F.col("y") - F.col("prediction")))).collect()[0][0]
    assert err < 1.0          # planted target recovered on the raw scale


def test_scoring_input_is_checked(spark, tmp_path):
    df = fx.ev_learn(spark, SF)
    t = LR.train(df, "y", FEATS, "linear", task="regression")
    B.save_bundle(t, str(tmp_path / "b"), schema_of=df)
    t2, meta = B.load_bundle(str(tmp_path / "b"))
    with pytest.raises(ValueError, match="Missing required columns"):
        B.score(df.drop("user_id"), t2, meta)
    with pytest.raises(ValueError, match="expected numeric"):
        B.score(df.withColumn("value", F.col("value").cast("string")), t2, meta)
