"""Steps whose work or memory must not grow faster than the rows."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import automl as AM
from quarry.operators import cluster as K
from quarry.operators import explain as XP
from quarry.operators import gradient as GD
from quarry.operators import learners as LR
from quarry.operators import network as NN
from quarry.operators import trees as TR


def test_shuffles_are_placed_once_for_all_features(spark, monkeypatch):
    """one sort of all shuffles, whatever the number of features."""
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, float(a), float(b), float(3 * a + b)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))],
                               "i long, a double, b double, y double")
    t = LR.train(df, "y", ["a", "b"], "linear", task="regression")
    calls, inner = [], XP.with_row_index
    monkeypatch.setattr(XP, "with_row_index", lambda *a, **k: calls.append(k.get("group")) or inner(*a, **k))
    got = {r["feature"]: r["importance"] for r in XP.permutation_importance(t, df, "i", n_perm=5).collect()}
    assert calls.count("__r") == 1
    assert got["a"] > 5 * got["b"] > 0
    one = XP.permutation_importance(t, df, "i", n_perm=5, features=["b"]).collect()
    assert one[0]["importance"] == pytest.approx(got["b"])


def test_micro_clusters_read_bounded_parts(spark, monkeypatch):
    """No task reads more than a bounded number of rows."""
    parts = []

    class Watched(K.KMeans):
        def fit(self, df):
            parts.append(df.rdd.getNumPartitions())
            return super().fit(df)

    monkeypatch.setattr(K, "KMeans", Watched)
    monkeypatch.setattr(K, "ROWS_OF_TASK", 40)
    df = spark.range(0, 400, 1, 2).select((F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    fit = K.hierarchical(df, ["x", "y"], k=3, micro=10)
    assert parts == [10] and fit.micro_weights.sum() == 400


def test_gradient_sums_over_blocks(spark, monkeypatch):
    """rows are stored as blocks; their sums are those of the rows."""
    monkeypatch.setattr(GD, "_SLICE", 16)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(100, 3))
    df = spark.createDataFrame(v.tolist(), "a double, b double, y double").repartition(3)
    data = GD.design_arrays(df, ["a", "b"], "y")
    assert data.columns == ["rows", "n"] and data.agg(F.sum("n"), F.max("n")).first() == (100, 16)

    def fn(w, X, y):
        r = y - X @ w
        return float((r * r).sum()), -2 * X.T @ r

    w = np.array([0.5, -1.0])
    loss, gradient, n = GD._partials(data, fn, w)
    want = fn(w, v[:, :2], v[:, 2])
    assert n == 100 and loss == pytest.approx(want[0]) and gradient == pytest.approx(want[1])


def test_elbow_iterates_all_starts_in_the_same_passes(spark, monkeypatch):
    """Spark's fits give first centres only; the rounds of all starts and k share their passes, and end where Spark's do."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame(rng.normal(size=(300, 2)).tolist(), "x double, y double").repartition(3)
    rounds, passes, inner, lloyd = [], [], K.KMeans, K._lloyd

    def watched(**k):
        rounds.append(k["maxIter"])
        return inner(**k)

    monkeypatch.setattr(K, "KMeans", watched)
    monkeypatch.setattr(K, "_lloyd", lambda blocks, first, n: passes.append(len(first)) or lloyd(blocks, first, n))
    got = {r["k"]: r["wss"] for r in K.elbow(df, ["x", "y"], ks=range(1, 5), n_starts=2).collect()}
    assert passes == [6] and rounds == [0] * 6
    v = K._vec(df, ["x", "y"]).cache()
    for k in (2, 3, 4):
        spark_s = min(inner(k=k, maxIter=100, seed=s, tol=1e-6).fit(v).summary.trainingCost for s in (42, 43))
        assert got[k] == pytest.approx(spark_s, rel=1e-9)


def test_a_cluster_without_rows_keeps_its_centre(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "x double")
    blocks = K._blocks(K._vec(df, ["x"]), 1)
    (centers, cost), = K._lloyd(blocks, [np.array([[0.0], [99.0]])], 10)
    assert centers.tolist() == [[1.0], [99.0]] and cost == pytest.approx(2.0)


def test_network_passes_read_blocks(spark, monkeypatch):
    """a pass reads blocks of rows as bytes, and sums what the rows give."""
    seen, inner = [], NN.summed
    monkeypatch.setattr(NN, "summed", lambda blocks, *a: seen.append(blocks.columns) or inner(blocks, *a))
    rng = np.random.default_rng(4)
    v = rng.normal(size=(90, 3))
    df = spark.createDataFrame(v.tolist(), "a double, b double, y double").repartition(4)
    model = NN.fit_network(df, ["a", "b"], "y", size=2, iters=5)
    assert model.passes == 5 and set(map(tuple, seen)) == {("rows", "n")}
    shape, w = NN.Shape(2, 2, 0), rng.normal(size=9)
    (loss, gradient), = inner(GD.design_arrays(df, ["a", "b"], "y"), shape, [w])
    want = shape.loss(w, v[:, :2], v[:, 2])
    assert loss == pytest.approx(want[0]) and gradient == pytest.approx(want[1])


def test_rows_and_subtree_are_one_table(spark, monkeypatch):
    """rows and their subtree are grouped once, so that no plan can part them."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(a), float(b), float(a > 0) + float(b)) for a, b in rng.normal(size=(400, 2))], "a double, b double, y double")
    t = LR.train(df, "y", ["a", "b"], "rf", task="regression", params={"trees": 4, "mtry": 2, "local_rows": 100})
    here = sorted(tuple(r) for r in t.predict(df, keep=["a"]).collect())
    monkeypatch.setattr(TR, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(TR, "BLOCK", 50)
    apart = t.predict(df, keep=["a"])
    assert "CoGroup" not in apart._jdf.queryExecution().executedPlan().toString()
    assert [r[1] for r in sorted(tuple(r) for r in apart.collect())] == pytest.approx([r[1] for r in here])


def test_learners_train_side_by_side(spark, monkeypatch):
    """a learner does not wait for the one before it; the ranking is the same."""
    df = spark.createDataFrame([(i, float(i % 10), float(3 * (i % 10) + i % 3)) for i in range(120)], "id long, a double, y double")
    both, inner = threading.Barrier(2, timeout=60), LR.train

    def meet(*a, **k):
        both.wait()
        return inner(*a, **k)

    alone = AM.run_automl(df, "y", ["a"], key="id", algos=("glm", "tree"), parallel=1).ranking.orderBy("algorithm").collect()
    monkeypatch.setattr(LR, "train", meet)
    assert AM.run_automl(df, "y", ["a"], key="id", algos=("glm", "tree")).ranking.orderBy("algorithm").collect() == alone
