"""The k-nearest-neighbour classifier against all pairs."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import knn as KNN
from quarry.operators import learners as LR
from quarry.sources import bundles as B


def brute(train, test, k):
    """Votes of all train rows at the k-th distance or nearer."""
    x, y = np.array([t[:-1] for t in train], dtype=float), [t[-1] for t in train]
    out = []
    for q in test:
        squared = np.zeros(len(x))
        for j, v in enumerate(q):
            squared += (v - x[:, j]) * (v - x[:, j])
        reach = np.sort(squared)[min(k, len(x)) - 1]
        votes = Counter(y[i] for i in np.flatnonzero(squared <= reach))
        out.append(min(votes, key=lambda c: (-votes[c], c)))
    return out


def answers(spark, train, test, k, leaf_points=8):
    names = [f"f{j}" for j in range(len(test[0]))]
    model = LR.train(spark.createDataFrame([(*map(float, t[:-1]), t[-1]) for t in train], [*names, "cls"]), "cls", names, "knn",
                     task="classification", params={"k": k, "leaf_points": leaf_points})
    rows = spark.createDataFrame([(i, *map(float, t)) for i, t in enumerate(test)], ["x", *names])
    return model, {r["x"]: r for r in model.predict(rows, keep=["x"]).collect()}


@pytest.mark.parametrize(("case", "k"), [("spread", 1), ("spread", 5), ("lattice", 5), ("hot", 5), ("line", 1), ("one", 3)])
def test_equals_all_pairs(spark, case, k):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 3))
    if case == "lattice":  # many equal distances
        x = rng.integers(0, 6, (400, 3))
    if case == "hot":  # a third of the rows at one point
        x[:140] = x[0]
    if case == "line":
        x[:, 1:] = 0
    if case == "one":
        x[:] = 1
    y = rng.choice(["a", "b", "c"], 400)
    test = [*(x[:30] + (rng.normal(size=(30, 3)) if case == "spread" else 0)).tolist(), [50.0, -50.0, 3.0]]
    train = [(*map(float, v), str(c)) for v, c in zip(x, y, strict=True)]
    model, got = answers(spark, train, test, k)
    assert [got[i]["prediction"] for i in range(len(test))] == brute(train, test, k)
    if case == "spread":
        assert len(model.model.tree.levels) > 2 and max(model.model.tree.sizes) > 20


def test_fewer_rows_than_k_and_missing_features(spark):
    train = [(0.0, 0.0, "b"), (1.0, 0.0, "a"), (2.0, 2.0, "b")]
    _, got = answers(spark, train, [(0.0, 0.0), (9.0, 9.0)], 5)
    assert [got[i]["prediction"] for i in range(2)] == ["b", "b"]
    assert got[0]["score"] == pytest.approx(2 / 3)  # share of the second class
    _, got = answers(spark, train, [(0.0, float("nan")), (float("inf"), 1.0), (2.0, 2.0)], 1)
    assert {i: r["prediction"] for i, r in got.items()} == {2: "b"}


def test_work_follows_the_distinct_points(spark):
    """A third of train and test rows at one point: pairs met grow with distinct points, not with rows."""
    def met(copies):
        rows = spark.range(600).select(F.array((F.col("id") % 25).cast("double"), (F.col("id") / 25).cast("int").cast("double")).alias("x"),
                                       (F.col("id") % 3).cast("int").alias("label"))
        rows = rows.unionByName(spark.range(copies).select(F.array(F.lit(3.0), F.lit(4.0)).alias("x"), F.lit(1).alias("label")))
        tree = KNN.grow(KNN.weighted_points(rows), 2, 16)
        return KNN.classify(rows.select("x"), tree, 5).count(), tree.points.count()
    assert met(300) == (900, 600)
    assert met(3_000) == (3_600, 600)


def test_factor_features_and_bundle(spark, tmp_path):
    rows = spark.createDataFrame([(float(i % 7), "uv"[i % 2], "p" if i % 2 else "q") for i in range(60)], "a double, b string, y string")
    t = LR.train(rows, "y", ["a", "b"], "knn", task="classification", params={"k": 3})
    want = t.predict(rows, keep=["a", "b"]).collect()
    assert all(r["prediction"] == ("q" if r["b"] == "u" else "p") for r in want)
    B.save_bundle(t, str(tmp_path / "knn"), schema_of=rows)
    again, _ = B.load_bundle(str(tmp_path / "knn"))
    assert sorted(again.predict(rows, keep=["a", "b"]).collect()) == sorted(want)
