"""Trees and forests: splits against trying them all, pruning, depth, and large nodes against small ones."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import learners as LR
from quarry.operators import trees as TR
from quarry.sources import bundles as B


def sse(y):
    return float(((y - y.mean()) ** 2).sum()) if len(y) else 0.0


def gini(y):
    return len(y) - sum((y == c).sum() ** 2 for c in np.unique(y)) / len(y) if len(y) else 0.0


def best_gain(x, y, levels, impurity, bucket=1):
    """Largest fall of the impurity over every cut and every set of levels."""
    best = 0.0
    for f, k in enumerate(levels):
        if k:
            there = sorted(set(x[:, f]))
            sides = [np.isin(x[:, f], s) for r in range(1, len(there)) for s in itertools.combinations(there, r)]
        else:
            sides = [x[:, f] <= v for v in np.unique(x[:, f])[:-1]]
        for side in sides:
            if min(side.sum(), (~side).sum()) >= bucket:
                best = max(best, impurity(y) - impurity(y[side]) - impurity(y[~side]))
    return best


@pytest.mark.parametrize("classes", [0, 2])
def test_every_split_is_the_best_of_all(classes):
    rng = np.random.default_rng(classes)
    levels = (0, 5, 0)
    x = np.column_stack([rng.integers(0, 12, 120), rng.integers(0, 5, 120), rng.normal(size=120)]).astype(float)
    y = rng.integers(0, 2, 120).astype(float) if classes else x[:, 0] * (x[:, 1] % 2) + rng.normal(size=120)
    tree = TR.grow_local(x, y, np.ones(120), TR.Shape(levels, classes), TR.Limits(), 3, 1)
    impurity = gini if classes else sse
    rows = {0: np.arange(120)}
    for i in range(len(tree.feature)):
        if tree.feature[i] < 0:
            continue
        on = rows[i]
        assert tree.gain[i] == pytest.approx(best_gain(x[on], y[on], levels, impurity), abs=1e-8)
        left = tree.goes_left(np.full(len(on), i), x[on])
        rows[int(tree.left[i])], rows[int(tree.right[i])] = on[left], on[~left]
        assert tree.stats[tree.left[i], 0] == left.sum()
    leaf = tree.leaf_of(x)
    assert all(impurity(y[leaf == n]) < 1e-6 for n in np.unique(leaf))  # grown until nothing is left to split


def test_pruning_is_the_cheapest_of_all_prunings():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2))
    y = (x[:, 0] > 0) * 3 + rng.normal(size=60)
    shape = TR.Shape((0, 0))
    tree = TR.grow_local(x, y, np.ones(60), shape, TR.Limits(4, 4, 2), 2, 1)
    risk = TR.risks(tree.stats, shape)

    def prunings(i):
        """(risk, leaves) of every way to cut the branch of ``i`` back."""
        out = [(risk[i], 1)]
        if tree.feature[i] >= 0:
            out += [(a + c, b + d) for a, b in prunings(tree.left[i]) for c, d in prunings(tree.right[i])]
        return out

    for price in (0.0, 1.0, 4.0, 20.0, 1e6):
        cut = tree.pruned(price, shape)
        leaves = cut.feature < 0
        cost = TR.risks(cut.stats, shape)[leaves].sum() + price * leaves.sum()
        assert cost == pytest.approx(min(r + price * n for r, n in prunings(0)))
    assert len(tree.pruned(1e6, shape).feature) == 1


def frame(spark, n=3_000):
    rng = np.random.default_rng(7)
    a, b, c = rng.integers(0, 40, n), rng.choice(list("pqrstu"), n), rng.normal(size=n)
    y = 5.0 * np.isin(b, ["p", "s", "u"]) + 3.0 * (a > 17) + rng.normal(size=n) * 0.3
    return spark.createDataFrame([(i, float(u), str(v), float(w), float(t), "hi" if t > 5 else "lo")
                                  for i, (u, v, w, t) in enumerate(zip(a, b, c, y, strict=True))],
                                 "i long, a double, b string, c double, y double, cls string")


def test_large_nodes_on_spark_equal_one_piece(spark):
    """Nodes counted by bins and split level by level give the tree that is grown in memory."""
    df = frame(spark)
    got = {}
    for local in (100_000, 200):
        t = LR.train(df, "y", ["a", "b"], "tree", task="regression", params={"depth": 4, "cp": 0.001, "local_rows": local})
        got[local] = sorted((r["i"], round(r["prediction"], 8)) for r in t.predict(df, keep=["i"]).collect())
        assert len({p for _, p in got[local]}) >= 4
        assert len(t.model.tops[0].subsets) == 2 or len(t.model.tops[0].subsets) == 1
    assert got[100_000] == got[200]


@pytest.mark.parametrize("target", ["y", "cls"])
def test_forest_over_large_nodes_and_both_ways_to_predict(spark, monkeypatch, target):
    df = frame(spark, 1_500)
    task = "regression" if target == "y" else "classification"
    t = LR.train(df, target, ["a", "b", "c"], "rf", task=task, params={"trees": 12, "mtry": 2, "local_rows": 250})
    assert all((top.feature >= 0).any() for top in t.model.tops) and t.model.branches.count() > 12
    here = sorted(tuple(r) for r in t.predict(df, keep=["i", target]).collect())
    if target == "y":
        error = np.mean([(r[2] - r[1]) ** 2 for r in here])
        assert error < 0.3 * np.var([r[1] for r in here])
    else:
        assert np.mean([r[1] == r[2] for r in here]) > 0.95
    monkeypatch.setattr(TR, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(TR, "BLOCK", 100)
    apart = sorted(tuple(r) for r in t.predict(df, keep=["i", target]).collect())
    assert [r[:2] for r in apart] == [r[:2] for r in here]
    assert all(x[2] == pytest.approx(y[2]) for x, y in zip(apart, here, strict=True))
    top = dict(LR.importance(t))
    assert set(top) == {"a", "b", "c"} and top["c"] < min(top["a"], top["b"])


def test_a_narrow_node_gets_bins_of_its_own(spark):
    """Most rows at one value and a step among the few beside it: the table's quantiles cannot see it."""
    df = spark.range(4_000).select(F.when(F.col("id") < 3_600, F.lit(0.0)).otherwise(1 + (F.col("id") - 3_600) / 1e6).alias("x"),
                                   F.when(F.col("id") >= 3_800, F.lit(9.0)).otherwise(F.lit(0.0)).alias("y"))
    t = LR.train(df, "y", ["x"], "tree", task="regression", params={"depth": 6, "cp": 0.0, "local_rows": 100})
    assert t.predict(df, keep=["y"]).where(F.abs(F.col("y") - F.col("prediction")) > 1e-9).count() == 0


def test_depth_has_no_limit_and_equal_rows_end_it(spark):
    deep = spark.range(64).select((F.pow(F.lit(2.0), F.col("id"))).alias("x"), (F.col("id") % 2).cast("double").alias("y"))
    t = LR.train(deep, "y", ["x"], "rf", task="regression", params={"trees": 1, "mtry": 1, "bootstrap": False, "min_split": 2})
    assert t.predict(deep, keep=["y"]).where("y != prediction").count() == 0
    same = spark.range(50).select(F.lit(1.0).alias("x"), (F.col("id") % 2).cast("double").alias("y"))
    t = LR.train(same, "y", ["x"], "rf", task="regression", params={"trees": 2, "mtry": 1, "local_rows": 10})
    assert t.predict(same).distinct().count() == 1


def test_draws_are_poisson_and_alike():
    rows = np.arange(200_000)
    w = TR.draws(rows, 3, 42)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.005
    assert (TR.draws(rows[100:200], 3, 42) == w[100:200]).all()
    assert abs(np.corrcoef(w, TR.draws(rows, 4, 42))[0, 1]) < 0.01


def test_unseen_levels_and_bundles(spark, tmp_path):
    df = frame(spark, 600)
    for algo, target, params in (("tree", "cls", {"depth": 4, "cp": 0.01}), ("rf", "y", {"trees": 5, "mtry": 2, "local_rows": 200})):
        task = "classification" if target == "cls" else "regression"
        t = LR.train(df, target, ["a", "b"], algo, task=task, params=params)
        other = df.withColumn("b", F.when(F.col("i") % 3 == 0, F.lit("new")).otherwise(F.col("b")))
        want = sorted(tuple(r) for r in t.predict(other, keep=["i"]).collect())
        assert len(want) == 600
        B.save_bundle(t, str(tmp_path / algo), schema_of=df)
        again, _ = B.load_bundle(str(tmp_path / algo))
        assert sorted(tuple(r) for r in again.predict(other, keep=["i"]).collect()) == want


def test_rows_and_subtrees_meet_in_every_partition(spark, monkeypatch):
    """Groups of rows and of subtrees have keys of the same types, and subtrees are not sent to all."""
    df = frame(spark, 1_500)
    t = LR.train(df, "cls", ["a", "b", "c"], "rf", task="classification", params={"trees": 6, "mtry": 2, "local_rows": 250})
    here = sorted(tuple(r) for r in t.predict(df, keep=["i"]).select("i", "prediction").collect())
    monkeypatch.setattr(TR, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(TR, "BLOCK", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        apart = t.predict(df, keep=["i"]).select("i", "prediction")
        assert "BroadcastHashJoin" not in "".join(
            line for line in apart._jdf.queryExecution().executedPlan().toString().splitlines() if "LeftOuter" in line)
        assert sorted(tuple(r) for r in apart.collect()) == here
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_leaves_of_rows_together_and_alone(monkeypatch):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=900), rng.integers(-1, 4, 900), rng.integers(0, 30, 900)]).astype(float)
    tree = TR.grow_local(x, rng.normal(size=900), np.ones(900), TR.Shape((0, 4, 0)), TR.Limits(), 3, 1)
    alone = np.array([tree.leaf_of(row[None, :])[0] for row in x])
    assert (tree.leaf_of(x) == alone).all() and len(np.unique(alone)) > 200
