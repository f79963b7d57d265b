"""Boosting of classes: deviance, probabilities, and large tables against one piece."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import boosting as BO
from quarry.operators import learners as LR
from quarry.operators import trees as TR
from quarry.sources import bundles as B


def frame(spark, n=900):
    rng = np.random.default_rng(6)
    a, b, g = rng.uniform(0, 10, n).round(1), rng.uniform(0, 10, n).round(1), rng.choice(list("pqrs"), n)
    cls = np.where(np.isin(g, ["p", "r"]) & (a > 4), "x", np.where(b > 6, "y", "z"))
    return spark.createDataFrame([(i, float(u), float(v), str(w), str(c), "hi" if u + v > 10 else "lo")
                                  for i, (u, v, w, c) in enumerate(zip(a, b, g, cls, strict=True))],
                                 "i long, a double, b double, g string, cls string, two string")


@pytest.mark.parametrize("target", ["cls", "two"])
def test_deviance_falls_and_probabilities_sum_to_one(spark, tmp_path, target):
    df = frame(spark)
    t = LR.train(df, target, ["a", "b", "g"], "gbm", task="classification", params={"trees": 40, "depth": 3, "shrinkage": 0.2})
    assert len(t.model.deviances) == 41 and all(y < x for x, y in zip(t.model.deviances, t.model.deviances[1:]))
    assert len(t.model.rounds[0]) == (3 if target == "cls" else 1)
    assert max(len(tree.feature) for trees in t.model.rounds for tree, _ in trees) <= 7  # three splits
    rows = df.toPandas()
    level = {v: k for k, v in enumerate("pqrs")}
    x = np.column_stack([rows.a, rows.b, rows.g.map(level)]).astype(float)
    p = t.model.chances(x)
    assert p.sum(axis=1) == pytest.approx(np.ones(len(x))) and (p > 0).all()
    own = p[np.arange(len(x)), [t.levels.index(c) for c in rows[target]]]
    assert -2 * np.log(own).sum() == pytest.approx(t.model.deviances[-1])
    got = t.predict(df, keep=["i", target]).toPandas()
    assert (got.prediction == got[target]).mean() > 0.95
    assert dict(LR.importance(t))["a"] > 0
    B.save_bundle(t, str(tmp_path / "b"), schema_of=df)
    again, _ = B.load_bundle(str(tmp_path / "b"))
    assert again.predict(df, keep=["i"]).toPandas().sort_values("i").prediction.tolist() == got.sort_values("i").prediction.tolist()


def test_passes_over_a_large_table_equal_one_piece(spark, monkeypatch):
    monkeypatch.setattr(BO, "REFRESH", 2)
    df = frame(spark, 300)
    found = []
    for local in (100_000, 10):
        t = LR.train(df, "cls", ["a", "b", "g"], "gbm", task="classification",
                     params={"trees": 5, "depth": 2, "shrinkage": 0.3, "local_rows": local})
        found.append(t.model)
    assert found[0].deviances == pytest.approx(found[1].deviances)
    for one, other in zip(found[0].rounds, found[1].rounds, strict=True):
        for (a, v), (b, w) in zip(one, other, strict=True):
            assert a.feature.tolist() == b.feature.tolist() and a.cut == pytest.approx(b.cut) and v == pytest.approx(w)


def test_leaves_by_bins_are_the_leaves_of_the_rows(spark):
    """A pass looks rows up by their bins, a prediction by their values."""
    rng = np.random.default_rng(9)
    x = np.column_stack([rng.normal(size=400), rng.integers(0, 5, 400), rng.integers(0, 9, 400)]).astype(float)
    shape = TR.Shape((0, 5, 0), 3)
    rows = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, rng.integers(0, 3, 400))], "x array<double>, y int")
    model = BO.fit(rows, shape, 4, 3, 0.5, local_rows=10)
    got = rows.agg(*[F.percentile_approx(F.col("x")[f], [i / TR.BINS for i in range(TR.BINS)], 10_000).alias(f"c{f}") for f in (0, 2)]).first()
    cuts = [np.unique(got["c0"]), np.zeros(0), np.unique(got["c2"])]
    bins = BO.binned(x, cuts, shape)
    for trees in model.rounds:
        for tree, _ in trees:
            assert (BO.leaves(tree, bins, cuts) == tree.leaf_of(x)).all()
    scores = BO.caught_up(np.tile(model.start[:, None], len(x)), bins, cuts, model.rounds)
    assert scores.T == pytest.approx(model.scores(x))
