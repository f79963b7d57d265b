"""Networks: gradients, where training ends, and what weight decay does."""

import numpy as np
import pytest

from quarry.operators import learners as LR
from quarry.operators import network as NN
from quarry.sources import bundles as B


@pytest.mark.parametrize("classes", [0, 3])
def test_gradient_against_differences(classes):
    rng = np.random.default_rng(1)
    shape = NN.Shape(4, 3, classes)
    z, w = rng.normal(size=(20, 4)), rng.normal(size=shape.weights)
    y = rng.integers(0, 3, 20).astype(float)
    _, gradient = shape.loss(w, z, y)
    for i in range(len(w)):
        step = np.zeros(len(w))
        step[i] = 1e-6
        assert gradient[i] == pytest.approx((shape.loss(w + step, z, y)[0] - shape.loss(w - step, z, y)[0]) / 2e-6, abs=1e-5)


def test_lbfgs_ends_at_the_bottom_of_a_valley():
    def valley(points):
        return [((1 - w[0])**2 + 100 * (w[1] - w[0]**2)**2,
                 np.array([-2 * (1 - w[0]) - 400 * w[0] * (w[1] - w[0]**2), 200 * (w[1] - w[0]**2)])) for w in points]

    w, largest, used = NN.lbfgs(valley, np.array([-1.2, 1.0]), 200)
    assert largest <= NN.FLAT and used < 80
    assert w == pytest.approx([1, 1], abs=1e-3)


def frame(spark, n=400):
    rng = np.random.default_rng(2)
    a, b = rng.uniform(-2, 2, n), rng.uniform(-2, 2, n)
    y = np.sin(a) + 0.5 * b
    cls = np.where(a**2 + b**2 < 1.5, "in", np.where(a > 0, "right", "left"))
    return spark.createDataFrame([(i, float(u), float(v), float(t), str(c)) for i, (u, v, t, c) in enumerate(zip(a, b, y, cls, strict=True))],
                                 "i long, a double, b double, y double, cls string")


def test_training_ends_flat_and_fits(spark, tmp_path):
    df = frame(spark)
    t = LR.train(df, "y", ["a", "b"], "nnet", task="regression", params={"size": 4, "decay": 0.05})
    assert t.model.gradient <= NN.FLAT and t.model.passes <= 200
    # the gradient as told is that of all rows
    rows = df.toPandas()
    z = (rows[["a", "b"]].to_numpy() - t.model.mean) / t.model.sd
    w = np.concatenate([t.model.W1.ravel(), t.model.b1, t.model.w2, [t.model.b2]])
    _, gradient = NN.Shape(2, 4, 0).loss(w, z, (rows.y.to_numpy() - t.model.y_mean) / t.model.y_sd)
    assert np.abs((gradient + 0.05 * w) / len(rows)).max() == pytest.approx(t.model.gradient, rel=1e-3, abs=1e-9)
    got = t.predict(df, keep=["i", "y"]).toPandas()
    assert ((got.prediction - got.y)**2).mean() < 0.02 * got.y.var()
    B.save_bundle(t, str(tmp_path / "n"), schema_of=df)
    again, _ = B.load_bundle(str(tmp_path / "n"))
    assert again.predict(df, keep=["i"]).toPandas().sort_values("i").prediction.tolist() == pytest.approx(got.sort_values("i").prediction.tolist())


def test_classes_and_decay(spark, tmp_path):
    df = frame(spark)
    sizes = []
    for decay in (0.01, 5.0):
        t = LR.train(df, "cls", ["a", "b"], "nnet", task="classification", params={"size": 6, "decay": decay, "iters": 120})
        sizes.append(float((t.model.W1**2).sum() + (t.model.w2**2).sum()))
        got = t.predict(df, keep=["i", "cls"]).toPandas()
        share = (got.prediction == got.cls).mean()
        assert share > (0.95 if decay < 1 else 0.4)
    assert sizes[1] < 0.2 * sizes[0]
    chance = t.model.predict(np.array([[0.0, 1.0], [2.0, -2.0]]))
    assert chance.sum(axis=1) == pytest.approx([1, 1]) and (chance > 0).all()
    assert dict(LR.importance(t)).keys() == {"a", "b"}
    B.save_bundle(t, str(tmp_path / "c"), schema_of=df)
    again, _ = B.load_bundle(str(tmp_path / "c"))
    assert sorted(map(tuple, again.predict(df, keep=["i"]).collect())) == sorted(map(tuple, t.predict(df, keep=["i"]).collect()))
