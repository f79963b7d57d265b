"""Ridge and lasso paths by their optimality conditions; Durbin-Watson against the dense formulas."""

import numpy as np
import pytest

from quarry.operators import learners as LR
from quarry.operators import linear as L
from quarry.operators import penalised as PN
from quarry.operators.design import fit_design
from quarry.sources import bundles as B


def data(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.normal(size=n) * 5
    c = a * 0.9 + rng.normal(size=n) * 0.2
    g = rng.choice(list("xyz"), n)
    y = 3 * a - 0.4 * b + 2 * (g == "y") + rng.normal(size=n)
    return spark.createDataFrame([(i, *map(float, v), str(s), 1.0, float(t)) for i, (*v, s, t) in enumerate(zip(a, b, c, g, y, strict=True))],
                                 "i long, a double, b double, c double, g string, one double, y double")


@pytest.mark.parametrize("alpha", [0.0, 0.5, 1.0])
def test_path_meets_the_optimality_conditions(spark, alpha):
    df = data(spark)
    design = fit_design(df, "y ~ a + b + c + g + one")
    fit = PN.fit_path(df, design, [0.01, 0.1, 0.5, 2.0, 50.0], alpha)
    rows = df.toPandas()
    x = np.column_stack([rows.a, rows.b, rows.c, rows.g == "y", rows.g == "z", rows.one]).astype(float)
    y = rows.y.to_numpy()
    sd, sy = x.std(axis=0), y.std()
    z = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)
    assert fit.lambdas == sorted(fit.lambdas, reverse=True)
    for penalty, coef, start in zip(fit.lambdas, fit.path, fit.intercepts, strict=True):
        left = (y - start - x @ coef) / sy
        assert abs(left.mean()) < 1e-9
        b = coef * sd / sy
        pull = z.T @ left / len(y) - penalty / sy * (1 - alpha) * b
        limit = penalty / sy * alpha
        for j in range(len(b)):
            if b[j]:
                assert pull[j] == pytest.approx(limit * np.sign(b[j]), abs=1e-8)
            else:
                assert abs(pull[j]) <= limit + 1e-8
        assert coef[5] == 0  # constant
    if alpha == 1:
        assert not fit.path[0].any() and fit.path[-1][:2].all()


def test_learners_predict_as_columns_and_survive_a_bundle(spark, tmp_path):
    df = data(spark)
    for algo in ("ridge", "lasso"):
        t = LR.train(df, "y", ["a", "b", "g"], algo, task="regression", params={"lambda": 0.05})
        want = sorted(tuple(r) for r in t.predict(df, keep=["i"]).collect())
        B.save_bundle(t, str(tmp_path / algo), schema_of=df)
        again, _ = B.load_bundle(str(tmp_path / algo))
        assert sorted(tuple(r) for r in again.predict(df, keep=["i"]).collect()) == want
        assert dict(LR.importance(t))["a"] > 1
    with pytest.raises(ValueError):
        LR.train(df, "y", ["a"], "ridge", task="regression", params={"lambda": -1})


@pytest.mark.parametrize("chunk", [7, 100_000])
def test_durbin_watson_against_dense_matrices(spark, monkeypatch, chunk):
    monkeypatch.setattr(L, "CHUNK", chunk)
    df = data(spark, 80)
    fit = L.fit_ols(df, "y ~ a + b + g")
    got = L.durbin_watson(df, fit, "i").first()
    rows = df.toPandas().sort_values("i")
    x = np.column_stack([np.ones(80), rows.a, rows.b, rows.g == "y", rows.g == "z"]).astype(float)
    y = rows.y.to_numpy()
    e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    steps = np.diff(np.eye(80), axis=0)
    a = steps.T @ steps
    left = np.eye(80) - x @ np.linalg.inv(x.T @ x) @ x.T
    ma = left @ a
    free = 80 - 5
    expected = np.trace(ma) / free
    variance = 2 * (np.trace(ma @ ma) - np.trace(ma) * expected) / (free * (free + 2))
    assert got["dw"] == pytest.approx(e @ a @ e / (e @ e))
    assert got["expected"] == pytest.approx(expected)
    assert got["variance"] == pytest.approx(variance)
    assert 0 < got["p_value"] < 1
