"""k-medoids over the whole table against plain Python."""

import itertools

import numpy as np
import pytest

from quarry.operators import medoids as MD


def gower(points, numeric):
    """Distances of all pairs of tuples; the first ``numeric`` features are numbers."""
    cols = list(zip(*points))
    out = np.zeros((len(points), len(points)))
    for j, values in enumerate(cols):
        if j < numeric:
            v = np.array(values, dtype=float)
            out += np.abs(v[:, None] - v[None, :]) / (v.max() - v.min()) if v.max() > v.min() else 0
        else:
            v = np.array(values, dtype=object)
            out += v[:, None] != v[None, :]
    return out / len(cols)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_objective_is_the_least_of_all_sets(spark, k):
    rng = np.random.default_rng(k)
    rows = [(float(rng.integers(0, 9)), "xyz"[rng.integers(0, 3)]) for _ in range(60)] + [(4.0, "x")] * 40
    away = gower(rows, 1)
    distinct = sorted({r: i for i, r in enumerate(rows)}.values())
    least = min(away[:, list(s)].min(axis=1).sum() for s in itertools.combinations(distinct, k))
    fit = MD.k_medoids(spark.createDataFrame([*rows, (None, "x")], "a double, b string"), ["a", "b"], k=k)
    assert fit.objective == pytest.approx(least)
    assert fit.better_swaps == 0


def test_gains_and_changes_against_recounting(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), "pq"[c]) for a, b, c in zip(rng.normal(size=80), rng.integers(0, 5, 80), rng.integers(0, 2, 80))] * 2
    df = spark.createDataFrame(rows, "a double, b double, c string")
    features = ["a", "b", "c"]
    points = MD.weighted_rows(df, features, MD.gower_ranges(df, features))
    block = MD.draw(points, features, 20, 1)
    away = gower(rows, 2)
    place = {r: i for i, r in enumerate(rows)}
    at = [place[tuple(r[f] for f in features)] for r in block]
    medoids = at[:3]
    cost = away[:, medoids].min(axis=1).sum()
    gains, now = MD.start_gains(points, MD._points(block[:3]), MD._points(block))
    assert now == pytest.approx(cost)
    assert gains == pytest.approx([cost - away[:, [*medoids, j]].min(axis=1).sum() for j in at])
    changes, _ = MD.exchange_changes(points, MD._points(block[:3]), MD._points(block))
    for m in range(3):
        rest = [x for i, x in enumerate(medoids) if i != m]
        assert changes[m] == pytest.approx([away[:, [*rest, j]].min(axis=1).sum() - cost for j in at])


def test_blocks_after_the_first_improve_and_few_rows_are_all_medoids(spark):
    rng = np.random.default_rng(5)
    centres = rng.uniform(-50, 50, (4, 2))
    rows = [tuple((centres[i % 4] + rng.normal(size=2)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double")
    small = MD.k_medoids(df, ["a", "b"], k=4, candidates=8)
    large = MD.k_medoids(df, ["a", "b"], k=4, candidates=400)
    away = gower(rows, 2)
    assert small.objective < 1.3 * large.objective < 0.2 * away[:, [0]].min(axis=1).sum()
    assert len(MD.k_medoids(df.limit(3), ["a", "b"], k=5).medoids) == 3
    with pytest.raises(ValueError):
        MD.k_medoids(df.limit(0), ["a", "b"])
