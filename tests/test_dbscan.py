"""DBSCAN against a brute-force reference implementation on small fixtures."""

import random

import pytest

from quarry.operators.dbscan import dbscan


def brute_dbscan(pts, eps, min_pts):
    n = len(pts)
    nb = [[j for j in range(n) if sum((a - b) ** 2 for a, b in zip(pts[i], pts[j])) <= eps * eps] for i in range(n)]
    core = [len(x) >= min_pts for x in nb]
    comp = [-1] * n
    c = 0
    for i in range(n):
        if core[i] and comp[i] < 0:
            stack = [i]
            comp[i] = c
            while stack:
                k = stack.pop()
                for j in nb[k]:
                    if core[j] and comp[j] < 0:
                        comp[j] = c
                        stack.append(j)
            c += 1
    # partition as sets: cores by component, borders by the components they can reach
    return core, comp, nb


def _check(spark, pts, eps, min_pts):
    df = spark.createDataFrame([tuple(p) + (i,) for i, p in enumerate(pts)],
                               ", ".join(f"f{k} double" for k in range(len(pts[0]))) + ", rid long")
    got = {r.rid: r.cluster for r in dbscan(df, [f"f{k}" for k in range(len(pts[0]))], eps, min_pts).collect()}
    core, comp, nb = brute_dbscan(pts, eps, min_pts)
    # same partition of core points
    mapping = {}
    for i in range(len(pts)):
        if core[i]:
            assert got[i] > 0
            assert mapping.setdefault(comp[i], got[i]) == got[i]
    assert len(set(mapping.values())) == len(mapping)
    for i in range(len(pts)):
        if not core[i]:
            reach = {mapping[comp[j]] for j in nb[i] if core[j]}
            if reach:
                assert got[i] == min(reach)
            else:
                assert got[i] == 0


@pytest.mark.parametrize("d,seed", [(1, 0), (2, 1), (2, 2), (3, 3)])
def test_dbscan_matches_brute_force(spark, d, seed):
    rnd = random.Random(seed)
    pts = []
    for c in range(4):
        centre = [rnd.uniform(-5, 5) for _ in range(d)]
        for _ in range(60):
            pts.append([x + rnd.gauss(0, 0.3) for x in centre])
    pts += [[rnd.uniform(-8, 8) for _ in range(d)] for _ in range(40)]
    pts += [pts[0]] * 30          # a hot duplicated point
    _check(spark, pts, 0.5, 5)


def test_dbscan_dense_hot_region(spark):
    rnd = random.Random(7)
    pts = [[rnd.uniform(0, 0.3), rnd.uniform(0, 0.3)] for _ in range(400)]      # one dense cell block
    pts += [[rnd.uniform(0.35, 0.7), rnd.uniform(0, 0.3)] for _ in range(400)]  # adjacent dense block
    pts += [[5 + rnd.random(), 5 + rnd.random()] for _ in range(3)]             # noise
    _check(spark, pts, 0.2, 4)
