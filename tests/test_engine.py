"""Properties of the shared engine pieces: quantiles, row index, special functions."""

import math
import random

import numpy as np
import pytest

from quarry.functions import special
from quarry.functions.quantiles import quantiles
from quarry.functions.rowindex import with_row_index


def _type7(xs, p):
    xs = sorted(xs)
    h = (len(xs) - 1) * p
    lo = math.floor(h)
    hi = min(lo + 1, len(xs) - 1)
    return xs[lo] + (h - lo) * (xs[hi] - xs[lo])


@pytest.mark.parametrize("mode", ["whole", "sketched", "narrowed"])
def test_quantiles_match_type7(spark, mode):
    rnd = random.Random(3)
    vals = [rnd.gauss(0, 1) for _ in range(3000)] + [5.0] * 1000   # a hot value
    df = spark.createDataFrame([(v, float(i % 7)) for i, v in enumerate(vals)], "x double, z double")
    kw = {"whole": {}, "sketched": {"accuracy": 200}, "narrowed": {"accuracy": 200, "fetch": 10}}[mode]
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = quantiles(df, ["x", "z"], probs, **kw)
    for c, data in (("x", vals), ("z", [float(i % 7) for i in range(len(vals))])):
        for p, q in zip(probs, got[c]):
            assert math.isclose(q, _type7(data, p), rel_tol=1e-12, abs_tol=1e-12)


def test_grouped_quantiles(spark):
    rows = [(float(i), "a" if i % 2 else "b") for i in range(101)]
    df = spark.createDataFrame(rows, "x double, g string")
    got = quantiles(df, ["x"], [0.5], by="g", accuracy=10, fetch=5)
    assert got[("x", "a")][0] == _type7([r[0] for r in rows if r[1] == "a"], 0.5)
    assert got[("x", "b")][0] == _type7([r[0] for r in rows if r[1] == "b"], 0.5)


def test_row_index_is_dense_and_ordered(spark):
    df = spark.range(5000).selectExpr("id", "(id * 7919) % 5000 AS k")
    out = with_row_index(df, ["k"], "ix", buckets=7).collect()
    by_k = sorted(out, key=lambda r: r.k)
    assert [r.ix for r in by_k] == list(range(1, 5001))


def test_special_functions():
    assert math.isclose(special.t_sf2(2.0, 10), 0.07338803477074, rel_tol=1e-9)
    assert math.isclose(special.f_sf(3.0, 2, 20), 0.0726, abs_tol=1e-4)
    assert math.isclose(special.chi2_sf(3.84145882, 1), 0.05, rel_tol=1e-6)
    assert math.isclose(special.norm_cdf(1.96), 0.9750021, rel_tol=1e-6)
    assert special.stars(0.0001) == "***" and special.stars(0.07) == "." and special.stars(0.5) == ""


def test_shapiro_wilk_normal_vs_skewed():
    from quarry.operators.normality import shapiro_wilk_w
    rng = np.random.default_rng(0)
    w1, p1 = shapiro_wilk_w(rng.normal(size=500))
    w2, p2 = shapiro_wilk_w(rng.exponential(size=500))
    assert 0.99 < w1 <= 1 and p1 > 0.01
    assert w2 < 0.95 and p2 < 1e-6


def test_row_index_restarts_per_group(spark):
    df = spark.range(3000).selectExpr("id % 3 AS g", "id", "(id * 7919) % 3000 AS k")
    out = with_row_index(df, ["k"], "ix", buckets=5, group="g").collect()
    for g in range(3):
        rows = sorted((r for r in out if r.g == g), key=lambda r: r.k)
        assert [r.ix for r in rows] == list(range(1, 1001))


def test_row_index_over_a_text_key(spark):
    from quarry.functions.rowindex import with_row_index
    words = ["b", "a", "", "ab", "zzzzzzzz1", "zzzzzzzz0", "é", "aa"] * 1
    got = with_row_index(spark.createDataFrame([(w,) for w in words], "w string"), ["w"], "i").orderBy("i").collect()
    assert [r["w"] for r in got] == sorted(words, key=str.encode)
    assert [r["i"] for r in got] == list(range(1, len(words) + 1))


def test_wide_feature_decides_naive_bayes(spark):
    from quarry.operators import learners as LR
    df = spark.range(2000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'hi' ELSE 'lo' END AS y",
                                      "CASE WHEN id % 2 = 0 THEN 900000.0 + (id % 97) * 4000 ELSE (id % 89) * 4000.0 END AS x")
    t = LR.train(df, "y", ["x"], "nb", task="classification")
    assert t.predict(df, keep=["y"]).where("y = prediction").count() == 2000


def test_one_class_and_coincident_points_give_nulls_not_errors(spark):
    from quarry.operators import cluster, metrics
    one = spark.range(20).selectExpr("CAST(id AS DOUBLE) AS s", "1 AS l")
    assert metrics.auc(one, "s", "l", positive=1, direction=1).first()[0] is None
    same = spark.range(10).selectExpr("1.0 AS x", "CAST(id % 2 + 1 AS INT) AS cluster")
    assert {r["silhouette"] for r in cluster.silhouette(same, ["x"]).collect()} == {0.0}


def test_shapiro_sample_is_one_of_rows(spark):
    from quarry.operators.normality import shapiro_wilk
    df = spark.range(20_000).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS v")
    r = shapiro_wilk(df, ["v"]).first()
    assert r["n"] == 5000
    assert 0.5 < r["statistic"] < 1


def test_clara_finds_k_different_medoids(spark):
    from quarry.operators.cluster import clara
    df = spark.range(6000).selectExpr("CAST(id % 5 AS DOUBLE) AS a", "CASE WHEN id % 3 = 0 THEN 'x' ELSE 'y' END AS b")
    fit = clara(df, ["a", "b"], k=3)
    assert len({tuple(r) for r in fit.medoids.itertuples(index=False)}) == 3


def test_log_normal_tail_far_out():
    import math

    import numpy as np

    from quarry.functions.special import betainc, chi2_sf, f_sf, log_norm_cdf, t_sf2
    got = log_norm_cdf(np.array([-141.0, -5.0, 0.0, 2.0, 9.0]))
    assert abs(got[0] + 141.0**2 / 2 + math.log(141 * math.sqrt(2 * math.pi))) < 1e-4
    for z, v in zip((-5.0, 0.0, 2.0), got[1:4]):
        assert abs(v - math.log(0.5 * math.erfc(-z / math.sqrt(2)))) < 1e-12
    assert -1e-15 < got[4] <= 0
    # closed forms: chi-square with 2 and 4, t with 1 and 2, F with 2 numerator degrees of freedom
    assert abs(chi2_sf(3.0, 2) - math.exp(-1.5)) < 1e-14
    assert abs(chi2_sf(30.0, 4) - math.exp(-15) * 16) < 1e-18
    assert abs(t_sf2(1.0, 1) - 0.5) < 1e-13
    assert abs(t_sf2(2.0, 2) - (1 - 2 / math.sqrt(6))) < 1e-13
    assert abs(f_sf(3.0, 2, 100) - (1 + 6 / 100) ** -50) < 1e-13
    # log-gamma of 300,000 is about 3.5 million, so ten digits are left
    assert abs(betainc(2.5, 300_000.0, 1e-5) - (1 - betainc(300_000.0, 2.5, 1 - 1e-5))) < 1e-10


def test_clara_weighs_rows_by_their_multiplicity(spark):
    from quarry.operators.cluster import _pam, clara
    df = spark.range(1300).selectExpr("CASE WHEN id < 1000 THEN 0.0 ELSE CAST(id % 30 + 1 AS DOUBLE) END AS a")
    assert clara(df, ["a"], k=1).medoids["a"].tolist() == [0.0]  # the median of the rows; that of the values is 15
    rare = spark.range(100_003).selectExpr("CAST(greatest(id - 100000, 0) AS DOUBLE) AS a")
    assert sorted(clara(rare, ["a"], k=3).medoids["a"]) == [0.0, 1.0, 2.0]
    points, weights = np.array([0.0, 1.0, 2.0, 9.0]), np.array([1, 1, 1, 9])
    away = np.abs(points[:, None] - points[None, :])
    often = np.repeat(points, weights)
    assert points[_pam(away, 1, weights=weights)[0]] == often[_pam(np.abs(often[:, None] - often[None, :]), 1)[0]] == 9.0
