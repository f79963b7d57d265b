"""Operator properties on the given tables (small scale) and edge inputs."""

import math

import pytest
from pyspark.sql import functions as F

from quarry.operators import cleaning as C
from quarry.operators import cluster as K
from quarry.operators import linear as L
from quarry.operators import outliers as O
from quarry.operators import profile as P
from quarry.operators import transform as X
from quarry.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_zscore_gives_mean_0_sd_1(spark):
    li = fx.t(spark, SF, "lineitem")
    out = X.scale(li, ["l_extendedprice"], "zscore")
    r = out.agg(F.avg("l_extendedprice").alias("m"), F.stddev_samp("l_extendedprice").alias("s")).collect()[0]
    assert abs(r.m) < 1e-9 and abs(r.s - 1) < 1e-9


def test_constant_column_minmax_unchanged_and_zscore_missing(spark):
    df = spark.range(10).selectExpr("CAST(5 AS DOUBLE) AS c")
    assert {r.c for r in X.scale(df, ["c"], "minmax").collect()} == {5.0}
    assert {r.c for r in X.scale(df, ["c"], "zscore").collect()} == {None}


def test_one_hot_rows_sum_to_one(spark):
    o = fx.t(spark, SF, "orders").select("o_orderkey", "o_orderpriority")
    enc = X.encode(o, ["o_orderpriority"], full_rank=False)
    dummies = [c for c in enc.columns if c.startswith("o_orderpriority_")]
    assert len(dummies) == 5
    tot = enc.select(sum(F.col(c) for c in dummies).alias("s")).distinct().collect()
    assert [r.s for r in tot] == [1.0]


def test_dedup_idempotent(spark):
    e = fx.ev_dup(spark, SF)
    once = C.remove_duplicates(e)
    assert once.count() == C.remove_duplicates(once).count() == e.distinct().count()


def test_bin_labels_like_r_cut():
    br = X.equal_width_breaks(1.0, 50.0, 4)
    assert X.bin_labels(br) == ["[0.951,13.2]", "(13.2,25.5]", "(25.5,37.8]", "(37.8,50]"]
    assert X.equal_width_breaks(3.0, 3.0, 2) == [2.997, 3.0, 3.003]


def test_find_correlated_drops_the_duplicate():
    names = ["a", "b", "c"]
    m = [[1, 0.99, 0.1], [0.99, 1, 0.2], [0.1, 0.2, 1]]
    assert O.find_correlated(names, m, 0.9) == ["b"]


def test_mode_ties_pick_smallest(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (2.0, "b"), (1.0, "a"), (None, None)], "x double, s string")
    out = C.impute(df, "mode").collect()
    assert out[-1].x == 1.0 and out[-1].s == "a"


def test_ols_recovers_planted_coefficients(spark):
    li = fx.t(spark, SF, "lineitem").select("l_quantity", "l_discount", "l_linenumber").withColumn(
        "y", F.expr("3*l_quantity - 40*l_discount + l_linenumber"))
    fit = L.fit_ols(li, "y ~ l_quantity + l_discount + l_linenumber")
    assert [round(x, 8) for x in fit.coef] == [0.0, 3.0, -40.0, 1.0]


def test_ols_reports_aliased_column(spark):
    df = spark.range(50).selectExpr("CAST(id AS DOUBLE) AS a", "CAST(2 * id AS DOUBLE) AS b",
                                    "CAST(id * id AS DOUBLE) AS y")
    fit = L.fit_ols(df, "y ~ a + b")
    assert math.isnan(fit.coef[2]) and not math.isnan(fit.coef[1])


def test_silhouette_bounds_and_agreement(spark):
    df = spark.range(300).selectExpr("id", "CAST(id % 3 AS DOUBLE) * 10 + (id % 7) / 10.0 AS x",
                                     "CAST(id % 3 + 1 AS INT) AS cluster")
    s = K.silhouette(df, ["x"], "cluster", noise=None).collect()
    assert all(-1 <= r.silhouette <= 1 for r in s)
    # brute force on the same rows
    pts = [(r.x, r.cluster) for r in s]
    for x, c in pts[:20]:
        own = [(x - y) ** 2 for y, d in pts if d == c]
        a = sum(own) / (len(own) - 1)
        b = min(sum((x - y) ** 2 for y, d in pts if d == o) / sum(1 for _, d in pts if d == o)
                for o in {1, 2, 3} - {c})
        want = (b - a) / max(a, b)
        got = [r.silhouette for r in s if r.x == x and r.cluster == c][0]
        assert math.isclose(got, want, rel_tol=1e-9)


def test_profile_edge_inputs(spark):
    empty = spark.createDataFrame([], "a double, b string")
    assert P.describe(empty).count() == 1
    one = spark.createDataFrame([(1.0, "x")], "a double, `b c` string")
    d = P.describe(one).collect()[0]
    assert d.n == 1 and d.sd is None and d.skewness is None
    assert P.variable_types(one).count() == 2


def test_streaming_scoring(spark, tmp_path):
    from pyspark.sql import types as T
    from quarry.operators import learners as LR
    from quarry.sources.bundles import save_bundle
    from quarry.streaming.scoring import score_stream
    e = fx.ev_learn(spark, SF)
    t = LR.train(e, "y2", ["value", "user_id", "event_type"], "nb", task="classification")
    save_bundle(t, str(tmp_path / "b"), schema_of=e)
    inp = tmp_path / "in"
    inp.mkdir()
    e.select("event_id", "value", "user_id", "event_type").orderBy("event_id").limit(50).toPandas().to_csv(
        inp / "x.csv", index=False)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType()),
                           T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType())])
    q = score_stream(spark, str(inp), schema, str(tmp_path / "b"), str(tmp_path / "out"), keep=["event_id"],
                     checkpoint=str(tmp_path / "ck"), trigger_once=True)
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 50 and set(out.columns) >= {"event_id", "prediction"}


def test_gram_by_partition_matches_aggregate(spark):
    from quarry.operators import linear as Lin
    df = spark.range(2000).selectExpr(*[f"CAST((id * {k + 3}) % 97 AS DOUBLE) AS c{k}" for k in range(5)])
    names = [f"c{k}" for k in range(5)]
    n, means, G1 = Lin._moments(df, names)
    G2 = Lin._gram_by_partition(df, names, means)
    import numpy as np
    assert np.allclose(G1, G2, rtol=1e-10, atol=1e-6)


def test_qq_points_of_every_row(spark):
    from statistics import NormalDist

    from quarry.operators import plotdata
    values = [float(i * i % 1201) for i in range(3000)] + [5.0] * 25_000 + [1e6, -1e6]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    got = sorted((r["theoretical"], r["sample"]) for r in plotdata.qq_points(df, "v").collect())
    n = len(values)
    want = [(NormalDist().inv_cdf((i + 0.5) / n), v) for i, v in enumerate(sorted(values))]
    assert len(got) == n and got[0][1] == -1e6 and got[-1][1] == 1e6
    assert all(abs(a - b) < 1e-9 and v == w for (a, v), (b, w) in zip(got, want))
    few = sorted((r["theoretical"], r["sample"]) for r in plotdata.qq_points(df.limit(4), "v").collect())
    assert abs(few[0][0] - NormalDist().inv_cdf((1 - 3 / 8) / (4 + 1 - 6 / 8))) < 1e-9 and len(few) == 4
    assert plotdata.qq_points(df.where("v IS NULL"), "v").count() == 0


def test_density_of_a_null_group(spark):
    from quarry.operators import plotdata
    df = spark.createDataFrame([(g, float(i * i % 97)) for g in ("a", None) for i in range(200)] + [("b", 1.0), ("b", 2.5)],
                               "g string, v double")
    got = {}
    for r in plotdata.density(df, "v", n=16, by="g").collect():
        got.setdefault(r["g"], {})[r["i"]] = (r["x"], r["density"])
    assert set(got) == {"a", "b", None} and all(len(v) == 16 for v in got.values())
    for i, (x, d) in got["a"].items():
        assert math.isclose(got[None][i][0], x) and math.isclose(got[None][i][1], d)
