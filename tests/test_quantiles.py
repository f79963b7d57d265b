"""Quantiles of many groups, of a hot value, of a null group, and after a failed bracket."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import quantiles as Q
from quarry.operators import plotdata as P


def test_a_hundred_thousand_groups(spark):
    df = spark.range(300_000).selectExpr("CAST(id % 100000 AS STRING) AS g", "CAST(id DIV 100000 + id % 100000 AS DOUBLE) AS x")
    table = Q.quantile_table(df, ["x"], [0.5], by="g")
    assert table.count() == 100_000
    assert table.where(F.col("q")[0] != F.col("g").cast("long") + 1).count() == 0
    assert P.box_stats(df.where("id < 60000 OR id % 5 = 0"), "x", by="g").count() == 100_000 - 40_000 + 8_000


def test_hot_value_and_null_group(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=9_000)
    x[:3_000] = 0.25
    groups = ["a", None, "c"]
    rows = [(float(v), groups[i % 3] if i >= 3_000 else None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "x double, g string")
    probs = [0.0, 0.05, 0.5, 0.95, 1.0]
    for kw in ({}, {"accuracy": 100}, {"accuracy": 100, "fetch": 50}):
        got = Q.quantiles(df, ["x"], probs, by="g", **kw)
        for g in groups:
            own = [v for v, of in rows if of == g]
            assert got["x", g] == pytest.approx(np.quantile(own, probs).tolist(), abs=1e-12)
    assert Q.quantiles(df.where("x > 1e9"), ["x"], [0.5]) == {"x": [None]}


def test_a_failed_bracket_is_found_out(spark, monkeypatch):
    """A sketch that is wrong by far: the count tells, and the key is done again."""
    real = F.percentile_approx
    monkeypatch.setattr(Q.F, "percentile_approx", lambda c, p, a: F.transform(real(c, p, a), lambda v: v * 0 + 123.0))
    df = spark.range(1_001).selectExpr("CAST(id AS DOUBLE) AS x")
    assert Q.quantiles(df, ["x"], [0.25, 0.5], accuracy=50) == {"x": [250.0, 500.0]}
