"""The reference's own unit tests, re-expressed on DataFrames (split, prepare, metrics, formula)."""

import math
import warnings

import pytest
from pyspark.sql import functions as F

from quarry.operators import cleaning as C
from quarry.operators import formula as FM
from quarry.operators import metrics as M
from quarry.operators import split as S


def test_split_exact_sizes_and_complete(spark):
    df = spark.range(100).withColumn("y", F.randn(seed=1))
    tr, te = S.train_test_split(df, "id", 0.8, 42)
    a = {r.id for r in tr.collect()}
    b = {r.id for r in te.collect()}
    assert len(a) == 80 and len(b) == 20
    assert not (a & b) and (a | b) == set(range(100))


def test_split_reproducible_and_seed_dependent(spark):
    df = spark.range(100)
    a1 = sorted(r.id for r in S.train_test_split(df, "id", 0.75, 1)[0].collect())
    a2 = sorted(r.id for r in S.train_test_split(df, "id", 0.75, 1)[0].collect())
    a3 = sorted(r.id for r in S.train_test_split(df, "id", 0.75, 2)[0].collect())
    assert a1 == a2 and a1 != a3 and len(a1) == 75


@pytest.mark.parametrize("ratio", [1.5, 0, 1, "x"])
def test_split_rejects_bad_ratio(spark, ratio):
    with pytest.raises(ValueError):
        S.train_test_split(spark.range(10), "id", ratio, 1)


def test_prepare_names_and_incomplete_rows(spark):
    rows = [(None if i < 3 else float(i), float(i % 4), float(i)) for i in range(32)]
    df = spark.createDataFrame(rows, "mpg double, cyl double, hp double")
    out = C.prepare(df, "mpg")
    assert out.columns == ["mpg", "cyl", "hp"]
    assert out.count() == 29


def test_prepare_rejects_absent_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    with pytest.raises(ValueError):
        C.prepare(df, "nope")
    with pytest.raises(ValueError, match="Columns not found: bad_col"):
        C.prepare(df, "a", ["b", "bad_col"])


def _metrics(spark, pairs):
    df = spark.createDataFrame(pairs, "y double, p double")
    return M.regression_metrics(df, "y", "p", warn=True).collect()[0]


def test_metrics_perfect_fit(spark):
    r = _metrics(spark, [(float(i), float(i)) for i in range(1, 6)])
    assert r.RMSE == 0 and r.MAE == 0 and r.R2 == 1


def test_metrics_shift_by_one(spark):
    r = _metrics(spark, [(float(i), float(i + 1)) for i in range(1, 6)])
    assert math.isclose(r.RMSE, 1) and math.isclose(r.MAE, 1) and r.R2 < 1


def test_metrics_missing_pairs_dropped_with_warning(spark):
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        r = _metrics(spark, [(1.0, 1.0), (None, 2.0), (3.0, None)])
    assert any("NA values ignored" in str(x.message) for x in w)
    assert r.RMSE == 0


def test_metrics_constant_actual_has_no_r2(spark):
    r = _metrics(spark, [(2.0, 1.0), (2.0, 3.0)])
    assert r.R2 is None


def test_formula_text_and_interactions():
    assert FM.build_formula("mpg", ["cyl", "hp", "wt"]) == "mpg ~ cyl + hp + wt"
    f = FM.build_formula("mpg", ["cyl", "hp", "wt"], True, ["cyl", "hp"])
    assert "cyl:hp" in f
    assert ":" not in FM.build_formula("mpg", ["cyl", "hp"], True, ["cyl"])
