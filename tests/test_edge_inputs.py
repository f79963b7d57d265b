"""Edge inputs: names with dots and spaces, NaN, all-missing, empty and one-row tables."""

import math

import pytest
from pyspark.sql import functions as F

from quarry.operators import cleaning as C
from quarry.operators import linear as L
from quarry.operators import outliers as O
from quarry.operators import profile as P
from quarry.operators import transform as X


@pytest.fixture()
def odd(spark):
    rows = [(1.0, "a", None, float("nan")), (2.0, "b", None, 1.0), (2.0, "b", None, 2.0), (5.0, None, None, 3.0)]
    return spark.createDataFrame(rows, "`x.v` double, `cat col` string, `all na` double, `n.an` double")


def test_profile_with_odd_names(odd):
    d = {r.variable: r for r in P.describe(odd).collect()}
    assert d["x.v"].n == 4 and d["all na"].n == 0 and d["all na"].mean is None
    assert d["n.an"].n == 3 and d["n.an"].missing == 1          # NaN counts as missing
    vt = {r.variable: r for r in P.variable_types(odd).collect()}
    assert vt["cat col"].n_unique == 2 and vt["cat col"].n_missing == 1
    assert P.missing_summary(odd).first().variable == "all na"


def test_cleaning_with_odd_names(odd):
    assert C.drop_incomplete(odd).count() == 0
    out = C.impute(odd, "mean").collect()
    assert out[0]["n.an"] == 2.0 and out[0]["all na"] is None    # all-missing stays missing
    m = C.impute(odd, "mode").collect()
    assert m[3]["cat col"] == "b"
    assert C.remove_duplicates(odd, ["x.v", "cat col"], order_by=["n.an"]).count() == 3


def test_transforms_with_odd_names(odd):
    z = X.scale(odd, ["x.v"], "zscore").agg(F.avg("`x.v`")).first()[0]
    assert abs(z) < 1e-12
    enc = X.encode(odd, ["cat col"], full_rank=False)
    assert {"cat_col_a", "cat_col_b"} <= set(enc.columns)
    b = X.bin_variable(odd, "x.v", 2)
    assert b.select("`x.v_bin`").distinct().count() == 2
    fl = O.handle_outliers(odd, ["x.v"], "iqr", "flag")
    assert fl.where("outlier_flag").count() >= 0


def test_linear_with_odd_names(spark):
    df = spark.range(30).selectExpr("CAST(id AS DOUBLE) AS `a.b`", "CAST(id * 2 + 1 AS DOUBLE) AS `y y`")
    fit = L.fit_ols(df, "y y ~ a.b")
    assert math.isclose(fit.coef[1], 2.0) and math.isclose(fit.coef[0], 1.0)


def test_empty_and_one_row(spark):
    empty = spark.createDataFrame([], "x double, s string")
    assert P.describe(empty).first().n == 0
    assert P.overview(empty).first().n_rows == 0
    assert C.remove_duplicates(empty).count() == 0
    one = spark.createDataFrame([(3.0, "k")], "x double, s string")
    r = P.describe(one).first()
    assert r.median == 3.0 and r.iqr == 0.0 and r.sd is None
    assert P.duplicate_rows(one).first().duplicate_rows == 0
