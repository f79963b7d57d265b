"""Every registered query with SQL against DuckDB on sf0.001 (the driver's check runs sf0.01)."""

import pytest

import __spark_entry__ as E
from oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"
# long fits, tested by their own modules; the op* queries and the pipeline have their own folder
SLOW = ("c4_", "c7_", "c8_", "r6_", "r7_", "r8_", "a3_", "a7_", "k11_", "x2_", "k5_", "e21_", "op", "pipeline")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(n for n in E.oracle_sql() if not n.startswith("op")))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF)
    assert r["ok"], r


@pytest.mark.parametrize("name", sorted(n for n in E.queries() if n not in E.oracle_sql()
                                        and not n.startswith(SLOW)))
def test_rows_only_queries_run(spark, name):
    df = E.queries()[name](spark, SF)
    assert df.count() > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
