"""Queries that SQL can express, against DuckDB."""

import pytest

import __spark_entry__ as entry
from oracle_compare import compare, duck
from quarry.llm.queries import ORACLES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    result = compare(spark, duck(SF), name, entry.queries()[name], ORACLES[name], SF)
    assert result["ok"], result
