"""Registry of named queries: a Spark builder and, where exact, its DuckDB SQL.

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the
given tables. The SQL runs on DuckDB views with the same table names.
Doubles are rounded on both sides to a fixed number of decimals, so the
comparison is about values, not about summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, d: int = 6) -> DataFrame:
    """Round every float/double column to ``d`` decimals."""
    out = []
    for f in df.schema.fields:
        c = F.col("`" + f.name + "`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(c.cast("double"), d).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def rsql(inner: str, double_cols: list[str], d: int = 6) -> str:
    """Wrap oracle SQL so the named double columns are rounded like :func:`rounded`."""
    if not double_cols:
        return inner
    rep = ", ".join(f"round(CAST({c} AS DOUBLE), {d}) AS {c}" for c in double_cols)
    return f"SELECT * REPLACE ({rep}) FROM ({inner}) AS _r"
