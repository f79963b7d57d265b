"""Column roles and missing-value expressions shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)


def is_numeric_type(dt) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_categorical_type(dt) -> bool:
    return isinstance(dt, T.StringType)


def roles(df: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """Split columns into numeric, categorical (string) and other."""
    num, cat, other = [], [], []
    for f in df.schema.fields:
        if is_numeric_type(f.dataType):
            num.append(f.name)
        elif is_categorical_type(f.dataType):
            cat.append(f.name)
        else:
            other.append(f.name)
    return num, cat, other


def numeric_columns(df: DataFrame) -> list[str]:
    return roles(df)[0]


def categorical_columns(df: DataFrame) -> list[str]:
    return roles(df)[1]


def q(name: str) -> str:
    """Back-quote a column name (dots and spaces are allowed in names)."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def dtype_of(df: DataFrame, name: str):
    return df.schema[name].dataType


def missing(df: DataFrame, name: str) -> Column:
    """True where the value is missing: NULL, or NaN for float columns."""
    c = col(name)
    if isinstance(dtype_of(df, name), FLOAT_TYPES):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def present(df: DataFrame, name: str) -> Column:
    return ~missing(df, name)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Normalise NaN to NULL in float columns (R's is.na is true for both)."""
    exprs = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, FLOAT_TYPES):
            exprs.append(F.when(~F.isnan(c), c).alias(f.name))
        else:
            exprs.append(c)
    return df.select(*exprs)


def type_name(dt) -> str:
    """R-like class name of a Spark type (numeric/integer/character/logical/...)."""
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "numeric"
    if isinstance(dt, T.StringType):
        return "character"
    if isinstance(dt, T.BooleanType):
        return "logical"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(dt, T.DateType):
        return "date"
    return dt.simpleString()


def require_columns(df: DataFrame, cols, what: str = "Columns") -> None:
    bad = [c for c in cols if c not in df.columns]
    if bad:
        raise ValueError(f"{what} not found: " + ", ".join(bad))
