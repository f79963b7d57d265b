"""Missing values and duplicates.

Fit returns a small record (one value per column); apply is a lazy
projection with literals, so it also runs on a streaming DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import quantiles
from ..functions.roles import FLOAT_TYPES, col, dtype_of, missing, roles


def drop_incomplete(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Remove rows with any missing value (NULL or NaN)."""
    cols = subset or df.columns
    cond = F.lit(True)
    for c in cols:
        cond = cond & ~missing(df, c)
    return df.where(cond)


def missing_rates(df: DataFrame) -> dict[str, float]:
    aggs = [F.avg(missing(df, c).cast("double")).alias(f"m{i}") for i, c in enumerate(df.columns)]
    r = df.agg(*aggs).collect()[0]
    return {c: (r[f"m{i}"] or 0.0) for i, c in enumerate(df.columns)}


def drop_sparse_columns(df: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Drop columns whose missing rate is strictly above ``threshold`` (0..1)."""
    rates = missing_rates(df)
    keep = [c for c in df.columns if not rates[c] > threshold]
    return df.select(*[col(c) for c in keep])


def prepare(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """``target, features...`` over complete rows.

    Default features = all but target. Errors: absent target, absent features.
    """
    if target not in df.columns:
        raise ValueError(f"Target not found: {target}")
    feats = [c for c in (features if features is not None else df.columns) if c != target]
    bad = [c for c in feats if c not in df.columns]
    if bad:
        raise ValueError("Columns not found: " + ", ".join(bad))
    out = df.select(*[col(c) for c in [target] + feats])
    return drop_incomplete(out)


@dataclass
class ImputeParams:
    method: str
    values: dict = field(default_factory=dict)      # column -> fill value
    to_double: list = field(default_factory=list)   # integer columns that become double
    dropped: list = field(default_factory=list)     # P7 columns


def fit_impute(df: DataFrame, method: str = "none", col_thresh: float = 1.0) -> ImputeParams:
    """T1-T4 (+P7): fill values for mean / median (numeric) or mode (all columns)."""
    rates = missing_rates(df)
    dropped = [c for c in df.columns if rates[c] > col_thresh]
    kept = [c for c in df.columns if c not in dropped]
    num, _, _ = roles(df.select(*[col(c) for c in kept]))
    p = ImputeParams(method=method, dropped=dropped)
    with_missing = [c for c in kept if rates[c] > 0]
    if method in ("none", "remove"):
        return p
    if method == "mean":
        targets = [c for c in num if c in with_missing]
        if targets:
            r = df.agg(*[F.avg(_num(df, c)).alias(f"a{i}") for i, c in enumerate(targets)]).collect()[0]
            p.values = {c: r[f"a{i}"] for i, c in enumerate(targets)}
    elif method == "median":
        targets = [c for c in num if c in with_missing]
        qs = quantiles(df, targets, [0.5])
        p.values = {c: qs[c][0] for c in targets}
    elif method == "mode":
        p.values = mode_values(df, [c for c in kept if c in with_missing])
    else:
        raise ValueError(f"Unknown method: {method}")
    p.to_double = [c for c in p.values if method in ("mean", "median")
                   and not isinstance(dtype_of(df, c), FLOAT_TYPES)]
    return p


def _num(df, c):
    x = col(c)
    if isinstance(dtype_of(df, c), FLOAT_TYPES):
        x = F.when(~F.isnan(x), x)
    return x.cast("double")


def mode_values(df: DataFrame, cols: list[str]) -> dict:
    """Most frequent present value per column; ties -> smallest value.

    Long form (column, number, text) -> groupBy count (partial aggregation
    first) -> per column the max count, smallest value: two small shuffles.
    """
    if not cols:
        return {}
    num = set(roles(df)[0])
    structs = []
    for c in cols:
        if c in num:
            structs.append(F.struct(F.lit(c).alias("variable"), _num(df, c).alias("vn"),
                                    F.lit(None).cast("string").alias("vs")))
        else:
            structs.append(F.struct(F.lit(c).alias("variable"), F.lit(None).cast("double").alias("vn"),
                                    col(c).cast("string").alias("vs")))
    lv = df.select(F.inline(F.array(*structs))).where(F.col("vn").isNotNull() | F.col("vs").isNotNull())
    counts = lv.groupBy("variable", "vn", "vs").agg(F.count(F.lit(1)).alias("c"))
    best = counts.groupBy("variable").agg(
        F.min(F.struct((-F.col("c")).alias("nc"), F.col("vn"), F.col("vs"))).alias("b")).collect()
    out = {}
    for r in best:
        b = r["b"]
        out[r["variable"]] = b["vn"] if r["variable"] in num else b["vs"]
    return out


def apply_impute(df: DataFrame, p: ImputeParams) -> DataFrame:
    out = df.select(*[col(c) for c in df.columns if c not in set(p.dropped)])
    if p.method == "remove":
        return drop_incomplete(out)
    exprs = []
    for f in out.schema.fields:
        c = col(f.name)
        if f.name in p.values and p.values[f.name] is not None:
            v = p.values[f.name]
            if f.name in p.to_double:
                c = F.coalesce(c.cast("double"), F.lit(float(v)))
            elif isinstance(f.dataType, FLOAT_TYPES):
                c = F.when(c.isNull() | F.isnan(c), F.lit(v).cast(f.dataType)).otherwise(c)
            elif isinstance(f.dataType, T.StringType):
                c = F.coalesce(c, F.lit(str(v)))
            else:
                c = F.coalesce(c, F.lit(v).cast(f.dataType))
        exprs.append(c.alias(f.name))
    return out.select(*exprs)


def impute(df: DataFrame, method: str = "none", col_thresh: float = 1.0) -> DataFrame:
    """Fit + apply in one call."""
    return apply_impute(df, fit_impute(df, method, col_thresh))


def remove_duplicates(df: DataFrame, subset: list[str] | str = "all",
                      order_by: list[str] | None = None) -> DataFrame:
    """Keep the first row of each group of duplicates.

    All columns: ``dropDuplicates`` (identical rows, any is "first").
    Subset: the first row in ``order_by`` order per subset key (a plain
    ``dropDuplicates(subset)`` keeps an arbitrary row).  Each key is reduced
    to its minimum order value by a partial aggregate and joined back, so a
    key holding a third of all rows never sits whole in one window task.
    """
    if subset == "all" or subset is None:
        return df.dropDuplicates()
    valid = [c for c in subset if c in df.columns]
    if not valid:
        raise ValueError("remove_duplicates: no such column")
    if not order_by:
        raise ValueError("remove_duplicates on a subset needs an order key (first in row order)")
    # the first row per group by partial aggregation: one scan, no big group in one task
    # (missing keys are equal to each other in a grouping)
    whole = F.struct(*[col(c).alias(f"__c{i}") for i, c in enumerate(df.columns)])
    first = df.groupBy(*[col(c).alias(f"__k{i}") for i, c in enumerate(valid)]).agg(
        F.min_by(whole, F.struct(*[col(c) for c in order_by])).alias("__row"))
    return first.select(*[F.col(f"__row.__c{i}").alias(c) for i, c in enumerate(df.columns)])
