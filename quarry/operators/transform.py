"""Scaling, one-hot encoding and binning."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.roles import FLOAT_TYPES, col, dtype_of, roles


def _num(df, c):
    x = col(c)
    if isinstance(dtype_of(df, c), FLOAT_TYPES):
        x = F.when(~F.isnan(x), x)
    return x.cast("double")


@dataclass
class ScaleParams:
    method: str
    stats: dict = field(default_factory=dict)   # column -> (a, b): x -> (x - a) / b


def fit_scale(df: DataFrame, cols: list[str], method: str = "zscore", sd_zero_to_one: bool = False) -> ScaleParams:
    """T9/T10/T11 fit: mean & sample sd, or min & max (one aggregate).

    ``sd_zero_to_one``: the AutoML rule (A2), a zero sd divides by 1.
    """
    num = set(roles(df)[0])
    valid = [c for c in cols if c in num]
    if not valid:
        raise ValueError("scale: no numeric column among those named")
    p = ScaleParams(method)
    if method == "log":
        p.stats = {c: None for c in valid}
        return p
    if method == "zscore":
        aggs = [F.avg(_num(df, c)).alias(f"a{i}") for i, c in enumerate(valid)] + \
               [F.stddev_samp(_num(df, c)).alias(f"b{i}") for i, c in enumerate(valid)]
    elif method == "minmax":
        aggs = [F.min(_num(df, c)).alias(f"a{i}") for i, c in enumerate(valid)] + \
               [F.max(_num(df, c)).alias(f"b{i}") for i, c in enumerate(valid)]
    else:
        raise ValueError(f"Unknown scaling method: {method}")
    r = df.agg(*aggs).collect()[0]
    for i, c in enumerate(valid):
        a, b = r[f"a{i}"], r[f"b{i}"]
        if method == "zscore":
            if sd_zero_to_one and (b is None or b == 0 or (isinstance(b, float) and math.isnan(b))):
                b = 1.0
            p.stats[c] = (a, b)
        else:
            p.stats[c] = (a, (b - a) if a is not None else None)
    return p


def apply_scale(df: DataFrame, p: ScaleParams) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if f.name in p.stats:
            x = _num(df, f.name)
            if p.method == "log":
                # log1p(max(x, 0)); missing stays missing (greatest skips NULL)
                c = F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))
            elif p.method == "zscore":
                a, b = p.stats[f.name]
                # sd = 0 (or one value): the reference's NaN becomes missing
                c = F.try_divide(x - F.lit(a), F.lit(b)) if (b is not None and b != 0) \
                    else F.lit(None).cast("double")
            else:
                a, w = p.stats[f.name]
                c = c if (w is None or w == 0) else (x - F.lit(a)) / F.lit(w)
        out.append(c.alias(f.name))
    return df.select(*out)


def scale(df: DataFrame, cols: list[str], method: str = "zscore") -> DataFrame:
    return apply_scale(df, fit_scale(df, cols, method))


MAX_LEVELS = 1000
_CLEAN = re.compile(r"[^A-Za-z0-9_]")


def clean_name(s: str) -> str:
    return _CLEAN.sub("_", s)


@dataclass
class EncodeParams:
    levels: dict = field(default_factory=dict)   # column -> sorted levels (text)
    full_rank: bool = True
    names: dict = field(default_factory=dict)    # column -> [(level, out name)]


def fit_encode(df: DataFrame, cols: list[str], full_rank: bool = True,
               max_levels: int = MAX_LEVELS) -> EncodeParams:
    """T13 fit: sorted distinct levels per column (one small shuffle for all).

    Numeric columns are sorted by value, text by text.
    """
    valid = [c for c in cols if c in df.columns]
    if not valid:
        raise ValueError("encode: no such column")
    num = set(roles(df)[0])
    structs = [F.struct(F.lit(c).alias("variable"), col(c).cast("string").alias("v"),
                        (_num(df, c) if c in num else F.lit(None).cast("double")).alias("n"))
               for c in valid]
    lv = (df.select(F.inline(F.array(*structs))).where(F.col("v").isNotNull())
          .groupBy("variable", "v", "n").count())
    cnt = {r["variable"]: r["k"] for r in lv.groupBy("variable").agg(F.count("*").alias("k")).collect()}
    over = [c for c, k in cnt.items() if k > max_levels]
    if over:
        raise ValueError(f"Too many levels (> {max_levels}) to encode: {', '.join(over)}")
    rows = lv.collect()
    p = EncodeParams(full_rank=full_rank)
    for c in valid:
        vals = [(r["n"], r["v"]) for r in rows if r["variable"] == c]
        vals.sort(key=(lambda t: t[0]) if c in num else (lambda t: t[1]))
        p.levels[c] = [v for _, v in vals]
    taken = set(x for x in df.columns if x not in valid)
    for c in valid:
        lv_c = p.levels[c][1:] if full_rank else p.levels[c]
        names = []
        for level in lv_c:
            name = clean_name(f"{c}.{level}")
            if name in taken:
                raise ValueError(f"Encoded column name collides: {name}")
            taken.add(name)
            names.append((level, name))
        p.names[c] = names
    return p


def apply_encode(df: DataFrame, p: EncodeParams) -> DataFrame:
    """T13 apply: 0/1 dummies (double) at the end; missing input -> missing dummies."""
    keep = [col(c) for c in df.columns if c not in p.names]
    dummies = []
    for c, names in p.names.items():
        s = col(c).cast("string")
        for level, name in names:
            dummies.append(F.when(s.isNull(), F.lit(None).cast("double"))
                           .when(s == F.lit(level), F.lit(1.0)).otherwise(F.lit(0.0)).alias(name))
    return df.select(*keep, *dummies)


def encode(df: DataFrame, cols: list[str], full_rank: bool = True) -> DataFrame:
    return apply_encode(df, fit_encode(df, cols, full_rank))


def scale_and_encode(df: DataFrame, scale_cols=None, method: str = "zscore", encode_cols=None,
                     full_rank: bool = True) -> tuple[DataFrame, list[str]]:
    """Scale, then encode; each failure reported separately (returned list)."""
    errors = []
    if scale_cols:
        try:
            df = scale(df, scale_cols, method)
        except ValueError as e:
            errors.append(f"scale: {e}")
    if encode_cols:
        try:
            df = encode(df, encode_cols, full_rank)
        except ValueError as e:
            errors.append(f"encode: {e}")
    return df, errors


# ---- binning (R cut: right-closed, lowest included) -------------------------

def bin_labels(breaks: list[float], digits: int = 3) -> list[str]:
    """Text of right-closed intervals, the first closed on both sides.

    Edges are written with as few significant digits, from ``digits`` to 12,
    as make neighbours differ.
    """
    for used in range(digits, max(digits, 12) + 1):
        edges = [f"{b or 0.0:.{used}g}" for b in breaks]  # no minus sign on zero
        if not any(map(str.__eq__, edges, edges[1:])):
            break
    return [f"{'(' if k else '['}{low},{high}]" for k, (low, high) in enumerate(zip(edges, edges[1:]))]


def equal_width_breaks(lo: float, hi: float, n_bins: int) -> list[float]:
    """``n_bins + 1`` equal steps over the range, its ends a thousandth of the range further out.

    A range of one value is as wide as that value (1 for zero), ends included.
    """
    if lo == hi:
        out = (abs(lo) or 1.0) / 1000
        return np.linspace(lo - out, hi + out, n_bins + 1).tolist()
    out = (hi - lo) / 1000
    return [lo - out, *np.linspace(lo, hi, n_bins + 1)[1:-1].tolist(), hi + out]


@dataclass
class BinParams:
    column: str
    breaks: list
    labels: list


def fit_bin(df: DataFrame, var: str, n_bins: int = 4, breaks=None, labels=None) -> BinParams:
    """Equal-width breaks from min/max (one aggregate) or given breaks."""
    if var not in df.columns:
        raise ValueError(f"Column not found: {var}")
    if var not in roles(df)[0]:
        raise ValueError(f"bin_variable: {var} is not a numeric column")
    if breaks is None:
        r = df.agg(F.min(_num(df, var)).alias("lo"), F.max(_num(df, var)).alias("hi")).collect()[0]
        if r["lo"] is None:
            raise ValueError(f"{var} has no values")
        br = equal_width_breaks(float(r["lo"]), float(r["hi"]), n_bins)
    else:
        br = sorted(float(b) for b in breaks)
    lab = list(labels) if labels is not None else bin_labels(br)
    if len(lab) != len(br) - 1:
        raise ValueError("number of labels must be one less than the number of breaks")
    return BinParams(var, br, lab)


def apply_bin(df: DataFrame, p: BinParams, new_col: str | None = None) -> DataFrame:
    x = _num(df, p.column)
    e = None
    for i in range(len(p.breaks) - 1):
        a, b = p.breaks[i], p.breaks[i + 1]
        cond = (x >= a) & (x <= b) if i == 0 else (x > a) & (x <= b)
        e = F.when(cond, F.lit(p.labels[i])) if e is None else e.when(cond, F.lit(p.labels[i]))
    return df.withColumn(new_col or f"{p.column}_bin", e if e is not None else F.lit(None).cast("string"))


def bin_variable(df: DataFrame, var: str, n_bins: int = 4, breaks=None, labels=None) -> DataFrame:
    return apply_bin(df, fit_bin(df, var, n_bins, breaks, labels))
