"""Design matrix as column expressions (F3), with R's treatment contrasts.

A formula ``y ~ a + b + a:b`` (``a*b`` expands to the three terms) becomes
one double column per model-matrix column.  Factors (string columns) use
treatment contrasts (first sorted level dropped) when the term's margin
is in the model, as R does, otherwise full indicators.  Column names
follow R: ``a<level>`` for a factor level, ``:`` joins interaction parts.
Everything is a lazy projection; the only job is finding factor levels.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.roles import col, roles
from .columns import MAX_LEVELS


def parse_formula(formula: str) -> tuple[str, list[tuple[str, ...]]]:
    lhs, rhs = formula.split("~", 1)
    terms: list[tuple[str, ...]] = []

    def add(t):
        if t not in terms:
            terms.append(t)

    for raw in rhs.split("+"):
        raw = raw.strip()
        if not raw or raw == "1":
            continue
        if "*" in raw:
            vs = [v.strip() for v in raw.split("*")]
            for r in range(1, len(vs) + 1):
                for combo in combinations(vs, r):
                    add(tuple(combo))
        else:
            add(tuple(v.strip() for v in raw.split(":")))
    terms.sort(key=len)  # R orders terms by degree
    return lhs.strip(), terms


@dataclass
class Design:
    target: str
    terms: list = field(default_factory=list)            # tuples of variable names
    levels: dict = field(default_factory=dict)           # factor -> sorted levels
    columns: list = field(default_factory=list)          # (name, term index, [(var, level|None)])

    @property
    def names(self) -> list[str]:
        return [c[0] for c in self.columns]

    def variables(self) -> list[str]:
        out = []
        for t in self.terms:
            for v in t:
                if v not in out:
                    out.append(v)
        return out


def fit_design(df: DataFrame, formula: str, max_levels: int = MAX_LEVELS) -> Design:
    target, terms = parse_formula(formula)
    d = Design(target=target, terms=terms)
    cats = set(roles(df)[1])
    for v in d.variables():
        if v not in df.columns:
            raise ValueError(f"Columns not found: {v}")
    factors = [v for v in d.variables() if v in cats]
    if factors:
        structs = [F.struct(F.lit(v).alias("f"), col(v).alias("lv")) for v in factors]
        got = (df.select(F.inline(F.array(*structs))).where("lv IS NOT NULL").distinct()
               .limit((max_levels + 1) * len(factors)).collect())
        for v in factors:
            lv = sorted(r["lv"] for r in got if r["f"] == v)
            if len(lv) > max_levels:
                raise ValueError(f"{v}: more than {max_levels} levels")
            d.levels[v] = lv
    term_set = set(frozenset(t) for t in terms)
    for ti, t in enumerate(terms):
        parts_per_var = []
        for v in t:
            if v in d.levels:
                margin = frozenset(x for x in t if x != v)
                contrast = (not margin) or (margin in term_set)
                lv = d.levels[v][1:] if contrast else d.levels[v]
                parts_per_var.append([(v, level) for level in lv])
            else:
                parts_per_var.append([(v, None)])
        combos = [[]]
        for opts in parts_per_var:
            combos = [c + [o] for c in combos for o in opts]
        for combo in combos:
            name = ":".join(v if level is None else f"{v}{level}" for v, level in combo)
            d.columns.append((name, ti, combo))
    return d


def column_expr(combo) -> Column:
    e = None
    for v, level in combo:
        x = col(v).cast("double") if level is None else \
            F.when(col(v).isNull(), F.lit(None).cast("double")).when(col(v) == F.lit(level), 1.0).otherwise(0.0)
        e = x if e is None else e * x
    return e


def apply_design(df: DataFrame, d: Design, keep: list[str] | None = None, with_target: bool = True,
                 complete: bool = True) -> DataFrame:
    """Model-matrix columns (+ target as ``__y``); complete cases only by default."""
    cols = [col(c) for c in (keep or [])]
    if with_target:
        cols.append(col(d.target).cast("double").alias("__y"))
    cols += [column_expr(combo).alias(name) for name, _, combo in d.columns]
    out = df.select(*cols)
    if complete:
        keep_ok = F.lit(True)
        for c in (["__y"] if with_target else []) + d.names:
            keep_ok = keep_ok & col(c).isNotNull() & ~F.isnan(col(c))
        out = out.where(keep_ok)
    return out


def assemble(df: DataFrame, d: Design, out: str = "features", keep: list[str] | None = None,
             with_target: bool = True) -> DataFrame:
    """Design columns packed in one vector column for Spark ML learners."""
    m = apply_design(df, d, keep, with_target)
    safe = [f"__d{i}" for i in range(len(d.names))]
    m = m.select(*[col(c) for c in (keep or [])], *([F.col("__y")] if with_target else []),
                 *[col(n).alias(s) for n, s in zip(d.names, safe)])
    va = VectorAssembler(inputCols=safe, outputCol=out, handleInvalid="skip")
    sel = [col(c) for c in (keep or [])] + ([F.col("__y").alias("label")] if with_target else [])
    return va.transform(m).select(*sel, out)
