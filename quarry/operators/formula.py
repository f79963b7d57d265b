"""Model formula and design matrix.

The formula text follows R: ``target ~ a + b [+ a:b ...]`` with all
two-way pairs of the interaction variables (ignored when fewer than two).
The design matrix itself is built by :mod:`quarry.operators.design`
(column expressions with R's treatment-contrast rule).
"""

from __future__ import annotations

from itertools import combinations


def build_formula(target: str, features: list[str], use_interactions: bool = False,
                  interaction_vars: list[str] | None = None) -> str:
    if not isinstance(target, str) or not target:
        raise ValueError("target must be one name")
    if not features or not all(isinstance(f, str) for f in features):
        raise ValueError("features must be a non-empty list of names")
    rhs = " + ".join(features)
    if use_interactions and interaction_vars and len(interaction_vars) >= 2:
        rhs = " + ".join([rhs] + [f"{a}:{b}" for a, b in combinations(interaction_vars, 2)])
    return f"{target} ~ {rhs}"


def formula_terms(formula: str) -> tuple[str, list[str]]:
    lhs, rhs = formula.split("~", 1)
    return lhs.strip(), [t.strip() for t in rhs.split("+") if t.strip()]
