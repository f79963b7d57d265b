"""Ridge, lasso and what lies between, from one moment matrix.

One scan gives the centred cross products of the design and the target; the whole
path of penalties is solved from them by coordinate descent, each from the solution of the
larger one before.  The objective is that of the reference's package:
``RSS / (2n) + lambda * ((1 - alpha) / 2 * |b|^2 + alpha * |b|_1)`` with features and target at unit
variance (divisor n) and ``lambda`` on the target's scale.  Constant columns have coefficient 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .design import Design, apply_design, column_expr
from .linear import _moments

#: Passes over the coefficients at most, and the change at which they are settled.
SWEEPS, SETTLED = 100_000, 1e-12


@dataclass
class PenalisedFit:
    """``path``: coefficients (a row for each of ``lambdas``, descending); ``coef`` are those of the last."""

    design: Design
    lambdas: list[float]
    path: np.ndarray
    intercepts: np.ndarray
    alpha: float

    @property
    def coef(self) -> np.ndarray:
        return self.path[-1]

    def prediction(self, at: int = -1) -> Column:
        """Lazy prediction over the raw columns."""
        total = F.lit(float(self.intercepts[at]))
        for (_, _, combo), b in zip(self.design.columns, self.path[at], strict=True):
            if b:
                total = total + column_expr(combo) * F.lit(float(b))
        return total


def descend(corr: np.ndarray, target: np.ndarray, penalty: float, alpha: float, start: np.ndarray) -> np.ndarray:
    """Coefficients of unit-variance features from their correlations and those with the target."""
    b = start.copy()
    residual = target - corr @ b  # correlation of each feature with what is left
    for _ in range(SWEEPS):
        largest = 0.0
        for j in range(len(b)):
            pull = residual[j] + corr[j, j] * b[j]
            new = np.sign(pull) * max(abs(pull) - penalty * alpha, 0.0) / (corr[j, j] + penalty * (1 - alpha)) if corr[j, j] > 0 else 0.0
            step = new - b[j]
            if step:
                residual -= corr[:, j] * step
                b[j] = new
                largest = max(largest, abs(step))
        if largest < SETTLED:
            break
    return b


def fit_path(data: DataFrame, design: Design, lambdas: list[float], alpha: float) -> PenalisedFit:
    """``alpha`` 0: ridge, 1: lasso."""
    if not lambdas or min(lambdas) < 0:
        raise ValueError("lambda must not be negative")
    names = design.names
    n, means, cross = _moments(apply_design(data, design), [*names, "__y"])
    p = len(names)
    order = sorted(lambdas, reverse=True)
    sd = np.sqrt(np.maximum(np.diag(cross), 0) / max(n, 1))
    spread = np.where(sd > 1e-12 * np.maximum(np.abs(means), 1), sd, 0.0)
    scale = np.where(spread[:p] > 0, spread[:p], 1.0)
    live = np.outer(spread[:p] > 0, spread[:p] > 0)
    path = np.zeros((len(order), p))
    if n and spread[p] > 0:
        corr = np.where(live, cross[:p, :p] / max(n, 1) / np.outer(scale, scale), 0.0)
        target = np.where(spread[:p] > 0, cross[:p, p] / n / scale / spread[p], 0.0)
        b = np.zeros(p)
        for i, penalty in enumerate(order):
            b = descend(corr, target, penalty / spread[p], alpha, b)
            path[i] = b * spread[p] / scale
    return PenalisedFit(design, order, path, means[p] - path @ means[:p], alpha)
