"""Full-batch gradient training for learners Spark ML lacks (R6 SVM regression, C4 kernel SVM features).

The data stay on the executors: every iteration is one job in which each
partition returns (loss, gradient) partial sums for the current weights
(a small vector shipped with the task) -- one row per partition reaches
the driver, which sums them and takes an Adam step.  Kernels are mapped
explicitly (random Fourier features for the radial kernel, Rahimi & Recht
2007; squares and products for the polynomial one), so training stays
linear in the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Rows of a block, and rows mapped at once (their map stays in the processor's cache).
_SLICE, _MAPPED = 2_048, 256
#: cos(t) as a polynomial in t^2 for |t| <= pi / 2, to 3e-16.
_COS = (4.608977003001797e-14, -1.1462901901757276e-11, 2.0876561839933163e-09, -2.755731639102575e-07, 2.4801587277414926e-05,
        -0.001388888888877299, 0.04166666666666388, -0.4999999999999997, 1.0)


@dataclass
class KernelMap:
    kind: str = "linear"            # linear | radial | polynomial
    mean: np.ndarray | None = None
    sd: np.ndarray | None = None
    W: np.ndarray | None = None     # radial: p x D
    b: np.ndarray | None = None     # radial: D
    gamma: float = 1.0

    def transform(self, X: np.ndarray) -> np.ndarray:
        Z = (X - self.mean) / self.sd
        if self.kind == "radial":
            out = np.empty((len(Z), self.W.shape[1]))
            scale, spare = math.sqrt(2.0 / self.W.shape[1]), np.empty((_MAPPED, self.W.shape[1]))
            for at in range(0, len(Z), _MAPPED):
                part = out[at:at + _MAPPED]
                np.matmul(Z[at:at + _MAPPED], self.W, out=part)
                part += self.b
                _cosines(part, spare[:len(part)])
                part *= scale
            return out
        if self.kind == "polynomial":
            p = Z.shape[1]
            prods = [Z[:, i] * Z[:, j] for i in range(p) for j in range(i, p)]
            return np.column_stack([Z] + prods) if prods else Z
        return Z


def _cosines(t: np.ndarray, spare: np.ndarray) -> None:
    """``cos(t)`` in place: of the half angle less whole half turns, then doubled."""
    t *= 0.5
    np.multiply(t, 1 / math.pi, out=spare)
    np.rint(spare, out=spare)
    spare *= math.pi
    t -= spare
    np.multiply(t, t, out=spare)
    np.multiply(spare, _COS[0], out=t)
    t += _COS[1]
    for c in _COS[2:]:
        t *= spare
        t += c
    t *= t
    t *= 2
    t -= 1


def make_kernel(kind: str, mean, sd, p: int, n_features: int = 200, gamma: float | None = None,
                seed: int = 42) -> KernelMap:
    sd = np.where(np.asarray(sd) > 0, sd, 1.0)
    km = KernelMap(kind=kind, mean=np.asarray(mean, float), sd=np.asarray(sd, float))
    if kind == "radial":
        g = gamma if gamma is not None else 1.0 / p          # e1071's default gamma = 1 / p
        rng = np.random.default_rng(seed)
        km.W = rng.normal(0.0, math.sqrt(2 * g), size=(p, n_features))
        km.b = rng.uniform(0, 2 * math.pi, size=n_features)
        km.gamma = g
    elif kind not in ("linear", "polynomial"):
        raise ValueError(f"Unknown kernel: {kind}")
    return km


def _partials(data: DataFrame, fn, w: np.ndarray) -> tuple[float, np.ndarray, int]:
    """One job: per-partition (loss, gradient, n) over blocks of rows; summed on the driver."""
    wb = w.copy()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(wb) + 1), 0
        for batch in batches:
            for block, size in zip(batch.column("rows"), batch.column("n").to_pylist(), strict=True):
                rows = np.frombuffer(block.as_buffer()).reshape(size, -1)
                lo, g = fn(wb, rows[:, :-1], rows[:, -1])
                total[0] += lo
                total[1:] += g
                n += size
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["v", "n"])
    rows = data.mapInArrow(part, "v binary, n long").collect()
    total = sum((np.frombuffer(r["v"]) for r in rows), np.zeros(len(w) + 1))
    return float(total[0]), total[1:], sum(r["n"] for r in rows)


@dataclass
class TrainLog:
    losses: list = field(default_factory=list)


def adam(data: DataFrame, fn, w0: np.ndarray, iters: int = 200, lr: float = 0.05, reg=None,
         log: TrainLog | None = None) -> np.ndarray:
    """Adam on the full-batch mean gradient; ``reg(w) -> (penalty, grad)`` is added on the driver."""
    w = w0.astype(float).copy()
    m = np.zeros_like(w)
    v = np.zeros_like(w)
    b1, b2, eps = 0.9, 0.999, 1e-8
    for t in range(1, iters + 1):
        loss, g, n = _partials(data, fn, w)
        g = g / max(n, 1)
        loss = loss / max(n, 1)
        if reg is not None:
            pl, pg = reg(w)
            loss += pl
            g = g + pg
        if log is not None:
            log.losses.append(loss)
        m = b1 * m + (1 - b1) * g
        v = b2 * v + (1 - b2) * g * g
        w -= lr * (m / (1 - b1 ** t)) / (np.sqrt(v / (1 - b2 ** t)) + eps)
    return w


def design_arrays(df: DataFrame, x_cols: list[str], y_col: str, size: int | None = None) -> DataFrame:
    """``rows, n``: blocks of rows (x, then y) as bytes, stored for the iterations."""
    size = size or _SLICE
    out = df.select(F.array(*[F.col(f"`{c}`").cast("double") for c in [*x_cols, y_col]]).alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            v = np.asarray(batch.column("v").flatten()).reshape(len(batch), -1)
            parts = [v[at:at + size] for at in range(0, len(v), size)]
            yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in parts], pa.binary()), pa.array([len(b) for b in parts], pa.int64())],
                                             ["rows", "n"])
    return cut_lineage(out.mapInArrow(pack, "rows binary, n long"))


# ---- SVM regression (epsilon-insensitive) -----------------------------------

@dataclass
class SVRModel:
    kernel: KernelMap
    w: np.ndarray
    y_mean: float
    y_sd: float

    def predict(self, X: np.ndarray) -> np.ndarray:
        Z = self.kernel.transform(X)
        return (Z @ self.w[:-1] + self.w[-1]) * self.y_sd + self.y_mean


def fit_svr(df: DataFrame, x_cols: list[str], y_col: str, kernel: str = "radial", cost: float = 1.0,
            epsilon: float = 0.1, iters: int = 200, seed: int = 42) -> SVRModel:
    """Minimise C * mean(max(0, |y - f| - eps)) + ||w||^2 / (2 n) on scaled x and y."""
    st = df.agg(*[F.avg(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(x_cols)],
                *[F.stddev_samp(F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(x_cols)],
                F.avg(F.col(f"`{y_col}`")).alias("ym"), F.stddev_samp(F.col(f"`{y_col}`")).alias("ys"),
                F.count(F.lit(1)).alias("n")).collect()[0]
    p = len(x_cols)
    km = make_kernel(kernel, [st[f"m{i}"] for i in range(p)], [st[f"s{i}"] or 1.0 for i in range(p)], p, seed=seed)
    ym, ys = st["ym"], (st["ys"] or 1.0)
    data = design_arrays(df, x_cols, y_col)
    dim = km.transform(np.zeros((1, p))).shape[1]

    def fn(w, X, y):
        Z = km.transform(X)
        r = (y - ym) / ys - (Z @ w[:-1] + w[-1])
        over = np.abs(r) - epsilon
        act = over > 0
        loss = cost * over[act].sum()
        s = -cost * np.sign(r) * act
        return loss, np.concatenate([Z.T @ s, [s.sum()]])
    n = st["n"]

    def reg(w):
        return 0.5 * (w[:-1] @ w[:-1]) / n, np.concatenate([w[:-1] / n, [0.0]])
    w = adam(data, fn, np.zeros(dim + 1), iters=iters, lr=0.05, reg=reg)
    return SVRModel(km, w, ym, ys)


def predict_column(df: DataFrame, model, x_cols: list[str], out: str = "prediction") -> DataFrame:
    """Arrow-batched prediction of a numpy model over the design columns."""
    from pyspark.sql.types import DoubleType, StructField, StructType
    schema = StructType(list(df.schema.fields) + [StructField(out, DoubleType())])

    def part(it):
        for pdf in it:
            if len(pdf) == 0:
                yield pdf.assign(**{out: pd.Series([], dtype=float)})
                continue
            X = pdf[x_cols].to_numpy(dtype=float)
            yield pdf.assign(**{out: model.predict(X)})
    return df.mapInPandas(part, schema)
