"""Networks with one hidden layer and weight decay, trained over all rows.

Logistic hidden units; a linear output for numbers, softmax for classes.  The objective is the
reference's: squared error, or minus the log-likelihood, plus ``decay`` times the squared weights.
Training is L-BFGS: each pass evaluates loss and gradient at a few points of the search
line at once; tasks add them up, and only sums reach the driver: of few parts each part's, of more those that
Spark sums by place.  It ends when no
part of the gradient (per row) exceeds :data:`FLAT`, or after ``iters`` passes.  Inputs, and a numeric target,
are at zero mean and unit variance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gradient import design_arrays

#: Largest part of the gradient that counts as none, pairs of steps remembered, and trial steps of a pass.
FLAT, MEMORY, TRIALS = 1e-4, 20, (1.0, 0.35, 0.1)
#: Rows of a block, and parts whose sums the driver takes as they are (a second stage costs as much as a pass).
_SLICE, FEW_PARTS = 4_096, 64

Point = tuple[float, np.ndarray]


@dataclass
class NetModel:
    """``w2``: a weight per hidden unit, or a row of weights (one for each class)."""

    mean: np.ndarray
    sd: np.ndarray
    W1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    y_mean: float = 0.0
    y_sd: float = 1.0
    gradient: float = 0.0     # largest part at the end
    passes: int = 0

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Numbers, or a row of class probabilities."""
        z = (x - self.mean) / self.sd
        out = _logistic(z @ self.W1 + self.b1) @ self.w2 + self.b2
        return _softmax(out) if np.ndim(self.w2) == 2 else out * self.y_sd + self.y_mean

    def input_weights(self) -> np.ndarray:
        """Connection-weight importance per input: sum over paths of the products' size."""
        out = np.abs(self.w2).sum(axis=1) if np.ndim(self.w2) == 2 else np.abs(self.w2)
        return np.abs(self.W1) @ out


def _logistic(v: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(v, -500, 500)))


def _softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Shape:
    inputs: int
    size: int
    classes: int    # 0: a number

    @property
    def weights(self) -> int:
        return (self.inputs + 1) * self.size + (self.size + 1) * max(self.classes, 1)

    def parts(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        p, h, k = self.inputs, self.size, max(self.classes, 1)
        at = np.cumsum([p * h, h, h * k])
        a, b, c, d = np.split(w, at)
        return a.reshape(p, h), b, c.reshape(h, k), d

    def loss(self, w: np.ndarray, z: np.ndarray, y: np.ndarray) -> Point:
        """Sum over rows of half the squared error, or of minus the log-likelihood, and its gradient."""
        w1, b1, w2, b2 = self.parts(w)
        hidden = _logistic(z @ w1 + b1)
        out = hidden @ w2 + b2
        if self.classes:
            chance = _softmax(out)
            own = chance[np.arange(len(y)), y.astype(int)]
            loss, error = -np.log(np.maximum(own, 1e-300)).sum(), chance - (y[:, None] == np.arange(self.classes))
        else:
            error = out - y[:, None]
            loss = 0.5 * (error**2).sum()
        back = (error @ w2.T) * hidden * (1 - hidden)
        return float(loss), np.concatenate([(z.T @ back).ravel(), back.sum(axis=0), (hidden.T @ error).ravel(), error.sum(axis=0)])


def summed(blocks: DataFrame, shape: Shape, points: list[np.ndarray]) -> list[Point]:
    """Loss and gradient over all rows (in blocks, see :func:`design_arrays`: inputs standardised, then the target) at each of the points: one pass."""
    width = shape.weights + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(points), width))
        for batch in batches:
            for block, size in zip(batch.column("rows"), batch.column("n").to_pylist(), strict=True):
                part = np.frombuffer(block.as_buffer()).reshape(size, -1)
                z, y = np.ascontiguousarray(part[:, :-1]), np.ascontiguousarray(part[:, -1])
                for k, w in enumerate(points):
                    loss, gradient = shape.loss(w, z, y)
                    total[k, 0] += loss
                    total[k, 1:] += gradient
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["v"])

    out = np.zeros(len(points) * width)
    if blocks.rdd.getNumPartitions() <= FEW_PARTS:
        for r in blocks.mapInArrow(add, "v array<double>").collect():
            out += r["v"]
        return [(float(v[0]), v[1:]) for v in out.reshape(len(points), width)]
    for r in (blocks.mapInArrow(add, "v array<double>").select(F.posexplode("v").alias("at", "v")).groupBy("at")
              .agg(F.sum("v").alias("v")).collect()):
        out[r["at"]] = r["v"]
    return [(float(v[0]), v[1:]) for v in out.reshape(len(points), width)]


def lbfgs(evaluate: Callable[[list[np.ndarray]], list[Point]], start: np.ndarray, passes: int) -> tuple[np.ndarray, float, int]:
    """A point where the gradient is flat (or the best after ``passes``), its largest part, and the passes taken.

    ``evaluate`` gives loss and gradient of several points for one pass over the data.
    """
    w = start
    (loss, gradient), used = evaluate([w])[0], 1
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    scale = 1.0
    while used < passes and np.abs(gradient).max() > FLAT:
        way = -_turned(gradient, steps)
        slope = float(gradient @ way)
        if slope >= 0:
            steps, way = [], -gradient
            slope = float(gradient @ way)
        first = scale if steps else scale / max(np.linalg.norm(way), 1e-300)
        points = [w + t * first * way for t in TRIALS]
        found = evaluate(points)
        used += 1
        fit = [k for k, (value, _) in enumerate(found) if value <= loss + 1e-4 * TRIALS[k] * first * slope]
        if not fit:
            if scale < 1e-8:
                break
            scale *= 0.03
            continue
        best = min(fit, key=lambda k: found[k][0])
        step, change = points[best] - w, found[best][1] - gradient
        if step @ change > 1e-12 * np.linalg.norm(step) * np.linalg.norm(change):
            steps = [*steps, (step, change)][-MEMORY:]
        w, (loss, gradient), scale = points[best], found[best], 1.0
    return w, float(np.abs(gradient).max()), used


def _turned(gradient: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The gradient times the inverse curvature that the last steps tell (two-loop recursion)."""
    q, back = gradient.copy(), []
    for s, c in reversed(steps):
        a = (s @ q) / (s @ c)
        q -= a * c
        back.append(a)
    if steps:
        s, c = steps[-1]
        q *= (s @ c) / (c @ c)
    for (s, c), a in zip(steps, reversed(back), strict=True):
        q += s * (a - (c @ q) / (s @ c))
    return q


def fit_network(df: DataFrame, inputs: list[str], target: str, size: int = 5, decay: float = 0.01, iters: int = 200, classes: int = 0,
                seed: int = 42) -> NetModel:
    """R8, and C8 with ``classes`` (the target holds their numbers from 0)."""
    p = len(inputs)
    names = [F.col(f"`{c}`").cast("double") for c in [*inputs, target]]
    st = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)],
                *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(names)]).first()
    if not st["n"]:
        raise ValueError("no complete rows")
    mean, sd = (np.array([st[f"{k}{i}"] or 0.0 for i in range(p + 1)]) for k in "ms")
    sd[~(sd > 0)] = 1.0
    if classes:
        mean[p], sd[p] = 0.0, 1.0
    scaled = [(c - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(names, mean, sd)]
    inner = [f"x{i}" for i in range(p)]
    blocks = design_arrays(df.select(*[c.alias(x) for c, x in zip(scaled, [*inner, "y"])]), inner, "y", _SLICE)
    shape, n = Shape(p, size, classes), st["n"]
    price = decay / n * (2.0 if classes else 1.0)  # beside half the squared error, or the whole log-likelihood

    def evaluate(points: list[np.ndarray]) -> list[Point]:
        return [(value / n + 0.5 * price * float(w @ w), gradient / n + price * w)
                for w, (value, gradient) in zip(points, summed(blocks, shape, points), strict=True)]

    start = np.random.default_rng(seed).uniform(-0.7, 0.7, shape.weights)
    w, largest, used = lbfgs(evaluate, start, iters)
    w1, b1, w2, b2 = shape.parts(w)
    if not classes:
        return NetModel(mean[:p], sd[:p], w1, b1, w2[:, 0], b2[0], float(mean[p]), float(sd[p]), largest, used)
    return NetModel(mean[:p], sd[:p], w1, b1, w2, b2, gradient=largest, passes=used)
