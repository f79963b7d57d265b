"""k-medoids on Gower distance over the whole table (K3).

Candidates for medoids are a block of at most ``candidates`` distinct rows, drawn by
multiplicity; what they are judged by is every row.  One pass gives the total
gain of all candidates at once (the greedy start), or of all exchanges of a medoid and a candidate: each row
knows its distances to the nearest and the second nearest medoid, and with these alone what any exchange would
change for it (Schubert and Rousseeuw 2019).  Tasks add these up, Spark sums them, and only
``(k + 1) x candidates`` numbers reach the driver.  The best exchange is made until none is better; then
the next block of candidates is tried, until a block brings nothing.

Equal rows are one point with a weight, so a row that a third of the table holds
costs what others cost.  Rows with a missing value are left out.  Numeric features count by their share of the
range, the others by equality (of a 64-bit hash).  With fewer distinct rows than ``k`` each is a medoid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.roles import col
from ..session import cut_lineage
from .cleaning import drop_incomplete
from .cluster import MedoidFit, gower_ranges

#: Distinct rows of a block, blocks that are tried at most.
CANDIDATES, BLOCKS = 256, 8
#: Rows that are compared at once, and the part of the cost below which a gain is rounding.
_SLICE, _NOISE = 2_048, 1e-10


def weighted_rows(df: DataFrame, features: list[str], ranges: dict) -> DataFrame:
    """Distinct complete rows: the features, ``__x`` (numeric, by range), ``__c`` (hashes of the others) and ``__w``."""
    whole = drop_incomplete(df.select(*[col(f) for f in features]))
    rows = whole.groupBy(*[col(f) for f in features]).agg(F.count(F.lit(1)).alias("__w"))
    numbers = [col(f).cast("double") / F.lit(ranges[f]) if ranges[f] > 0 else F.lit(0.0) for f in features if f in ranges]
    others = [F.xxhash64(col(f).cast("string")) for f in features if f not in ranges]
    return rows.withColumns({"__x": F.array(*numbers).cast("array<double>"), "__c": F.array(*others).cast("array<long>")})


def draw(rows: DataFrame, features: list[str], size: int, seed: int) -> list:
    """``size`` distinct rows, likelier the more often they occur: those with the smallest exponential keys."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[col(f) for f in features]), 11).cast("double") + 0.5) / float(1 << 53)
    return (rows.withColumn("__key", -F.log(u) / F.col("__w")).orderBy("__key", *[col(f) for f in features]).limit(size)
            .drop("__key").collect())


def _distances(x: np.ndarray, c: np.ndarray, to_x: np.ndarray, to_c: np.ndarray) -> np.ndarray:
    total = np.zeros((len(x), len(to_x)))
    for j in range(x.shape[1]):
        total += np.abs(x[:, j:j + 1] - to_x[:, j])
    for j in range(c.shape[1]):
        total += c[:, j:j + 1] != to_c[:, j]
    return total / max(x.shape[1] + c.shape[1], 1)


class _Points:
    """Rows as arrays."""

    def __init__(self, x: list, c: list):
        self.x = np.array(x, dtype=float).reshape(len(x), len(x[0]) if x else 0)
        self.c = np.array(c, dtype=np.int64).reshape(len(c), len(c[0]) if c else 0)


def _summed(rows: DataFrame, size: int, add: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of ``add(x, c, weights)``, a vector of ``size`` numbers: tasks add up, Spark sums by place."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for at in range(0, len(batch), _SLICE):
                cut = batch.slice(at, _SLICE)
                x, c = (np.asarray(cut.column(k).flatten()).reshape(len(cut), -1) for k in ("__x", "__c"))
                total += add(x, c, np.asarray(cut.column("__w")).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["v"])

    sums = (rows.select("__x", "__c", "__w").mapInArrow(part, "v array<double>").select(F.posexplode("v").alias("at", "v"))
            .groupBy("at").agg(F.sum("v").alias("v")).collect())
    out = np.zeros(size)
    for r in sums:
        out[r["at"]] = r["v"]
    return out


def start_gains(rows: DataFrame, medoids: _Points, candidates: _Points) -> tuple[np.ndarray, float]:
    """How much each candidate would lower the cost as a further medoid (as the first: minus its cost), and the cost now."""
    n = len(candidates.x)

    def add(x, c, w):
        far = _distances(x, c, candidates.x, candidates.c)
        if not len(medoids.x):
            return np.append(-(w @ far), 0.0)
        near = _distances(x, c, medoids.x, medoids.c).min(axis=1)
        return np.append(w @ np.maximum(near[:, None] - far, 0), w @ near)

    out = _summed(rows, n + 1, add)
    return out[:n], float(out[n])


def exchange_changes(rows: DataFrame, medoids: _Points, candidates: _Points) -> tuple[np.ndarray, float]:
    """Change of the cost by every exchange (medoids x candidates), and the cost now."""
    k, n = len(medoids.x), len(candidates.x)

    def add(x, c, w):
        to_medoid = _distances(x, c, medoids.x, medoids.c)
        order = np.argsort(to_medoid, axis=1, kind="stable")
        at = np.arange(len(x))
        first, near = order[:, 0], to_medoid[at, order[:, 0]]
        second = to_medoid[at, order[:, 1]] if k > 1 else np.full(len(x), np.inf)
        far = _distances(x, c, candidates.x, candidates.c)
        kept = np.minimum(far, near[:, None])
        lost = (np.minimum(far, second[:, None]) - kept) * w[:, None]
        own = np.zeros((k, n))
        for m in range(k):
            own[m] = lost[first == m].sum(axis=0)
        return np.concatenate([w @ (kept - near[:, None]), own.ravel(), [w @ near]])

    out = _summed(rows, n + k * n + 1, add)
    return out[:n][None, :] + out[n:-1].reshape(k, n), float(out[-1])


def k_medoids(df: DataFrame, features: list[str], k: int = 3, candidates: int = CANDIDATES, max_iter: int = 100,
              seed: int = 42, starts: int = 1) -> MedoidFit:
    """Medoids, with the objective over all rows; ``max_iter`` limits the exchanges.

    The first start is greedy, further ones are drawn; the lowest objective counts.
    """
    ranges = gower_ranges(df, features)
    rows = cut_lineage(weighted_rows(df, features, ranges))
    block = draw(rows, features, max(candidates, k), seed)
    if not block:
        raise ValueError("no complete rows")
    best = None
    for start in range(starts):
        chosen = draw(rows, features, k, seed - start) if start else _greedy(rows, block, k)
        chosen, cost, better = _improved(rows, features, chosen, block, max_iter, seed)
        if best is None or cost < best[1]:
            best = chosen, cost, better
    return MedoidFit(features, pd.DataFrame([[r[f] for f in features] for r in best[0]], columns=features), ranges, *best[1:])


def _greedy(rows: DataFrame, block: list, k: int) -> list:
    """Candidates one by one, each the one that lowers the cost most."""
    chosen: list = []
    while len(chosen) < min(k, len(block)):
        gains, _ = start_gains(rows, _points(chosen), _points(block))
        chosen.append(block[next(int(i) for i in np.argsort(-gains, kind="stable") if block[i] not in chosen)])
    return chosen


def _improved(rows: DataFrame, features: list[str], chosen: list, block: list, left: int, seed: int) -> tuple[list, float, int]:
    """Medoids after the best exchanges of every block, their cost, and how many exchanges would still lower it."""
    size = len(block)
    for number in range(1, BLOCKS + 1):
        made = 0
        while True:
            change, cost = exchange_changes(rows, _points(chosen), _points(block))
            m, j = np.unravel_index(int(change.argmin()), change.shape)
            if left <= 0 or change[m, j] >= -_NOISE * max(cost, 1.0):
                break
            chosen[m] = block[j]
            left, made = left - 1, made + 1
        again = draw(rows, features, size, seed + number)
        if left <= 0 or (number > 1 and not made) or _values(again, features) == _values(block, features):
            break
        block = again
    return chosen, cost, int((change < -_NOISE * max(cost, 1.0)).sum())


def _values(rows: list, features: list[str]) -> set[tuple]:
    return {tuple(r[f] for f in features) for r in rows}


def _points(rows: list) -> _Points:
    return _Points([r["__x"] for r in rows], [r["__c"] for r in rows])
