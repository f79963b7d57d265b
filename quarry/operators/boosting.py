"""Gradient boosting of classes: trees on shared softmax gradients.

A round grows one tree for each class (for two classes a single one, on the log-odds) on what
the probabilities of all trees so far leave unexplained (Friedman 2001).  A tree is grown best
split first to ``depth`` splits, as in the reference's package; features are binned at quantiles of the table and
factors split by sets of levels, as in :mod:`quarry.operators.trees`.  A leaf adds ``shrinkage`` times a Newton step.

The table holds blocks of rows: their bins, classes and scores, each as bytes.  Each split costs one pass for
all classes: tasks bring their rows' scores up to date with the trees that
are not in the table yet, add up moments by node, feature and bin, and one row of such sums for each task reaches the driver.  Every
:data:`REFRESH` rounds the scores are written anew.  A table of at most ``local_rows`` rows goes through the same
steps in one piece, with the scores brought up to date in each round; what one task holds is bounded by :data:`LOCAL_VALUES`.  All rows count in every round, so the training deviance falls.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import trees as TR

#: Rounds after which the scores are written anew, and rows that each side of a split must have.
REFRESH, MIN_BUCKET = 10, 10
#: Rows of a block.
_SLICE = 16_384
#: Numbers (features, class and scores of all rows) up to which a table is boosted in one piece: hundreds of short passes cost more than they share out.
LOCAL_VALUES = 4_000_000


def local_rows(shape: TR.Shape) -> int:
    return LOCAL_VALUES // (len(shape.levels) + 1 + (1 if shape.classes == 2 else shape.classes))


@dataclass
class Boosted:
    """``rounds``: of each round the trees with their leaf values; ``gains`` by feature; ``deviances`` before each round, and at the end."""

    shape: TR.Shape                  # of the features; two classes or more
    start: np.ndarray
    rounds: list[list[tuple[TR.Tree, np.ndarray]]] = field(default_factory=list)
    gains: np.ndarray = field(default_factory=lambda: np.zeros(0))
    deviances: list[float] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return added(np.tile(self.start, (len(x), 1)), x, self.rounds)

    def chances(self, x: np.ndarray) -> np.ndarray:
        return chances(self.scores(x))

    def packed(self) -> bytes:
        parts = {"start": self.start, "gains": self.gains, "deviances": np.array(self.deviances),
                 "levels": np.array(self.shape.levels, dtype=np.int64), "classes": np.array(self.shape.classes),
                 "rounds": np.array(len(self.rounds))}
        for i, trees in enumerate(self.rounds):
            for j, (tree, values) in enumerate(trees):
                parts[f"tree_{i}_{j}"], parts[f"values_{i}_{j}"] = np.frombuffer(tree.packed(), np.uint8), values
        out = io.BytesIO()
        np.savez(out, **parts)
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Boosted:
        got = np.load(io.BytesIO(data))
        shape = TR.Shape(tuple(got["levels"].tolist()), int(got["classes"]))
        rounds = [[(TR.Tree.unpacked(got[f"tree_{i}_{j}"].tobytes()), got[f"values_{i}_{j}"]) for j in range(len(got["start"]))]
                  for i in range(int(got["rounds"]))]
        return cls(shape, got["start"], rounds, got["gains"], got["deviances"].tolist())


def added(scores: np.ndarray, x: np.ndarray, rounds: list[list[tuple[TR.Tree, np.ndarray]]]) -> np.ndarray:
    for trees in rounds:
        for j, (tree, values) in enumerate(trees):
            scores[:, j] += values[tree.leaf_of(x)]
    return scores


def chances(scores: np.ndarray) -> np.ndarray:
    """Probability of each class; a single score is the log-odds of the second."""
    if scores.shape[1] == 1:
        p = 1 / (1 + np.exp(-np.clip(scores[:, 0], -500, 500)))
        return np.column_stack([1 - p, p])
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def unexplained(scores: np.ndarray, y: np.ndarray, with_loss: bool = True) -> tuple[np.ndarray, float]:
    """For each tree of a round (a row each, as in ``scores``) what it is to explain, and minus twice the log-likelihood."""
    if len(scores) == 1:
        p = 1 / (1 + np.exp(-np.clip(scores[0], -500, 500)))
        own, left = np.where(y == 1, p, 1 - p), ((y == 1) - p)[None, :]
    else:
        e = np.exp(scores - scores.max(axis=0))
        p = e / e.sum(axis=0)
        own, left = p[y, np.arange(len(y))], -p
        left[y, np.arange(len(y))] += 1
    return left, -2 * float(np.log(np.maximum(own, 1e-300)).sum()) if with_loss else 0.0


#: ``n, sum, sum of squares`` of the gradient, and the sum of its curvature.
_WIDTH = 4


def binned(x: np.ndarray, cuts: list[np.ndarray], shape: TR.Shape) -> np.ndarray:
    """Bins of the rows that a model is trained on (they have known levels), a row for each feature."""
    return np.ascontiguousarray(TR._bins(x, cuts, shape).T.astype(np.uint16))


def leaves(tree: TR.Tree, bins: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Leaf of each row by its bins: :meth:`quarry.operators.trees.Tree.leaf_of` for few nodes."""
    node = np.zeros(bins.shape[1], dtype=np.uint16)
    for at in np.flatnonzero(tree.feature >= 0).tolist():  # parents come first
        f = tree.feature[at]
        if tree.subset[at] >= 0:
            left = tree.subsets[tree.subset[at]][bins[f]]
        else:
            left = bins[f] <= np.searchsorted(cuts[f], tree.cut[at])
        node = np.where(node == at, np.where(left, np.uint16(tree.left[at]), np.uint16(tree.right[at])), node)
    return node


def caught_up(scores: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], rounds: list[list[tuple[TR.Tree, np.ndarray]]]) -> np.ndarray:
    """:func:`added` by bins, a row of scores for each tree."""
    for trees in rounds:
        for j, (tree, values) in enumerate(trees):
            scores[j] += values[leaves(tree, bins, cuts)]
    return scores


def histogram(left: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], sizes: list[int], growing: list[TR.Tree],
              wanted: list[list[int]]) -> np.ndarray:
    """Moments by wanted node (tree by tree), then feature and bin."""
    total = np.zeros((sum(map(len, wanted)), sum(sizes), _WIDTH))
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
    at = 0
    for j, (tree, nodes) in enumerate(zip(growing, wanted, strict=True)):
        if not nodes:
            continue
        place = np.full(len(tree.feature), -1)
        place[nodes] = np.arange(len(nodes))
        of = place[leaves(tree, bins, cuts)]
        r, here = left[j], bins
        if len(nodes) < len(tree.feature):
            on = np.flatnonzero(of >= 0)
            r, here, of = r[on], bins[:, on], of[on]
        size = np.abs(r)
        moments = (None, r, r * r, size * (1 - size))
        for f, k in enumerate(sizes):
            cell = of * k + here[f]
            for m, v in enumerate(moments):
                total[at:at + len(nodes), offsets[f]:offsets[f] + k, m] = np.bincount(cell, v, minlength=len(nodes) * k).reshape(len(nodes), k)
        at += len(nodes)
    return total


def _split_of(table: np.ndarray, sizes: list[int], shape: TR.Shape, cuts: list[np.ndarray]) -> tuple | None:
    """Best split of a node from its moments by feature and bin: gain, feature, cut, mask, moments left and right."""
    plain, best, at = TR.Shape(shape.levels), None, 0
    for f, size in enumerate(sizes):
        m = table[at:at + size]
        at += size
        there = np.flatnonzero(m[:, 0] > 0)
        total = m.sum(axis=0, keepdims=True)
        zero = np.zeros(len(there), dtype=np.int64)
        if shape.levels[f]:
            gain, mask, low, high = TR.best_subsets(zero, there, m[there], total, plain, size, MIN_BUCKET)
            cut, mask = 0.0, mask[0]
        else:
            gain, below, _, low, high = TR.best_cuts(zero, there.astype(float), m[there], total, plain, MIN_BUCKET)
            cut, mask = (float(cuts[f][int(below[0])]) if gain[0] > -np.inf else 0.0), np.zeros(0, bool)
        if gain[0] > 1e-10 * max(float(TR.impurity(total, plain)[0]), 1e-300) and (best is None or gain[0] > best[0]):
            best = float(gain[0]), f, cut, mask, low[0], high[0]
    return best


def train(model: Boosted, sizes: list[int], cuts: list[np.ndarray], counted: Callable, refresh: Callable, trees: int, depth: int,
          shrinkage: float, every: int = REFRESH) -> Boosted:
    """All rounds.  ``counted(pending, growing, wanted)`` gives moments and deviance, ``refresh(pending)`` brings the scores up to date."""
    shape, width = model.shape, len(model.start)
    numeric, levels = (lambda f: shape.levels[f] == 0), max(shape.levels, default=0)
    pending: list[list[tuple[TR.Tree, np.ndarray]]] = []
    model.gains = np.zeros(len(sizes))
    for _ in range(trees):
        growing = [TR.Tree.of_root(np.zeros(_WIDTH), TR.Shape(shape.levels)) for _ in range(width)]
        wanted: list[list[int]] = [[0] for _ in range(width)]
        known: list[dict[int, tuple | None]] = [{} for _ in range(width)]
        for made in range(depth):
            table, loss = counted(pending, growing, wanted)
            if not made:
                model.deviances.append(loss)
            at = 0
            for j in range(width):
                for node in wanted[j]:
                    if not made:
                        growing[j].stats[0] = table[at][:sizes[0]].sum(axis=0)
                    known[j][node] = _split_of(table[at], sizes, shape, cuts)
                    at += 1
            wanted = [[] for _ in range(width)]
            for j in range(width):
                open_nodes = [(split[0], -node) for node, split in known[j].items() if split]
                if not open_nodes:
                    continue
                node = -max(open_nodes)[1]
                gain, f, cut, mask, low, high = known[j].pop(node)
                masks = np.zeros((1, levels), bool)
                masks[0, :len(mask)] = mask
                first = int(growing[j].split(np.array([node]), np.array([f]), np.array([cut]), masks, np.array([numeric(f)]),
                                             np.array([gain]), low[None, :], high[None, :])[0])
                model.gains[f] += gain
                wanted[j] = [first, first + 1]
            if not any(wanted):
                break
        scale = shrinkage if width == 1 else shrinkage * (width - 1) / width
        done = [(tree, scale * tree.stats[:, 1] / np.maximum(tree.stats[:, 3], 1e-10) * (tree.feature < 0)) for tree in growing]
        model.rounds.append(done)
        pending.append(done)
        if len(pending) == every:
            refresh(pending)
            pending = []
    _, loss = counted(pending, [], [])
    model.deviances.append(loss)
    return model


def fit(rows: DataFrame, shape: TR.Shape, trees: int = 100, depth: int = 3, shrinkage: float = 0.1,
        local_rows: int = TR.LOCAL_ROWS) -> Boosted:
    """Over ``x`` (see :func:`quarry.operators.trees.grow`) and ``y``, the number of the class."""
    p, k = len(shape.levels), shape.classes
    rows = cut_lineage(rows.select("x", F.col("y").cast("int").alias("y")))
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n = sum(counts.values())
    if not n:
        raise ValueError("no complete rows")
    share = min(max(counts.get(1, 0) / n, 1e-6), 1 - 1e-6)
    start = np.array([np.log(share / (1 - share))]) if k == 2 else np.zeros(k)
    plain = [f for f in range(p) if not shape.levels[f]]
    got = rows.agg(*[F.percentile_approx(F.col("x")[f], [i / TR.BINS for i in range(TR.BINS)], 10_000).alias(f"c{f}")
                     for f in plain]).first() if plain else {}
    cuts = [np.zeros(0) if shape.levels[f] else np.unique(got[f"c{f}"]) for f in range(p)]
    sizes = [shape.levels[f] or len(cuts[f]) + 1 for f in range(p)]
    model = Boosted(shape, start)
    if n <= local_rows:
        def whole(table: pa.Table) -> pa.Table:
            x = np.asarray(table.column("x").combine_chunks().flatten()).reshape(len(table), p)
            y = np.asarray(table.column("y"))
            order = np.lexsort((y, *x.T))  # the same model however the rows arrive
            x, y = x[order], y[order]
            bins, scores = binned(x, cuts, shape), np.tile(start[:, None], len(x))
            state = [unexplained(scores, y)]

            def refresh(pending):
                state[0] = unexplained(caught_up(scores, bins, cuts, pending), y)

            def counted(_, growing, wanted):
                left, loss = state[0]
                return histogram(left, bins, cuts, sizes, growing, wanted), loss

            done = train(model, sizes, cuts, counted, refresh, trees, depth, shrinkage, every=1)
            return pa.table([pa.array([done.packed()], pa.binary())], names=["blob"])

        return Boosted.unpacked(bytes(rows.withColumn("one", F.lit(True)).groupBy("one").applyInArrow(whole, "blob binary").first()["blob"]))
    names, width = ["bins", "y", "f"], len(start)
    blocks = "bins binary, y binary, f binary"

    def packed(bins: np.ndarray, y: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (bins, y, f)], names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, y in TR._slices(b.append_column("i", b.column("y")) for b in batches):
            for at in range(0, len(y), _SLICE):
                own = y[at:at + _SLICE].astype(np.int32)
                yield packed(binned(x[at:at + _SLICE], cuts, shape), own, np.tile(start[:, None], len(own)))

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for bins, y, f in zip(*(batch.column(c) for c in names), strict=True):
                yield (np.frombuffer(bins.as_buffer(), np.uint16).reshape(p, -1), np.frombuffer(y.as_buffer(), np.int32),
                       np.frombuffer(f.as_buffer(), np.float64).reshape(width, -1).copy())

    table = [cut_lineage(rows.mapInArrow(pack, blocks))]

    def refresh(pending: list) -> None:
        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bins, y, f in arrays(batches):
                yield packed(bins, y, caught_up(f, bins, cuts, pending))
        table[0] = cut_lineage(table[0].mapInArrow(write, blocks))

    def counted(pending: list, growing: list[TR.Tree], wanted: list[list[int]]) -> tuple[np.ndarray, float]:
        shape_of = (sum(map(len, wanted)), sum(sizes), _WIDTH)
        first = not growing or len(growing[0].feature) == 1  # the deviance is asked for once a round

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, loss = np.zeros(shape_of), 0.0
            for bins, y, f in arrays(batches):
                left, own = unexplained(caught_up(f, bins, cuts, pending), y, first)
                loss += own
                total += histogram(left, bins, cuts, sizes, growing, wanted)
            yield pa.RecordBatch.from_arrays([pa.array([np.append(total.ravel(), loss).tobytes()], pa.binary())], ["v"])

        # a row of sums for each task
        out = sum((np.frombuffer(r["v"]) for r in table[0].mapInArrow(count, "v binary").collect()), np.zeros(int(np.prod(shape_of)) + 1))
        return out[:-1].reshape(shape_of), float(out[-1])

    return train(model, sizes, cuts, counted, refresh, trees, depth, shrinkage)


def predict(rows: DataFrame, model: Boosted) -> DataFrame:
    """``rows`` (with ``x``) and ``answer``, the probability of each class."""
    p = len(model.shape.levels)

    @F.arrow_udf("array<double>")
    def answer(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            out = model.chances(np.asarray(lists.flatten()).reshape(len(lists), p))
            yield pa.ListArray.from_arrays(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32), out.ravel())

    return rows.withColumn("answer", answer("x"))
