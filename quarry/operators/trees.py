"""Trees and forests with factor splits, grown on Spark.

Nodes with more than :data:`LOCAL_ROWS` rows are split level by level: every task counts its rows by
tree, node, feature and bin, Spark adds up, and each node's best split is found in a group of bounded size.
Smaller nodes are finished in one piece: their rows go to a group per tree and node, and the
subtree comes back as one row.  No depth is cut unless asked for.

* Numeric features are split between two values.  In large nodes the values are binned: at quantiles of the table
  first, and evenly between the least and the largest of a node that these do not divide.
* Factors are split into two sets of levels.  For means and for two classes the best set is a prefix of the
  levels in the order of their mean (Breiman 1984); above two classes the best prefix over the orders by each
  class's share is taken.  A level that a node has not seen goes to the larger side.
* Forests draw rows by Poisson weights, a hash of row and tree, and ``mtry`` features anew in each node.
* A tree is pruned by cost complexity: a split stays if its branch lowers the risk (squares, or rows
  misclassified) by ``cp`` of the root's for every leaf it adds.  What is left has at most
  ``1 / cp`` leaves, so only that reaches the driver.

A forest's subtrees stay a table.  Up to :data:`BROADCAST_BYTES` of them are sent to the tasks that
predict; beyond that, rows and subtrees meet by tree and node, in blocks of bounded size.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hotjoin import join_on_hot_key
from ..session import cut_lineage

#: Rows up to which a node is finished in one piece, and bins of a feature in larger ones.
LOCAL_ROWS, BINS = 65_536, 64
#: Serialised subtrees up to which predictions have them all in each task.
BROADCAST_BYTES = 64 << 20
#: Rows that one group of a prediction meets a subtree with, and rows handled at once.
BLOCK, _SLICE = 100_000, 32_768
#: Rows from which those of a node are sent on together.
_TOGETHER = 128
#: Numbers that a task adds up in one pass over the rows.
SUMS = 12_000_000
#: Part of a node's risk below which a gain is rounding.
_NOISE = 1e-10


@dataclass(frozen=True)
class Limits:
    max_depth: int | None = None
    min_split: int = 2     # rows a node must have to be split
    min_bucket: int = 1    # rows each side must have


@dataclass(frozen=True)
class Shape:
    """``levels`` of each feature (0: numeric) and ``classes`` of the target (0: a number)."""

    levels: tuple[int, ...]
    classes: int = 0

    @property
    def width(self) -> int:
        """Numbers that describe rows: ``n, sum, sum of squares``, or ``n`` and the rows of each class."""
        return 1 + (self.classes or 2)

    def moments(self, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """These numbers for each row."""
        if self.classes:
            return w[:, None] * np.column_stack([np.ones(len(y)), y[:, None] == np.arange(self.classes)])
        return w[:, None] * np.column_stack([np.ones(len(y)), y, y * y])


@dataclass
class Tree:
    """Nodes as arrays, the root first and children after their parents; ``feature`` -1: a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    stats: np.ndarray
    gain: np.ndarray
    larger_left: np.ndarray
    subset: np.ndarray                    # row of ``subsets`` (levels that go left), or -1
    subsets: np.ndarray

    @classmethod
    def of_root(cls, stats: np.ndarray, shape: Shape) -> Tree:
        one = np.full(1, -1, dtype=np.int32)
        return cls(one, np.zeros(1), one.copy(), one.copy(), stats[None, :].astype(float), np.zeros(1), np.zeros(1, bool), one.copy(),
                   np.zeros((0, max(shape.levels, default=0)), bool))

    def split(self, at: np.ndarray, feature: np.ndarray, cut: np.ndarray, masks: np.ndarray, numeric: np.ndarray, gain: np.ndarray,
              left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Give the leaves ``at`` two children each (with these stats); the numbers of the left ones, the right ones follow."""
        first = len(self.feature) + 2 * np.arange(len(at))
        self.feature[at], self.cut[at], self.gain[at] = feature, cut, gain
        self.left[at], self.right[at] = first, first + 1
        self.larger_left[at] = left[:, 0] >= right[:, 0]
        self.subset[at] = np.where(numeric, -1, len(self.subsets) + np.cumsum(~numeric) - 1)
        self.subsets = np.concatenate([self.subsets, masks[~numeric]])
        grown = 2 * len(at)
        none = np.full(grown, -1, dtype=np.int32)
        for name in ("feature", "left", "right", "subset"):
            setattr(self, name, np.concatenate([getattr(self, name), none]))
        for name in ("cut", "gain"):
            setattr(self, name, np.concatenate([getattr(self, name), np.zeros(grown)]))
        self.larger_left = np.concatenate([self.larger_left, np.zeros(grown, bool)])
        self.stats = np.concatenate([self.stats, np.stack([left, right], axis=1).reshape(grown, -1)])
        return first

    def goes_left(self, nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Which rows ``x`` at inner ``nodes`` go left."""
        value = x[np.arange(len(x)), self.feature[nodes]]
        out = value <= self.cut[nodes]
        factor = np.flatnonzero(self.subset[nodes] >= 0)
        if len(factor):
            level = value[factor].astype(int)
            seen = self.subsets[self.subset[nodes[factor]], np.maximum(level, 0)]
            out[factor] = np.where(level >= 0, seen, self.larger_left[nodes[factor]])
        return out

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Number of the leaf of each row: many rows of a node go on together, the rest each from its own node."""
        node = np.zeros(len(x), dtype=np.int64)
        columns, few = np.ascontiguousarray(x.T), [np.zeros(0, np.int64)]
        open_nodes = [(0, np.arange(len(x)))]
        while open_nodes:
            at, rows = open_nodes.pop()
            if self.feature[at] < 0 or len(rows) < _TOGETHER:
                node[rows] = at
                few.append(rows)
                continue
            value = columns[self.feature[at]][rows]
            if self.subset[at] >= 0:
                left = np.append(self.subsets[self.subset[at]], self.larger_left[at])[value.astype(int)]  # -1: the last
            else:
                left = value <= self.cut[at]
            open_nodes += [(int(self.left[at]), rows[left]), (int(self.right[at]), rows[~left])]
        live = np.concatenate(few)
        live = live[self.feature[node[live]] >= 0]
        while len(live):
            now = node[live]
            node[live] = np.where(self.goes_left(now, x[live]), self.left[now], self.right[now])
            live = live[self.feature[node[live]] >= 0]
        return node

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **vars(self))
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        return cls(**np.load(io.BytesIO(data)))

    def with_branches(self, branches: dict[int, Tree]) -> Tree:
        """This tree with subtrees in place of leaves."""
        out = Tree(**{k: v.copy() for k, v in vars(self).items()})
        for at, branch in sorted(branches.items()):
            base = len(out.feature) - 1  # node j > 0 of the branch becomes base + j, its root is the leaf
            moved = {k: np.where(v < 0, v, v + base).astype(np.int32) for k, v in (("left", branch.left), ("right", branch.right))}
            moved["subset"] = np.where(branch.subset < 0, -1, branch.subset + len(out.subsets)).astype(np.int32)
            for name in ("feature", "cut", "stats", "gain", "larger_left", "left", "right", "subset"):
                values = moved.get(name, getattr(branch, name))
                joined = np.concatenate([getattr(out, name), values[1:]])
                joined[at] = values[0]
                setattr(out, name, joined)
            out.subsets = np.concatenate([out.subsets, branch.subsets])
        return out

    def pruned(self, price: float, shape: Shape) -> Tree:
        """Without the branches that lower the risk by less than ``price`` for each leaf they add."""
        risk = risks(self.stats, shape)
        cost, keep = risk + price, self.feature >= 0
        for i in reversed(range(len(risk))):
            if keep[i]:
                below = cost[self.left[i]] + cost[self.right[i]]
                keep[i] = below < cost[i] - _NOISE * max(risk[0], 1e-300)
                cost[i] = below if keep[i] else cost[i]
        order, stack = [], [0]
        while stack:
            i = stack.pop(0)
            order.append(i)
            if keep[i]:
                stack += [int(self.left[i]), int(self.right[i])]
        place = np.full(len(risk) + 1, -1, dtype=np.int32)
        place[order] = np.arange(len(order))
        at = np.array(order)
        inner = keep[at]
        subset = np.where(inner, self.subset[at], -1)
        used = subset[subset >= 0]
        subset[subset >= 0] = np.arange(len(used))
        return Tree(np.where(inner, self.feature[at], -1).astype(np.int32), self.cut[at], np.where(inner, place[self.left[at]], -1),
                    np.where(inner, place[self.right[at]], -1), self.stats[at], np.where(inner, self.gain[at], 0), self.larger_left[at],
                    subset.astype(np.int32), self.subsets[used])


def risks(stats: np.ndarray, shape: Shape) -> np.ndarray:
    """Rows outside the commonest class, or the sum of squares about the mean."""
    if shape.classes:
        return stats[:, 0] - stats[:, 1:].max(axis=1)
    return np.maximum(stats[:, 2] - stats[:, 1] ** 2 / np.maximum(stats[:, 0], 1e-300), 0)


def purity(stats: np.ndarray, shape: Shape) -> np.ndarray:
    """What splits are to raise: sum of squares explained, or n - n x Gini impurity."""
    n = np.maximum(stats[..., 0], 1e-300)
    return (stats[..., 1:] ** 2).sum(axis=-1) / n if shape.classes else stats[..., 1] ** 2 / n


def impurity(stats: np.ndarray, shape: Shape) -> np.ndarray:
    """What is left for splits to explain."""
    return (stats[..., 0] if shape.classes else stats[..., 2]) - purity(stats, shape)


def value_of(stats: np.ndarray, shape: Shape) -> np.ndarray:
    """Mean, or share of each class (a row for each node)."""
    n = np.maximum(stats[:, :1], 1e-300)
    return stats[:, 1:] / n if shape.classes else stats[:, 1:2] / n


# ---- the best split of sorted pieces ------------------------------------------------------------

def best_cuts(node: np.ndarray, value: np.ndarray, moments: np.ndarray, totals: np.ndarray, shape: Shape,
              min_bucket: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best cut of each node between two neighbouring values.

    Pieces (rows or bins) are sorted by node and value; ``totals`` has the moments of each node.  Returns gains
    (-inf: none), the values below and above the cut, and the moments left and right of it.
    """
    k = len(totals)
    gain, below, above = np.full(k, -np.inf), np.zeros(k), np.zeros(k)
    left, right = np.zeros_like(totals), np.zeros_like(totals)
    at = np.flatnonzero((node[1:] == node[:-1]) & (value[1:] > value[:-1]))
    if not len(at):
        return gain, below, above, left, right
    sums = np.concatenate([np.zeros((1, moments.shape[1])), np.cumsum(moments, axis=0)])
    starts = np.searchsorted(node, np.arange(k))
    of = node[at]
    low = sums[at + 1] - sums[starts[of]]
    high = totals[of] - low
    worth = purity(low, shape) + purity(high, shape) - purity(totals, shape)[of]
    worth = np.where((low[:, 0] >= min_bucket) & (high[:, 0] >= min_bucket), worth, -np.inf)
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    most = np.maximum.reduceat(worth, first)
    group = np.cumsum(np.concatenate([[0], of[1:] != of[:-1]]))
    hit = np.flatnonzero(worth == most[group])
    best = hit[np.flatnonzero(np.diff(group[hit], prepend=-1))]  # the first of equal ones
    n = of[best]
    gain[n], below[n], above[n] = worth[best], value[at[best]], value[at[best] + 1]
    left[n], right[n] = low[best], high[best]
    return gain, below, above, left, right


def midpoint(below: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A value that parts the two; the lower one where there is none between."""
    middle = below + (above - below) / 2
    return np.where(middle < above, middle, below)


def best_subsets(node: np.ndarray, level: np.ndarray, moments: np.ndarray, totals: np.ndarray, shape: Shape, levels: int,
                 min_bucket: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best set of levels of each node: gains, masks (node x level), moments left and right of it."""
    k = len(totals)
    cell = node * levels + level
    table = np.zeros((k * levels, moments.shape[1]))
    for j in range(moments.shape[1]):
        table[:, j] = np.bincount(cell, moments[:, j], minlength=k * levels)
    table = table.reshape(k, levels, -1)
    there = table[:, :, 0] > 0
    gain, masks = np.full(k, -np.inf), np.zeros((k, levels), bool)
    left, right = np.zeros_like(totals), np.zeros_like(totals)
    for j in range(1, shape.classes) if shape.classes > 2 else (1,):
        share = np.where(there, table[:, :, j + (shape.classes == 2)] / np.maximum(table[:, :, 0], 1e-300), np.inf)
        order = np.argsort(share, axis=1, kind="stable")
        place = np.argsort(order, axis=1, kind="stable")
        rows, at = np.nonzero(np.take_along_axis(there, order, axis=1))
        found = best_cuts(rows, at.astype(float), table[rows, order[rows, at]], totals, shape, min_bucket)
        better = found[0] > gain
        gain[better], left[better], right[better] = found[0][better], found[3][better], found[4][better]
        masks[better] = (place[better] <= found[1][better][:, None]) & there[better]
    larger = (left[:, 0] >= right[:, 0])[:, None]
    return gain, masks | (~there & larger), left, right


def chosen_features(seed: int, tree: int, node: int, features: int, mtry: int) -> np.ndarray:
    """The features that a node may be split by, alike wherever it is asked."""
    if mtry >= features:
        return np.ones(features, bool)
    out = np.zeros(features, bool)
    out[np.random.default_rng((seed, tree, node)).choice(features, mtry, replace=False)] = True
    return out


def grow_local(x: np.ndarray, y: np.ndarray, w: np.ndarray, shape: Shape, limits: Limits, mtry: int, seed: int, tree: int = 0,
               origin: int = 0, depth: int = 0) -> Tree:
    """A whole tree of rows in memory, all nodes of a level at once."""
    if shape.levels == (0,):
        return _grow_sorted(x[:, 0], y, w, shape, limits, depth)
    moments = shape.moments(y, w)
    out = Tree.of_root(moments.sum(axis=0), shape)
    rng = np.random.default_rng((seed, tree, origin, 1))
    rows, of = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    sorted_rows = [None if levels else np.argsort(x[:, f], kind="stable") for f, levels in enumerate(shape.levels)]
    noise = _NOISE * 1e-5 * max(float(impurity(out.stats, shape)[0]), 1e-300)
    limit = math.inf if limits.max_depth is None else limits.max_depth
    while len(rows) and depth < limit:
        there = np.bincount(of, minlength=len(out.feature)) > 0
        there &= (out.stats[:, 0] >= limits.min_split) & (impurity(out.stats, shape) > noise)
        fit = there[of]
        rows, of = rows[fit], of[fit]
        if not len(rows):
            break
        nodes = np.flatnonzero(there)
        where = (np.cumsum(there) - 1)[of]
        totals = out.stats[nodes]
        k, p = len(nodes), x.shape[1]
        allowed = np.ones((k, p), bool) if mtry >= p else rng.random((k, p)).argsort(axis=1).argsort(axis=1) < mtry
        gain, feature, cut = _NOISE * impurity(totals, shape) + noise, np.full(k, -1), np.zeros(k)
        masks = np.zeros((k, out.subsets.shape[1]), bool)
        left, right = np.zeros_like(totals), np.zeros_like(totals)
        place = np.full(len(x), k, dtype=np.uint16 if k < 1 << 16 else np.int64)  # small numbers sort in linear time
        place[rows] = where
        for f in range(p):
            if shape.levels[f]:
                here = np.flatnonzero(allowed[where, f])
                values = x[rows[here], f]
                inside = values >= 0
                found = best_subsets(where[here[inside]], values[inside].astype(int), moments[rows[here[inside]]], totals, shape,
                                     shape.levels[f], limits.min_bucket)
                better = found[0] > gain
                masks[better, :shape.levels[f]] = found[1][better]
                low, high = found[2], found[3]
            else:
                sorted_rows[f] = sorted_rows[f][place[sorted_rows[f]] < k]
                here = sorted_rows[f][np.append(allowed[:, f], False)[place[sorted_rows[f]]]]
                here = here[np.argsort(place[here], kind="stable")]
                found = best_cuts(place[here].astype(np.int64), x[here, f], moments[here], totals, shape, limits.min_bucket)
                better = found[0] > gain
                cut[better] = midpoint(found[1], found[2])[better]
                low, high = found[3], found[4]
            gain[better], feature[better] = found[0][better], f
            left[better], right[better] = low[better], high[better]
        made = np.flatnonzero(feature >= 0)
        if not len(made):
            break
        numeric = np.array([shape.levels[f] == 0 for f in feature[made]])
        out.split(nodes[made], feature[made], cut[made], masks[made], numeric, gain[made], left[made], right[made])
        stay = feature[where] >= 0
        rows, of = rows[stay], of[stay]
        of = np.where(out.goes_left(of, x[rows]), out.left[of], out.right[of]).astype(np.int64)
        depth += 1
    return out


def _grow_sorted(x: np.ndarray, y: np.ndarray, w: np.ndarray, shape: Shape, limits: Limits, depth: int) -> Tree:
    """:func:`grow_local` by a single number: sorted once, every node is a range of its values, and moments are differences of running sums."""
    order = np.argsort(x, kind="stable")
    value, moments = x[order], shape.moments(y[order], w[order])
    ends = np.flatnonzero(np.append(value[1:] != value[:-1], True)) if len(value) else np.zeros(0, np.int64)
    value, sums = value[ends], np.concatenate([np.zeros((1, shape.width)), np.cumsum(moments, axis=0)[ends]])
    out = Tree.of_root(moments.sum(axis=0), shape)
    noise = _NOISE * 1e-5 * max(float(impurity(out.stats, shape)[0]), 1e-300)
    limit = math.inf if limits.max_depth is None else limits.max_depth
    nodes, first, last = np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([len(value)])
    while len(nodes) and depth < limit:
        totals = out.stats[nodes]
        left_over = impurity(totals, shape)
        fit = (totals[:, 0] >= limits.min_split) & (left_over > noise) & (last - first > 1)
        nodes, first, last, totals, left_over = nodes[fit], first[fit], last[fit], totals[fit], left_over[fit]
        if not len(nodes):
            break
        cuts = last - first - 1  # places between two values of a node
        starts = np.cumsum(cuts) - cuts
        at = np.arange(cuts.sum()) + np.repeat(first - starts, cuts)
        low = sums[at + 1] - np.repeat(sums[first], cuts, axis=0)
        high = np.repeat(totals, cuts, axis=0) - low
        worth = purity(low, shape) + purity(high, shape) - np.repeat(purity(totals, shape), cuts)
        if limits.min_bucket > 0:
            worth[(low[:, 0] < limits.min_bucket) | (high[:, 0] < limits.min_bucket)] = -np.inf
        most = np.maximum.reduceat(worth, starts)
        hit = np.flatnonzero(worth == np.repeat(most, cuts))
        best = hit[np.searchsorted(hit, starts)]  # the first of equal ones
        made = np.flatnonzero(most > _NOISE * left_over + noise)
        if not len(made):
            break
        best, place = best[made], at[best[made]]
        none = np.zeros((len(made), out.subsets.shape[1]), bool)
        grown = out.split(nodes[made], np.zeros(len(made), np.int64), midpoint(value[place], value[place + 1]), none, np.ones(len(made), bool),
                          most[made], low[best], high[best])
        nodes = np.stack([grown, grown + 1], axis=1).ravel()
        first, last = np.stack([first[made], place + 1], axis=1).ravel(), np.stack([place + 1, last[made]], axis=1).ravel()
        depth += 1
    return out


# ---- growing on Spark ----------------------------------------------------------------------------

@dataclass
class Forest:
    """``tops``: a tree each, whose leaves may go on in ``branches`` (``key`` = tree and leaf, ``blob``)."""

    shape: Shape
    tops: list[Tree]
    branches: DataFrame | None = None
    branch_bytes: int = 0
    gains: np.ndarray = field(default_factory=lambda: np.zeros(0))
    shift: float = 0.0                   # mean of the target, which the nodes are told without


def draws(row: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row: Poisson with mean 1 of a hash of row and tree."""
    h = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + tree + 1) * 0xD1B54A32D192ED03 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)
    return np.searchsorted(_POISSON, u, side="right").astype(float)


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


def _key(tree: int, node: int) -> int:
    return tree << 32 | node


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``i, x, y`` of the rows, some batches at once."""
    def together(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))

    parts, held = [], 0
    for batch in batches:
        if not len(batch):
            continue
        parts.append((np.asarray(batch.column("i")), np.asarray(batch.column("x").flatten()).reshape(len(batch), -1), np.asarray(batch.column("y"))))
        held += len(batch)
        if held >= _SLICE:
            yield together(parts)
            parts, held = [], 0
    if parts:
        yield together(parts)


def _weights(bootstrap: bool, row: np.ndarray, tree: int, seed: int) -> np.ndarray:
    return draws(row, tree, seed) if bootstrap else np.ones(len(row))


def _bins(x: np.ndarray, cuts: list[np.ndarray], shape: Shape) -> np.ndarray:
    """Bin of every value: the level of a factor, or the place among the cuts."""
    return np.column_stack([x[:, f].astype(int) if shape.levels[f] else np.searchsorted(cuts[f], x[:, f]) for f in range(x.shape[1])])


def _count(rows: DataFrame, tops: list[Tree], wanted: dict[int, list[np.ndarray] | None], cuts: list[np.ndarray], shape: Shape,
           bootstrap: bool, mtry: int, seed: int) -> DataFrame:
    """``key, f, bin, lo, hi, m0, m1, ...`` of the nodes ``wanted`` (key -> own cuts): moments and value range of each bin."""
    p, width = len(shape.levels), shape.width
    sizes = _cells(shape)
    offsets, cells = np.concatenate([[0], np.cumsum(sizes)[:-1]]), sum(sizes)
    by_tree: dict[int, list[int]] = {}
    for key in sorted(wanted):
        by_tree.setdefault(key >> 32, []).append(key & 0xFFFFFFFF)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = {t: np.array([chosen_features(seed, t, node, p, mtry) for node in nodes]) for t, nodes in by_tree.items()}
        sums = {t: np.zeros((width, len(nodes) * cells)) for t, nodes in by_tree.items()}
        los = {t: np.full(len(nodes) * cells, np.inf) for t, nodes in by_tree.items()}
        his = {t: np.full(len(nodes) * cells, -np.inf) for t, nodes in by_tree.items()}
        for row, x, y in _slices(batches):
            usual, plain = _bins(x, cuts, shape), shape.moments(y, np.ones(len(y)))
            for t, nodes in by_tree.items():
                place = np.full(len(tops[t].feature), -1)
                place[nodes] = np.arange(len(nodes))
                w = _weights(bootstrap, row, t, seed)
                at = place[tops[t].leaf_of(x)]
                on = np.flatnonzero((w > 0) & (at >= 0))
                at, bins = at[on], usual[on]
                for j, node in enumerate(nodes):
                    if (own := wanted[_key(t, node)]) is not None:
                        bins[at == j] = _bins(x[on[at == j]], own, shape)
                moments = plain[on] * w[on, None]
                for f in range(p):
                    inside = np.flatnonzero(chosen[t][at, f])
                    cell = at[inside] * cells + offsets[f] + bins[inside, f] + 1
                    for m in range(width):
                        sums[t][m] += np.bincount(cell, moments[inside, m], minlength=sums[t].shape[1])
                    np.minimum.at(los[t], cell, x[on[inside], f])
                    np.maximum.at(his[t], cell, x[on[inside], f])
        for t, nodes in by_tree.items():
            there = np.flatnonzero(sums[t][0] > 0)
            f = np.searchsorted(offsets, there % cells, side="right") - 1
            for start in range(0, len(there), _SLICE):
                part, of = there[start:start + _SLICE], f[start:start + _SLICE]
                columns = [_key(t, 0) + np.array(nodes)[part // cells], of.astype(np.int32), (part % cells - offsets[of] - 1).astype(np.int32),
                           los[t][part], his[t][part], *sums[t][:, part]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    names = ["key", "f", "bin", "lo", "hi", *[f"m{j}" for j in range(width)]]
    schema = "key long, f int, bin int, lo double, hi double, " + ", ".join(f"m{j} double" for j in range(width))
    return (rows.mapInArrow(count, schema).groupBy("key", "f", "bin")
            .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.sum(f"m{j}").alias(f"m{j}") for j in range(width)]))


def _cells(shape: Shape) -> list[int]:
    """Places for the bins of each feature; the first is for no known level."""
    return [(levels or BINS) + 1 for levels in shape.levels]


def _passes(wanted: dict[int, list[np.ndarray] | None], shape: Shape) -> Iterator[dict[int, list[np.ndarray] | None]]:
    """The nodes in parts whose sums a task can hold."""
    keys, step = sorted(wanted), max(SUMS // (sum(_cells(shape)) * (shape.width + 2)), 1)
    for at in range(0, len(keys), step):
        yield {key: wanted[key] for key in keys[at:at + step]}


_SPLIT = ("key long, at int, f int, cut double, gain double, mask array<boolean>, lefts array<double>, rights array<double>, "
          "los array<double>, his array<double>")


def _best(counted: DataFrame, shape: Shape, limits: Limits, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """A row per node: its best split, or ``f`` -1 and the value ranges of its features.

    ``at`` is 0, or with a single feature, whose bins the children of a node share, also a descendant: those of the
    split in row ``s`` of a node are ``2 s + 1`` and ``2 s + 2``, and the rows of large ones follow.
    """
    p, width = len(shape.levels), shape.width

    def split(got: pd.DataFrame) -> tuple[tuple, list[float], list[float]]:
        gain, choice = 0.0, None
        los, his = [0.0] * p, [0.0] * p
        for f, part in got.groupby("f"):
            m = part[[f"m{j}" for j in range(width)]].to_numpy()
            total = m.sum(axis=0, keepdims=True)
            zero = np.zeros(len(m), dtype=np.int64)
            los[f], his[f] = float(part.lo.min()), float(part.hi.max())
            floor = max(gain, _NOISE * float(impurity(total, shape)[0]))
            if shape.levels[f]:
                on = part.bin.to_numpy() >= 0
                g, mask, low, high = best_subsets(zero[on], part.bin.to_numpy()[on], m[on], total, shape, shape.levels[f], limits.min_bucket)
                cut, mask = 0.0, mask[0].tolist()
            else:  # bins do not overlap: a cut lies between the ranges of two neighbours
                g, b0, b1, low, high = best_cuts(zero, np.arange(len(m), dtype=float), m, total, shape, limits.min_bucket)
                cut, mask = 0.0, []
                if g[0] > -np.inf:
                    lo, hi = part.hi.to_numpy()[int(b0[0])], part.lo.to_numpy()[int(b1[0])]
                    cut = float(midpoint(np.array([lo]), np.array([hi]))[0])
            if g[0] > floor:
                gain, choice = float(g[0]), (int(f), cut, float(g[0]), mask, low[0].tolist(), high[0].tolist())
        return choice or (-1, 0.0, 0.0, [], [], []), los, his

    def best(table: pa.Table) -> pa.Table:
        rows, todo = [], [(0, table.to_pandas().sort_values(["f", "bin"]))]
        while todo:
            at, got = todo.pop(0)
            choice, los, his = split(got)
            if p == 1 and not shape.levels[0] and choice[0] >= 0:
                low = got.hi.to_numpy() <= choice[1]
                for side, here, stats in ((1, low, choice[4]), (2, ~low, choice[5])):
                    if stats[0] > local_rows:
                        todo.append((2 * len(rows) + side, got[here]))
            rows.append((int(got.key.iloc[0]), at, *choice, los, his))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.bool_()), *[pa.list_(pa.float64())] * 4]
        return pa.table([pa.array(list(v), t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                        names=[x.split()[0] for x in _SPLIT.split(", ")])

    return counted.groupBy("key").applyInArrow(best, _SPLIT)


def _grow_tops(rows: DataFrame, roots: list[Tree], shape: Shape, limits: Limits, bootstrap: bool, mtry: int, seed: int,
               local_rows: int) -> tuple[list[Tree], dict[int, int]]:
    """Trees down to nodes of at most ``local_rows`` rows, and the depth of their leaves that are to be grown on."""
    tops, p = roots, len(shape.levels)
    depths = {_key(t, 0): 0 for t in range(len(tops))}
    own: dict[int, list[np.ndarray]] = {}
    cuts = None
    limit = math.inf if limits.max_depth is None else limits.max_depth

    def large(key: int) -> bool:
        stats = tops[key >> 32].stats[[key & 0xFFFFFFFF]]
        return stats[0, 0] > local_rows and depths[key] < limit

    while wanted := {k: own.get(k) for k in depths if large(k)}:
        if cuts is None:
            numeric = [f for f in range(p) if not shape.levels[f]]
            got = rows.agg(*[F.percentile_approx(F.col("x")[f], [i / BINS for i in range(1, BINS)], 10_000).alias(f"c{f}")
                             for f in numeric]).first() if numeric else {}
            cuts = [np.zeros(0) if shape.levels[f] else np.unique(got[f"c{f}"]) for f in range(p)]
        found: dict[int, list] = {}
        for some in _passes(wanted, shape):
            for r in _best(_count(rows, tops, some, cuts, shape, bootstrap, mtry, seed), shape, limits, local_rows).collect():
                found.setdefault(r["key"], []).append(r)
        # the splits of a node, then those of its children that the same bins told
        wave = [(key, got, 0) for key, got in found.items()]
        while wave:
            by_tree: dict[int, list] = {}
            for key, got, s in wave:
                r, t, node = got[s], key >> 32, key & 0xFFFFFFFF
                if depths[key] >= limit:
                    continue
                if r["f"] >= 0:
                    by_tree.setdefault(t, []).append((node, got, s))
                    continue
                spread = [f for f in range(p) if not shape.levels[f] and r["his"][f] > r["los"][f]]
                if key in own or not spread:
                    del depths[key]  # it stays a leaf
                else:  # the bins do not part this node: even cuts of its own range
                    own[key] = [np.linspace(r["los"][f], r["his"][f], BINS)[:-1] if f in spread else np.zeros(0) for f in range(p)]
            wave = []
            for t, splits in by_tree.items():
                splits.sort(key=lambda split: split[0])
                rs = [got[s] for _, got, s in splits]
                masks = np.zeros((len(splits), tops[t].subsets.shape[1]), bool)
                for i, r in enumerate(rs):
                    masks[i, :len(r["mask"])] = r["mask"]
                f = np.array([r["f"] for r in rs])
                first = tops[t].split(np.array([n for n, *_ in splits]), f, np.array([r["cut"] for r in rs]), masks,
                                      np.array([shape.levels[v] == 0 for v in f]), np.array([r["gain"] for r in rs]),
                                      np.array([r["lefts"] for r in rs]), np.array([r["rights"] for r in rs]))
                for (node, got, s), a in zip(splits, first.tolist(), strict=True):
                    deeper = depths.pop(_key(t, node)) + 1
                    depths[_key(t, a)] = depths[_key(t, a + 1)] = deeper
                    below = {r["at"] - 2 * s - 1: i for i, r in enumerate(got) if r["at"] in (2 * s + 1, 2 * s + 2)}
                    wave += [(_key(t, a + side), got, i) for side, i in below.items()]
    return tops, {key: depth for key, depth in depths.items() if depth < limit}


def _branches(rows: DataFrame, tops: list[Tree], depths: dict[int, int], shape: Shape, limits: Limits, bootstrap: bool, mtry: int,
              seed: int, price: float | None) -> DataFrame:
    """``key, blob, gains``: the subtree of every open leaf, grown (and pruned) in one piece."""
    p = len(shape.levels)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, x, y in _slices(batches):
            for t, top in enumerate(tops):
                w = _weights(bootstrap, row, t, seed)
                leaf = top.leaf_of(x)
                on = np.flatnonzero((w > 0) & opened[t][leaf])
                yield _by_leaf(t, leaf[on], np.column_stack([x[on], y[on], w[on]]))

    def finish(table: pa.Table) -> pa.Table:
        key = table.column("key")[0].as_py()
        got = _unpacked_rows(table, p + 2)
        x, y, w = got[:, :p], got[:, p], got[:, p + 1]
        order = np.lexsort((w, y, *x.T))  # the same tree however the rows arrive
        tree = grow_local(x[order], y[order], w[order], shape, limits, mtry, seed, key >> 32, key & 0xFFFFFFFF, depths[key])
        if price is not None:
            tree = tree.pruned(price, shape)
        inner = tree.feature >= 0
        gains = np.bincount(tree.feature[inner], tree.gain[inner], minlength=p)
        return pa.table([pa.array([key]), pa.array([tree.packed()], pa.binary()), pa.array([gains.tolist()], pa.list_(pa.float64()))],
                        names=["key", "blob", "gains"])

    opened = [np.zeros(len(top.feature), bool) for top in tops]
    for key in depths:
        opened[key >> 32][key & 0xFFFFFFFF] = True
    return (rows.mapInArrow(deal, "key long, rows binary, n long").groupBy("key")
            .applyInArrow(finish, "key long, blob binary, gains array<double>"))


def _by_leaf(tree: int, leaf: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """``key, rows, n``: the rows of ``values`` at each leaf as bytes."""
    order = np.argsort(leaf.astype(np.uint16) if len(leaf) and leaf.max() < 1 << 16 else leaf, kind="stable")
    leaf, values = leaf[order], np.ascontiguousarray(values[order])
    starts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]])) if len(leaf) else np.zeros(0, np.int64)
    ends = np.append(starts, len(leaf))
    data = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((ends * values.shape[1] * 8).astype(np.int32)), pa.py_buffer(values)])
    return pa.RecordBatch.from_arrays([pa.array(leaf[starts] + _key(tree, 0), pa.int64()), data, pa.array(np.diff(ends), pa.int64())], ["key", "rows", "n"])


def _unpacked_rows(table: pa.Table, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("rows").to_pylist()), dtype=np.float64).reshape(-1, width)


def grow(rows: DataFrame, shape: Shape, limits: Limits, trees: int = 1, bootstrap: bool = False, mtry: int | None = None,
         cp: float | None = None, seed: int = 42, local_rows: int = LOCAL_ROWS) -> Forest:
    """Trees over ``x`` (array of numbers; a factor as the number of its level, -1: none of them) and ``y``."""
    shift = 0.0 if shape.classes else rows.agg(F.avg("y")).first()[0] or 0.0
    rows = cut_lineage(rows.select(F.monotonically_increasing_id().alias("i"), "x", (F.col("y").cast("double") - shift).alias("y")))
    p = len(shape.levels)
    mtry = min(mtry or p, p)
    totals = _root_moments(rows, shape, trees, bootstrap, seed)
    tops, depths = _grow_tops(rows, [Tree.of_root(m, shape) for m in totals], shape, limits, bootstrap, mtry, seed, local_rows)
    price = None if cp is None else cp * float(risks(totals[:1], shape)[0])
    branches = cut_lineage(_branches(rows, tops, depths, shape, limits, bootstrap, mtry, seed, price))
    if cp is not None:  # what pruning leaves is small
        tops = [tops[t].with_branches({r["key"] & 0xFFFFFFFF: Tree.unpacked(r["blob"]) for r in branches.where(F.col("key").between(
            _key(t, 0), _key(t + 1, 0) - 1)).collect()}).pruned(price, shape) for t in range(trees)]
        return Forest(shape, tops, gains=sum(_gains(t, p) for t in tops), shift=shift)
    summed = branches.agg(F.coalesce(F.sum(F.length("blob")), F.lit(0)).alias("n"),
                          *[F.coalesce(F.sum(F.col("gains")[f]), F.lit(0.0)).alias(f"g{f}") for f in range(p)]).first()
    gains = sum(_gains(t, p) for t in tops) + np.array([summed[f"g{f}"] for f in range(p)])
    return Forest(shape, tops, branches.select("key", "blob"), int(summed["n"]), gains, shift)


def _gains(tree: Tree, p: int) -> np.ndarray:
    inner = tree.feature >= 0
    return np.bincount(tree.feature[inner], tree.gain[inner], minlength=p)


def _root_moments(rows: DataFrame, shape: Shape, trees: int, bootstrap: bool, seed: int) -> np.ndarray:
    """The moments of all rows that each tree draws."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((trees, shape.width))
        for row, _, y in _slices(batches):
            moments = shape.moments(y, np.ones(len(y)))
            for t in range(trees):
                total[t] += _weights(bootstrap, row, t, seed) @ moments
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["v"])

    out = np.zeros(trees * shape.width)
    for r in (rows.mapInArrow(add, "v array<double>").select(F.posexplode("v").alias("at", "v")).groupBy("at")
              .agg(F.sum("v").alias("v")).collect()):
        out[r["at"]] = r["v"]
    return out.reshape(trees, shape.width)


# ---- prediction -----------------------------------------------------------------------------------

def _answers(tree: Tree, shape: Shape, vote: bool) -> np.ndarray:
    """A row for each node."""
    values = value_of(tree.stats, shape)
    if vote:  # a tree of a forest has one vote
        values = np.eye(shape.classes)[values.argmax(axis=1)]
    return values


def predict(rows: DataFrame, forest: Forest, vote: bool = False) -> DataFrame:
    """``rows`` (with ``x``) and ``answer``: mean, or share of each class; over several trees their mean (or votes)."""
    here = forest.branches is None or forest.branch_bytes <= BROADCAST_BYTES
    out = _predict_here(rows, forest, vote) if here else _predict_by_key(rows, forest, vote)
    return out if forest.shape.classes else out.withColumn("answer", F.array(F.col("answer")[0] + forest.shift))


def _predict_here(rows: DataFrame, forest: Forest, vote: bool) -> DataFrame:
    found: dict[int, dict[int, bytes]] = {}
    for r in forest.branches.collect() if forest.branches is not None else []:
        found.setdefault(r["key"] >> 32, {})[r["key"] & 0xFFFFFFFF] = bytes(r["blob"])
    sent = rows.sparkSession.sparkContext.broadcast(found)
    shape, tops = forest.shape, forest.tops

    @F.arrow_udf("array<double>")
    def answer(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trees = [top.with_branches({k: Tree.unpacked(b) for k, b in sent.value.get(t, {}).items()}) for t, top in enumerate(tops)]
        answers = [_answers(tree, shape, vote) for tree in trees]
        for lists in batches:
            x = np.asarray(lists.flatten()).reshape(len(lists), len(shape.levels))
            total = np.zeros((len(x), max(shape.classes, 1)))
            for tree, values in zip(trees, answers, strict=True):
                total += values[tree.leaf_of(x)]
            ends = np.arange(0, total.size + 1, total.shape[1], dtype=np.int32)
            yield pa.ListArray.from_arrays(ends, (total / len(trees)).ravel())

    return rows.withColumn("answer", answer("x"))


def _predict_by_key(rows: DataFrame, forest: Forest, vote: bool) -> DataFrame:
    shape, tops, p = forest.shape, forest.tops, len(forest.shape.levels)
    asked = cut_lineage(rows.withColumn("i", F.monotonically_increasing_id()))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, x, _ in _slices(batches):
            named = np.column_stack([row.view(np.float64), x])  # the bits of the number, not its value
            for t, top in enumerate(tops):
                yield _by_leaf(t, top.leaf_of(x), named)

    dealt = cut_lineage(asked.select("i", "x", F.lit(0.0).alias("y")).mapInArrow(deal, "key long, rows binary, n long"))
    blocks = dealt.groupBy("key").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    # a leaf that was not grown on has its answer in the top; the subtrees are large, so they are never sent to all
    grown = blocks.join(forest.branches.hint("merge"), "key", "left").select(
        "key", "blob", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dealt = join_on_hot_key(dealt, blocks, "key").withColumn("block", F.pmod(F.xxhash64("rows"), F.col("blocks")).cast("int")).drop("blocks", "n")
    # rows and subtree are sent as one table: whatever the plan, they meet in one group
    none = F.lit(None).cast("binary")
    together = dealt.select("key", "block", "rows", none.alias("blob"), F.lit(False).alias("top")).unionByName(
        grown.select("key", "block", none.alias("rows"), "blob", F.col("blob").isNull().alias("top")))
    k = max(shape.classes, 1)
    names = [f"v{j}" for j in range(k)]

    def meet(group: pa.Table) -> pa.Table:
        asked_by = group.filter(group.column("rows").is_valid())
        got = _unpacked_rows(asked_by, p + 1)
        values = np.zeros((0, k))
        if len(got):
            key = group.column("key")[0].as_py()
            blobs = group.column("blob").drop_null().to_pylist()
            if blobs:
                tree = Tree.unpacked(blobs[0])
                values = _answers(tree, shape, vote)[tree.leaf_of(got[:, 1:])]
            elif any(group.column("top").to_pylist()):
                values = np.repeat(_answers(tops[key >> 32], shape, vote)[[key & 0xFFFFFFFF]], len(got), axis=0)
            else:
                raise ValueError(f"rows of leaf {key} came without its subtree")
        return pa.table([np.ascontiguousarray(got[:, 0]).view(np.int64), *np.ascontiguousarray(values.T)], names=["i", *names])

    each = together.groupBy("key", "block").applyInArrow(meet, "i long, " + ", ".join(f"{v} double" for v in names))
    mean = each.groupBy("i").agg(F.array(*[F.sum(v) / len(tops) for v in names]).alias("answer"))
    return asked.join(mean.hint("merge"), "i").drop("i")


# ---- storing ----------------------------------------------------------------------------------------

def save(forest: Forest, path: str, spark: SparkSession) -> None:
    """Tops and branches as two tables."""
    tops = [(t, bytearray(top.packed()), list(forest.shape.levels), forest.shape.classes, forest.branch_bytes, forest.gains.tolist(), forest.shift)
            for t, top in enumerate(forest.tops)]
    spark.createDataFrame(tops, "tree int, blob binary, levels array<int>, classes int, bytes long, gains array<double>, shift double") \
        .write.mode("overwrite").parquet(f"{path}/tops")
    branches = forest.branches if forest.branches is not None else spark.createDataFrame([], "key long, blob binary")
    branches.write.mode("overwrite").parquet(f"{path}/branches")


def load(path: str, spark: SparkSession) -> Forest:
    rows = spark.read.parquet(f"{path}/tops").orderBy("tree").collect()
    shape = Shape(tuple(rows[0]["levels"]), rows[0]["classes"])
    return Forest(shape, [Tree.unpacked(bytes(r["blob"])) for r in rows], spark.read.parquet(f"{path}/branches"), rows[0]["bytes"],
                  np.array(rows[0]["gains"]), rows[0]["shift"])
