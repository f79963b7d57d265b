"""k nearest neighbours, exact and without comparing every row with every row.

Equal training points become one point that carries its count per class.  A k-d tree
over the points is grown level by level on Spark: a node with more than
:data:`LEAF_POINTS` points is cut at the quantiles of its widest side into up to
:data:`FAN` children, all nodes of a level in one aggregate.  Nodes have exact boxes.

A search has two rounds.  In the first, each (distinct) test point meets the points of its
own leaf, which bounds its k-th distance; so does the far corner of any box on its way that holds
``k`` rows.  In the second it descends from the root into all children whose box is within that bound, and
meets the points of the leaves it reaches.  Leaf and test points meet in blocks of bounded size.
What remains are the candidates within the bound, of which all at the k-th distance or nearer vote, as
in the reference; a draw goes to the smallest class.

Distances are sums of squares in the order of the features, on both sides of every comparison, so
that no rounding can hide a neighbour.  Rows with a missing or infinite feature are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hotjoin import broadcast_if_small, join_on_hot_key
from ..session import cut_lineage

#: Points above which a node is cut, children of a node, test points of a block.
LEAF_POINTS, FAN, BLOCK = 2_048, 16, 4_096
#: Test points that are compared at once.
_SLICE = 256
_CANDIDATES = "qid long, squared double, label int, n long, reach double"


@dataclass
class Tree:
    """``points`` (``node, x, labels, ns, weight``), ``levels`` of nodes from the root down, and the rows of each level."""

    points: DataFrame
    levels: list[DataFrame]
    sizes: list[int]
    dims: int


def finite(x: str) -> Column:
    return F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def weighted_points(rows: DataFrame) -> DataFrame:
    """Distinct points of ``x, label`` with ``labels, ns`` (rows of each class) and ``weight`` (rows)."""
    counted = rows.where(finite("x")).groupBy("x", "label").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("x").agg(F.sort_array(F.collect_list(F.struct("label", "n"))).alias("v"), F.sum("n").alias("weight")).select(
        "x", F.col("v.label").alias("labels"), F.col("v.n").alias("ns"), "weight")


def _child() -> Column:
    return F.col("node") * FAN + F.size(F.filter("cuts", lambda c: c < F.col("x")[F.col("dim")]))


def _nodes(points: DataFrame, dims: int, leaf_points: int) -> DataFrame:
    """A row per node: ``node, parent, weight, lo, hi, leaf, dim, cuts``.

    ``cuts`` are values of the widest side below its largest, so every child gets a point.
    """
    probs = [i / FAN for i in range(1, FAN)]
    x = [F.col("x")[j] for j in range(dims)]
    stats = points.groupBy("node").agg(
        F.count(F.lit(1)).alias("size"), F.sum("weight").alias("weight"), F.array(*[F.min(v) for v in x]).alias("lo"),
        F.array(*[F.max(v) for v in x]).alias("hi"), F.array(*[F.percentile_approx(v, probs, 1_000) for v in x]).alias("parts"))
    spread = F.zip_with("hi", "lo", lambda a, b: a - b)
    wide = stats.withColumn("dim", (F.array_position(spread, F.array_max(spread)) - 1).cast("int"))
    low, high, part = (F.col(c)[F.col("dim")] for c in ("lo", "hi", "parts"))
    cuts = F.array_distinct(F.filter(part, lambda c: c < high))
    return wide.select("node", F.floor(F.col("node") / FAN).cast("long").alias("parent"), "weight", "lo", "hi",
                       (F.col("size") <= leaf_points).alias("leaf"), "dim",
                       F.when(F.size(cuts) == 0, F.array(low)).otherwise(cuts).alias("cuts"))


def grow(points: DataFrame, dims: int, leaf_points: int = LEAF_POINTS) -> Tree:
    """The k-d tree of :func:`weighted_points`; a pass over the points of open nodes per level."""
    current = cut_lineage(points.withColumn("node", F.lit(1).cast("long")))
    levels, sizes, placed = [], [], []
    while True:
        nodes = cut_lineage(_nodes(current, dims, leaf_points))
        levels.append(nodes)
        sizes.append(nodes.count())
        if nodes.where("NOT leaf").isEmpty():
            placed.append(current)
            break
        cut = current.join(broadcast_if_small(nodes.select("node", "leaf", "dim", "cuts"), sizes[-1]), "node")
        placed.append(cut.where("leaf").select(current.columns))
        current = cut_lineage(cut.where("NOT leaf").withColumn("node", _child()).select(current.columns))
    out = placed[0]
    for part in placed[1:]:
        out = out.unionByName(part)
    return Tree(out, levels, sizes, dims)


def _near(dims: int) -> Column:
    """Squared distance of ``x`` to the box ``lo, hi``, summed in the order of the features."""
    total = F.lit(0.0)
    for j in range(dims):
        x, lo, hi = (F.col(c)[j] for c in ("x", "lo", "hi"))
        gap = F.when(x < lo, lo - x).when(x > hi, x - hi).otherwise(F.lit(0.0))
        total = total + gap * gap
    return total


def _far(dims: int) -> Column:
    """Squared distance of ``x`` to the far corner of the box."""
    total = F.lit(0.0)
    for j in range(dims):
        x, lo, hi = (F.col(c)[j] for c in ("x", "lo", "hi"))
        gap = F.greatest(F.abs(x - lo), F.abs(x - hi))
        total = total + gap * gap
    return total


def at_home(queries: DataFrame, tree: Tree, k: int) -> DataFrame:
    """``qid, x, node, reach``: the leaf of each test point, and the least squared far-corner distance on the way."""
    now = queries.select("qid", "x", F.lit(1).cast("long").alias("node"), F.lit(float("inf")).alias("reach"))
    for nodes, size in zip(tree.levels, tree.sizes, strict=True):
        met = now.join(broadcast_if_small(nodes.select("node", "weight", "lo", "hi", "leaf", "dim", "cuts"), size), "node", "left")
        reach = F.least("reach", F.when(F.col("weight") >= k, _far(tree.dims)).otherwise(F.lit(float("inf"))))
        now = met.select("qid", "x", F.when(~F.col("leaf"), _child()).otherwise(F.col("node")).alias("node"),
                         F.when(F.col("leaf").isNull(), F.col("reach")).otherwise(reach).alias("reach"))
    return now


def visits(homes: DataFrame, tree: Tree) -> DataFrame:
    """``qid, x, node, reach`` for every leaf, but the own one, whose box is within ``reach`` of a test point."""
    front = homes.select("qid", "x", "reach", F.col("node").alias("home"), F.lit(1).cast("long").alias("node"))
    out = None
    for nodes, size in zip(tree.levels[1:], tree.sizes[1:], strict=True):
        children = nodes.select(F.col("parent").alias("node"), F.col("node").alias("child"), "leaf", "lo", "hi")
        hit = cut_lineage(front.join(broadcast_if_small(children, size), "node").where(_near(tree.dims) <= F.col("reach"))
                          .select("qid", "x", "reach", "home", "leaf", F.col("child").alias("node")))
        found = hit.where(F.col("leaf") & (F.col("node") != F.col("home"))).select("qid", "x", "node", "reach")
        out = found if out is None else out.unionByName(found)
        front = hit.where("NOT leaf").drop("leaf")
    return homes.limit(0) if out is None else out


def _matrix(table: pa.Table, dims: int) -> np.ndarray:
    lists = table.column("x").combine_chunks()
    return np.asarray(lists.flatten()).astype(float).reshape(len(table), dims)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        apart = a[:, j:j + 1] - b[:, j]
        total += apart * apart
    return total


def meet(asked: DataFrame, tree: Tree, k: int) -> DataFrame:
    """Candidates (:data:`_CANDIDATES`) of ``asked`` (``qid, x, node, reach``) in the leaf ``node``.

    ``n`` rows of class ``label`` at ``squared``; ``reach`` is the k-th squared distance within the leaf, or infinite.
    """
    asked = cut_lineage(asked)
    blocks = asked.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = join_on_hot_key(asked, blocks, "node").withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks"))).drop("blocks")
    points = tree.points.join(blocks.select("node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")), "node")
    # names of their own: both sides may stem from one table
    dealt, points = dealt.toDF(*dealt.columns), points.toDF(*points.columns)
    dims = tree.dims
    schema = pa.schema([("qid", pa.int64()), ("squared", pa.float64()), ("label", pa.int32()), ("n", pa.int64()), ("reach", pa.float64())])

    def nearest(queries: pa.Table, near: pa.Table) -> pa.Table:
        if not len(queries) or not len(near):
            return schema.empty_table()
        asked_x, x = _matrix(queries, dims), _matrix(near, dims)
        ids = np.asarray(queries.column("qid"))
        limits = np.asarray(queries.column("reach"))
        weights = np.asarray(near.column("weight"))
        lists = near.column("labels").combine_chunks()
        labels, ns = np.asarray(lists.flatten()), np.asarray(near.column("ns").combine_chunks().flatten())
        sizes = np.asarray(lists.value_lengths())
        starts = np.concatenate([[0], np.cumsum(sizes)])
        out = []
        for at in range(0, len(ids), _SLICE):
            squared = _distances(asked_x[at:at + _SLICE], x)
            limit = limits[at:at + _SLICE]
            if len(x) > k:
                limit = np.minimum(limit, np.partition(squared, k - 1, axis=1)[:, k - 1])
            rows, points = np.nonzero(squared <= limit[:, None])
            order = np.lexsort((squared[rows, points], rows))
            rows, points = rows[order], points[order]
            apart = squared[rows, points]
            seen = np.cumsum(weights[points])
            first = np.searchsorted(rows, np.arange(len(squared)))  # where each test point's candidates begin
            before = np.concatenate([[0], seen])[first][rows]
            full = np.flatnonzero(seen - before >= k)
            reach = np.full(len(squared), np.inf)
            np.minimum.at(reach, rows[full], apart[full])
            keep = apart <= reach[rows]
            rows, points, apart = rows[keep], points[keep], apart[keep]
            many = sizes[points]
            votes = np.repeat(starts[points], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            out.append(pa.table([ids[at:at + _SLICE][np.repeat(rows, many)], np.repeat(apart, many), labels[votes].astype(np.int32),
                                 ns[votes], reach[np.repeat(rows, many)]], schema=schema))
        return pa.concat_tables(out)

    return dealt.groupBy("node", "block").cogroup(points.groupBy("node", "block")).applyInArrow(nearest, _CANDIDATES)


def votes(queries: DataFrame, tree: Tree, k: int) -> DataFrame:
    """``qid, label, n``: votes of each class among the rows at the k-th distance of ``qid, x`` or nearer."""
    homes = cut_lineage(at_home(queries, tree, k))
    near = cut_lineage(meet(homes, tree, k))
    reach = near.groupBy("qid").agg(F.min("reach").alias("own"))
    bound = cut_lineage(homes.join(reach, "qid").withColumn("reach", F.least("reach", "own")).drop("own"))
    every = near.drop("reach").unionByName(meet(visits(bound, tree), tree, k).drop("reach"))
    by_distance = every.groupBy("qid", "squared", "label").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("qid").orderBy("squared").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    here = Window.partitionBy("qid", "squared")
    nearer = by_distance.withColumn("before", F.sum("n").over(upto) - F.sum("n").over(here)).where(F.col("before") < k)
    return nearer.groupBy("qid", "label").agg(F.sum("n").alias("n"))


def classify(rows: DataFrame, tree: Tree, k: int) -> DataFrame:
    """``rows`` (with ``x``) and their ``label`` (most votes, then the smallest) and ``shares`` (class -> part of the votes)."""
    asked = cut_lineage(rows.where(finite("x")).select("x").distinct().withColumn("qid", F.monotonically_increasing_id()))
    counted = votes(asked, tree, k)
    best = counted.groupBy("qid").agg(F.min(F.struct(-F.col("n"), "label"))["label"].alias("label"), F.sum("n").alias("all"),
                                      F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("ns"))
    answers = best.join(asked, "qid").select("x", "label", F.transform_values("ns", lambda _, n: n / F.col("all")).alias("shares"))
    return join_on_hot_key(rows, cut_lineage(answers), "x")
