"""Approximate nearest neighbours: a forest of random-projection trees.

Trees split a bounded sample of the vectors (``FIT_ROWS``, first by a hash
of their id) at the median along the difference of two random members,
until leaves hold about ``LEAF`` rows of the whole table.  Every distinct
vector goes into one leaf of every tree.  A query walks all trees through
one priority queue, ordered by the smallest margin to a plane on the way,
until the leaves it has visited hold ``share`` times all vectors; the
candidates of these leaves are reranked by the exact cosine.

Equal vectors are searched once: each distinct vector keeps its smallest
``k + 1`` ids, which is all that any top ``k`` can need.  Leaves and the
queries at a leaf are dealt out in blocks of bounded size, so no leaf and no
vector that many rows share becomes one task.

Vectors that are null, empty, zero or hold null or non-finite components,
those whose length is not the commonest (ties: the smaller), and rows with
a null id take no part.  Rows that repeat an id and its vector count once.
Ties in score go to the smaller id.  A table without vectors gives no rows; fewer candidates than
``k`` give fewer rows.  Only the two columns named are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tables import quoted

#: Vectors that the trees are split on; trees; rows of the table that a leaf is meant to hold.
FIT_ROWS, TREES, LEAF = 20_000, 8, 256
#: Rows in the visited leaves of all trees, as a multiple of the number of distinct vectors.
SHARE = 1.1
#: Vectors of a leaf, and queries at a leaf, that one row holds at most (about).
BLOCK = 512
#: Queries whose best a task keeps before it hands them on.
HELD = 20_000


@dataclass
class Forest:
    """Trees as arrays: plane and threshold of a node, children (negative: leaf ``-child - 1``)."""

    planes: np.ndarray
    cuts: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: list[int]
    leaves: int

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree: (rows, trees)."""
        out = np.empty((len(x), len(self.roots)), dtype=np.int32)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root, dtype=np.int64)
            while (inner := np.flatnonzero(at >= 0)).size:
                node = at[inner]
                goes_right = np.einsum("ij,ij->i", x[inner], self.planes[node]) > self.cuts[node]
                at[inner] = np.where(goes_right, self.right[node], self.left[node])
            out[:, t] = -at - 1
        return out

    def visit(self, q: np.ndarray, sizes: np.ndarray, wanted: float) -> list[int]:
        """Leaves in the order of the shared queue until they hold ``wanted`` rows."""
        margins = (self.planes @ q - self.cuts).tolist()
        left, right = self.left, self.right
        queue = [(-np.inf, root) for root in self.roots]
        heapq.heapify(queue)
        out, held = [], 0
        while queue and held < wanted:
            worst, node = heapq.heappop(queue)
            if node < 0:
                out.append(-node - 1)
                held += int(sizes[-node - 1])
                continue
            m = margins[node]
            heapq.heappush(queue, (max(worst, -m), int(right[node])))
            heapq.heappush(queue, (max(worst, m), int(left[node])))
        return out


def fit_forest(sample: np.ndarray, n_rows: int, trees: int = TREES, leaf: int = LEAF, seed: int = 3) -> Forest:
    """Split unit vectors; a node is a leaf once its share of ``n_rows`` is at most ``leaf``."""
    rng = np.random.default_rng(seed)
    planes, cuts, left, right, roots, leaves = [], [], [], [], [], 0
    least = max(2.0, leaf * len(sample) / max(n_rows, 1))
    for _ in range(trees):
        # (rows of the node, its parent, on the parent's right)
        todo, root = [(np.arange(len(sample)), -1, False)], None
        while todo:
            rows, parent, on_right = todo.pop()
            plane = None
            if len(rows) > least:
                a, b = sample[rng.choice(rows, 2, replace=False)]
                plane = a - b
                if not np.any(plane):
                    plane = rng.normal(size=sample.shape[1])
                plane = plane / np.linalg.norm(plane)
                along = sample[rows] @ plane
                cut = float(np.median(along))
                if not (along > cut).any() or not (along <= cut).any():
                    plane = None
            if plane is None:
                leaves += 1
                me = -leaves
            else:
                me = len(planes)
                planes.append(plane)
                cuts.append(cut)
                left.append(0)
                right.append(0)
                todo += [(rows[along <= cut], me, False), (rows[along > cut], me, True)]
            if parent >= 0:
                (right if on_right else left)[parent] = me
            else:
                root = me
        roots.append(root)
    dim = sample.shape[1] if sample.ndim == 2 else 0
    return Forest(np.array(planes, dtype=np.float64).reshape(-1, dim), np.array(cuts), np.array(left, dtype=np.int64),
                  np.array(right, dtype=np.int64), roots, leaves)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """A list array of equal lengths as float64 rows."""
    flat = np.asarray(vectors.flatten(), dtype=np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    fine = F.forall(vector, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.coalesce(fine & (F.size(vector) > 0) & F.exists(vector, lambda v: v != 0), F.lit(False))


def valid_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id``, ``v`` (array<float> or array<double>) of the rows that take part."""
    rows = (df.select(quoted(key).cast("long").alias("id"), quoted(vector).alias("v"))
            .where(F.col("id").isNotNull() & usable(F.col("v"))))
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (most["n"] if most else 0))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """One row per distinct vector: ``vid`` (its smallest id), ``ids`` (its ``keep`` smallest), ``v``.

    The rank filter thins equal vectors before they are shuffled.
    """
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = rows.groupBy("v", "id").agg(F.lit(1).alias("one")).withColumn("rank", rank).where(F.col("rank") <= keep)
    return (few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
            .select(F.element_at("ids", 1).alias("vid"), "ids", "v"))


def _nearest(k: int):
    """Blocks of queries and of leaf vectors -> ``qid, vid, about``: the best ``k`` of each query, task by task.

    A task keeps the best of at most ``HELD`` queries; beyond that it hands
    on what it has, and a query may then be handed on more than once.
    """
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, dict[int, float]] = {}

        def trimmed(found: dict[int, float]) -> dict[int, float]:
            ranked = sorted(found.items(), key=lambda x: (-round(x[1], 12), x[0]))
            return dict(ranked[:k])

        def handed_on() -> pa.RecordBatch:
            rows = [(q, v, s) for q, found in best.items() for v, s in trimmed(found).items()]
            best.clear()
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                                               pa.array(columns[2], pa.float64())], ["qid", "vid", "about"])

        for batch in batches:
            asked, held = batch.column("asked"), batch.column("held")
            for i in range(batch.num_rows):
                q, x = asked[i].values, held[i].values
                scores = _unit(_matrix(q.field("v"))) @ _unit(_matrix(x.field("v"))).T
                qid, vid = q.field("id").to_pylist(), np.asarray(x.field("id"))
                for at, own in enumerate(scores):
                    if len(vid) > 4 * k:  # all that reach the k-th score, ties too
                        some = np.flatnonzero(own >= np.partition(own, -k)[-k] - 1e-12)
                    else:
                        some = np.arange(len(vid))
                    found = best.setdefault(qid[at], {})
                    found.update(zip(vid[some].tolist(), own[some].tolist(), strict=True))
                    if len(found) > 8 * k:
                        best[qid[at]] = trimmed(found)
                if len(best) > HELD:
                    yield handed_on()
        yield handed_on()

    return nearest


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision, components in order."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda s, t: s.cast("double") * t.cast("double")), F.lit(0.0),
                           lambda total, p: total + p)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def search(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding",
           trees: int = TREES, leaf: int = LEAF, share: float = SHARE) -> DataFrame:
    """The ``k`` nearest found for each query row: ``query_id, rank, vec_id, score``.

    ``is_query`` is a condition on the column ``id``.
    """
    rows = valid_vectors(df, key, vector)
    units = cut_lineage(distinct_vectors(rows, k + 1))
    n = units.count()
    sample = units.orderBy(F.xxhash64("vid"), "vid").limit(FIT_ROWS).select("v").toArrow().column("v").combine_chunks()
    forest = fit_forest(_unit(_matrix(sample)) if n else np.zeros((0, 1)), n, trees, leaf)
    sent = df.sparkSession.sparkContext.broadcast(forest)

    @F.arrow_udf("array<int>")
    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            at = sent.value.leaf_of(_unit(_matrix(vectors))) if len(vectors) else np.zeros((0, 1), np.int32)
            yield pa.array(list(at), pa.list_(pa.int32()))

    placed = cut_lineage(units.select("vid", "v", F.explode(place("v")).alias("leaf")))
    sizes = np.zeros(max(forest.leaves, 1), dtype=np.int64)
    for r in placed.groupBy("leaf").count().toLocalIterator():  # as many rows as the forest has leaves
        sizes[r["leaf"]] = r["count"]

    @F.arrow_udf("array<int>")
    def visits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            asked = _unit(_matrix(vectors)) if len(vectors) else []
            yield pa.array([sent.value.visit(q, sizes, share * n) for q in asked], pa.list_(pa.int32()))

    queries = rows.where(is_query).distinct()
    asked_for = queries.join(units.select("vid", F.col("v").alias("w")), F.col("v") == F.col("w")).select("id", "vid")
    asked_for = cut_lineage(asked_for)
    asking = units.join(asked_for.select("vid").distinct(), "vid", "left_semi")
    at_leaf = asking.select(F.col("vid"), "v", F.explode(visits("v")).alias("leaf"))

    def blocks(at: DataFrame, name: str, salts: int) -> DataFrame:
        return (at.groupBy("leaf", F.pmod(F.xxhash64("vid"), F.lit(salts)).alias("salt"))
                .agg(F.collect_list(F.struct(F.col("vid").alias("id"), "v")).alias(name)).drop("salt"))

    held = blocks(placed, "held", max(1, -(-int(sizes.max()) // BLOCK)))
    n_asking = asking.count()
    asked = blocks(at_leaf, "asked", max(1, -(-n_asking // BLOCK)))
    found = (asked.join(held, "leaf").select("asked", "held")
             .mapInArrow(_nearest(k + 1), "qid long, vid long, about double")
             .groupBy("qid", "vid").agg(F.max("about").alias("about")))
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("about", 12)), "vid"))
    few = found.withColumn("near", best).where(F.col("near") <= k + 1)
    right = units.select("vid", F.col("v").alias("right"), "ids")
    left = units.select(F.col("vid").alias("qid"), F.col("v").alias("left"))
    scored = (few.join(right, "vid").join(left, "qid")
              .select("qid", F.explode("ids").alias("vec_id"), cosine(F.col("left"), F.col("right")).alias("score")))
    top = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    kept = scored.withColumn("place", top).where(F.col("place") <= k + 1)
    answers = (asked_for.join(kept, asked_for["vid"] == kept["qid"])
               .where(F.col("vec_id") != F.col("id"))
               .select(F.col("id").alias("query_id"), "vec_id", "score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (answers.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
