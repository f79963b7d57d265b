"""Centroid clustering with centroids filtered by n-simplex projection.

Vectors become integers, and their squared distances to a few pivots are computed
once, exactly, and kept.  The pivots are the corners of a base simplex; a
vector's distances to them fix its apex over that base: its coordinates within the
base's hull, and its height above it.  For two vectors the distance of their
apexes is a lower bound of their distance, and the distance to the apex mirrored below
the base is an upper bound.  In each round the centroids get apexes too; a centroid whose
lower bound exceeds the least upper bound of a vector cannot be nearest, and the
others are compared by exact integer arithmetic.  Bounds are floating point and are
widened by :data:`SLACK` of the distances they come from, far above their error.

A round is one pass: each task adds its vectors up by cluster and hands on a
row per cluster.  Only these sums (``k`` rows after the shuffle) reach the driver, so a
vector that a third of all rows hold costs what others cost.

Vectors that are null, have another number of components, or hold a null or
non-finite one take no part.  Integers beyond ``2 ** 27`` are set to it, so that squared
distances fit a long.  A null id is hashed as the empty text; repeated rows are
vectors of their own; equal hashes are ordered by the vector.  With
fewer vectors than ``k`` there are as many clusters as vectors.  An empty table gives no rows.  A sum of
distances beyond a long is null.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tables import quoted

#: Corners of the base simplex, at most.
PIVOTS = 16
#: A pivot's height over the earlier ones, at least, as a part of the largest height.
LEAST_HEIGHT = 0.1
#: Part of the squared distances by which bounds are widened.
SLACK = 1e-6
#: Vectors that are compared at once.
SLICE = 1_024
#: Largest absolute component.
LARGEST = 1 << 27


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` and ``y`` (int64)."""
    return (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)


@dataclass
class Simplex:
    """``pivots`` (a row each) and ``base``: the lower triangle of their coordinates, the first at 0."""

    pivots: np.ndarray
    base: np.ndarray

    def apexes(self, squared: np.ndarray) -> np.ndarray:
        """Apexes from squared distances to the pivots: coordinates in the base's hull, then the height."""
        first = squared[:, :1].astype(float)
        if len(self.base) == 0:
            return np.sqrt(first)
        # for a corner b and a vector v, 2 b.v = |v|^2 + |b|^2 - |v - b|^2
        products = (first + (self.base**2).sum(1) - squared[:, 1:]) / 2
        inside = np.linalg.solve(self.base, products.T).T
        height = np.sqrt(np.maximum(first - (inside**2).sum(1, keepdims=True), 0))
        return np.hstack([inside, height])


def build_simplex(candidates: np.ndarray, pivots: int = PIVOTS) -> Simplex:
    """Pivots among ``candidates``: the first, then ever the one highest above the hull of those chosen."""
    moved = (candidates - candidates[0]).astype(float)
    chosen, rows = [0], []
    heights = (moved**2).sum(1)  # squared, above the hull so far
    least = LEAST_HEIGHT**2 * heights.max()
    axes: list[np.ndarray] = []
    while len(chosen) < pivots:
        best = int(heights.argmax())
        if heights[best] <= max(least, 0.5):
            break
        axis = moved[best] - sum((moved[best] @ a) * a for a in axes)
        axes.append(axis / np.linalg.norm(axis))
        chosen.append(best)
        rows.append([moved[best] @ a for a in axes])
        heights = np.maximum(heights - (moved @ axes[-1]) ** 2, 0)
        heights[chosen] = 0
    base = np.zeros((len(rows), len(rows)))
    for i, row in enumerate(rows):
        base[i, :len(row)] = row
    return Simplex(candidates[chosen], base)


@dataclass
class Centroids:
    """Centroids, a row each, with their apexes."""

    vectors: np.ndarray
    apexes: np.ndarray

    def possible(self, apexes: np.ndarray) -> np.ndarray:
        """Which centroids (columns) may be nearest to which vectors (rows)."""
        ours = (self.apexes**2).sum(1)
        theirs = (apexes**2).sum(1)[:, None]
        slack = SLACK * (ours + theirs + 1)
        lower = ours + theirs - 2 * (apexes @ self.apexes.T)
        upper = lower + 4 * apexes[:, -1:] * self.apexes[:, -1]
        return lower - slack <= (upper + slack).min(1, keepdims=True)

    def nearest(self, vectors: np.ndarray, apexes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of and squared distance to the nearest centroid of each vector; ties: the smaller number."""
        rows, numbers = np.nonzero(self.possible(apexes))
        apart = vectors[rows] - self.vectors[numbers]
        squared = np.einsum("ij,ij->i", apart, apart)
        starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        least = np.minimum.reduceat(squared, starts)
        number = np.where(squared == least[rows], numbers, len(self.vectors))
        return np.minimum.reduceat(number, starts), least


def placed(simplex: Simplex, vectors: np.ndarray) -> Centroids:
    return Centroids(vectors, simplex.apexes(squared_distances(vectors, simplex.pivots)))


def _matrix(lists: pa.Array, rows: int, dtype: type) -> np.ndarray:
    return np.asarray(lists.flatten()).astype(dtype).reshape(rows, -1)


def integer_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = 64,
                    factor: int = 256) -> DataFrame:
    """``vec_id``, ``v`` (array of int): ``floor(factor * x)`` of the vectors that take part."""
    scaled = F.transform(quoted(vector), lambda x: F.lit(float(factor)) * x.cast("double"))
    whole = (F.size(quoted(vector)) == size) & F.forall(
        "x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    limit = F.lit(float(LARGEST))
    return (rows.select(quoted(key).cast("long").alias("vec_id"), scaled.alias("x"), whole.alias("whole")).where("whole")
            .select("vec_id", F.transform("x", lambda x: F.floor(F.greatest(F.least(x, limit), -limit)).cast("int")).alias("v")))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors whose ids hash lowest."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    ordered = vectors.select(F.sha2(text.cast("binary"), 256).alias("h"), "v").orderBy("h", "v").limit(k)
    return [r["v"] for r in ordered.collect()]


def with_apexes(vectors: DataFrame, simplex: Simplex) -> DataFrame:
    """``vec_id``, ``v``, ``apex``: the distances to the pivots, turned into apexes and kept."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = simplex.apexes(squared_distances(_matrix(batch.column("v"), len(batch), np.int64), simplex.pivots))
            ends = np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, found.ravel())],
                                             ["vec_id", "v", "apex"])

    return vectors.mapInArrow(project, "vec_id long, v array<int>, apex array<double>")


def _assigned(batch: pa.RecordBatch, centroids: Centroids) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for at in range(0, len(batch), SLICE):
        part = batch.slice(at, SLICE)
        vectors = _matrix(part.column("v"), len(part), np.int64)
        yield part, vectors, *centroids.nearest(vectors, _matrix(part.column("apex"), len(part), float))


def cluster_sums(points: DataFrame, centroids: Centroids) -> DataFrame:
    """``cluster, n, sums``: of each task's vectors, a row per cluster."""
    k, size = centroids.vectors.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, dtype=np.int64), np.zeros((k, size), dtype=np.int64)
        for batch in batches:
            for _, vectors, number, _ in _assigned(batch, centroids):
                n += np.bincount(number, minlength=k)
                np.add.at(sums, number, vectors)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))],
            ["cluster", "n", "sums"])

    return points.mapInArrow(add, "cluster int, n long, sums array<long>")


def next_centroids(points: DataFrame, centroids: Centroids) -> np.ndarray:
    """Exact ``floor(sum / count)`` of each cluster; an empty one keeps its centroid."""
    size = centroids.vectors.shape[1]
    summed = cluster_sums(points, centroids).groupBy("cluster").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(size)]).alias("sums"))
    out = centroids.vectors.copy()
    for r in summed.collect():
        out[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    return out


def assign(points: DataFrame, centroids: Centroids) -> DataFrame:
    """``vec_id, cluster, distance`` (squared)."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, number, least in _assigned(batch, centroids):
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(least)],
                                                 ["vec_id", "cluster", "distance"])

    return points.mapInArrow(nearest, "vec_id long, cluster int, distance long")


def _as_long(total: int) -> int | None:
    return total if total < 1 << 63 else None


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, key: str = "vec_id", vector: str = "embedding",
            size: int = 64, factor: int = 256, pivots: int = PIVOTS) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that takes part."""
    spark = rows.sparkSession
    vectors = integer_vectors(rows, key, vector, size, factor)
    first = first_centroids(vectors, k, seed)
    about = "of int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], f"vec_id long, cluster int, distance long, {about}").drop("of")
    start = np.array(first, dtype=np.int64)
    simplex = build_simplex(start, pivots)
    points = cut_lineage(with_apexes(vectors, simplex))
    now = placed(simplex, start)
    for _ in range(rounds):
        now = placed(simplex, next_centroids(points, now))
    assigned = cut_lineage(assign(points, now))
    apart = {r["cluster"]: int(r["d"]) for r in
             assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    total = _as_long(sum(apart.values()))
    facts = [(c, _as_long(d), total, hashlib.sha256(",".join(map(str, now.vectors[c].tolist())).encode()).hexdigest())
             for c, d in apart.items()]  # k rows at most
    return assigned.join(F.broadcast(spark.createDataFrame(facts, about)), F.col("cluster") == F.col("of")).drop("of")
