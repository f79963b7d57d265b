"""Clustering.

* K2 k-means: first centres by Spark's ``KMeans`` (k-means|| or random init), several seeds; all starts
  (and all k of an elbow) iterate in the same passes, the lowest within-cluster sum of squares kept.
* K4 hierarchical: Spark k-means condenses the rows into at most
  ``micro`` weighted micro-clusters (BIRCH idea, Zhang et al. 1996); the
  chosen linkage runs on those centres on the driver (micro x micro) and
  every row takes its micro-cluster's label through a broadcast lookup.
* K3 k-medoids on Gower distance: CLARA (Kaufman & Rousseeuw 1990) --
  PAM on several seeded samples in parallel (one ``applyInPandas`` group
  per sample), every row assigned to the nearest medoid of the best
  sample by broadcast of the k medoids.
* K9/K10 silhouette: the squared-Euclidean form is exact from cluster
  aggregates (n, sum x, sum |x|^2) -- no pairs of rows are formed.
* K13 PCA: covariance from one moment pass, eigenvectors on the driver,
  scores as column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.roles import col, roles
from ..session import cut_lineage
from .cleaning import drop_incomplete
from .transform import apply_scale, fit_scale

#: Rows that a task of a pass over vectors reads at most.
ROWS_OF_TASK = 500_000
#: Move of a centre up to which it stays, rows of a block, and starts looked for side by side.
TOL, _SLICE, STARTS = 1e-6, 1_024, 4


def prepare(df: DataFrame, features: list[str], scale: str = "none") -> DataFrame:
    """K1: chosen features, complete rows, optional z-score / min-max of numeric ones."""
    bad = [f for f in features if f not in df.columns]
    if bad:
        raise ValueError("Columns not found: " + ", ".join(bad))
    out = drop_incomplete(df.select(*[col(c) for c in features]))
    num = roles(out)[0]
    if scale in ("zscore", "minmax") and num:
        out = apply_scale(out, fit_scale(out, num, scale))
    elif scale not in ("none", "zscore", "minmax"):
        raise ValueError(f"Unknown scaling: {scale}")
    return out


def _vec(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    safe = [f"__f{i}" for i in range(len(cols))]
    tmp = df.select(*[col(c) for c in (keep or [])], *[col(c).cast("double").alias(s) for c, s in zip(cols, safe)])
    return VectorAssembler(inputCols=safe, outputCol="features").transform(tmp).select(
        *[col(c) for c in (keep or [])], "features", *safe)


@dataclass
class KMeansFit:
    features: list
    centers: np.ndarray
    wss: float
    seed: int


def kmeans(df: DataFrame, features: list[str] | None = None, k: int = 3, max_iter: int = 100, n_starts: int = 5,
           init: str = "k-means||", seed: int = 42) -> KMeansFit:
    """K2: best of ``n_starts`` seeded runs (lowest WSS). Lloyd iterations;
    the reference's variant names all map to this."""
    feats = features or roles(df)[0]
    return _kmeans_of(df, feats, [k], max_iter, n_starts, init, seed)[k]


def _kmeans_of(df: DataFrame, feats: list[str], ks: list[int], max_iter: int, n_starts: int, init: str, seed: int) -> dict[int, KMeansFit]:
    """:func:`kmeans` of each of ``ks``: Spark's first centres of every start, then the iterations of all of them together, pass by pass."""
    if any(not 2 <= k <= 10 and k != 1 for k in ks):
        raise ValueError("k must be within 2..10")
    v = _vec(df, feats).persist(StorageLevel.MEMORY_AND_DISK)
    runs = [(k, seed + s) for k in ks for s in range(n_starts)]

    def start(run: tuple[int, int]) -> np.ndarray:
        model = KMeans(k=run[0], maxIter=0, initMode=init, seed=run[1], tol=TOL).fit(v)
        return np.array([c.tolist() for c in model.clusterCenters()])

    with ThreadPoolExecutor(STARTS) as pool:  # small independent jobs over the same vectors
        first = list(pool.map(start, runs))
    blocks = _blocks(v, len(feats))
    v.unpersist()
    best: dict[int, KMeansFit] = {}
    for (k, s), (centers, cost) in zip(runs, _lloyd(blocks, first, max_iter), strict=True):
        if k not in best or cost < best[k].wss:
            best[k] = KMeansFit(feats, centers, cost, s)
    return best


def _blocks(v: DataFrame, p: int) -> DataFrame:
    """``rows, n``: blocks of the rows of ``__f0, ...`` as bytes, over as many parts as there are cores, stored for the iterations."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(len(batch), p)
            parts = [x[at:at + _SLICE] for at in range(0, len(x), _SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in parts], pa.binary()), pa.array([len(b) for b in parts], pa.int64())],
                                             ["rows", "n"])

    packed = v.select(F.array(*[F.col(f"__f{i}") for i in range(p)]).alias("x")).mapInArrow(pack, "rows binary, n long")
    return cut_lineage(packed.repartition(max(v.rdd.getNumPartitions(), v.sparkSession.sparkContext.defaultParallelism)))


def _lloyd(blocks: DataFrame, first: list[np.ndarray], max_iter: int) -> list[tuple[np.ndarray, float]]:
    """Centres and cost of each run from its first centres: one pass a round for all runs that still move.

    As Spark's: a cluster without rows keeps its centre, a run ends when no centre moves by more than
    :data:`TOL`, and its cost is that of the last round, before its centres moved.
    """
    centers, costs, live = [c.copy() for c in first], [0.0] * len(first), list(range(len(first)))
    p = first[0].shape[1]
    for _ in range(max_iter):
        if not live:
            break
        now = [centers[r] for r in live]
        ends = np.cumsum([len(c) for c in now])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, spent = np.zeros((ends[-1], p + 1)), np.zeros(len(now))
            every = np.concatenate(now)
            turned, norm = -2 * every, (every * every).sum(axis=1)[:, None]
            for batch in batches:
                for block, size in zip(batch.column("rows"), batch.column("n").to_pylist(), strict=True):
                    x = np.frombuffer(block.as_buffer()).reshape(size, p)
                    columns = np.ascontiguousarray(x.T)
                    far = turned @ columns + norm  # less the rows' own squares
                    for r, (c, end) in enumerate(zip(now, ends, strict=True)):
                        label = far[end - len(c):end].argmin(axis=0)
                        total[end - len(c):end, p] += np.bincount(label, minlength=len(c))
                        for j in range(p):
                            total[end - len(c):end, j] += np.bincount(label, columns[j], len(c))
                            away = columns[j] - c[label, j]
                            spent[r] += away @ away
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([total.ravel(), spent]).tobytes()], pa.binary())], ["v"])

        parts = blocks.mapInArrow(add, "v binary").collect()
        found = sum((np.frombuffer(r["v"]) for r in parts), np.zeros(ends[-1] * (p + 1) + len(now)))
        total, spent = found[:-len(now)].reshape(-1, p + 1), found[-len(now):]
        moving = []
        for r, c, end, cost in zip(live, now, ends, spent, strict=True):
            sums = total[end - len(c):end]
            there = sums[:, p] > 0
            centers[r] = np.where(there[:, None], sums[:, :p] / np.maximum(sums[:, p:], 1), c)
            costs[r] = float(cost)
            if (((centers[r] - c) ** 2).sum(axis=1) > TOL * TOL).any():
                moving.append(r)
        live = moving
    return list(zip(centers, costs, strict=True))


def assign_nearest(df: DataFrame, features: list[str], centers: np.ndarray, out: str = "cluster") -> DataFrame:
    """Label = 1 + index of the nearest centre (squared Euclidean), first on ties.
    The k centres are literals: a size bounded by k."""
    dists = []
    for c in centers:
        d = None
        for f, v in zip(features, c):
            term = F.pow(col(f).cast("double") - F.lit(float(v)), 2)
            d = term if d is None else d + term
        dists.append(d)
    arr = F.array(*[F.struct(d.alias("d"), F.lit(i + 1).alias("i")) for i, d in enumerate(dists)])
    best = F.aggregate(arr, F.struct(F.lit(float("inf")).alias("d"), F.lit(0).alias("i")),
                       lambda acc, x: F.when(x["d"] < acc["d"], x).otherwise(acc))["i"]
    return df.withColumn(out, best)


def within_ss(df: DataFrame, features: list[str], cluster: str = "cluster", noise: int | None = None) -> DataFrame:
    """K8: per cluster sum over features of var_samp * (n - 1) (= sum of squared deviations)."""
    d = df if noise is None else df.where(col(cluster) != noise)
    aggs = [F.count(F.lit(1)).alias("n")]
    ss = None
    for f in features:
        x = col(f).cast("double")
        term = F.coalesce(F.var_samp(x) * (F.count(x) - 1), F.lit(0.0))
        ss = term if ss is None else ss + term
    return d.groupBy(col(cluster).alias("cluster")).agg(*aggs, ss.alias("wss"))


def total_wss(df: DataFrame, features: list[str], cluster: str = "cluster") -> float:
    return float(within_ss(df, features, cluster).agg(F.sum("wss")).collect()[0][0] or 0.0)


def elbow(df: DataFrame, features: list[str] | None = None, ks=range(1, 11), n_starts: int = 3,
          max_iter: int = 100, seed: int = 42) -> DataFrame:
    """WSS for k = 1..10 (k = 1 is the total sum of squares)."""
    feats = features or roles(df)[0]
    several = _kmeans_of(df, feats, [k for k in ks if k != 1], max_iter, n_starts, "k-means||", seed) if any(k != 1 for k in ks) else {}
    rows = []
    for k in ks:
        if k == 1:
            w = float(within_ss(df.withColumn("__c", F.lit(1)), feats, "__c").collect()[0]["wss"])
        else:
            w = several[k].wss
        rows.append((int(k), w))
    return df.sparkSession.createDataFrame(rows, "k int, wss double")


def euclidean(a_cols: list[str], b_cols: list[str]):
    """K6: Euclidean distance between two sets of columns of the same row."""
    s = None
    for a, b in zip(a_cols, b_cols):
        t = F.pow(col(a).cast("double") - col(b).cast("double"), 2)
        s = t if s is None else s + t
    return F.sqrt(s)


def gower_ranges(df: DataFrame, features: list[str]) -> dict:
    num = set(roles(df)[0])
    nf = [f for f in features if f in num]
    if not nf:
        return {}
    r = df.agg(*[(F.max(col(f)) - F.min(col(f))).alias(f"r{i}") for i, f in enumerate(nf)]).collect()[0]
    return {f: float(r[f"r{i}"] or 0.0) for i, f in enumerate(nf)}


def gower_to(df: DataFrame, features: list[str], point: dict, ranges: dict):
    """K7: Gower distance of each row to a given point: mean over variables of
    |x - y| / range (numeric) or x != y (categorical); zero-range numerics add 0."""
    parts = []
    for f in features:
        if f in ranges:
            rg = ranges[f]
            parts.append(F.abs(col(f).cast("double") - F.lit(float(point[f]))) / F.lit(rg) if rg > 0 else F.lit(0.0))
        else:
            parts.append((col(f).cast("string") != F.lit(str(point[f]))).cast("double"))
    s = parts[0]
    for p in parts[1:]:
        s = s + p
    return s / F.lit(float(len(parts)))


def silhouette(df: DataFrame, features: list[str], cluster: str = "cluster", noise: int | None = 0) -> DataFrame:
    """Per-row silhouette with squared Euclidean distance, exact from cluster sums.

    mean d(i, C) = |x_i|^2 - 2 x_i . mean_C + mean_C(|x|^2); own cluster
    scaled by n/(n-1) (the point itself contributes 0); singletons get 0.
    """
    d = df if noise is None else df.where(col(cluster) != noise)
    sq = None
    for f in features:
        t = F.pow(col(f).cast("double"), 2)
        sq = t if sq is None else sq + t
    agg = d.groupBy(col(cluster).alias("__c")).agg(
        F.count(F.lit(1)).alias("n"), (F.sum(sq) / F.count(F.lit(1))).alias("msq"),
        *[F.avg(col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(features)]).collect()
    if len(agg) < 2:
        raise ValueError("silhouette needs at least 2 clusters")
    terms = []
    for r in agg:
        dot = None
        for i, f in enumerate(features):
            t = col(f).cast("double") * F.lit(float(r[f"m{i}"]))
            dot = t if dot is None else dot + t
        md = sq - 2 * dot + F.lit(float(r["msq"]))
        terms.append((r["__c"], r["n"], md))
    own_n = F.create_map(*[x for c, n, _ in terms for x in (F.lit(c), F.lit(n))])
    a_expr = None
    b_expr = None
    for c, n, md in terms:
        is_own = col(cluster) == F.lit(c)
        a_part = F.when(is_own, md * F.lit(n / (n - 1) if n > 1 else 0.0))
        a_expr = a_part if a_expr is None else F.coalesce(a_expr, a_part)
        b_part = F.when(~is_own, md)
        b_expr = b_part if b_expr is None else F.least(b_expr, b_part)
    s = F.when(F.element_at(own_n, col(cluster)) <= 1, F.lit(0.0)).otherwise(
        F.when(F.greatest(a_expr, b_expr) == 0, F.lit(0.0))
        .otherwise(F.try_divide(b_expr - a_expr, F.greatest(a_expr, b_expr))))
    return d.withColumn("silhouette", s)


def mean_silhouette(df: DataFrame, features: list[str], cluster: str = "cluster", noise: int | None = 0) -> float:
    """K9: average of K10 (noise left out); needs >= 2 clusters."""
    return float(silhouette(df, features, cluster, noise).agg(F.avg("silhouette")).collect()[0][0])


def profiles(df: DataFrame, features: list[str] | None = None, cluster: str = "cluster",
             noise: int | None = 0) -> DataFrame:
    """Mean per feature and cluster, long form (cluster, feature, mean); noise left out."""
    feats = features or [c for c in roles(df)[0] if c != cluster]
    d = df if noise is None else df.where(col(cluster) != noise)
    structs = [F.struct(F.lit(f).alias("feature"), F.avg(col(f).cast("double")).alias("mean")) for f in feats]
    return (d.groupBy(col(cluster).alias("cluster")).agg(F.array(*structs).alias("a"))
            .select("cluster", F.inline("a")))


def cluster_counts(df: DataFrame, cluster: str = "cluster", noise: int = 0) -> DataFrame:
    """Number of clusters (noise excluded) and noise points."""
    return df.agg(F.count_distinct(F.when(col(cluster) != noise, col(cluster))).alias("n_clusters"),
                  F.count_if(col(cluster) == noise).alias("n_noise"))


# ---- PCA ----------------------------------------------------------------------

@dataclass
class PCAFit:
    features: list
    means: np.ndarray
    loadings: np.ndarray      # p x k
    variances: np.ndarray


def pca(df: DataFrame, features: list[str] | None = None, k: int = 2) -> PCAFit:
    """Centred, unscaled principal components; each loading vector's
    largest-magnitude entry is made positive."""
    from .linear import _moments
    feats = features or roles(df)[0]
    if len(feats) < 2:
        raise ValueError("PCA needs at least 2 numeric columns")
    data = drop_incomplete(df.select(*[col(f).cast("double").alias(f) for f in feats]))
    n, means, G = _moments(data, feats)
    cov = G / (n - 1)
    w, v = np.linalg.eigh(cov)
    order = np.argsort(w)[::-1][:k]
    L = v[:, order]
    for j in range(L.shape[1]):
        if L[np.argmax(np.abs(L[:, j])), j] < 0:
            L[:, j] = -L[:, j]
    return PCAFit(feats, means, L, w[order])


def pca_scores(df: DataFrame, fit: PCAFit, keep: list[str] | None = None) -> DataFrame:
    cols = []
    for j in range(fit.loadings.shape[1]):
        s = None
        for i, f in enumerate(fit.features):
            t = (col(f).cast("double") - F.lit(float(fit.means[i]))) * F.lit(float(fit.loadings[i, j]))
            s = t if s is None else s + t
        cols.append(s.alias(f"PC{j + 1}"))
    return df.select(*[col(c) for c in (keep or [])], *cols)


# ---- hierarchical on micro-clusters -------------------------------------------

@dataclass
class HierFit:
    features: list
    micro_centers: np.ndarray
    micro_weights: np.ndarray
    micro_labels: np.ndarray      # final cluster (1..k) of each micro-cluster
    heights: list = field(default_factory=list)


def _linkage(X: np.ndarray, w: np.ndarray, method: str):
    """Agglomerative clustering of weighted points (Lance-Williams updates).
    Returns the merge list [(a, b, height)] over cluster ids (n + step for merges)."""
    n = len(X)
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    if method == "ward.D2":
        # Ward distance between weighted groups; equals the point distance for singletons
        D = np.sqrt(2.0 * np.outer(w, w) / (w[:, None] + w[None, :])) * D
    elif method == "centroid":
        D = D ** 2
    size = w.astype(float).copy()
    active = list(range(n))
    ids = list(range(n))
    cent = X.astype(float).copy()
    merges = []
    Dm = D.copy()
    np.fill_diagonal(Dm, np.inf)
    for step in range(n - 1):
        sub = Dm[np.ix_(active, active)]
        i, j = np.unravel_index(np.argmin(sub), sub.shape)
        a, b = active[i], active[j]
        if a > b:
            a, b = b, a
        h = Dm[a, b]
        na, nb = size[a], size[b]
        for c in active:
            if c in (a, b):
                continue
            dac, dbc, dab = Dm[a, c], Dm[b, c], Dm[a, b]
            nc = size[c]
            if method == "single":
                nd = min(dac, dbc)
            elif method == "complete":
                nd = max(dac, dbc)
            elif method == "average":
                nd = (na * dac + nb * dbc) / (na + nb)
            elif method == "ward.D2":
                nd = math.sqrt(((na + nc) * dac ** 2 + (nb + nc) * dbc ** 2 - nc * dab ** 2) / (na + nb + nc))
            elif method == "centroid":
                nd = (na * dac + nb * dbc) / (na + nb) - na * nb * dab / (na + nb) ** 2
            else:
                raise ValueError(f"Unknown linkage: {method}")
            Dm[a, c] = Dm[c, a] = nd
        cent[a] = (na * cent[a] + nb * cent[b]) / (na + nb)
        size[a] = na + nb
        active.remove(b)
        Dm[b, :] = np.inf
        Dm[:, b] = np.inf
        merges.append((ids[a], ids[b], float(math.sqrt(h) if method == "centroid" else h)))
        ids[a] = n + step
    return merges


def _cut(n: int, merges, k: int) -> np.ndarray:
    parent = list(range(n + len(merges)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for step, (a, b, _) in enumerate(merges[:n - k]):
        new = n + step
        parent[find(a)] = new
        parent[find(b)] = new
    roots = [find(i) for i in range(n)]
    order = {}
    for r in roots:               # number clusters by first appearance, as cutree does
        order.setdefault(r, len(order) + 1)
    return np.array([order[r] for r in roots])


def hierarchical(df: DataFrame, features: list[str] | None = None, k: int = 3, method: str = "ward.D2",
                 micro: int = 200, seed: int = 42) -> HierFit:
    """K4 + K12: linkage over at most ``micro`` k-means micro-clusters."""
    feats = features or roles(df)[0]
    n_rows = df.count()
    m = min(micro, n_rows)
    v = _vec(df, feats)
    tasks = math.ceil(n_rows / ROWS_OF_TASK)
    if v.rdd.getNumPartitions() < tasks:
        v = v.repartition(tasks)
    km = KMeans(k=m, maxIter=20, seed=seed, initMode="k-means||").fit(v)
    centers = np.array([c.tolist() for c in km.clusterCenters()])
    sizes = km.summary.clusterSizes
    keep = [i for i, s in enumerate(sizes) if s > 0]
    centers, weights = centers[keep], np.array([sizes[i] for i in keep], float)
    merges = _linkage(centers, weights, method)
    labels = _cut(len(centers), merges, k)
    return HierFit(feats, centers, weights, labels, [h for _, _, h in merges])


def hierarchical_labels(df: DataFrame, fit: HierFit, out: str = "cluster") -> DataFrame:
    """Each row: nearest micro-cluster, then that micro-cluster's label (k-size literal map)."""
    tmp = assign_nearest(df, fit.features, fit.micro_centers, "__m")
    mp = F.create_map(*[x for i, lab in enumerate(fit.micro_labels) for x in (F.lit(i + 1), F.lit(int(lab)))])
    return tmp.withColumn(out, F.element_at(mp, F.col("__m"))).drop("__m")


def merge_heights(fit: HierFit, last: int = 20) -> list[tuple[int, float]]:
    """The last ``last`` merge heights with their index."""
    h = fit.heights
    start = max(0, len(h) - last)
    return [(i + 1, h[i]) for i in range(start, len(h))]


# ---- CLARA (k-medoids on Gower) -----------------------------------------------

def _gower_matrix(A: pd.DataFrame, B: pd.DataFrame, num: list[str], cat: list[str], ranges: dict) -> np.ndarray:
    parts = []
    for f in num:
        rg = ranges.get(f, 0.0)
        a = A[f].to_numpy(float)[:, None]
        b = B[f].to_numpy(float)[None, :]
        parts.append(np.abs(a - b) / rg if rg > 0 else np.zeros((len(A), len(B))))
    for f in cat:
        parts.append((A[f].to_numpy()[:, None] != B[f].to_numpy()[None, :]).astype(float))
    return sum(parts) / len(parts)


def _pam(D: np.ndarray, k: int, max_iter: int = 100, weights: np.ndarray | None = None) -> list[int]:
    """PAM: greedy BUILD then SWAP until no improving swap (or max_iter); point i counts ``weights[i]`` times."""
    n = len(D)
    if weights is not None:
        D = D * weights[:, None]  # rows are points, columns are candidates
    med = [int(np.argmin(D.sum(axis=0)))]
    while len(med) < k:
        cur = D[:, med].min(axis=1)
        gains = [(np.maximum(cur - D[:, j], 0).sum(), j) for j in range(n) if j not in med]
        med.append(max(gains)[1])
    cost = D[:, med].min(axis=1).sum()
    for _ in range(max_iter):
        improved = False
        for mi in range(k):
            for j in range(n):
                if j in med:
                    continue
                trial = med[:mi] + [j] + med[mi + 1:]
                c = D[:, trial].min(axis=1).sum()
                if c < cost - 1e-12:
                    med, cost, improved = trial, c, True
        if not improved:
            break
    return med


@dataclass
class MedoidFit:
    features: list
    medoids: pd.DataFrame
    ranges: dict
    objective: float
    better_swaps: int | None = None    # exchanges with a candidate that would lower the objective


def clara(df: DataFrame, features: list[str], k: int = 3, samples: int = 5, sample_size: int | None = None,
          max_iter: int = 100, seed: int = 42) -> MedoidFit:
    """K3: k-medoids on Gower distance by CLARA; ``max_iter`` is honoured."""
    ranges = gower_ranges(df, features)
    num = [f for f in features if f in ranges]
    cat = [f for f in features if f not in ranges]
    size = sample_size or (40 + 2 * k)
    # distinct rows with their counts c; each sample is of rows of the table: every row has an
    # exponential key from a seeded hash, and those with the smallest keys are taken.  The keys of
    # c equal rows come in ascending order as sums of -log(u) / c, -log(u) / (c - 1), ...
    names = [col(f) for f in features]
    data = df.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    parts = []
    for s in range(samples):
        def gap(j, s=s):
            h = F.xxhash64(*names, F.lit(seed + s), j)
            u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
            return -F.log(u) / (F.col("__n") - j + 1)

        copies = F.sequence(F.lit(1).cast("long"), F.least(F.col("__n"), F.lit(size).cast("long")))
        keys = F.aggregate(copies, F.array().cast("array<double>"), lambda acc, j: F.concat(
            acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + gap(j))))
        keyed = data.select(*names, keys.alias("__keys"))
        drawn = (keyed.select(*names, F.explode("__keys").alias("__h"), F.lit(1).alias("__w"))
                 .orderBy("__h", *names).limit(size))
        # the first k different rows are always there, so that k medoids are found
        first = (keyed.select(*names, F.col("__keys")[0].alias("__h"), F.lit(0).alias("__w"))
                 .orderBy("__h", *names).limit(k))
        parts.append(drawn.unionByName(first).groupBy(*names)
                     .agg(F.greatest(F.sum("__w"), F.lit(1)).alias("__w"), F.min("__h").alias("__h"))
                     .withColumn("__s", F.lit(s)))
    smp = parts[0]
    for p in parts[1:]:
        smp = smp.unionByName(p)
    schema = smp.drop("__w", "__h").schema

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__h")
        D = _gower_matrix(pdf, pdf, num, cat, ranges)
        med = _pam(D, min(k, len(pdf)), max_iter, pdf["__w"].to_numpy(float))
        return pdf.iloc[med].drop(columns=["__w", "__h"])
    cands = smp.groupBy("__s").applyInPandas(search, schema).collect()
    best = None
    by_s: dict = {}
    for r in cands:
        by_s.setdefault(r["__s"], []).append(r.asDict())
    for s, rows in by_s.items():
        meds = pd.DataFrame(rows)
        cost = _medoid_cost(df, features, meds, ranges)
        if best is None or cost < best.objective:
            best = MedoidFit(features, meds.drop(columns=["__s"]), ranges, cost)
    return best


def _medoid_dist_exprs(features, medoids: pd.DataFrame, ranges):
    return [gower_to(None, features, medoids.iloc[i].to_dict(), ranges) for i in range(len(medoids))]


def medoid_labels(df: DataFrame, fit: MedoidFit, out: str = "cluster") -> DataFrame:
    ds = _medoid_dist_exprs(fit.features, fit.medoids, fit.ranges)
    arr = F.array(*[F.struct(d.alias("d"), F.lit(i + 1).alias("i")) for i, d in enumerate(ds)])
    best = F.aggregate(arr, F.struct(F.lit(float("inf")).alias("d"), F.lit(0).alias("i")),
                       lambda acc, x: F.when(x["d"] < acc["d"], x).otherwise(acc))
    return df.withColumn("__b", best).withColumn(out, F.col("__b")["i"]) \
             .withColumn("medoid_distance", F.col("__b")["d"]).drop("__b")


def _medoid_cost(df, features, medoids, ranges) -> float:
    ds = _medoid_dist_exprs(features, medoids, ranges)
    return float(df.agg(F.sum(F.least(*ds) if len(ds) > 1 else ds[0])).collect()[0][0])
