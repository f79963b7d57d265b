"""Regression and classification learners.

Every learner trains on the expression design matrix
(:mod:`quarry.operators.design`): Spark ML estimators where Spark has
one, closed forms as aggregates (OLS, naive Bayes), and trainers of
their own for penalised regression, trees and forests, networks, the SVM regression and neighbours.  Predictions are lazy transforms.  Classes are the sorted
levels of the target (C9); predictions map back to the same levels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.roles import col, roles
from ..session import cut_lineage
from . import boosting as BO
from . import gradient as GD
from . import knn as KNN
from . import linear as L
from . import network as NN
from . import penalised as PN
from . import trees as TR
from .cleaning import drop_incomplete
from .design import Design, apply_design, assemble, column_expr, fit_design

REGRESSORS = ("linear", "ridge", "lasso", "tree", "rf", "svm", "gbm", "nnet")
CLASSIFIERS = ("logistic", "tree", "rf", "svm", "knn", "nb", "gbm", "nnet")

DEFAULTS = {
    "ridge": {"lambda": 0.1}, "lasso": {"lambda": 0.1},
    "tree": {"depth": 5, "cp": 0.01},
    "rf": {"trees": 100, "mtry": 3},
    "svm": {"kernel": "radial", "cost": 1.0, "epsilon": 0.1},
    "knn": {"k": 5},
    "gbm": {"trees": 100, "depth": 3, "shrinkage": 0.1},
    "nnet": {"size": 5, "decay": 0.01, "iters": 200},
}


@dataclass
class Trained:
    algo: str
    task: str
    target: str
    features: list
    design: Design
    levels: list | None = None
    model: Any = None
    params: dict = field(default_factory=dict)
    extra: dict = field(default_factory=dict)

    def predict(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        return predict(self, df, keep)


def _formula(target: str, features: list[str], interactions=None) -> str:
    rhs = " + ".join(features)
    if interactions:
        rhs += " + " + " + ".join(f"{a}:{b}" for a, b in interactions)
    return f"{target} ~ {rhs}"


def _label_expr(target: str, levels: list[str]):
    arr = F.array(*[F.lit(v) for v in levels])
    return (F.array_position(arr, col(target).cast("string")) - 1).cast("double")


def train(df: DataFrame, target: str, features: list[str], algo: str, task: str | None = None,
          params: dict | None = None, interactions=None, seed: int = 42, max_levels: int = 1000) -> Trained:
    """Fit one learner on complete rows of ``target`` + ``features``."""
    from .runs import detect_task
    feats = [f for f in features if f != target]
    data = drop_incomplete(df.select(*[col(c) for c in [target] + feats]))
    task = task or detect_task(data, target)
    p = dict(DEFAULTS.get(algo, {}))
    p.update(params or {})
    if task == "classification":
        if algo not in CLASSIFIERS:
            raise ValueError(f"Unknown classifier: {algo}")
        levels = sorted(r[0] for r in data.select(col(target).cast("string")).distinct()
                        .limit(max_levels + 1).collect())
        if len(levels) > max_levels:
            raise ValueError("too many classes")
        data = data.withColumn("__label", _label_expr(target, levels))
        design = fit_design(data, _formula("__label", feats, interactions))
        t = Trained(algo, task, target, feats, design, levels, params=p)
        return _fit_classifier(t, data, seed)
    if algo not in REGRESSORS:
        raise ValueError(f"Unknown regressor: {algo}")
    design = fit_design(data, _formula(target, feats, interactions))
    t = Trained(algo, task, target, feats, design, params=p)
    return _fit_regressor(t, data, seed)


def _fit_regressor(t: Trained, data: DataFrame, seed: int) -> Trained:
    p, d = t.params, t.design
    if t.algo == "linear":
        t.model = L.fit_ols(data, "", design=d)
        return t
    if t.algo in ("svm", "nnet"):
        m = apply_design(data, d)
        if t.algo == "svm":
            t.model = GD.fit_svr(m, d.names, "__y", p["kernel"], p["cost"], p["epsilon"], seed=seed)
        else:
            t.model = NN.fit_network(m, d.names, "__y", p["size"], p["decay"], p.get("iters", 200), seed=seed)
        return t
    if t.algo in ("tree", "rf"):
        t.model = _grow(t, data.select(_tree_point(d).alias("x"), col(d.target).cast("double").alias("y")), 0, seed)
        return t
    if t.algo in ("ridge", "lasso"):
        t.model = PN.fit_path(data, d, [p["lambda"]], 0.0 if t.algo == "ridge" else 1.0)
        return t
    a = assemble(data, d).persist(StorageLevel.MEMORY_AND_DISK)
    if t.algo == "gbm":
        est = GBTRegressor(maxIter=p["trees"], maxDepth=p["depth"], stepSize=p["shrinkage"], seed=seed)
    else:
        raise ValueError(t.algo)
    t.model = est.fit(_for_many_passes(a))
    a.unpersist()
    return t


#: Rows of a task in a learner of hundreds of passes.
PASS_ROWS = 100_000


def _for_many_passes(rows: DataFrame) -> DataFrame:
    """Persisted ``rows`` in a part for each core, or more of :data:`PASS_ROWS` rows.

    A shuffle leaves parts that are small for a pass, and each pass starts a task for each of them.
    """
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PASS_ROWS)))


#: One-vs-rest classifiers trained at once.
CLASSES_AT_ONCE = 8


#: Rows of a node that is split and of each side, in a pruned tree; rows of a node that a forest splits, by task.
TREE_LIMITS, FOREST_SPLIT = {"min_split": 20, "min_bucket": 7}, {"regression": 6, "classification": 2}


def _tree_columns(d: Design) -> list[tuple[str, Column, int]]:
    """Name, number and count of levels (0: numeric) of what trees see: features as they are, and interaction columns."""
    out = []
    for v in d.variables():
        if v in d.levels:
            place = F.array_position(F.array(*[F.lit(x) for x in d.levels[v]]), col(v)) - 1
            out.append((v, place.cast("double"), len(d.levels[v])))
        else:
            out.append((v, col(v).cast("double"), 0))
    return out + [(name, column_expr(combo), 0) for name, _, combo in d.columns if len(combo) > 1]


def _tree_point(d: Design) -> Column:
    return F.array(*[value for _, value, _ in _tree_columns(d)])


def _grow(t: Trained, rows: DataFrame, classes: int, seed: int) -> TR.Forest:
    """A pruned tree, or a forest of full trees."""
    p = t.params
    shape = TR.Shape(tuple(levels for *_, levels in _tree_columns(t.design)), classes)
    local = p.get("local_rows", TR.LOCAL_ROWS)
    rows = rows.where(KNN.finite("x"))
    if t.algo == "tree":
        return TR.grow(rows, shape, TR.Limits(p["depth"], **TREE_LIMITS), cp=p["cp"], seed=seed, local_rows=local)
    limits = TR.Limits(p.get("max_depth"), p.get("min_split", FOREST_SPLIT[t.task]))
    return TR.grow(rows, shape, limits, p["trees"], p.get("bootstrap", True), p["mtry"], seed=seed, local_rows=local)


def _tree_predict(t: Trained, df: DataFrame, keep: list[str]) -> DataFrame:
    rows = df.select(F.struct(F.lit(1).alias("__one"), *[col(c) for c in keep]).alias("kept"), _tree_point(t.design).alias("x"))
    rows = rows.where(KNN.finite("x"))
    if t.algo == "gbm":
        found = BO.predict(rows, t.model)
    else:
        found = TR.predict(rows, t.model, vote=t.algo == "rf" and t.task == "classification")
    kept = [F.col("kept")[c].alias(c) for c in keep]
    if t.task == "regression":
        return found.select(*kept, F.col("answer")[0].alias("prediction"))
    best = F.array_position("answer", F.array_max("answer")).cast("int")
    sel = [*kept, F.element_at(F.array(*[F.lit(v) for v in t.levels]), best).alias("prediction")]
    if len(t.levels) == 2:
        sel.append(F.col("answer")[1].alias("score"))
    return found.select(*sel)


def _fit_classifier(t: Trained, data: DataFrame, seed: int) -> Trained:
    p, d = t.params, t.design
    k = len(t.levels)
    if t.algo == "nb":
        t.model = fit_naive_bayes(data, "__label", t.features, k)
        return t
    if t.algo == "knn":
        rows = data.select(_point(d).alias("x"), F.col("__label").cast("int").alias("label"))
        t.model = KnnModel(cut_lineage(KNN.weighted_points(rows)), len(d.names), p.get("leaf_points", KNN.LEAF_POINTS))
        return t
    if t.algo in ("tree", "rf"):
        t.model = _grow(t, data.select(_tree_point(d).alias("x"), F.col("__label").alias("y")), k, seed)
        return t
    if t.algo == "nnet":
        m = apply_design(data, d)
        t.model = NN.fit_network(m, d.names, "__y", p["size"], p["decay"], p.get("iters", 200), k, seed)
        return t
    if t.algo == "gbm":
        shape = TR.Shape(tuple(levels for *_, levels in _tree_columns(d)), k)
        rows = data.select(_tree_point(d).alias("x"), F.col("__label").alias("y")).where(KNN.finite("x"))
        t.model = BO.fit(rows, shape, p["trees"], p["depth"], p["shrinkage"], p.get("local_rows", BO.local_rows(shape)))
        return t
    a = assemble(data, d).persist(StorageLevel.MEMORY_AND_DISK)
    if t.algo == "logistic":
        est = LogisticRegression(regParam=0.0, family="multinomial" if k > 2 else "binomial", maxIter=100)
    elif t.algo == "svm":
        out = _fit_svm_classifier(t, a, seed)
        a.unpersist()
        return out
    else:
        raise ValueError(t.algo)
    t.model = est.fit(a)
    a.unpersist()
    return t


def _fit_svm_classifier(t: Trained, a: DataFrame, seed: int) -> Trained:
    """C4: kernel map (as R6) + LinearSVC (one-vs-rest above 2 classes, side by side);
    binary probabilities by a logistic fit on the margin (Platt).

    A pass over few rows is all start of tasks, so the mapped rows are in parts of :data:`PASS_ROWS`.
    """
    p = t.params
    x = a.select(vector_to_array("features").alias("x"), "label")
    dims = len(t.design.names)
    st = x.select(*[F.col("x")[i].alias(f"c{i}") for i in range(dims)])
    r = st.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"c{i}").alias(f"m{i}") for i in range(dims)],
               *[F.stddev_samp(f"c{i}").alias(f"s{i}") for i in range(dims)]).collect()[0]
    km = GD.make_kernel(p["kernel"], [r[f"m{i}"] for i in range(dims)], [r[f"s{i}"] or 1.0 for i in range(dims)],
                        dims, n_features=p.get("n_features", 100), seed=seed)
    mapped = _kernel_features(a.coalesce(max(-(-r["n"] // PASS_ROWS), 1)), km, dims).persist(StorageLevel.MEMORY_AND_DISK)
    svc = LinearSVC(regParam=1.0 / (p["cost"] * 100.0), maxIter=100)
    est = svc if len(t.levels) == 2 else OneVsRest(classifier=svc, parallelism=min(len(t.levels), CLASSES_AT_ONCE))
    model = est.fit(mapped)
    t.model = model
    t.extra["kernel"] = km
    t.extra["dims"] = dims
    if len(t.levels) == 2:
        margin = model.transform(mapped).select(vector_to_array("rawPrediction")[1].alias("m"), "label")
        from pyspark.ml.feature import VectorAssembler
        platt = LogisticRegression(regParam=0.0).fit(
            VectorAssembler(inputCols=["m"], outputCol="features").transform(margin))
        t.extra["platt"] = (float(platt.coefficients[0]), float(platt.intercept))
    mapped.unpersist()
    return t


def _point(d: Design) -> Column:
    """The design columns as one array."""
    return F.array(*[column_expr(combo) for _, _, combo in d.columns])


class KnnModel:
    """The weighted training points and the k-d tree over them."""

    def __init__(self, points: DataFrame, dims: int, leaf_points: int = KNN.LEAF_POINTS):
        self.points, self.dims, self.leaf_points = points, dims, leaf_points
        self.tree = KNN.grow(points, dims, leaf_points)


def _knn_predict(t: Trained, df: DataFrame, keep: list[str]) -> DataFrame:
    levels = F.array(*[F.lit(v) for v in t.levels])
    rows = df.select(F.struct(F.lit(1).alias("__one"), *[col(c) for c in keep]).alias("kept"), _point(t.design).alias("x"))
    found = KNN.classify(rows, t.model.tree, t.params["k"])
    sel = [F.col("kept")[c].alias(c) for c in keep] + [levels[F.col("label")].alias("prediction")]
    if len(t.levels) == 2:
        sel.append(F.coalesce(F.col("shares")[F.lit(1)], F.lit(0.0)).alias("score"))
    return found.select(*sel)


def _net_predict(t: Trained, df: DataFrame, keep: list[str]) -> DataFrame:
    """The class of the largest probability; complete rows only."""
    model, inputs = t.model, len(t.design.names)

    @F.arrow_udf("array<double>")
    def chances(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            out = model.predict(np.asarray(lists.flatten()).reshape(len(lists), inputs))
            yield pa.ListArray.from_arrays(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32), out.ravel())

    rows = df.select(F.struct(F.lit(1).alias("__one"), *[col(c) for c in keep]).alias("kept"), _point(t.design).alias("x"))
    found = rows.where(KNN.finite("x")).withColumn("chance", chances("x"))
    best = F.array_position("chance", F.array_max("chance")).cast("int")
    sel = [F.col("kept")[c].alias(c) for c in keep]
    sel.append(F.element_at(F.array(*[F.lit(v) for v in t.levels]), best).alias("prediction"))
    if len(t.levels) == 2:
        sel.append(F.col("chance")[1].alias("score"))
    return found.select(*sel)


def _kernel_features(a: DataFrame, km: GD.KernelMap, dims: int) -> DataFrame:
    """Apply the explicit kernel map to the feature vectors in Arrow batches
    (numpy, one pass); the result is a vector column again."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
    keep = [c for c in a.columns if c != "features"]
    tmp = a.select(*[col(c) for c in keep], vector_to_array("features").alias("__x"))
    schema = StructType([*tmp.schema.fields[:-1], StructField("__z", ArrayType(DoubleType()))])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.ascontiguousarray(km.transform(np.asarray(batch.column("__x").flatten()).reshape(len(batch), dims)))
            ends = np.arange(0, z.size + 1, z.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.ListArray.from_arrays(ends, z.ravel())], [*keep, "__z"])
    mapped = tmp.mapInArrow(part, schema)
    return mapped.select(*[col(c) for c in keep], array_to_vector("__z").alias("features"))


# ---- naive Bayes (closed form) ----------------------------------------------

@dataclass
class NaiveBayes:
    k: int
    prior: list
    gauss: dict          # feature -> [(mean, sd)] per class
    table: dict          # feature -> {class: {level: p}}
    threshold: float = 0.001


def fit_naive_bayes(data: DataFrame, label: str, features: list[str], k: int) -> NaiveBayes:
    """Class priors, Gaussian mean/sd of numeric features and level
    frequencies of text features per class: one grouped aggregate each."""
    num, cat, _ = roles(data.select(*[col(f) for f in features]))
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(num):
        aggs += [F.avg(col(f)).alias(f"m{i}"), F.stddev_samp(col(f)).alias(f"s{i}")]
    rows = {int(r[label]): r for r in data.groupBy(label).agg(*aggs).collect()}
    total = sum(r["n"] for r in rows.values())
    prior = [rows[c]["n"] / total if c in rows else 0.0 for c in range(k)]
    gauss = {f: [((rows[c][f"m{i}"], rows[c][f"s{i}"]) if c in rows else (None, None)) for c in range(k)]
             for i, f in enumerate(num)}
    table = {}
    for f in cat:
        cnt = data.groupBy(label, col(f).alias("lv")).agg(F.count(F.lit(1)).alias("c")).collect()
        tb = {c: {} for c in range(k)}
        for r in cnt:
            c = int(r[label])
            tb[c][r["lv"]] = r["c"] / rows[c]["n"]
        table[f] = tb
    return NaiveBayes(k, prior, gauss, table)


def naive_bayes_scores(m: NaiveBayes) -> list:
    """Per class: log prior + sum of log densities, as column expressions."""
    out = []
    thr = math.log(m.threshold)
    for c in range(m.k):
        s = F.lit(math.log(m.prior[c]) if m.prior[c] > 0 else -1e300)
        for f, params in m.gauss.items():
            mu, sd = params[c]
            if mu is None:
                continue
            sd = sd if sd and sd > 0 else m.threshold
            x = col(f).cast("double")
            logd = -0.5 * F.pow((x - F.lit(mu)) / F.lit(sd), 2) - F.lit(math.log(sd * math.sqrt(2 * math.pi)))
            # only a density that is 0 as a double is replaced
            s = s + F.coalesce(F.when(F.exp(logd) > 0, logd).otherwise(F.when(logd.isNotNull(), F.lit(thr))), F.lit(0.0))
        for f, tb in m.table.items():
            probs = tb[c]
            if probs:
                mp = F.create_map(*[x for lv, pr in probs.items() for x in (F.lit(lv), F.lit(math.log(pr)))])
                s = s + F.coalesce(F.element_at(mp, col(f)), F.lit(thr))
        out.append(s)
    return out


def _nb_predict(t: Trained, df: DataFrame) -> DataFrame:
    sc = naive_bayes_scores(t.model)
    arr = F.array(*[F.struct(s.alias("s"), F.lit(i).alias("i")) for i, s in enumerate(sc)])
    # first class with the highest score
    best = F.aggregate(arr, F.struct(F.lit(-float("inf")).alias("s"), F.lit(-1).alias("i")),
                       lambda acc, x: F.when(x["s"] > acc["s"], x).otherwise(acc))["i"]
    out = df.withColumn("__pi", best.cast("double"))
    if t.model.k == 2:
        out = out.withColumn("score", 1.0 / (1.0 + F.exp(sc[0] - sc[1])))
    return out


# ---- prediction ---------------------------------------------------------------

def predict(t: Trained, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """R9/C-predict: ``prediction`` (number, or class label); binary: ``score`` = P(second level)."""
    keep = list(keep or [])
    d = t.design
    if t.algo in ("tree", "rf") or isinstance(t.model, BO.Boosted):
        return _tree_predict(t, df, keep)
    if t.task == "regression":
        if t.algo in ("linear", "ridge", "lasso"):
            return df.select(*[col(c) for c in keep], t.model.prediction().alias("prediction"))
        if t.algo in ("svm", "nnet"):
            m = apply_design(df, d, keep=keep, with_target=False)
            out = GD.predict_column(m, t.model, d.names)
            return out.select(*[col(c) for c in keep], "prediction")
        a = assemble(df, d, keep=keep, with_target=False)
        return t.model.transform(a).select(*[col(c) for c in keep], "prediction")
    levels = F.array(*[F.lit(v) for v in t.levels])
    if t.algo == "nb":
        out = _nb_predict(t, df.select(*[col(c) for c in dict.fromkeys(keep + t.features)]))
        sel = [col(c) for c in keep] + [F.element_at(levels, F.col("__pi").cast("int") + 1).alias("prediction")]
        if "score" in out.columns:
            sel.append("score")
        return out.select(*sel)
    if t.algo == "knn":
        return _knn_predict(t, df, keep)
    if t.algo == "nnet":
        return _net_predict(t, df, keep)
    a = assemble(df, d, keep=keep, with_target=False)
    if t.algo == "svm":
        a = _kernel_features(a, t.extra["kernel"], t.extra["dims"])
    res = t.model.transform(a)
    sel = [col(c) for c in keep] + [F.element_at(levels, F.col("prediction").cast("int") + 1).alias("prediction")]
    if len(t.levels) == 2:
        if t.algo == "svm":
            wgt, b = t.extra["platt"]
            m = vector_to_array("rawPrediction")[1]
            sel.append((1.0 / (1.0 + F.exp(-(F.lit(wgt) * m + F.lit(b))))).alias("score"))
        elif "probability" in res.columns:
            sel.append(vector_to_array("probability")[1].alias("score"))
    return res.select(*sel)


# ---- importance ---------------------------------------------------------------

def importance(t: Trained) -> list[tuple[str, float]]:
    """Native importance per design column (trees, forests and boosted classes: per feature), sorted desc.

    linear: abs(t); ridge/lasso/logistic: abs(coefficient); trees, forests: share of
    all gains; boosted numbers: Spark's impurity importance; network: connection weights;
    svm / naive Bayes: none (use permutation importance).
    """
    names = t.design.names
    m = t.model
    vals = None
    if t.algo == "linear":
        tv = m.t()[1:]
        vals = [abs(v) if v == v else 0.0 for v in tv]
    elif t.algo in ("ridge", "lasso"):
        vals = [abs(v) for v in m.coef]
    elif t.algo == "logistic":
        cm = m.coefficientMatrix.toArray()
        vals = list(np.abs(cm).sum(axis=0))
    elif t.algo in ("tree", "rf") or isinstance(m, BO.Boosted):
        names = [name for name, *_ in _tree_columns(t.design)]
        vals = list(m.gains / max(m.gains.sum(), 1e-300))
    elif t.algo == "gbm":
        vals = list(m.featureImportances.toArray())
    elif t.algo == "nnet":
        vals = list(m.input_weights())
    if vals is None:
        return []
    return sorted(zip(names, [float(v) for v in vals]), key=lambda x: -x[1])
