"""Model bundles: save, load, check and batch-score.

A bundle is a folder: the fitted learner as a Spark ML pipeline where the
learner is a Spark estimator (its own ``save``), plus a one-row ``sidecar`` table with
algorithm, task, target, feature names and types, class levels, design
levels and -- unlike the reference (D11) -- the preprocessing (scaling)
parameters, so scoring new files is on the training scale.  Closed-form
and numpy learners keep their parameters in the sidecar.
"""

from __future__ import annotations

import io
import json
import os

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.roles import is_numeric_type
from ..operators import learners as LR
from ..operators.design import Design
from ..operators.transform import ScaleParams, apply_scale


def _design_to_json(d: Design) -> dict:
    return {"target": d.target, "terms": [list(t) for t in d.terms], "levels": d.levels,
            "columns": [[n, ti, [list(x) for x in combo]] for n, ti, combo in d.columns]}


def _design_from_json(j: dict) -> Design:
    return Design(target=j["target"], terms=[tuple(t) for t in j["terms"]], levels=j["levels"],
                  columns=[(n, ti, [tuple(x) for x in combo]) for n, ti, combo in j["columns"]])


def save_bundle(t: LR.Trained, path: str, schema_of: DataFrame | None = None,
                scaler: ScaleParams | None = None) -> str:
    """Write the model and its sidecar (overwrites)."""
    meta = {"algo": t.algo, "task": t.task, "target": t.target, "features": t.features, "levels": t.levels,
            "params": t.params, "design": _design_to_json(t.design),
            "scaler": {"method": scaler.method, "stats": scaler.stats} if scaler else None,
            "feature_types": ({f: schema_of.schema[f].dataType.simpleString() for f in t.features}
                              if schema_of is not None else None)}
    m = t.model
    arrays = None
    if hasattr(m, "write"):
        m.write().overwrite().save(os.path.join(path, "model"))
        meta["model_class"] = f"{type(m).__module__}.{type(m).__name__}"
    else:
        arrays = {}
        if t.algo == "linear":
            arrays = {"coef": m.coef, "se": m.se, "vcov": m.vcov, "means": m.means,
                      "scalars": np.array([m.n, m.rss, m.tss, m.ymean]), "kept": np.array(m.kept)}
        elif t.algo in ("ridge", "lasso"):
            arrays = {"lambdas": np.array(m.lambdas), "path": m.path, "intercepts": m.intercepts, "alpha": np.array(m.alpha)}
        elif t.algo == "gbm":
            arrays = {"blob": np.frombuffer(m.packed(), np.uint8)}
        elif t.algo in ("tree", "rf"):
            LR.TR.save(m, path, SparkSession.getActiveSession())
        elif t.algo == "knn":
            m.points.write.mode("overwrite").parquet(os.path.join(path, "points"))
        elif t.algo == "nb":
            meta["nb"] = {"k": m.k, "prior": m.prior, "gauss": m.gauss,
                          "table": {f: {str(c): v for c, v in tb.items()} for f, tb in m.table.items()}}
        elif t.algo in ("svm", "nnet"):
            arrays = {k: np.asarray(v) for k, v in vars(m).items() if not hasattr(v, "transform")}
            if t.algo == "svm":
                arrays.update({f"k_{k}": (np.asarray(v) if v is not None else np.array([]))
                               for k, v in vars(m.kernel).items() if k != "kind"})
                meta["kernel_kind"] = m.kernel.kind
    kernel = None
    if t.extra.get("kernel") is not None:
        km = t.extra["kernel"]
        kernel = {k: (np.asarray(v) if v is not None else np.array([])) for k, v in vars(km).items() if k != "kind"}
        meta["svm_kernel"] = km.kind
        meta["dims"] = t.extra.get("dims")
        meta["platt"] = t.extra.get("platt")
    row = (json.dumps(meta, default=float), _packed(arrays), _packed(kernel))
    SparkSession.getActiveSession().createDataFrame([row], SIDECAR).coalesce(1).write.mode("overwrite").parquet(
        os.path.join(path, "sidecar"))
    return path


#: One row beside the model, written by Spark so that any store it reaches will do.
SIDECAR = "meta string, arrays binary, kernel binary"


def _packed(arrays: dict | None) -> bytes | None:
    """Arrays as the bytes of an ``npz`` file."""
    if arrays is None:
        return None
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def load_bundle(path: str) -> tuple[LR.Trained, dict]:
    """Read a bundle; a bare Spark model folder is accepted with
    algo 'Loaded' and task 'unknown', as the reference does."""
    try:
        row = SparkSession.getActiveSession().read.schema(SIDECAR).parquet(os.path.join(path, "sidecar")).first()
    except AnalysisException:  # no such folder
        from pyspark.ml import PipelineModel
        m = PipelineModel.load(path)
        return LR.Trained("Loaded", "unknown", None, [], Design(target=""), model=m), {"algo": "Loaded",
                                                                                       "task": "unknown"}
    meta = json.loads(row["meta"])
    d = _design_from_json(meta["design"])
    t = LR.Trained(meta["algo"], meta["task"], meta["target"], meta["features"], d, meta["levels"],
                   params=meta["params"])
    if "model_class" in meta:
        mod, cls = meta["model_class"].rsplit(".", 1)
        import importlib
        t.model = getattr(importlib.import_module(mod), cls).load(os.path.join(path, "model"))
    elif t.algo in ("tree", "rf"):
        t.model = LR.TR.load(path, SparkSession.getActiveSession())
    elif t.algo == "knn":
        points = SparkSession.getActiveSession().read.parquet(os.path.join(path, "points"))
        t.model = LR.KnnModel(points, len(d.names), t.params.get("leaf_points", LR.KNN.LEAF_POINTS))
    else:
        arr = dict(np.load(io.BytesIO(row["arrays"]), allow_pickle=False))
        if t.algo == "linear":
            from ..operators.linear import OLSFit
            n, rss, tss, ym = arr["scalars"]
            t.model = OLSFit(design=d, names=["(Intercept)"] + d.names, coef=arr["coef"], se=arr["se"], n=int(n),
                             rss=float(rss), tss=float(tss), means=arr["means"], ymean=float(ym),
                             vcov=arr["vcov"], kept=[int(k) for k in arr["kept"]])
        elif t.algo == "gbm":
            t.model = LR.BO.Boosted.unpacked(arr["blob"].tobytes())
        elif t.algo in ("ridge", "lasso"):
            t.model = LR.PN.PenalisedFit(d, arr["lambdas"].tolist(), arr["path"], arr["intercepts"], float(arr["alpha"]))
        elif t.algo == "nb":
            nb = meta["nb"]
            t.model = LR.NaiveBayes(nb["k"], nb["prior"], {f: [tuple(x) for x in v] for f, v in nb["gauss"].items()},
                                    {f: {int(c): v for c, v in tb.items()} for f, tb in nb["table"].items()})
        elif t.algo == "nnet":
            t.model = LR.NN.NetModel(arr["mean"], arr["sd"], arr["W1"], arr["b1"], arr["w2"], arr["b2"],
                                     float(arr["y_mean"]), float(arr["y_sd"]), float(arr["gradient"]), int(arr["passes"]))
        elif t.algo == "svm":
            from ..operators.gradient import KernelMap, SVRModel
            km = KernelMap(meta["kernel_kind"], arr["k_mean"], arr["k_sd"],
                           arr["k_W"] if arr["k_W"].size else None, arr["k_b"] if arr["k_b"].size else None,
                           float(arr["k_gamma"]))
            t.model = SVRModel(km, arr["w"], float(arr["y_mean"]), float(arr["y_sd"]))
    if meta.get("svm_kernel"):
        from ..operators.gradient import KernelMap
        k = dict(np.load(io.BytesIO(row["kernel"]), allow_pickle=False))
        t.extra["kernel"] = KernelMap(meta["svm_kernel"], k["mean"], k["sd"], k["W"] if k["W"].size else None,
                                      k["b"] if k["b"].size else None, float(k["gamma"]))
        t.extra["dims"] = meta["dims"]
        t.extra["platt"] = tuple(meta["platt"]) if meta.get("platt") else None
    return t, meta


def check_input(df: DataFrame, meta: dict) -> None:
    """V2: fail early when the scoring table lacks a feature or its kind changed."""
    missing = [f for f in meta.get("features", []) if f not in df.columns]
    if missing:
        raise ValueError("Missing required columns: " + ", ".join(missing))
    types = meta.get("feature_types") or {}
    for f, tname in types.items():
        was_num = tname in ("tinyint", "smallint", "int", "bigint", "float", "double") or tname.startswith("decimal")
        if was_num != is_numeric_type(df.schema[f].dataType):
            raise ValueError(f"Column {f}: expected {'numeric' if was_num else 'text'} values")


def score(df: DataFrame, t: LR.Trained, meta: dict, keep: list[str] | None = None) -> DataFrame:
    """V1: batch scoring with the bundle's own preprocessing (scaling) applied first."""
    check_input(df, meta)
    sc = meta.get("scaler")
    if sc:
        df = apply_scale(df, ScaleParams(sc["method"], {k: tuple(v) for k, v in sc["stats"].items()}))
    return t.predict(df, keep=keep)


def score_file(spark: SparkSession, path: str, bundle_path: str, out_path: str | None = None,
               keep: list[str] | None = None, fmt: str | None = None) -> DataFrame:
    """S7 + V1 + S8: read a file with the bundle's feature schema, score, optionally write CSV."""
    from .tables import load, write_predictions
    t, meta = load_bundle(bundle_path)
    df = load(spark, path, fmt)
    types = meta.get("feature_types") or {}
    if any(f.dataType.simpleString() != types.get(f.name, f.dataType.simpleString()) for f in df.schema.fields):
        # inferred types may differ from those of the training table (a code such as 007): read with those
        schema = T.StructType([T.StructField(f.name, T.DataType.fromDDL(types[f.name]) if f.name in types else f.dataType)
                               for f in df.schema.fields])
        df = spark.read.schema(schema).parquet(path) if fmt == "parquet" else load(spark, path, fmt, schema=schema)
    pred = score(df, t, meta, keep)
    if out_path:
        write_predictions(pred, out_path)
    return pred

