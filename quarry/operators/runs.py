"""Task detection, ranking, run registry and comparison."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.roles import col, is_numeric_type


def detect_task(df: DataFrame, target: str, max_classes: int = 10) -> str:
    """A1: numeric target with more than 10 distinct values -> regression."""
    if not is_numeric_type(df.schema[target].dataType):
        return "classification"
    # at most 11 distinct values are needed to decide
    k = df.select(col(target)).where(col(target).isNotNull()).distinct().limit(max_classes + 1).count()
    return "regression" if k > max_classes else "classification"


def task_table(df: DataFrame, targets: list[str], max_classes: int = 10) -> DataFrame:
    rows = []
    for t in targets:
        rows.append((t, detect_task(df, t, max_classes)))
    return df.sparkSession.createDataFrame(rows, "target string, task string")


METRIC_FOR = {"regression": ("RMSE", True), "classification": ("Accuracy", False)}


def ranking(scores: DataFrame, task: str) -> DataFrame:
    """Ordered table (algorithm, score, metric, rank, best); best = min RMSE /
    max accuracy, the first in registration order on ties (``position``)."""
    metric, lower_better = METRIC_FOR[task]
    order = F.col("score").asc_nulls_last() if lower_better else F.col("score").desc_nulls_last()
    w = Window.orderBy(order, "position")  # one row per learner: a tiny table
    return (scores.withColumn("rank", F.row_number().over(w))
            .select("algorithm", F.col("score").cast("double").alias("score"), F.lit(metric).alias("metric"),
                    F.col("rank").cast("int").alias("rank"), (F.col("rank") == 1).alias("best")))


def run_id(algo: str, now: _dt.datetime | None = None) -> str:
    """``<algo>_<HHMMSS>``."""
    return f"{algo}_{(now or _dt.datetime.now()).strftime('%H%M%S')}"


RUNS_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("task", T.StringType()),
    T.StructField("algorithm", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("metric", T.StringType()), T.StructField("best", T.BooleanType()),
    T.StructField("error", T.StringType()),
])


def run_summary(runs: DataFrame, run: str) -> DataFrame:
    """Task, best algorithm, best score, number of models of one run."""
    r = runs.where(F.col("run_id") == run)
    return r.agg(F.first("task").alias("task"),
                 F.max(F.when(F.col("best"), F.col("algorithm"))).alias("best_algorithm"),
                 F.max(F.when(F.col("best"), F.col("score"))).alias("best_score"),
                 F.count(F.col("score")).alias("n_models"))


def score_matrix(runs: DataFrame, run_ids: list[str] | None = None) -> DataFrame:
    """A10: algorithm x run matrix of scores, missing where a run lacks a learner."""
    ids = run_ids or sorted(r["run_id"] for r in runs.select("run_id").distinct().collect())
    return runs.groupBy("algorithm").pivot("run_id", ids).agg(F.first("score"))
