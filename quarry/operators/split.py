"""Exact-size, seeded train/test split (F1, F2).

Rows are ordered by ``md5(key || ':' || seed)`` and the first
``floor(ratio * n)`` go to train.  ``randomSplit`` is not exact in size;
this is, and it is reproducible on any partitioning (the order depends on
the key only).  The global position comes from :func:`with_row_index`
(range buckets, no single-task window).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.roles import col
from ..functions.rowindex import hex_prefix_number, md5_order_key, with_row_index


def split_labels(df: DataFrame, key: str, ratio: float = 0.8, seed: int = 42,
                 label_col: str = "split") -> DataFrame:
    """Add ``split`` = 'train' for the first floor(ratio*n) rows in hash order, else 'test'."""
    if not isinstance(ratio, (int, float)) or not (0 < ratio < 1):
        raise ValueError("train_ratio must be a number in (0, 1)")
    if key not in df.columns:
        raise ValueError(f"Key column not found: {key}")
    n = df.count()
    k = math.floor(ratio * n)
    h = md5_order_key(col(key), seed)
    tmp = df.withColumn("__h", h)
    idx = with_row_index(tmp, ["__h", key], "__pos", bucket_key=hex_prefix_number(F.col("__h")))
    return idx.withColumn(label_col, F.when(F.col("__pos") <= k, "train").otherwise("test")) \
              .drop("__h", "__pos")


def train_test_split(df: DataFrame, key: str, ratio: float = 0.8, seed: int = 42):
    """(train, test) DataFrames, disjoint and complete, |train| = floor(ratio * n)."""
    lab = split_labels(df, key, ratio, seed, "__split")
    return (lab.where("__split = 'train'").drop("__split"),
            lab.where("__split = 'test'").drop("__split"))


def automl_split(df: DataFrame, key: str, test_pct: float = 20, seed: int = 123):
    """floor(n * pct / 100) test rows (10..40 %), the rest train."""
    if not (10 <= test_pct <= 40):
        raise ValueError("test percent must be within 10..40")
    n = df.count()
    k_test = math.floor(n * test_pct / 100)
    h = md5_order_key(col(key), seed)
    idx = with_row_index(df.withColumn("__h", h), ["__h", key], "__pos",
                         bucket_key=hex_prefix_number(F.col("__h")))
    lab = idx.withColumn("__split", F.when(F.col("__pos") <= k_test, "test").otherwise("train")) \
             .drop("__h", "__pos")
    return (lab.where("__split = 'train'").drop("__split"),
            lab.where("__split = 'test'").drop("__split"))
