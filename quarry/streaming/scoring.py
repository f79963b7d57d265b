"""Batch scoring of arriving files with Structured Streaming (V1 on a stream).

The reference scores an uploaded file with the active model.  Here the
same fitted transform -- a lazy column expression, or an Arrow-batched
``mapInPandas`` for numpy learners -- runs unchanged on a streaming
DataFrame: files dropped into a folder are scored as they arrive and the
predictions written with exactly-once file-sink semantics
(checkpointed progress in the shared checkpoint folder).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..session import ensure_checkpoint_dir
from ..sources.bundles import load_bundle, score


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv",
                max_files_per_trigger: int | None = None, **opts) -> DataFrame:
    """A file stream with a fixed schema (streams never infer)."""
    r = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        r = r.option("header", "true").option("nullValue", "NA")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.options(**opts).load(path)


def score_stream(spark: SparkSession, in_path: str, schema: T.StructType, bundle_path: str, out_path: str,
                 keep: list[str] | None = None, fmt: str = "csv", checkpoint: str | None = None,
                 trigger_once: bool = False) -> StreamingQuery:
    """Score every new file in ``in_path`` with the bundle and append parquet to ``out_path``."""
    t, meta = load_bundle(bundle_path)
    stream = read_stream(spark, in_path, schema, fmt)
    pred = score(stream, t, meta, keep=keep)
    ck = checkpoint or os.path.join(ensure_checkpoint_dir(spark),
                                    "score_stream_" + os.path.basename(out_path.rstrip("/")))
    w = pred.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", ck) \
        .outputMode("append")
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
