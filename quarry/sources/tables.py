"""Scans and sinks (survey 2.1: S1-S8)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.roles import type_name

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_FORMATS = {".csv": "csv", ".txt": "csv", ".parquet": "parquet", ".json": "json", ".orc": "orc"}


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given test tables: ``<sf_dir>/<name>.parquet``."""
    return spread(spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")))


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Give a scan at least ``defaultParallelism`` partitions.

    A parquet file with one row group is read by one task, whatever
    ``maxPartitionBytes`` says; the per-row work of the first stage would
    then run on one core.  Large inputs (many files / row groups) already
    have enough splits and are left alone -- no extra shuffle at scale.
    """
    try:
        want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        have = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 -- no RDD view (e.g. Spark Connect): leave the scan as it is
        return df
    return df.repartition(want) if have < want else df


def read_csv(spark: SparkSession, path: str, header: bool = True, sep: str = ",",
             schema: T.StructType | str | None = None, infer: bool = True) -> DataFrame:
    """Delimited text (``,`` ``;`` tab); ``NA`` and empty are missing.

    Any size: the reader splits files across tasks. Give ``schema`` to skip
    the inference pass (recommended at scale, and for S7 scoring files).
    """
    r = (spark.read.option("header", str(bool(header)).lower()).option("sep", sep)
         .option("nullValue", "NA").option("mode", "PERMISSIVE"))
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", str(bool(infer)).lower())
    return r.csv(path)


def load(spark: SparkSession, path: str, fmt: str | None = None, **opts) -> DataFrame:
    """S3: load by format (from the extension when not given).

    Unknown extension -> ValueError("Unsupported file format"), as the
    reference. Directories and globs are accepted with an explicit ``fmt``.
    """
    if fmt is None:
        ext = os.path.splitext(path.rstrip("/"))[1]
        fmt = _FORMATS.get(ext)
        if fmt is None:
            raise ValueError("Unsupported file format")
    if fmt == "csv":
        return read_csv(spark, path, **opts)
    if fmt in ("parquet", "json", "orc"):
        return spark.read.format(fmt).options(**opts).load(path)
    raise ValueError("Unsupported file format")


def preview(df: DataFrame, n: int = 100, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows (in ``order_by`` order when given, for determinism)."""
    if order_by:
        df = df.orderBy(*order_by)
    return df.limit(n)


def structure(df: DataFrame) -> DataFrame:
    """Rows, columns and the type of each column (long form)."""
    n = df.count()
    spark = df.sparkSession
    rows = [(f.name, i + 1, type_name(f.dataType), f.dataType.simpleString(), n, len(df.columns))
            for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(
        rows, "variable string, position int, type string, spark_type string, n_rows long, n_cols long")


def write_predictions(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite",
                      sep: str = ",") -> str:
    """Predictions as CSV with a header (a directory of part files), or parquet."""
    w = df.write.mode(mode)
    if fmt == "csv":
        # missing written as NA, as R's write.csv does
        w.option("header", "true").option("nullValue", "NA").option("sep", sep).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def timestamped_name(prefix: str, ext: str = "csv") -> str:
    """S8 file name: ``<prefix>_<YYYYmmdd_HHMMSS>.<ext>``."""
    import datetime as _dt
    return f"{prefix}_{_dt.datetime.now().strftime('%Y%m%d_%H%M%S')}.{ext}"


def with_derived_missing(df: DataFrame, name: str, expr) -> DataFrame:
    """Helper for fixtures: add a derived column from a SQL expression."""
    return df.withColumn(name, F.expr(expr) if isinstance(expr, str) else expr)
