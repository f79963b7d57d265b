"""Small shared helpers of the operators: scans, text defaults, size-checked broadcast, hot keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Most rows of a two-long-column side that is ever broadcast (about 8 MB of keys);
#: a larger side goes through a shuffle join instead.
BROADCAST_ROWS = 250_000
#: Most keys that count as hot, and the rows that a hot key has more than.
HOT_KEYS, HOT_ROWS = 50_000, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, as any store that Spark reads holds it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(column: str | Column) -> Column:
    """The text as a string; null counts as empty."""
    c = F.col(f"`{column}`") if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


def quoted(name: str) -> Column:
    """A column whose name may hold dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only when the counted size is within :data:`BROADCAST_ROWS`."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def remainder_of_id(id_col: str, modulus: int) -> Column:
    """``crc32`` of the id written as text, modulo ``modulus`` (null id: as the empty text)."""
    return F.crc32(F.coalesce(quoted(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read again.

    Cuts the lineage like a checkpoint.  The table also has its true size,
    whereas a checkpoint keeps the planner's estimate, which a loop of joins
    multiplies without bound.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(batch: pa.Array, size: int = 256) -> Iterator[str]:
    """The texts of an Arrow batch, a few at a time as Python strings; gives unused memory back at the end."""
    for at in range(0, len(batch), size):
        yield from batch.slice(at, size).to_pylist()
    pa.default_memory_pool().release_unused()


def join_on_hot_key(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` with ``facts`` (one row per ``key``) that no frequent key puts into one task.

    Keys with more than ``n / HOT_KEYS`` of the ``n`` rows are fewer than
    :data:`HOT_KEYS`, so their facts are broadcast; the rows of the others go
    through a shuffle, where each key has few.  Null keys match nothing.  Both sides are read twice.
    """
    total = rows.count()
    often = (rows.groupBy(key).count().where((F.col("count") > max(total // HOT_KEYS, HOT_ROWS)) & F.col(key).isNotNull())
             .select(key))
    often = written(often)
    hot = rows.join(F.broadcast(facts.join(F.broadcast(often), key, "left_semi")), key)
    rest = rows.join(F.broadcast(often), key, "left_anti")
    return hot.unionByName(rest.join(facts, key))


@contextmanager
def removed(spark: SparkSession, folder: str) -> Iterator[None]:
    """Deletes ``folder`` of the shared folder at the end."""
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
