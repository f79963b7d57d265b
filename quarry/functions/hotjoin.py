"""Joins that no frequent key puts into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Most keys that count as hot, and the rows that a hot key has more than.
HOT_KEYS, HOT_ROWS = 50_000, 16
#: Most rows of a narrow side that is broadcast.
BROADCAST_ROWS = 20_000


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only when the counted size is within :data:`BROADCAST_ROWS`."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def join_on_hot_key(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` with ``facts`` (narrow, one row per ``key``).

    Keys with more than ``n / HOT_KEYS`` of the ``n`` rows are fewer than
    :data:`HOT_KEYS`, so their facts are broadcast; the rows of the others go
    through a shuffle, where each key has few.  Null keys match nothing.  Both sides are read twice.
    """
    facts = facts.toDF(*facts.columns)  # names of their own: both sides may stem from one table
    total = rows.count()
    often = cut_lineage(rows.groupBy(key).count()
                        .where((F.col("count") > max(total // HOT_KEYS, HOT_ROWS)) & F.col(key).isNotNull()).select(key))
    often = often.toDF(key)
    hot = rows.join(F.broadcast(facts.join(F.broadcast(often), key, "left_semi")), key)
    return hot.unionByName(rows.join(F.broadcast(often), key, "left_anti").join(facts, key))
