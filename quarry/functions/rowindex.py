"""Global 1-based row index in a given order, without a single-task window.

1. one pass: ``count`` + ``percentile_approx`` of a numeric key that is
   monotone in the order (the first order column, or a numeric prefix of
   a hash) -> bucket bounds;
2. bucket every row with ``Bucketizer`` (binary search in the JVM) and
   count rows per bucket (a small result: one row per bucket);
3. a bucket of many rows that all share the first order column is cut by the second, and so
   on; rows that share the whole order are cut by a hash of the row, so that no value, nor
   null, is one task;
4. index = offset of the bucket + ``row_number`` over
   ``partitionBy(bucket).orderBy(order)``.

Every step is deterministic, so a lost executor recomputes the same
index; no checkpoint is needed.  Rows that share the whole order get an
arbitrary but stable order.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _num_buckets(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _monotone_number(df: DataFrame, key: Column) -> Column:
    """A double that never falls where the key rises: the key itself, or a text's first six bytes as a number."""
    if isinstance(df.select(key).schema[0].dataType, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(key.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return key.cast("double")


def with_row_index(df: DataFrame, order_by: list, name: str = "row_index",
                   bucket_key: Column | None = None, buckets: int | None = None,
                   rows_per_bucket: int = 2_000_000, group: str | None = None, hot_rows: int = 200_000) -> DataFrame:
    """1-based position in ``order_by`` order; with ``group``, positions restart per
    group (a small number of groups sharing one key distribution, e.g. shuffles).
    Buckets of more than ``hot_rows`` equal keys are cut further."""
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order_by]
    key = bucket_key if bucket_key is not None else order_cols[0]
    key = _monotone_number(df, key)
    nb = buckets or _num_buckets(df)

    def bounds_for(k):
        probs = [i / k for i in range(1, k)] or [0.5]
        r = df.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(key, probs, 10_000).alias("b")).collect()[0]
        return r["n"], ((r["b"] or []) if k > 1 else [])
    # one pass gives the row count and the bucket bounds; a second only when the rows
    # need more buckets than the default
    n, got = bounds_for(nb)
    need = int(math.ceil(n / rows_per_bucket))
    if need > nb:
        nb = need
        n, got = bounds_for(nb)
    bounds = sorted({float(b) for b in got if b is not None}) if n else []
    splits = [-math.inf] + bounds + [math.inf]
    tmp = df.withColumn("__bk", key)
    bz = Bucketizer(splits=splits, inputCol="__bk", outputCol="__bucket", handleInvalid="keep")
    # nulls come first, as in the window below
    b = bz.transform(tmp).drop("__bk").withColumn("__bucket", F.coalesce("__bucket", F.lit(-1.0)))
    gcols = [group] if group else []
    # a directed order (descending) is not cut further
    plain = not group and not any(re.search(r" (ASC|DESC) NULLS", str(c)) for c in order_cols)
    spread = [] if not plain else [F.min(order_cols[0]).alias("lo"), F.max(order_cols[0]).alias("hi")]
    counts = b.groupBy(*gcols, "__bucket").agg(F.count(F.lit(1)).alias("count"), *spread).collect()   # (groups x buckets) rows
    most = max(hot_rows, 2 * n // nb)
    if plain and any(r["count"] > most and r["lo"] == r["hi"] for r in counts):
        b, order_cols = _cut_hot(b, order_cols, most)
        counts = b.groupBy("__bucket").count().collect()
    per: dict = {}
    for r in counts:
        per.setdefault(r[group] if group else None, []).append((r["__bucket"], r["count"]))
    entries = []
    for g, lst in per.items():
        acc = 0
        for k, c in sorted(lst):
            entries.append((g, float(k), acc))
            acc += c
    if entries:
        if group:
            m = F.create_map(*[x for g, k, v in entries
                               for x in (F.struct(F.lit(g).alias("g"), F.lit(k).alias("b")), F.lit(v))])
            off = F.element_at(m, F.struct(F.col(group).alias("g"), F.col("__bucket").alias("b")))
        else:
            m = F.create_map(*[x for _, k, v in entries for x in (F.lit(k), F.lit(v))])
            off = F.element_at(m, F.col("__bucket"))
    else:
        off = F.lit(0)
    w = Window.partitionBy(*gcols, "__bucket").orderBy(*order_cols)
    return (b.withColumn(name, (off + F.row_number().over(w)).cast("long"))
            .drop("__bucket"))


#: Parts of one hot bucket at most.
_PARTS = 1_000


def _cut_hot(df: DataFrame, order_cols: list[Column], most: int) -> tuple[DataFrame, list[Column]]:
    """``__bucket`` with buckets of over ``most`` rows of one key cut by the next order column, at last by a hash.

    Returns the order with that hash, if it was needed.
    """
    scale = 1.0
    row_hash = F.xxhash64(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c != "__bucket"])
    for level, key in enumerate(order_cols):
        after = order_cols[level + 1] if level + 1 < len(order_cols) else None
        stats = (df.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
                 .where((F.col("n") > most) & F.col("lo").eqNullSafe(F.col("hi"))).collect())  # fewer than all rows / most
        if not stats:
            return df, order_cols
        scale /= _PARTS
        place = F.col("__bucket")
        hot = {r["__bucket"]: min(-(-r["n"] // max(most // 2, 1)), _PARTS - 2) for r in stats}
        if after is None:
            share = F.shiftrightunsigned(row_hash, 11).cast("double") / float(1 << 53)
            parts = {b: F.floor(share * k) for b, k in hot.items()}
        else:
            number = _monotone_number(df, after)
            wide = max(hot.values())
            got = (df.where(F.col("__bucket").isin(list(hot))).groupBy("__bucket")
                   .agg(F.percentile_approx(number, [i / wide for i in range(1, wide)] or [0.5], 10_000).alias("b")).collect())
            # nulls of the next column come first, as in the window
            parts = {r["__bucket"]: F.size(F.filter(F.array(*[F.lit(float(x)) for x in sorted(set(r["b"] or []))]).cast("array<double>"),
                                                    lambda x: x < number)) for r in got}
            parts = {b: F.when(number.isNull(), F.lit(0)).otherwise(v + 1) for b, v in parts.items()}
        for b, part in parts.items():
            place = F.when(F.col("__bucket") == F.lit(b), F.lit(b) + part.cast("double") * F.lit(scale)).otherwise(place)
        df = df.withColumn("__bucket", place)
    return df, [*order_cols, row_hash]


def md5_order_key(key: Column, seed: int) -> Column:
    """Seeded pseudo-random order: md5(key || ':' || seed) as hex text."""
    return F.md5(F.concat(key.cast("string"), F.lit(":"), F.lit(str(seed))))


def hex_prefix_number(h: Column) -> Column:
    """Numeric value of the first 13 hex digits: monotone in the hex order."""
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double")
