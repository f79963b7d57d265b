"""Row positions and running sums where one key holds a third of the rows."""

import pytest
from pyspark.sql import functions as F

from quarry.functions.rowindex import with_row_index
from quarry.operators.profile import _prefix_sum


def test_hot_first_key_is_cut_by_the_second(spark):
    df = spark.range(6_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).cast("int").alias("a"),
                                   (F.col("id") * 7_919 % 6_000).alias("b"))
    got = with_row_index(df, ["a", "b"], "t", hot_rows=100, buckets=8)
    rows = got.collect()
    want = sorted((r["a"], r["b"]) for r in rows)
    assert [(r["a"], r["b"]) for r in sorted(rows, key=lambda r: r["t"])] == want
    assert sorted(r["t"] for r in rows) == list(range(1, 6_001))


@pytest.mark.parametrize("hot", ["null", "'x'"])
def test_ties_of_the_whole_order_are_cut_by_a_hash(spark, hot):
    df = spark.range(4_000).selectExpr(f"CASE WHEN id % 3 = 0 THEN {hot} ELSE concat('k', id) END AS a", "id")
    got = with_row_index(df, ["a"], "t", hot_rows=50, buckets=8)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan  # the hot key is spread
    rows = got.collect()
    assert sorted(r["t"] for r in rows) == list(range(1, 4_001))
    by_place = [r["a"] for r in sorted(rows, key=lambda r: r["t"])]
    present = [a for a in by_place if a is not None]
    assert present == sorted(present)
    again = {r["id"]: r["t"] for r in with_row_index(df.repartition(3), ["a"], "t", hot_rows=50, buckets=8).collect()}
    assert again == {r["id"]: r["t"] for r in rows}


def test_nulls_of_the_second_key_come_first_within_the_hot_one(spark):
    df = spark.range(900).selectExpr("1 AS a", "CASE WHEN id % 4 = 0 THEN NULL ELSE id END AS b")
    rows = with_row_index(df, ["a", "b"], "t", hot_rows=40, buckets=4).collect()
    by_place = [r["b"] for r in sorted(rows, key=lambda r: r["t"])]
    assert by_place == [None] * 225 + sorted(b for b in by_place if b is not None)


def test_running_sums_over_blocks_of_blocks(spark):
    df = spark.range(1, 501).selectExpr("id AS t", "id % 7 AS v")
    got = {r["t"]: r["before"] for r in _prefix_sum(df, "t", "v", block=6).collect()}  # 84 blocks, 14 blocks of these, 3 of those
    total = 0
    for t in range(1, 501):
        assert got[t] == total
        total += t % 7
