"""Derived inputs built by the same expression in Spark and in the oracle SQL.

Each fixture is a pair: a Spark builder over the given tables and the
equivalent SQL text (a sub-query usable in FROM).  Missing values, planted
targets and duplicates are derived from the tables so the work grows with
them (FIXTURES.md part C).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load_table


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return load_table(spark, sf, name)


# lineitem with a derived missing column: 5 numeric + 2 categorical
LI_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "disc_na"]
LI_SQL = ("(SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber, "
          "nullif(l_discount, 0.0) AS disc_na, l_returnflag, l_linestatus FROM lineitem)")


def li(spark, sf) -> DataFrame:
    return t(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber",
        F.expr("nullif(l_discount, 0.0)").alias("disc_na"), "l_returnflag", "l_linestatus")


# orders with missing numeric (every 7th key) and categorical (status P)
ORD_SQL = ("(SELECT o_orderkey, o_custkey, "
           "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price_na, "
           "nullif(o_orderstatus, 'P') AS status_na, o_orderpriority, "
           "CASE WHEN o_orderkey % 10 = 0 THEN CAST(1 AS DOUBLE) END AS mostly_na "
           "FROM orders)")


def ords(spark, sf) -> DataFrame:
    return t(spark, sf, "orders").select(
        "o_orderkey", "o_custkey",
        F.expr("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END").alias("price_na"),
        F.expr("nullif(o_orderstatus, 'P')").alias("status_na"), "o_orderpriority",
        F.expr("CASE WHEN o_orderkey % 10 = 0 THEN CAST(1 AS DOUBLE) END").alias("mostly_na"))


# events with exact duplicates: every 20th event repeated
EV_DUP_SQL = ("(SELECT event_id, user_id, event_type, value FROM events UNION ALL "
              "SELECT event_id, user_id, event_type, value FROM events WHERE event_id % 20 = 0)")


def ev_dup(spark, sf) -> DataFrame:
    e = t(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return e.unionByName(e.where("event_id % 20 = 0"))


# planted regression targets on lineitem (coefficients known)
LIN_TARGET = "(3*l_quantity - 40*l_discount + l_linenumber + ((l_partkey % 13) - 6) / 10.0)"
INTER_TARGET = "(2*l_quantity + 5*l_tax + 0.5*l_quantity*l_linenumber + ((l_partkey % 13) - 6) / 10.0)"


# planted targets on events (key event_id): a known signal for the learners
EV_Y = ("(2 * value + 0.05 * user_id + CASE WHEN event_type = 'purchase' THEN 30.0 ELSE 0.0 END"
        " + ((event_id % 13) - 6) / 10.0)")
EV_CLS2 = f"CASE WHEN {EV_Y} > 100 THEN 'high' ELSE 'low' END"
EV_CLS3 = f"CASE WHEN {EV_Y} < 70 THEN 'a_low' WHEN {EV_Y} < 130 THEN 'b_mid' ELSE 'c_high' END"


def ev_learn(spark, sf) -> DataFrame:
    """events + planted regression, binary and 3-class targets."""
    return t(spark, sf, "events").select(
        "event_id", "value", "user_id", "event_type", F.expr(EV_Y).alias("y"),
        F.expr(EV_CLS2).alias("y2"), F.expr(EV_CLS3).alias("y3"))
