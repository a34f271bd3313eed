"""Registry of runnable queries with their DuckDB counterparts, and the shared inputs of both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.operators.splits import time_split3
from txnlens.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, the SQL that must give the same rows."""
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


# Sums in different order differ in the last digits, and decimal data often lies exactly half-way between two
# rounded values. Both sides therefore round on a grid that is shifted off those half-way points.
_SHIFT = 0.3141


def q(x: Column | str, digits: int = 4) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    scale = float(10 ** digits)
    return F.floor(x * scale + _SHIFT) / scale


def sq(x: str, digits: int = 4) -> str:
    return f"(floor(({x}) * 1e{digits} + {_SHIFT}) / 1e{digits})"


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: q(c, d) for c, d in digits.items()})


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events bound to the roles, with three model scores and their blend."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    k = F.get_json_object("props", "$.k").cast("int")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    e = read_table(spark, d, "events").select(
        "event_id", micros.alias("t"), "user_id", "event_type", "value", k.alias("k"))
    return e.select(
        "*", (F.col("k") < 4).cast("int").alias("y"),
        F.least(F.round(F.col("value") / 500, 4), F.lit(1.0)).alias("p1"),
        ((F.col("event_id") * 7919) % 1000 / 1000.0).alias("p2"),
        (F.floor(F.col("t") / 3_600_000_000) % 24 / 24.0).alias("p3"),
    ).withColumn("p", 0.5 * F.col("p1") + 0.3 * F.col("p2") + 0.2 * F.col("p3"))


EV = """ev AS (
  SELECT *, 0.5::DOUBLE * p1 + 0.3::DOUBLE * p2 + 0.2::DOUBLE * p3 AS p FROM (
    SELECT event_id, epoch_us(ts) AS t, user_id, event_type, value,
           CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
           CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) < 4 AS INTEGER) AS y,
           least(round(value / 500, 4), 1.0) AS p1,
           ((event_id * 7919) % 1000) / 1000.0::DOUBLE AS p2,
           ((epoch_us(ts) // 3600000000) % 24) / 24.0::DOUBLE AS p3
    FROM events))"""


def split_events(spark: SparkSession, d: str) -> DataFrame:
    return time_split3(events(spark, d))


SPLIT = EV + """, sp AS (
  SELECT * EXCLUDE (n), CASE WHEN rn >= floor(n * 0.7999999999999999::DOUBLE) THEN 'test'
                             WHEN rn >= floor(n * 0.7::DOUBLE) THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY t, event_id) - 1 AS rn, count(*) OVER () AS n FROM ev))"""


def orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders bound to the roles; the day granularity gives ties in time."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return read_table(spark, d, "orders").select(
        F.col("o_orderkey"), F.col("o_custkey"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("t"),
        F.col("o_totalprice"), F.col("o_orderstatus"), F.col("o_orderpriority"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y"))


ORD = """ord AS (
  SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) AS t, o_totalprice, o_orderstatus, o_orderpriority,
         CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS y FROM orders)"""

# One event arrives k hours after it happened, which gives an arrival order with late rows.
ARRIVAL = "t + k * 3600000000"
W = "PARTITION BY user_id ORDER BY t, event_id"
PRIOR = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def grid_sql(values) -> str:
    """A threshold list as a table, with the same doubles on both sides."""
    rows = ", ".join(f"({i}, CAST('{v!r}' AS DOUBLE))" for i, v in enumerate(values))
    return f"(VALUES {rows})"


CURVE = """
  SELECT p, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg
  FROM (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM {src} GROUP BY p)
  WINDOW w AS (ORDER BY p DESC)"""
