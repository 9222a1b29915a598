"""How the domain's shapes are read from the driver's tables, in Spark and in SQL.

An append stream is (device, seq, us, t, kind, bpm, value, props): ``us`` are microseconds, ``t`` whole seconds.
A daily table is (device, day, price, n, urgent, high, low): sums of one device's orders of a day.
Sessions are (device, start_t, end_t, n): runs of stream rows without a gap above three hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import islands

DEVICES, GAP = 8, 3 * 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % DEVICES).alias("device"), F.col("event_id").alias("seq"), us.alias("us"), F.expr("unix_micros(CAST(ts AS TIMESTAMP)) DIV 1000000").alias("t"),
        F.col("event_type").alias("kind"), (45 + F.col("value") / 3).alias("bpm"), "value", "props",
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda p: F.count_if(F.col("o_orderpriority") == p)
    return (
        table(spark, sf_dir, "orders")
        .groupBy((F.col("o_custkey") % 3).alias("device"), F.to_date("o_orderdate").alias("day"))
        .agg((F.sum("o_totalprice") / 1000).alias("price"), F.count("*").alias("n"), count("1-URGENT").alias("urgent"), count("2-HIGH").alias("high"), count("5-LOW").alias("low"))
    )


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 3).alias("device"), F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = islands(stream(spark, sf_dir), "device", ["t", "seq"], "t", GAP)
    return runs.groupBy("device", "island").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("n")).drop("island")


STREAM = "s AS (SELECT user_id % 8 AS device, event_id AS seq, epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS t, event_type AS kind, 45 + value / 3 AS bpm, value, props FROM events)"
DAILY = """d AS (SELECT o_custkey % 3 AS device, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) / 1000 AS price, count(*) AS n,
  count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '2-HIGH') AS high, count(*) FILTER (o_orderpriority = '5-LOW') AS low
  FROM orders GROUP BY ALL)"""
SHIPPED = "sh AS (SELECT l_suppkey % 3 AS device, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS quantity, avg(l_discount) AS discount FROM lineitem GROUP BY ALL)"
SESSIONS = (
    STREAM
    + """, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY device ORDER BY t, seq) <= 10800 THEN 0 ELSE 1 END AS cut FROM s),
i AS (SELECT *, sum(cut) OVER (PARTITION BY device ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS island FROM g),
ss AS (SELECT device, min(t) AS start_t, max(t) AS end_t, count(*) AS n FROM i GROUP BY device, island)"""
)
