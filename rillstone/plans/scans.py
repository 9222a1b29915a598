"""Scans, cursors, upserts and retention, as queries over the bound tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import query
from ..operators.joins import prioritised
from ..operators.windows import by
from ..sources.sinks import latest_wins, preserve_columns, range_replaced
from .bindings import DAILY, SHIPPED, STREAM, daily, sessions, shipped, stream, SESSIONS, table

#: 2024-01-05 and 2024-01-12 as unix seconds.
FROM_T, TO_T = 1704412800, 1705017600


@query(f"WITH {STREAM} SELECT device, seq, t, bpm FROM s WHERE device = 3 AND t BETWEEN {FROM_T} AND {TO_T} ORDER BY t, seq LIMIT 200")
def scan_time_range(spark: SparkSession, sf: str) -> DataFrame:
    return stream(spark, sf).filter((F.col("device") == 3) & F.col("t").between(FROM_T, TO_T)).orderBy("t", "seq").limit(200).select("device", "seq", "t", "bpm")


@query(f"""WITH {STREAM}, o AS (SELECT *, CASE WHEN kind = 'error' THEN NULL ELSE length(kind) END AS ord FROM s)
SELECT device, seq, t // 3600 AS hour, row_number() OVER (PARTITION BY device, t // 3600 ORDER BY ord NULLS FIRST, value, seq) AS place FROM o""")
def scan_stable_order(spark, sf):
    s = stream(spark, sf).withColumn("hour", F.floor(F.col("t") / 3600)).withColumn("ord", F.when(F.col("kind") != "error", F.length("kind")))
    w = W.partitionBy("device", "hour").orderBy(F.col("ord").asc_nulls_first(), "value", "seq")
    return s.select("device", "seq", "hour", F.row_number().over(w).alias("place"))


@query(f"WITH {DAILY} SELECT device, day, round(price, 6) AS price, n FROM d WHERE device = 1 AND day BETWEEN DATE '1996-03-01' AND DATE '1996-06-30'", days="day")
def scan_daily_range(spark, sf):
    return daily(spark, sf).filter((F.col("device") == 1) & F.col("day").between("1996-03-01", "1996-06-30")).select("device", "day", F.round("price", 6).alias("price"), "n").orderBy("day")


@query(f"WITH {SESSIONS} SELECT device, start_t, end_t, n FROM ss WHERE start_t BETWEEN {FROM_T} AND {TO_T}")
def scan_sessions(spark, sf):
    return sessions(spark, sf).filter(F.col("start_t").between(FROM_T, TO_T)).orderBy("device", "start_t")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 400000")
def scan_filtered_rows(spark, sf):
    rows = table(spark, sf, "orders").filter((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_totalprice") >= 400_000))
    return rows.select("o_custkey", "o_orderkey", "o_totalprice")


@query(f"""WITH {DAILY} SELECT device, day, key, round(CAST(value AS DOUBLE), 6) AS value FROM d
UNPIVOT (value FOR key IN (price, n, urgent)) WHERE key = 'price' AND day < DATE '1995-04-01'""".replace("FROM d\n", "FROM (SELECT device, day, price, CAST(n AS DOUBLE) AS n, CAST(urgent AS DOUBLE) AS urgent FROM d)\n"), days="day")
def scan_long_metric(spark, sf):
    return long_metrics(daily(spark, sf)).filter((F.col("key") == "price") & (F.col("day") < "1995-04-01")).withColumn("value", F.round("value", 6))


def long_metrics(rows: DataFrame) -> DataFrame:
    """Wide to long; null values are dropped."""
    wide = rows.select("device", "day", *(F.col(c).cast("double").alias(c) for c in ("price", "n", "urgent")))
    return wide.unpivot(["device", "day"], ["price", "n", "urgent"], "key", "value").filter("value IS NOT NULL")


@query(f"WITH {STREAM} SELECT device, kind, count(*) AS n FROM s GROUP BY ALL")
def scan_distinct_keys(spark, sf):
    return stream(spark, sf).groupBy("device", "kind").agg(F.count("*").alias("n")).orderBy("device", "kind")


@query(f"WITH {STREAM} SELECT device, kind, min(CAST(to_timestamp(t) AS DATE)) AS first_day, max(CAST(to_timestamp(t) AS DATE)) AS last_day FROM s GROUP BY ALL", days="first_day last_day")
def scan_first_last_day(spark, sf):
    day = F.to_date(F.timestamp_seconds("t"))
    return stream(spark, sf).groupBy("device", "kind").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE (CAST(o_orderdate AS DATE), o_orderkey) > (DATE '1997-01-01', 500) ORDER BY day, o_orderkey LIMIT 100", days="day")
def scan_keyset_page(spark, sf):
    day, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    after = (day > F.lit("1997-01-01").cast("date")) | ((day == F.lit("1997-01-01").cast("date")) & (key > 500))
    return table(spark, sf, "orders").filter(after).select("o_orderkey", day.alias("day")).orderBy("day", "o_orderkey").limit(100)


@query("SELECT event_id, user_id, value FROM events WHERE event_id > 300 ORDER BY event_id LIMIT 250")
def scan_after_cursor(spark, sf):
    return table(spark, sf, "events").filter("event_id > 300").orderBy("event_id").limit(250).select("event_id", "user_id", "value")


@query(f"""WITH {STREAM} SELECT 'push:' || kind AS cursor, max(seq) AS value FROM s GROUP BY kind UNION ALL SELECT 'read:' || kind, max(t) FROM s GROUP BY kind""")
def scan_highwater_cursors(spark, sf):
    s = stream(spark, sf)
    one = lambda prefix, c: s.groupBy("kind").agg(F.max(c).alias("value")).select(F.concat(F.lit(prefix), "kind").alias("cursor"), "value")
    return one("push:", "seq").unionByName(one("read:", "t"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def scan_offset_page(spark, sf):
    w = W.orderBy(F.desc("o_totalprice"), "o_orderkey")  # after a top-150 cut, so the window sees 150 rows
    top = table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(150)
    return top.withColumn("_k", F.row_number().over(w)).filter("_k > 100").select("o_orderkey", "o_orderdate")


@query(f"WITH {STREAM} SELECT device, count(*) AS n, sum(length(props)) AS bytes, max(t) AS newest FROM s GROUP BY device")
def storage_statistics(spark, sf):
    return stream(spark, sf).groupBy("device").agg(F.count("*").alias("n"), F.sum(F.length("props")).alias("bytes"), F.max("t").alias("newest"))


@query("""SELECT 'c_acctbal' AS column_name, count(c_acctbal) AS filled, count(*) AS n FROM customer UNION ALL SELECT 'c_mktsegment', count(c_mktsegment), count(*) FROM customer
UNION ALL SELECT 'c_name', count(c_name), count(*) FROM customer""")
def column_coverage(spark, sf):
    names = ["c_acctbal", "c_mktsegment", "c_name"]
    one = table(spark, sf, "customer").agg(F.count("*").alias("n"), *(F.count(c).alias(c) for c in names))
    return one.unpivot(["n"], names, "column_name", "filled").select("column_name", "filled", "n")


@query(f"WITH {STREAM} SELECT device, t // 60 AS minute, kind, min(seq) AS seq FROM s GROUP BY ALL")
def insert_or_ignore(spark, sf):
    """The first row of each natural key stays."""
    s = stream(spark, sf).withColumn("minute", F.floor(F.col("t") / 60))
    return s.groupBy("device", "minute", "kind").agg(F.min("seq").alias("seq"))


@query(f"""WITH {STREAM}, old AS (SELECT device, kind, max(seq) AS seq, arg_max(value, seq) AS value FROM s WHERE seq % 2 = 0 GROUP BY ALL),
new AS (SELECT device, kind, max(seq) AS seq, arg_max(value, seq) AS value FROM s WHERE seq % 2 = 1 AND kind <> 'view' GROUP BY ALL)
SELECT coalesce(n.device, o.device) AS device, coalesce(n.kind, o.kind) AS kind, coalesce(n.seq, o.seq) AS seq, coalesce(n.value, o.value) AS value
FROM old o FULL JOIN new n ON o.device = n.device AND o.kind = n.kind""")
def upsert_latest_wins(spark, sf):
    s = stream(spark, sf)
    last = lambda df: df.groupBy("device", "kind").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"))
    return latest_wins(last(s.filter("seq % 2 = 0")), last(s.filter("seq % 2 = 1 AND kind <> 'view'")), ["device", "kind"])


@query(f"""WITH {DAILY}, {SHIPPED} SELECT d.device, d.day, d.n, round(coalesce(sh.quantity, d.price), 6) AS price
FROM d LEFT JOIN sh ON d.device = sh.device AND d.day = sh.day AND sh.quantity > 100""", days="day")
def upsert_preserving_columns(spark, sf):
    fresh = shipped(spark, sf).filter("quantity > 100").select("device", "day", F.col("quantity").alias("price"))
    return preserve_columns(daily(spark, sf).select("device", "day", "n", "price"), fresh, ["device", "day"], ["price"]).withColumn("price", F.round("price", 6))


@query(f"""WITH {DAILY} SELECT device, day, n FROM d WHERE NOT (device = 2 AND day BETWEEN DATE '1996-01-01' AND DATE '1996-12-31')
UNION ALL SELECT device, day, n * 10 FROM d WHERE device = 2 AND day BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND n > 2""", days="day")
def range_replace(spark, sf):
    d = daily(spark, sf).select("device", "day", "n")
    inside = (F.col("device") == 2) & F.col("day").between("1996-01-01", "1996-12-31")
    return range_replaced(d, d.filter(inside & (F.col("n") > 2)).withColumn("n", F.col("n") * 10), inside)


@query(f"WITH {STREAM} SELECT device, seq, t FROM s WHERE NOT (kind = 'error' AND device < 4) AND t BETWEEN {FROM_T} AND 1706000000")
def delete_rows(spark, sf):
    return stream(spark, sf).filter(~((F.col("kind") == "error") & (F.col("device") < 4)) & F.col("t").between(FROM_T, 1706000000)).select("device", "seq", "t")


@query(f"""WITH {STREAM}, m AS (SELECT CASE WHEN device = 5 THEN 6 ELSE device END AS device, t // 3600 AS hour, kind, seq, (device = 5) AS moved FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY device, hour, kind ORDER BY moved, seq) AS k FROM m) SELECT device, hour, kind, seq FROM r WHERE k = 1""")
def rekey_device(spark, sf):
    """Rows of one device move to another; where the key exists there, the moved row is ignored."""
    s = stream(spark, sf).select(F.when(F.col("device") == 5, 6).otherwise(F.col("device")).alias("device"), F.floor(F.col("t") / 3600).alias("hour"), "kind", "seq", (F.col("device") == 5).alias("moved"))
    return prioritised(s, ["device", "hour", "kind"], ["moved", "seq"]).drop("moved")


@query(f"""WITH {STREAM}, z AS (SELECT *, sum(length(props) * 20) OVER (PARTITION BY device ORDER BY t DESC, seq DESC) AS held, max(t) OVER (PARTITION BY device) AS newest FROM s)
SELECT device, seq FROM z WHERE t >= newest - 20 * 86400 AND held <= 40000""")
def retention_prune(spark, sf):
    """Rows of the last twenty days, newest first, while they fit in a device's budget of bytes."""
    newest = W.partitionBy("device").orderBy(F.desc("t"), F.desc("seq"))
    s = stream(spark, sf).withColumn("held", F.sum(F.length("props") * 20).over(newest)).withColumn("newest", F.max("t").over(W.partitionBy("device")))
    return s.filter((F.col("t") >= F.col("newest") - 20 * 86400) & (F.col("held") <= 40_000)).select("device", "seq")


@query(f"WITH {STREAM}, k AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY t DESC, seq DESC) AS k FROM s) SELECT device, seq, t FROM k WHERE k <= 20")
def keep_newest(spark, sf):
    w = W.partitionBy("device").orderBy(F.desc("t"), F.desc("seq"))
    return stream(spark, sf).withColumn("k", F.row_number().over(w)).filter("k <= 20").select("device", "seq", "t")


@query(f"WITH {STREAM}, k AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY t DESC, seq DESC) AS k FROM s) SELECT device, t, value, 21 - k AS place FROM k WHERE k <= 20")
def suffix_limit(spark, sf):
    """The last twenty points, in ascending order."""
    w = W.partitionBy("device").orderBy(F.desc("t"), F.desc("seq"))
    return stream(spark, sf).withColumn("k", F.row_number().over(w)).filter("k <= 20").select("device", "t", "value", (21 - F.col("k")).alias("place")).orderBy("device", "place")


@query(f"""WITH {STREAM}, z AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY t, seq) AS k, ceil(30 * 3600 * 0.001 * 1.5) AS cap FROM s WHERE t >= {FROM_T} AND t < {FROM_T} + 54 * 3600)
SELECT device, count(*) AS wanted, count(*) FILTER (k <= cap) AS served, count(*) > max(cap) AS truncated FROM z GROUP BY device""")
def read_cap(spark, sf):
    """Rows asked for and served in a window of 54 hours under a cap from the expected rate, with 1.5 headroom."""
    cap = F.ceil(F.lit(30 * 3600 * 0.001 * 1.5))
    z = stream(spark, sf).filter((F.col("t") >= FROM_T) & (F.col("t") < FROM_T + 54 * 3600)).withColumn("k", F.row_number().over(by("device", ["t", "seq"])))
    return z.groupBy("device").agg(F.count("*").alias("wanted"), F.count_if(F.col("k") <= cap).alias("served"), (F.count("*") > F.max(cap)).alias("truncated"))


@query("""SELECT p_partkey, least(greatest(p_size * 20, 1), 366) AS days, least(greatest(CAST(round(p_retailprice) AS BIGINT), 1), 1000) AS rows_limit FROM part""")
def bounded_parameters(spark, sf):
    clamp = lambda c, low, high: F.least(F.greatest(c, F.lit(low)), F.lit(high))
    return table(spark, sf, "part").select("p_partkey", clamp(F.col("p_size") * 20, 1, 366).alias("days"), clamp(F.round("p_retailprice").cast("long"), 1, 1000).alias("rows_limit"))
