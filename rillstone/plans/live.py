"""Streaming queries: windows with watermarks, duplicates, sessions, stateful detectors, over what is available."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..session import shared_folder
from ..streaming import detectors, guard
from ..streaming.ledger import Ledger
from ..streaming.sinks import available
from .aggregates import R
from .bindings import STREAM, table


def live_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files; the pattern stands for a single file as for a folder."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque*").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("device", F.col("user_id") % 8)


@query("SELECT user_id % 8 AS device, event_type AS kind, epoch_us(ts) // 3600000000 * 3600 AS start_t, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def live_tumbling(spark, sf):
    """Hourly windows; all of them are given, since the input ends."""
    g = live_events(spark, sf).groupBy("device", F.col("event_type").alias("kind"), F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return available(g.select("device", "kind", F.unix_timestamp("w.start").alias("start_t"), "n", R("total", 4).alias("total")), "complete")


@query("""WITH e AS (SELECT user_id % 8 AS device, epoch_us(ts) // 1800000000 AS k, value FROM events), s AS (SELECT device, (k - o) * 1800 AS start_t, value FROM e, (SELECT unnest([0, 1]) AS o))
SELECT device, start_t, count(*) AS n, round(avg(value), 6) AS mean FROM s GROUP BY ALL""")
def live_sliding(spark, sf):
    """Windows of an hour that start every half hour."""
    g = live_events(spark, sf).groupBy("device", F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return available(g.select("device", F.unix_timestamp("w.start").alias("start_t"), "n", R("mean").alias("mean")), "complete")


@query(f"""WITH {STREAM}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY device ORDER BY us, seq) <= 10800000000 THEN 0 ELSE 1 END AS cut FROM s), i AS (SELECT *, sum(cut) OVER (PARTITION BY device ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT device, min(t) AS start_t, count(*) AS n FROM i GROUP BY device, k""")
def live_sessions(spark, sf):
    """Sessions that end after three hours without a row."""
    g = live_events(spark, sf).groupBy("device", F.session_window("ts", "3 hours").alias("w")).agg(F.count("*").alias("n"))
    return available(g.select("device", F.unix_timestamp("w.start").alias("start_t"), "n"), "complete")


@query("SELECT DISTINCT user_id, event_type FROM events")
def live_distinct(spark, sf):
    """The first row of each key, under a watermark of forty days."""
    d = live_events(spark, sf).withWatermark("ts", "40 days").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return available(d.select("user_id", "event_type"))


@query("""WITH e AS (SELECT user_id % 8 AS device, epoch_us(ts) // 86400000000 AS day FROM events), f AS (SELECT max(epoch_us(ts)) - 6 * 3600000000 AS mark FROM events) SELECT device, day * 86400 AS start_t, count(*) AS n FROM e, f WHERE (day + 1) * 86400000000 <= mark GROUP BY ALL""")
def live_closed_days(spark, sf):
    """Day windows that a watermark of six hours has closed: later rows of them would be dropped."""
    g = live_events(spark, sf).withWatermark("ts", "6 hours").groupBy("device", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return available(g.select("device", F.unix_timestamp("w.start").alias("start_t"), "n"))


def _signal(spark, sf):
    return live_events(spark, sf).select("device", F.unix_seconds("ts").alias("t"), "value")


@query()
def live_onsets(spark, sf):
    return available(detectors.detected(_signal(spark, sf), detectors.onset, 3))


@query()
def live_alerts(spark, sf):
    return available(detectors.detected(_signal(spark, sf), detectors.latch, 1))


@query()
def live_guard(spark, sf):
    return available(detectors.detected(_signal(spark, sf), detectors.guard, 3))


@query()
def live_nudges(spark, sf):
    return available(detectors.detected(_signal(spark, sf), detectors.nudge, 2))


@query("""WITH e AS (SELECT user_id % 8 AS device, epoch_us(ts) // 1000000 AS t, value FROM events), k AS (SELECT device, t, value, unnest(range(0, 10)) AS ahead FROM e)
SELECT device, t + ahead AS at, round(median(value), 6) AS smoothed, count(*) AS n FROM k GROUP BY ALL""")
def live_smoothed(spark, sf):
    """At every second the median of the ten seconds up to it, as sliding windows of the stream."""
    g = live_events(spark, sf).groupBy("device", F.window("ts", "10 seconds", "1 second").alias("w")).agg(F.percentile("value", 0.5).alias("smoothed"), F.count("*").alias("n"))
    return available(g.select("device", (F.unix_timestamp("w.end") - 1).alias("at"), R("smoothed").alias("smoothed"), "n"), "complete")


@query()
def live_session_guard(spark, sf):
    """A guard with timers: four rows a second of time are dealt to eight devices, so that some fall silent."""
    second = F.expr("1700000000 + event_id DIV 4")
    beat = F.round(100 + 60 * F.sin(F.col("event_id") / 900) + F.col("value") % 7, 1)
    rows = live_events(spark, sf).select("device", second.alias("t"), beat.alias("value"), F.timestamp_seconds(second).alias("at")).withWatermark("at", "30 seconds")
    return available(guard.guarded(rows), settings=guard.STORE)


@query("SELECT event_id, user_id, round(value, 4) AS value FROM events")
def live_accepted(spark, sf):
    """The stream's batches through the ledger, and once more by a second run that has lost its own progress."""
    folder = shared_folder(spark, "accepted")
    ledger = Ledger(spark, folder)
    rows = live_events(spark, sf).select("event_id", "user_id", F.round("value", 4).alias("value"))
    for run in ("first", "second"):
        rows.writeStream.foreachBatch(ledger.sink()).option("checkpointLocation", f"{folder}/{run}").trigger(availableNow=True).start().awaitTermination()
    return ledger.rows(rows.schema).select("event_id", "user_id", "value")
