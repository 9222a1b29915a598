"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text
from .bindings import DAILY, SESSIONS, STREAM, daily, sessions, stream, table

# Plausible ranges of metrics.
RANGES = {"price": (5.0, 250.0), "n": (1.0, 8.0), "urgent": (0.0, 3.0)}


@query(f"WITH {STREAM} SELECT device, seq, bpm FROM s WHERE bpm BETWEEN 60 AND 120")
def plausible_range(spark, sf):
    return stream(spark, sf).filter(F.col("bpm").between(60, 120)).select("device", "seq", "bpm")


@query(f"""WITH {STREAM}, r AS (SELECT *, 60000.0 / bpm AS rr FROM s)
SELECT device, count(*) AS n, count(*) FILTER (rr BETWEEN 300 AND 2000) AS kept, round(avg(rr) FILTER (rr BETWEEN 300 AND 2000), 6) AS mean_rr FROM r GROUP BY device""")
def beat_range_filter(spark, sf):
    rr = 60000.0 / F.col("bpm")
    ok = rr.between(300, 2000)
    return stream(spark, sf).groupBy("device").agg(F.count("*").alias("n"), F.count_if(ok).alias("kept"), F.round(F.avg(F.when(ok, rr)), 6).alias("mean_rr"))


@query(f"""WITH {DAILY} SELECT device, day, CASE WHEN price BETWEEN 5 AND 250 THEN round(price, 6) END AS price, CASE WHEN n BETWEEN 1 AND 8 THEN CAST(n AS DOUBLE) END AS n,
CASE WHEN urgent BETWEEN 0 AND 3 THEN CAST(urgent AS DOUBLE) END AS urgent FROM d""", days="day")
def metric_sanity_gate(spark, sf):
    gate = lambda c: F.when(F.col(c).between(*RANGES[c]), F.col(c))
    return daily(spark, sf).select("device", "day", F.round(gate("price"), 6).alias("price"), gate("n").cast("double").alias("n"), gate("urgent").cast("double").alias("urgent"))


@query(f"WITH {STREAM}, b AS (SELECT *, min(t) OVER (PARTITION BY device) AS oldest FROM s) SELECT device, count(*) AS n FROM b WHERE t >= 1577836800 AND t <= 1706300000 + 86400 AND t >= oldest + 3600 GROUP BY device")
def plausible_timestamps(spark, sf):
    s = stream(spark, sf).withColumn("oldest", F.min("t").over(W.partitionBy("device")))
    return s.filter((F.col("t") >= 1577836800) & (F.col("t") <= 1706300000 + 86400) & (F.col("t") >= F.col("oldest") + 3600)).groupBy("device").agg(F.count("*").alias("n"))


@query(f"WITH {DAILY} SELECT device, day, n FROM d WHERE strftime(day, '%Y-%m-%d') LIKE '1997-05-%'", days="day")
def month_prefix(spark, sf):
    """A month by its prefix, as a range of dates that a scan can skip by."""
    return daily(spark, sf).filter((F.col("day") >= "1997-05-01") & (F.col("day") < "1997-06-01")).select("device", "day", "n")


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'fast' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'unknown' ELSE 'slow' END AS class,
regexp_replace(lower(o_orderpriority), '[^a-z]+', '', 'g') AS folded FROM orders""")
def source_classification(spark, sf):
    p = F.col("o_orderpriority")
    kind = F.when(p.isin("1-URGENT", "2-HIGH"), "fast").when(p == "4-NOT SPECIFIED", "unknown").otherwise("slow")
    return table(spark, sf, "orders").select("o_orderkey", kind.alias("class"), text.folded(p).alias("folded"))


@query(f"WITH {STREAM}, m AS (SELECT *, (t // 60) % 1440 AS minute FROM s) SELECT device, count(*) FILTER (minute >= 1320 OR minute < 420) AS quiet, count(*) FILTER (minute >= 540 AND minute < 1020) AS active FROM m GROUP BY device")
def window_of_day(spark, sf):
    """Minutes of a day in an interval that may pass midnight."""
    m = stream(spark, sf).withColumn("minute", F.floor(F.col("t") / 60) % 1440)
    inside = lambda a, b: (F.col("minute") >= a) & (F.col("minute") < b) if a <= b else (F.col("minute") >= a) | (F.col("minute") < b)
    return m.groupBy("device").agg(F.count_if(inside(1320, 420)).alias("quiet"), F.count_if(inside(540, 1020)).alias("active"))


@query(f"WITH {SESSIONS} SELECT device, start_t, end_t FROM ss WHERE NOT EXISTS (SELECT 1 FROM ss x WHERE x.device = ss.device AND x.n >= 12 AND x.start_t < ss.end_t + 1800 AND ss.start_t - 1800 < x.end_t AND x.start_t <> ss.start_t)")
def suppressed_spans(spark, sf):
    """Sessions that no large other session (widened by half an hour) overlaps: the neighbours on both sides decide."""
    from ..operators.joins import overlapping

    a = sessions(spark, sf)
    wide = a.select("device", F.col("start_t").alias("own"), (F.col("start_t") - 1800).alias("a_start"), (F.col("end_t") + 1800).alias("a_end"))
    big = a.filter("n >= 12").select("device", F.col("start_t").alias("other"), F.col("start_t").alias("b_start"), F.col("end_t").alias("b_end"))
    hit = overlapping(wide, big, "device", 86400).filter("own <> other").select("device", F.col("own").alias("start_t")).distinct()
    return a.join(hit, ["device", "start_t"], "left_anti").select("device", "start_t", "end_t")


@query(f"WITH {DAILY}, x AS (SELECT device, max(day) AS day FROM d WHERE urgent > 0 AND day <= DATE '1998-06-15' GROUP BY device) SELECT x.device, x.day, d.urgent FROM x JOIN d USING (device, day) WHERE x.day > DATE '1998-06-15' - 7", days="day")
def freshest_carried(spark, sf):
    rows = daily(spark, sf).filter("urgent > 0 AND day <= DATE '1998-06-15'").groupBy("device").agg(F.max("day").alias("day"), F.max_by("urgent", "day").alias("urgent"))
    return rows.filter("day > DATE '1998-06-15' - INTERVAL 7 DAYS")


@query(f"WITH {DAILY} SELECT device, max(day) FILTER (urgent > 1) AS last_urgent, max(day) FILTER (price IS NOT NULL) AS last_price FROM d GROUP BY device", days="last_urgent last_price")
def last_day_with_metric(spark, sf):
    return daily(spark, sf).groupBy("device").agg(F.max(F.when(F.col("urgent") > 1, F.col("day"))).alias("last_urgent"), F.max(F.when(F.col("price").isNotNull(), F.col("day"))).alias("last_price"))


@query(f"""WITH {DAILY} SELECT device, day, urgent > 0 AS has_urgent, low > 0 AS has_low, (CASE WHEN urgent > 0 THEN 1 ELSE 0 END + CASE WHEN high > 0 THEN 1 ELSE 0 END + CASE WHEN low > 0 THEN 1 ELSE 0 END) >= 2 AS complete FROM d""", days="day")
def completeness_flags(spark, sf):
    have = [F.when(F.col(c) > 0, 1).otherwise(0) for c in ("urgent", "high", "low")]
    return daily(spark, sf).select("device", "day", (F.col("urgent") > 0).alias("has_urgent"), (F.col("low") > 0).alias("has_low"), (sum(have[1:], have[0]) >= 2).alias("complete"))


@query("SELECT event_id, coalesce(CAST(json_extract_string(props, '$.kk') AS BIGINT), CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM events")
def coalesced_json(spark, sf):
    return table(spark, sf, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.kk").cast("long"), F.get_json_object("props", "$.k").cast("long"), F.lit(-1).cast("long")).alias("k"))
