"""Reports and the read interface: snapshots, series by source, readiness, forecasts, digests, suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import query
from ..operators.joins import prioritised
from ..operators.windows import by
from .aggregates import R
from .bindings import DAILY, SESSIONS, SHIPPED, STREAM, daily, sessions, shipped, stream


def metric_series(spark: SparkSession, sf: str, key: str, source: str = "auto", days: int = 30, limit: int = 1000) -> DataFrame:
    """A metric's last days: one source, or sources in order of priority that fill each other's gaps.

    ``days`` is kept within 1 to 3,660 and ``limit`` within 1 to 10,000; rows are newest first.
    """
    days, limit = max(1, min(3660, days)), max(1, min(10_000, limit))
    own = {"orders": lambda: daily(spark, sf).select("device", "day", F.col("price" if key == "value" else key).cast("double").alias("value"), F.lit("orders").alias("source"), F.lit(0).alias("rank")), "lineitem": lambda: shipped(spark, sf).select("device", "day", F.col("quantity").alias("value"), F.lit("lineitem").alias("source"), F.lit(1).alias("rank"))}
    rows = own[source]() if source != "auto" else own["orders"]().unionByName(own["lineitem"]())
    rows = prioritised(rows, ["device", "day"], ["rank"])
    last = rows.agg(F.max("day")).first()[0]
    return rows.filter(F.col("day") > F.date_sub(F.lit(last), days)).orderBy(F.desc("day"), "device").limit(limit).select("device", "day", "value", "source")


@query(f"""WITH {DAILY}, {SHIPPED}, u AS (SELECT device, day, price AS value, 'orders' AS source, 0 AS rank FROM d UNION ALL SELECT device, day, quantity, 'lineitem', 1 FROM sh), k AS (SELECT *, row_number() OVER (PARTITION BY device, day ORDER BY rank) AS k FROM u)
SELECT device, day, round(value, 6) AS value, source FROM k WHERE k = 1 AND day > (SELECT max(day) FROM u) - 180""", days="day")
def series_by_source(spark, sf):
    return metric_series(spark, sf, "value", "auto", 180, 10_000).withColumn("value", R("value"))


@query(f"""WITH {DAILY}, {SHIPPED} SELECT d.device, d.day, round(d.price, 6) AS price, round(sh.quantity, 6) AS quantity, round(avg(p.price), 6) AS week_mean FROM d LEFT JOIN sh USING (device, day) LEFT JOIN d p ON p.device = d.device AND p.day BETWEEN d.day - 7 AND d.day - 1 WHERE d.day BETWEEN DATE '1998-02-01' AND DATE '1998-02-28' GROUP BY d.device, d.day, d.price, sh.quantity""", days="day")
def day_snapshot(spark, sf):
    d = daily(spark, sf).withColumn("k", F.datediff("day", F.lit("1970-01-01").cast("date")))
    d = d.withColumn("week_mean", F.avg("price").over(W.partitionBy("device").orderBy("k").rangeBetween(-7, -1))).filter(F.col("day").between("1998-02-01", "1998-02-28"))
    return d.join(shipped(spark, sf), ["device", "day"], "left").select("device", "day", R("price").alias("price"), R("quantity").alias("quantity"), R("week_mean").alias("week_mean"))


@query(f"WITH {STREAM}, n AS (SELECT max(t) AS now FROM s) SELECT device, kind, max(t) AS newest, max(now) - max(t) AS age, max(now) - max(t) <= 86400 AS fresh FROM s, n GROUP BY ALL")
def freshness(spark, sf):
    s = stream(spark, sf)
    now = s.agg(F.max("t")).first()[0]
    return s.groupBy("device", "kind").agg(F.max("t").alias("newest")).withColumn("age", F.lit(now) - F.col("newest")).withColumn("fresh", F.col("age") <= 86400)


@query(f"WITH {SESSIONS}, z AS (SELECT *, end_t - start_t AS seconds FROM ss) SELECT device, count(*) AS sessions, round(avg(seconds) / 60, 4) AS mean_minutes, max(seconds) AS longest, round(stddev_samp(start_t % 86400) / 60, 4) AS start_spread FROM z GROUP BY device")
def session_summary(spark, sf):
    z = sessions(spark, sf).withColumn("seconds", F.col("end_t") - F.col("start_t"))
    return z.groupBy("device").agg(F.count("*").alias("sessions"), R(F.avg("seconds") / 60, 4).alias("mean_minutes"), F.max("seconds").alias("longest"), R(F.stddev_samp(F.col("start_t") % 86400) / 60, 4).alias("start_spread"))


@query(f"WITH {STREAM} SELECT device, kind, count(*) AS n, round(sum(value), 4) AS total, round(avg(bpm), 6) AS mean_bpm, round(max(bpm), 6) AS max_bpm FROM s WHERE kind IN ('click', 'purchase') GROUP BY ALL")
def workout_summary(spark, sf):
    return stream(spark, sf).filter(F.col("kind").isin("click", "purchase")).groupBy("device", "kind").agg(F.count("*").alias("n"), R(F.sum("value"), 4).alias("total"), R(F.avg("bpm")).alias("mean_bpm"), R(F.max("bpm")).alias("max_bpm"))


READY = """z AS (SELECT device, day, (price - avg(price) OVER b) / nullif(stddev_samp(price) OVER b, 0) AS z1, -(n - avg(n) OVER b) / nullif(stddev_samp(n) OVER b, 0) AS z2, avg(price) OVER a / nullif(avg(price) OVER c, 0) AS ratio, count(*) OVER b AS k FROM d
WINDOW b AS (PARTITION BY device ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY device ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), c AS (PARTITION BY device ORDER BY day ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)),
f AS (SELECT *, CASE WHEN z1 >= 0.5 THEN 'good' WHEN z1 >= -0.5 THEN 'neutral' WHEN z1 >= -1 THEN 'watch' ELSE 'bad' END AS f1, CASE WHEN z2 >= 0.5 THEN 'good' WHEN z2 >= -0.5 THEN 'neutral' WHEN z2 >= -1 THEN 'watch' ELSE 'bad' END AS f2, CASE WHEN ratio < 0.8 THEN 'watch' WHEN ratio < 1.3 THEN 'good' WHEN ratio < 1.5 THEN 'watch' ELSE 'bad' END AS f3 FROM z WHERE k >= 7 AND z1 IS NOT NULL AND z2 IS NOT NULL),
g AS (SELECT *, (f1 = 'bad')::INT + (f2 = 'bad')::INT + (f3 = 'bad')::INT AS bad, (f1 = 'good')::INT + (f2 = 'good')::INT + (f3 = 'good')::INT AS good, (f1 = 'watch')::INT + (f2 = 'watch')::INT + (f3 = 'watch')::INT AS watch FROM f)"""
LEVEL = "CASE WHEN bad >= 2 OR (f1 = 'bad' AND f3 = 'bad') THEN 'rundown' WHEN bad >= 1 THEN 'strained' WHEN good >= 2 AND watch = 0 THEN 'primed' ELSE 'balanced' END"


def readiness_rows(spark, sf):
    """Flags of two z-scores and of the load ratio, and the level that follows from them."""
    w = by("device", ["day"])
    b, a, c = w.rowsBetween(-30, -1), w.rowsBetween(-6, 0), w.rowsBetween(-27, 0)
    z = lambda x: (F.col(x) - F.avg(x).over(b)) / F.nullif(F.stddev_samp(x).over(b), F.lit(0.0))
    f = daily(spark, sf).select("device", "day", z("price").alias("z1"), (-z("n")).alias("z2"), (F.avg("price").over(a) / F.nullif(F.avg("price").over(c), F.lit(0.0))).alias("ratio"), F.count("*").over(b).alias("k")).filter("k >= 7 AND z1 IS NOT NULL AND z2 IS NOT NULL")
    flag = lambda x: F.when(F.col(x) >= 0.5, "good").when(F.col(x) >= -0.5, "neutral").when(F.col(x) >= -1, "watch").otherwise("bad")
    f = f.withColumn("f1", flag("z1")).withColumn("f2", flag("z2")).withColumn("f3", F.when(F.col("ratio") < 0.8, "watch").when(F.col("ratio") < 1.3, "good").when(F.col("ratio") < 1.5, "watch").otherwise("bad"))
    for name in ("bad", "good", "watch"):
        f = f.withColumn(name, sum((F.when(F.col(x) == name, 1).otherwise(0) for x in ("f1", "f2", "f3")), F.lit(0)))
    level = F.when((F.col("bad") >= 2) | ((F.col("f1") == "bad") & (F.col("f3") == "bad")), "rundown").when(F.col("bad") >= 1, "strained").when((F.col("good") >= 2) & (F.col("watch") == 0), "primed").otherwise("balanced")
    return f.withColumn("level", level)


@query(f"WITH {DAILY}, {READY} SELECT device, day, f1, f2, f3, {LEVEL} AS level FROM g", days="day")
def readiness(spark, sf):
    return readiness_rows(spark, sf).select("device", "day", "f1", "f2", "f3", "level")


@query(f"WITH {DAILY}, {READY}, l AS (SELECT device, day, {LEVEL} AS level, z1, ratio FROM g), s AS (SELECT device, day, unnest([CASE WHEN level = 'rundown' THEN 'rest' END, CASE WHEN z1 < -1 THEN 'sleep earlier' END, CASE WHEN ratio > 1.3 THEN 'ease load' END, CASE WHEN level = 'primed' THEN 'push' END]) AS chip FROM l) SELECT device, day, chip FROM s WHERE chip IS NOT NULL", days="day")
def suggestions(spark, sf):
    r = readiness_rows(spark, sf)
    chips = F.array(F.when(F.col("level") == "rundown", "rest"), F.when(F.col("z1") < -1, "sleep earlier"), F.when(F.col("ratio") > 1.3, "ease load"), F.when(F.col("level") == "primed", "push"))
    return r.select("device", "day", F.explode(chips).alias("chip")).filter("chip IS NOT NULL")


@query(f"""WITH {DAILY}, z AS (SELECT *, avg(price) OVER w AS m, stddev_samp(price) OVER w AS sd, regr_slope(price, day - DATE '1995-01-01') OVER w AS slope, count(*) OVER w AS k, avg(n) OVER w AS load FROM d WINDOW w AS (PARTITION BY device ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
SELECT device, day, round(m + slope - least(12, greatest(-12, 9 * (n - load) / 12)) + least(8, greatest(-8, m - price)), 4) AS forecast, round(greatest(8, sd), 4) AS band, k >= 10 AS trusted FROM z WHERE k >= 5""", days="day")
def recovery_forecast(spark, sf):
    """Tomorrow's value: the mean of fourteen nights and its slope, less the load above usual, with a reversion term."""
    w = by("device", ["day"]).rowsBetween(-13, 0)
    x = F.datediff("day", F.lit("1995-01-01").cast("date"))
    z = daily(spark, sf).select("device", "day", "price", "n", F.avg("price").over(w).alias("m"), F.stddev_samp("price").over(w).alias("sd"), F.regr_slope(F.col("price"), x).over(w).alias("slope"), F.count("*").over(w).alias("k"), F.avg("n").over(w).alias("load")).filter("k >= 5")
    clip = lambda v, c: F.least(F.lit(c), F.greatest(F.lit(-c), v))
    forecast = F.col("m") + F.col("slope") - clip(9 * (F.col("n") - F.col("load")) / 12, 12.0) + clip(F.col("m") - F.col("price"), 8.0)
    return z.select("device", "day", R(forecast, 4).alias("forecast"), R(F.greatest(F.lit(8.0), F.col("sd")), 4).alias("band"), (F.col("k") >= 10).alias("trusted"))


@query(f"""WITH {DAILY}, w AS (SELECT device, date_trunc('week', day) AS week, sum(n) AS rows_, count(*) AS days FROM d GROUP BY ALL) SELECT device, CAST(week AS DATE) AS week, CASE WHEN days >= 6 THEN 'solid' WHEN days >= 4 THEN 'building' ELSE 'calibrating' END AS confidence FROM w""", days="week")
def score_confidence(spark, sf):
    w = daily(spark, sf).groupBy("device", F.to_date(F.date_trunc("week", "day")).alias("week")).agg(F.count("*").alias("days"))
    return w.select("device", "week", F.when(F.col("days") >= 6, "solid").when(F.col("days") >= 4, "building").otherwise("calibrating").alias("confidence"))


@query(f"""WITH {DAILY}, w AS (SELECT device, CAST(date_trunc('week', day) AS DATE) AS week, avg(price) AS price, avg(n) * 100 AS n, avg(urgent) * 100 AS urgent FROM d GROUP BY ALL), u AS (SELECT * FROM w UNPIVOT (value FOR metric IN (price, n, urgent))),
c AS (SELECT a.device, a.week, a.metric, (a.value - b.value) / nullif(abs(b.value), 0) AS change FROM u a JOIN u b ON b.device = a.device AND b.metric = a.metric AND b.week = a.week - 7), k AS (SELECT *, row_number() OVER (PARTITION BY device, week ORDER BY abs(change) DESC, metric) AS k FROM c WHERE change IS NOT NULL)
SELECT device, week, metric, round(change, 6) AS change FROM k WHERE k = 1 AND abs(change) >= 0.5""", days="week")
def focal_points(spark, sf):
    """The metric that moved most in each week, if it moved by half at least."""
    w = daily(spark, sf).groupBy("device", F.to_date(F.date_trunc("week", "day")).alias("week")).agg(F.avg("price").alias("price"), (F.avg("n") * 100).alias("n"), (F.avg("urgent") * 100).alias("urgent"))
    u = w.unpivot(["device", "week"], ["price", "n", "urgent"], "metric", "value")
    before = u.select("device", "metric", F.date_add("week", 7).alias("week"), F.col("value").alias("old"))
    c = u.join(before, ["device", "metric", "week"]).withColumn("change", (F.col("value") - F.col("old")) / F.nullif(F.abs("old"), F.lit(0.0))).filter("change IS NOT NULL")
    return prioritised(c, ["device", "week"], [F.desc(F.abs("change")), "metric"]).filter(F.abs("change") >= 0.5).select("device", "week", "metric", R("change").alias("change"))


@query(f"""WITH {DAILY}, f AS (SELECT device, count(*) AS days, avg(price) / 100 AS a, avg(n) AS b, avg(urgent) AS c FROM d GROUP BY device), g AS (SELECT *, (0.05 * (a - 4) + 0.03 * (b - 2) + 0.10 * (c - 0.5)) * 0.75 / (0.6931471805599453 / 8) AS years FROM f)
SELECT device, days, round(least(90, greatest(20, 40 + years)), 6) AS body_age, round(least(100, greatest(0, 50 - 2.5 * years)), 6) AS vitality FROM g WHERE days >= 3""")
def body_age(spark, sf):
    """Summed logarithms of hazards, shrunk for overlap, as years; and a score from them."""
    f = daily(spark, sf).groupBy("device").agg(F.count("*").alias("days"), (F.avg("price") / 100).alias("a"), F.avg("n").alias("b"), F.avg("urgent").alias("c")).filter("days >= 3")
    years = (0.05 * (F.col("a") - 4) + 0.03 * (F.col("b") - 2) + 0.10 * (F.col("c") - 0.5)) * 0.75 / (0.6931471805599453 / 8)
    return f.select("device", "days", R(F.least(F.lit(90.0), F.greatest(F.lit(20.0), 40 + years))).alias("body_age"), R(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 50 - 2.5 * years))).alias("vitality"))


@query(f"WITH {STREAM}, g AS (SELECT device, kind, count(DISTINCT props) AS distinct_values, count(*) AS n, min(value) AS low, max(value) AS high FROM s GROUP BY ALL) SELECT device, kind, n, distinct_values, distinct_values = 1 AS constant_field, low, high FROM g")
def decode_coverage(spark, sf):
    g = stream(spark, sf).groupBy("device", "kind").agg(F.count("*").alias("n"), F.count_distinct("props").alias("distinct_values"), F.min("value").alias("low"), F.max("value").alias("high"))
    return g.withColumn("constant_field", F.col("distinct_values") == 1)
