"""JSON exports of two more makers, and whole exports of sleeps, workouts and answers, written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..session import shared_folder
from ..sources import exports, files, wearables
from .aggregates import R
from .bindings import SESSIONS, STREAM, sessions, stream


def _lines(rows) -> str:
    path = shared_folder(rows.sparkSession, "wearable")
    rows.write.option("ignoreNullFields", False).json(path)
    return path


def _iso(c):
    return F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss.SSS")


@query(f"""WITH {SESSIONS} SELECT CAST(make_timestamp(end_t * 1000000) AS DATE) AS day, start_t AS start_ts, end_t AS end_ts, CASE WHEN n % 5 > 0 THEN CAST(n % 5 AS DOUBLE) END AS deep_min, CAST(n AS DOUBLE) AS total_min,
CASE WHEN n % 2 = 0 THEN CAST(n + 1 AS DOUBLE) END AS awake_min, 'light:' || start_t || ':' || (start_t + 600) || ',wake:' || (start_t + 600) || ':' || (start_t + 660) AS stages FROM ss WHERE end_t > start_t""", days="day")
def file_tracker_sleep(spark, sf):
    """Sleep logs with stages by name; a length that is not positive and a log without a span are left out."""
    s, t = sessions(spark, sf), F.col("start_t")
    piece = lambda at, seconds, level: F.struct(_iso(at).alias("dateTime"), F.lit(seconds).cast("double").alias("seconds"), F.lit(level).alias("level"))
    data = F.array(piece(t + 600, 60, "restless"), piece(t, 600, "ASLEEP"), piece(t, 0, "deep"))
    summary = F.struct(F.struct((F.col("n") % 5).cast("double").alias("minutes")).alias("deep"))
    log = s.select(_iso(t).alias("startTime"), _iso(F.col("end_t")).alias("endTime"), F.col("n").cast("double").alias("minutesAsleep"), F.when(F.col("n") % 2 == 0, F.col("n") + 1.0).alias("minutesAwake"), F.struct(summary.alias("summary"), data.alias("data")).alias("levels"))
    rows = wearables.tracker_sleeps(spark, _lines(log))
    text = F.array_join(F.transform("stages", lambda x: F.concat_ws(":", x["stage"], x["start"], x["end"])), ",")
    return rows.select("day", "start_ts", "end_ts", "deep_min", "total_min", "awake_min", text.alias("stages"))


@query(f"""WITH {STREAM}, k AS (SELECT *, CAST(make_timestamp(us) AS DATE) AS day FROM s), st AS (SELECT day, sum(seq % 50) AS steps FROM k GROUP BY day), r AS (SELECT day, max(40 + seq % 30) AS resting FROM k WHERE seq % 3 <> 0 GROUP BY day)
SELECT day, CAST(resting AS INT) AS resting_hr, CAST(steps AS BIGINT) AS steps FROM st LEFT JOIN r USING (day) WHERE steps > 0""", days="day")
def file_tracker_days(spark, sf):
    """Counts under American dates, resting rates as numbers or objects, joined by day."""
    s = stream(spark, sf)
    steps = s.select(F.date_format(F.timestamp_seconds("t"), "MM/dd/yy HH:mm:ss").alias("dateTime"), (F.col("seq") % 50).cast("string").alias("value"))
    rate = 40 + F.col("seq") % 30
    resting = s.select(F.date_format(F.timestamp_seconds("t"), "MM/dd/yy HH:mm:ss").alias("dateTime"), F.when(F.col("seq") % 3 == 0, "-1").when(F.col("seq") % 2 == 0, F.concat(F.lit('{"value":'), rate, F.lit("}"))).otherwise(rate.cast("string")).alias("value"))
    both = wearables.tracker_steps(spark, _lines(steps)).join(wearables.tracker_resting(spark, _lines(resting)), "day", "left")
    return both.select("day", "resting_hr", "steps")


@query(f"""WITH {SESSIONS} SELECT CAST(make_timestamp(end_t * 1000000) AS DATE) AS day, start_t AS start_ts, end_t AS end_ts, round((n % 7 + n) / 60.0, 6) AS total_min, CASE WHEN n % 7 > 0 THEN round(n % 7 / 60.0, 6) END AS deep_min, CASE WHEN n % 4 > 0 THEN CAST(n % 4 AS DOUBLE) ELSE 33.0 END AS score FROM ss WHERE end_t > start_t""", days="day")
def file_account_sleep(spark, sf):
    """Sleep files under both spellings: milliseconds and seconds, a score of its own or nested."""
    s, even = sessions(spark, sf), F.col("n") % 2 == 0
    double = lambda c: c.cast("double")
    log = s.select(
        F.when(even, (F.col("start_t") * 1000).cast("string")).alias("sleepStartTimestampGMT"), F.when(even, (F.col("end_t") * 1000).cast("string")).alias("sleepEndTimestampGMT"), F.when(~even, double(F.col("start_t"))).alias("StartTimeInSeconds"), F.when(~even, double(F.col("end_t"))).alias("EndTimeInSeconds"),
        F.when(even, double(F.col("n") % 7)).alias("deepSleepSeconds"), F.when(~even, double(F.col("n") % 7)).alias("DeepSleepDurationInSeconds"), double(F.col("n")).alias("remSleepSeconds"), double(F.col("n") % 4).alias("overallSleepScore"), F.struct(F.struct(F.lit(33.0).alias("value")).alias("overall")).alias("sleepScores"),
    )
    return wearables.account_sleeps(spark, _lines(log)).select("day", "start_ts", "end_ts", R("total_min").alias("total_min"), R("deep_min").alias("deep_min"), "score")


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY ALL) SELECT day, CAST(n AS DOUBLE) AS steps, CAST(40 + n AS DOUBLE) AS resting_hr, CASE WHEN n % 3 > 0 THEN CAST(n % 3 AS DOUBLE) END AS stress FROM d""", days="day")
def file_account_days(spark, sf):
    """Daily summaries under both spellings."""
    from .imports import _order_days

    d, even = _order_days(spark, sf), F.col("n") % 2 == 0
    n = F.col("n").cast("double")
    doc = d.select(F.when(even, F.col("day").cast("string")).alias("calendarDate"), F.when(~even, F.col("day").cast("string")).alias("calendar_date"), F.when(even, n).alias("totalSteps"), F.when(~even, n).alias("steps"), (40 + n).alias("restingHeartRate"), (n % 3).alias("avgStressLevel"))
    return wearables.account_days(spark, _lines(doc)).select("day", "steps", "resting_hr", "stress")


@query(f"WITH {SESSIONS} SELECT start_t AS start_ts, end_t AS end_ts, n % 5 = 0 AS is_nap, CAST(n AS DOUBLE) AS asleep_min, 0.85::DOUBLE AS efficiency FROM ss")
def export_sleeps(spark, sf):
    """Sleeps of zones on both sides of UTC, exported and read back."""
    path = shared_folder(spark, "export")
    s = sessions(spark, sf).select(F.col("start_t").alias("start_ts"), F.col("end_t").alias("end_ts"), ((F.col("n") % 5 - 2) * 90).cast("int").alias("offset"), (F.col("n") % 5 == 0).alias("is_nap"), F.col("n").cast("double").alias("asleep_min"), F.lit(0.85).alias("efficiency"))
    exports.write_sleeps(s, path)
    return files.read_sleeps(spark, path).select("start_ts", "end_ts", "is_nap", "asleep_min", R("efficiency", 4).alias("efficiency"))


@query(f"WITH {SESSIONS} SELECT start_t AS start_ts, end_t AS end_ts, CASE WHEN n % 2 = 0 THEN 'Run, \"easy\"' ELSE 'Ride' END AS sport, CAST(n % 100 AS DOUBLE) AS strain, CAST(n AS DOUBLE) AS distance_m, CAST(n % 60 AS DOUBLE) AS zone_2 FROM ss")
def export_workouts(spark, sf):
    path = shared_folder(spark, "export")
    n = F.col("n").cast("double")
    w = sessions(spark, sf).select(F.col("start_t").alias("start_ts"), F.col("end_t").alias("end_ts"), F.lit(-210).alias("offset"), F.when(F.col("n") % 2 == 0, 'Run, "easy"').otherwise("Ride").alias("sport"), (n % 100).alias("strain"), n.alias("energy_kcal"), n.alias("avg_hr"), n.alias("max_hr"), n.alias("distance_m"), F.array(F.lit(0.0), n % 60).alias("zones"))
    exports.write_workouts(w, path)
    return files.read_workouts(spark, path).select("start_ts", "end_ts", "sport", R("strain", 4).alias("strain"), "distance_m", F.col("zones")[1].alias("zone_2"))


@query(f"WITH {SESSIONS} SELECT start_t AS cycle_start, 'q' || n % 3 AS question, CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END AS answer, 'a, \"b\"' AS notes, count(*) AS n FROM ss GROUP BY ALL")
def export_journal(spark, sf):
    path = shared_folder(spark, "export")
    a = sessions(spark, sf).select(F.col("start_t").alias("cycle_start"), F.lit(90).alias("offset"), F.concat(F.lit("q"), F.col("n") % 3).alias("question"), (F.col("n") % 2 == 0).alias("answer"), F.lit('a, "b"').alias("notes"))
    exports.write_journal(a, path)
    return files.read_journal(spark, path).groupBy("cycle_start", "question", "answer", "notes").agg(F.count("*").alias("n"))
