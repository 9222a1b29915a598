"""JSON exports of two more makers: a tracker's logs (sleep, resting rate, steps) and a watch account's daily files.

Files hold a document a line, or one array each (``whole``: then a file is one task). Times without an offset are taken as
UTC; what is not positive is null where zero means absence; a sleep without a span that can be read is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What the tracker's stage names mean; anything else is awake.
STAGES = {"deep": "deep", "rem": "rem", "light": "light", "asleep": "light"}
#: The columns of a sleep.
SLEEP = ("day", "start_ts", "end_ts", "deep_min", "light_min", "rem_min", "awake_min", "total_min", "efficiency", "resting_hr", "hrv", "resp_rate", "score")


def _at(c: Column) -> Column:
    """Epoch seconds of a time in one of the exports' forms."""
    text = F.trim(c)
    tried = [F.try_to_timestamp(text), *(F.try_to_timestamp(text, F.lit(p)) for p in ("MM/dd/yy HH:mm:ss", "MM/dd/yy"))]
    return F.unix_timestamp(F.coalesce(*tried))


def _day(c: Column) -> Column:
    """The day of a time, or of the ten characters that it begins with."""
    return F.coalesce(F.to_date(F.timestamp_seconds(_at(c))), F.try_to_timestamp(F.substring(F.trim(c), 1, 10)).cast("date"))


def _above(c: Column) -> Column:
    return F.when(c > 0, c)


def tracker_sleeps(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """A tracker's sleep logs: the columns ``SLEEP`` and stages (stage, start, end) in order."""
    log = """dateOfSleep string, startTime string, endTime string, minutesAsleep double, minutesAwake double, efficiency double,
        levels struct<summary:map<string,struct<minutes:double>>,data:array<struct<dateTime:string,seconds:double,level:string>>>"""
    raw = spark.read.json(path, schema=log, multiLine=whole)
    minutes = lambda k: _above(F.col("levels.summary")[k]["minutes"])
    named = F.create_map(*(F.lit(x) for pair in STAGES.items() for x in pair))
    span = lambda s: F.struct(_at(s["dateTime"]).alias("start"), (_at(s["dateTime"]) + s["seconds"].cast("long")).alias("end"), F.coalesce(named[F.lower(s["level"])], F.lit("wake")).alias("stage"))
    good = F.filter("levels.data", lambda s: (s["seconds"] > 0) & _at(s["dateTime"]).isNotNull() & s["level"].isNotNull())
    nothing = F.lit(None).cast("double")
    rows = raw.select(
        F.coalesce(F.try_to_timestamp("dateOfSleep").cast("date"), F.to_date(F.timestamp_seconds(_at(F.col("endTime"))))).alias("day"), _at(F.col("startTime")).alias("start_ts"), _at(F.col("endTime")).alias("end_ts"),
        minutes("deep").alias("deep_min"), minutes("light").alias("light_min"), minutes("rem").alias("rem_min"), F.coalesce(minutes("wake"), _above(F.col("minutesAwake"))).alias("awake_min"),
        _above(F.col("minutesAsleep")).alias("total_min"), _above(F.col("efficiency")).alias("efficiency"), *(nothing.alias(c) for c in SLEEP[9:]), F.array_sort(F.transform(good, span)).alias("stages"),
    )
    return rows.filter("end_ts > start_ts")


def tracker_resting(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """day and resting_hr; the value is a number, or an object that holds one."""
    raw = spark.read.json(path, schema="dateTime string, value string", multiLine=whole)
    value = F.coalesce(F.get_json_object("value", "$.value"), F.col("value")).try_cast("double")
    rows = raw.select(_day(F.col("dateTime")).alias("day"), _above(F.round(value).cast("int")).alias("resting_hr")).filter("day IS NOT NULL AND resting_hr IS NOT NULL")
    return rows.groupBy("day").agg(F.max("resting_hr").alias("resting_hr"))


def tracker_steps(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """day and the sum of its counts; days without a step are left out."""
    raw = spark.read.json(path, schema="dateTime string, value string", multiLine=whole)
    rows = raw.select(_day(F.col("dateTime")).alias("day"), F.col("value").try_cast("double").cast("long").alias("v")).filter("day IS NOT NULL AND v >= 0")
    return rows.groupBy("day").agg(F.sum("v").alias("steps")).filter("steps > 0")


def _instant(ms: str, seconds: str) -> Column:
    """Epoch seconds of a field in milliseconds (or seconds, or text), or of another in seconds."""
    number = F.col(ms).try_cast("double")
    return F.coalesce(F.when(number >= 1e11, number / 1000).otherwise(number).cast("long"), _at(F.col(ms)), F.col(seconds).cast("long"))


def account_sleeps(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """A watch account's sleep files, under either of their two spellings: the columns ``SLEEP``."""
    seconds = {"deep_min": ("deepSleepSeconds", "DeepSleepDurationInSeconds"), "light_min": ("lightSleepSeconds", "LightSleepDurationInSeconds"), "rem_min": ("remSleepSeconds", "RemSleepInSeconds"), "awake_min": ("awakeSleepSeconds", "AwakeDurationInSeconds")}
    names = [n for pair in seconds.values() for n in pair]
    doc = ", ".join(["calendarDate string, sleepStartTimestampGMT string, sleepEndTimestampGMT string, StartTimeInSeconds double, EndTimeInSeconds double", *(f"{n} double" for n in names)])
    doc += ", restingHeartRate double, avgOvernightHrv double, averageHrvValue double, averageRespirationValue double, averageRespiration double, overallSleepScore double, sleepScores struct<overall:struct<value:double>>"
    raw = spark.read.json(path, schema=doc, multiLine=whole)
    first = lambda *cs: F.coalesce(*(_above(F.col(c)) for c in cs))
    rows = raw.select(_instant("sleepStartTimestampGMT", "StartTimeInSeconds").alias("start_ts"), _instant("sleepEndTimestampGMT", "EndTimeInSeconds").alias("end_ts"), F.try_to_timestamp("calendarDate").cast("date").alias("_day"), *((first(*pair) / 60).alias(c) for c, pair in seconds.items()), first("restingHeartRate").alias("resting_hr"), first("avgOvernightHrv", "averageHrvValue").alias("hrv"), first("averageRespirationValue", "averageRespiration").alias("resp_rate"), first("overallSleepScore", "sleepScores.overall.value").alias("score"))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in ("deep_min", "light_min", "rem_min")), F.lit(0.0))
    rows = rows.withColumns({"day": F.coalesce("_day", F.to_date(F.timestamp_seconds("end_ts"))), "total_min": _above(total), "efficiency": F.lit(None).cast("double")})
    return rows.filter("end_ts > start_ts").select(*SLEEP)


def account_days(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """A watch account's daily summaries: day, resting_hr, steps, distance_m, active_kcal, stress."""
    pairs = {"resting_hr": ("restingHeartRate", "restingHeartRateInBeatsPerMinute"), "steps": ("totalSteps", "steps"), "distance_m": ("totalDistanceMeters", "totalDistanceInMeters"), "active_kcal": ("activeKilocalories", "activeCalories"), "stress": ("averageStressLevel", "avgStressLevel")}
    doc = ", ".join(["calendarDate string, calendar_date string", *(f"{n} double" for pair in pairs.values() for n in pair)])
    raw = spark.read.json(path, schema=doc, multiLine=whole).withColumn("day", F.try_to_timestamp(F.coalesce("calendarDate", "calendar_date")).cast("date")).filter("day IS NOT NULL")
    return raw.groupBy("day").agg(*(F.max(F.coalesce(*(_above(F.col(n)) for n in pair))).alias(c) for c, pair in pairs.items()))


def merged_days(sleeps: DataFrame, *days: DataFrame) -> DataFrame:
    """A row a day: of its sleeps the one that ends first gives the night's columns, then those of the day tables."""
    night = sleeps.groupBy("day").agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("end_ts"))).alias(c) for c in ("total_min", "deep_min", "light_min", "rem_min", "awake_min", "efficiency")))
    out = night
    for d in days:
        out = out.join(d, "day", "full")
    return out
