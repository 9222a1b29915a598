"""Readers of exported files: delimited text, health XML, track points, JSON documents, newline-delimited batches.

Each gives a DataFrame in the shapes of ``schemas``; files are split and read by Spark's own sources wherever there is
one. Malformed cells become null, malformed records are left out, and counts of both can be taken from the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

# Names under which exports give a column, in order of preference.
ALIASES = {
    "day": ("cycle_start_time", "date", "day"),
    "recovery": ("recovery_score_pct", "recovery_score", "recovery"),
    "resting_hr": ("resting_heart_rate_bpm", "resting_heart_rate", "rhr"),
    "hrv": ("heart_rate_variability_ms", "hrv_ms", "hrv"),
    "skin_temp_c": ("skin_temp_celsius", "skin_temp_c"),
    "skin_temp_f": ("skin_temp_f", "skin_temp_fahrenheit"),
    "strain": ("day_strain", "strain"),
    "efficiency": ("sleep_efficiency_pct", "sleep_efficiency"),
}


def delimiter_of(first_line: str) -> str:
    """The commonest of comma, semicolon and tab in a header; a comma if there is none."""
    return max(",;\t", key=first_line.count)


def snake_name(header: str) -> str:
    import re

    named = header.replace("﻿", "").strip().lower().replace("%", " pct ")
    return re.sub(r"[^a-z0-9]+", "_", named).strip("_")


def holds_quoted_lines(lines: DataFrame) -> bool:
    """Whether a quoted cell may hold a line end: then, and only then, some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return bool(lines.filter(quotes % 2 == 1).take(1))


def read_delimited(spark: SparkSession, path: str, quoted_lines: bool | None = None) -> DataFrame:
    """A delimited file with a header, quoted cells that may hold line ends, any of three delimiters; all cells as text.

    Only the first line is looked at on the driver. Where no cell holds a line end (``quoted_lines`` says so, or a pass
    over the lines tells), large files are split among tasks; else a file is one task.
    """
    head = spark.read.text(path).limit(1).collect()
    if not head:
        return spark.createDataFrame([], "empty string")
    if quoted_lines is None:
        quoted_lines = holds_quoted_lines(spark.read.text(path))
    df = spark.read.csv(path, header=True, sep=delimiter_of(head[0][0]), multiLine=quoted_lines, quote='"', escape='"', enforceSchema=False)
    names: list[str] = []
    for c in df.columns:
        n = snake_name(c) or "column"
        names.append(n if n not in names else f"{n}_{len(names)}")
    return df.toDF(*names)


def cell(df: DataFrame, *names: str) -> Column:
    """The first non-empty of several columns, as text; null if none is there."""
    there = [F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def number(c: Column) -> Column:
    """A number in either decimal convention, or with an exponent; null if it is none."""
    power = F.when(F.trim(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)[eE][+-]?\d+$"), F.trim(c).try_cast("double"))
    plain = F.regexp_replace(c, r"[^0-9,.\-]", "")
    point = F.when(plain.contains(",") & ~plain.contains("."), F.replace(plain, F.lit(","), F.lit("."))).otherwise(F.replace(plain, F.lit(","), F.lit("")))
    return F.coalesce(power, point.try_cast("double"))


def flag(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin("true", "yes", "1", "y", "ja", "oui", "si"), True).when(low.isin("false", "no", "0", "n", "nein", "non"), False)


def read_cycles(spark: SparkSession, path: str) -> DataFrame:
    """Daily rows of an exported table: percentages as fractions, Fahrenheit as Celsius, strain 0-21 as 0-100."""
    raw = read_delimited(spark, path)
    get = lambda k: cell(raw, *ALIASES[k])
    celsius = F.coalesce(number(get("skin_temp_c")), (number(get("skin_temp_f")) - 32) * 5 / 9)
    day = get("day")
    return raw.select(
        _day(day).alias("day"),
        number(get("recovery")).alias("recovery"), number(get("resting_hr")).cast("int").alias("resting_hr"), number(get("hrv")).alias("hrv"),
        celsius.alias("skin_temp_c"), (number(get("strain")) * 100 / 21).alias("strain"), (number(get("efficiency")) / 100).alias("efficiency"),
    ).filter("day IS NOT NULL")


def zone_minutes(c: Column) -> Column:
    """Minutes east of UTC in texts like ``UTC+05:30``; none are 0."""
    part = lambda k: F.coalesce(F.regexp_extract(c, r"([+-])(\d{1,2}):?(\d{2})?", k).try_cast("int"), F.lit(0))
    return F.coalesce(F.when(c.contains("-"), -1).otherwise(1) * (part(2) * 60 + part(3)), F.lit(0))


def local_seconds(c: Column, zone: Column) -> Column:
    """Epoch seconds of a wall time of a zone; null if it cannot be read."""
    wall = F.replace(F.substring(F.trim(c), 1, 19), F.lit("T"), F.lit(" "))
    return F.unix_timestamp(F.try_to_timestamp(F.concat(wall, F.lit(" +0000")), F.lit("yyyy-MM-dd HH:mm:ss Z"))) - zone_minutes(zone) * 60


def read_sleeps(spark: SparkSession, path: str) -> DataFrame:
    """Sleeps of an exported table, times as epoch seconds; rows without any time are left out."""
    raw = read_delimited(spark, path)
    at = lambda c: local_seconds(cell(raw, c), cell(raw, "cycle_timezone"))
    stages = {"asleep_min": ("asleep_duration_min",), "in_bed_min": ("in_bed_duration_min",), "light_min": ("light_sleep_duration_min",), "deep_min": ("deep_sws_duration_min", "deep_sleep_duration_min"), "rem_min": ("rem_duration_min",), "awake_min": ("awake_duration_min",)}
    rows = raw.select(
        at("cycle_start_time").alias("cycle_start"), at("sleep_onset").alias("start_ts"), at("wake_onset").alias("end_ts"), F.coalesce(flag(cell(raw, "nap")), F.lit(False)).alias("is_nap"),
        *(number(cell(raw, *names)).alias(c) for c, names in stages.items()), (number(cell(raw, "sleep_efficiency_pct")) / 100).alias("efficiency"), number(cell(raw, "respiratory_rate_rpm", "respiratory_rate")).alias("resp_rate"),
    )
    return rows.filter("coalesce(cycle_start, start_ts, end_ts) IS NOT NULL")


def read_workouts(spark: SparkSession, path: str) -> DataFrame:
    """Workouts of an exported table: strain 0-21 as 0-100, zones 1 to 5 as percentages; rows without any time are left out."""
    raw = read_delimited(spark, path)
    at = lambda c: local_seconds(cell(raw, c), cell(raw, "cycle_timezone"))
    zones = F.array(*(number(cell(raw, f"hr_zone_{k}_pct", f"zone_{k}_pct", f"hr_zone_{k}_pct_pct")) for k in range(1, 6)))
    rows = raw.select(
        at("cycle_start_time").alias("cycle_start"), at("workout_start_time").alias("start_ts"), at("workout_end_time").alias("end_ts"), cell(raw, "activity_name").alias("sport"),
        (number(cell(raw, "activity_strain")) * 100 / 21).alias("strain"), number(cell(raw, "energy_burned_cal")).alias("energy_kcal"), number(cell(raw, "average_hr_bpm", "average_heart_rate_bpm")).alias("avg_hr"),
        number(cell(raw, "max_hr_bpm", "max_heart_rate_bpm")).alias("max_hr"), number(cell(raw, "distance_meters", "distance_meter")).alias("distance_m"), zones.alias("zones"),
    )
    return rows.filter("coalesce(cycle_start, start_ts, end_ts) IS NOT NULL")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Journal answers of an exported table; rows without question, answer and notes are left out."""
    raw = read_delimited(spark, path)
    rows = raw.select(
        local_seconds(cell(raw, "cycle_start_time"), cell(raw, "cycle_timezone")).alias("cycle_start"), cell(raw, "question_text", "question").alias("question"),
        cell(raw, "answered_yes", "answered_yes_no", "answer", "answer_text").alias("answer"), cell(raw, "notes").alias("notes"),
    )
    return rows.filter("coalesce(question, answer, notes) IS NOT NULL")


def _day(c: Column) -> Column:
    """A day in ISO, d/m/y or d.m.y form."""
    first = F.split(F.trim(c), r"[ T]")[0]
    return F.coalesce(*(F.try_to_timestamp(first, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy")))


def read_health_records(spark: SparkSession, path: str) -> DataFrame:
    """kind, start, end, value, source of the records of a health export in XML; equal records once."""
    schema = "_type string, _sourceName string, _unit string, _startDate string, _endDate string, _value string"
    raw = spark.read.format("xml").option("rowTag", "Record").option("mode", "DROPMALFORMED").schema(schema).load(path)
    at = lambda c: F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd HH:mm:ss Z"))
    rows = raw.select(F.regexp_replace("_type", r"^HK(Quantity|Category)TypeIdentifier", "").alias("kind"), at("_startDate").alias("start"), at("_endDate").alias("end"), F.col("_value").try_cast("double").alias("value"), F.col("_sourceName").alias("source"))
    return rows.filter("start IS NOT NULL").dropDuplicates()


def health_days(records: DataFrame) -> DataFrame:
    """Per day: steps of the source with most, mean and highest heart rate, the day's last weight."""
    r = records.withColumn("day", F.to_date("start"))
    steps = r.filter("kind = 'StepCount'").groupBy("day", "source").agg(F.sum("value").alias("v")).groupBy("day").agg(F.max("v").alias("steps"))
    heart = r.filter("kind = 'HeartRate'").groupBy("day").agg(F.avg("value").alias("avg_hr"), F.max("value").alias("max_hr"))
    weight = r.filter("kind = 'BodyMass'").groupBy("day").agg(F.max_by("value", "start").alias("weight_kg"))
    return steps.join(heart, "day", "full").join(weight, "day", "full")


def read_gpx(spark: SparkSession, path: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """ts, lat, lon, ele, hr of the track points of GPX files, and ``keys``, partition columns of their folders."""
    schema = "_lat double, _lon double, ele double, time string, extensions struct<`gpxtpx:TrackPointExtension`:struct<`gpxtpx:hr`:int>>"
    raw = spark.read.format("xml").option("rowTag", "trkpt").schema(schema).load(path)
    points = raw.select(*keys, F.try_to_timestamp("time").alias("ts"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), "ele", F.col("extensions.`gpxtpx:TrackPointExtension`.`gpxtpx:hr`").alias("hr"))
    return points.filter(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & F.col("ts").isNotNull())


def read_tcx(spark: SparkSession, path: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """ts, lat, lon, ele, hr, distance of the track points of TCX files, and ``keys``, partition columns of their folders."""
    schema = "Time string, Position struct<LatitudeDegrees:double,LongitudeDegrees:double>, AltitudeMeters double, DistanceMeters double, HeartRateBpm struct<Value:int>"
    raw = spark.read.format("xml").option("rowTag", "Trackpoint").schema(schema).load(path)
    return raw.select(*keys, F.try_to_timestamp("Time").alias("ts"), F.col("Position.LatitudeDegrees").alias("lat"), F.col("Position.LongitudeDegrees").alias("lon"), F.col("AltitudeMeters").alias("ele"), F.col("HeartRateBpm.Value").alias("hr"), F.col("DistanceMeters").alias("distance")).filter("ts IS NOT NULL")


def activity(points: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Points, distance by great circles, ascent and mean heart rate of each track."""
    from pyspark.sql import Window as W

    key = key or []
    w = W.partitionBy(*key).orderBy("ts")
    half = lambda a, b: F.pow(F.sin((a - b) / 2), 2)
    lat, lon = F.radians("lat"), F.radians("lon")
    lat0, lon0 = F.lag(lat).over(w), F.lag(lon).over(w)
    hop = 2 * 6_371_000 * F.asin(F.sqrt(half(lat, lat0) + F.cos(lat0) * F.cos(lat) * half(lon, lon0)))
    rows = points.withColumn("_hop", hop).withColumn("_up", F.greatest(F.lit(0.0), F.col("ele") - F.lag("ele").over(w)))
    ok = F.when(F.col("hr").between(30, 250), F.col("hr"))
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.coalesce(F.sum("_hop"), F.lit(0.0)).alias("distance_m"), F.coalesce(F.sum("_up"), F.lit(0.0)).alias("ascent_m"), F.avg(ok).alias("avg_hr"))


def read_lifting(spark: SparkSession, path: str) -> DataFrame:
    """Sessions of a lifting log: sets, exercises and volume (weight times repetitions)."""
    raw = read_delimited(spark, path)
    start = cell(raw, "start_time", "date", "workout_date")
    rows = raw.select(start.alias("start"), cell(raw, "title", "workout_name").alias("title"), cell(raw, "exercise_title", "exercise_name").alias("exercise"), number(cell(raw, "weight_kg", "weight")).alias("weight"), number(cell(raw, "reps")).alias("reps"))
    return rows.filter("start IS NOT NULL").groupBy("start", "title").agg(F.count("*").alias("sets"), F.count_distinct("exercise").alias("exercises"), F.sum(F.coalesce(F.col("weight") * F.col("reps"), F.lit(0.0))).alias("volume"))


def read_nutrition(spark: SparkSession, path: str) -> DataFrame:
    """kcal and macros by day; columns are found by part of their names."""
    raw = read_delimited(spark, path)
    like = lambda *parts: cell(raw, *(c for p in parts for c in raw.columns if p in c))
    rows = raw.select(_day(like("date", "day")).alias("day"), number(like("kcal", "calories", "energy")).alias("kcal"), number(like("protein")).alias("protein"), number(like("carb")).alias("carbs"), number(like("fat")).alias("fat"))
    return rows.filter("day IS NOT NULL").groupBy("day").agg(*(F.sum(c).alias(c) for c in ("kcal", "protein", "carbs", "fat")))


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """day, marker, value, unit of a lab table; a blood pressure ``120/80`` becomes two markers.

    Where there is no unit of its own, what follows the number of a value is its unit; values without a number are left out.
    """
    raw = read_delimited(spark, path)
    value = cell(raw, "value", "result")
    rows = raw.select(_day(cell(raw, "date", "taken_at", "day")).alias("day"), text.snake(cell(raw, "marker", "name", "test")).alias("marker"), value.alias("v"), F.coalesce(cell(raw, "unit", "units"), F.nullif(F.trim(F.regexp_extract(value, r"^[<>]?\s*[0-9.,/]+\s+(.+)$", 1)), F.lit(""))).alias("unit"))
    rows = rows.withColumn("v", F.regexp_extract("v", r"^[<>]?\s*([0-9.,/ ]*[0-9])", 1))
    pair = F.split("v", "/")
    two = F.array(F.struct(F.lit("systolic").alias("m"), number(F.get(pair, F.lit(0))).alias("x")), F.struct(F.lit("diastolic").alias("m"), number(F.get(pair, F.lit(1))).alias("x")))
    one = F.array(F.struct(F.col("marker").alias("m"), number(F.col("v")).alias("x")))
    both = F.when(F.col("v").rlike(r"^\s*\d+\s*/\s*\d+"), two).otherwise(one)
    return rows.withColumn("e", F.explode(both)).select("day", F.col("e.m").alias("marker"), F.col("e.x").alias("value"), "unit").filter("day IS NOT NULL AND value IS NOT NULL")


def read_ring_sleep(spark: SparkSession, path: str) -> DataFrame:
    """Sleep documents in JSON: one row a period, with its five-minute hypnogram as spans of equal stages."""
    raw = spark.read.json(path, schema="id string, day string, bedtime_start string, bedtime_end string, sleep_phase_5_min string, average_hrv double, lowest_heart_rate int")
    start = F.unix_timestamp(F.try_to_timestamp("bedtime_start"))
    stage = lambda c: F.element_at(F.create_map(*(x for a, b in (("1", "deep"), ("2", "light"), ("3", "rem"), ("4", "awake")) for x in (F.lit(a), F.lit(b)))), c)
    codes = F.split(F.coalesce("sleep_phase_5_min", F.lit("")), "")
    spans = F.transform(F.filter(codes, lambda c: c != ""), lambda c, k: F.struct((start + k * 300).alias("start"), (start + (k + 1) * 300).alias("end"), stage(c).alias("stage")))
    return raw.select("id", F.to_date("day").alias("day"), start.alias("start_ts"), F.unix_timestamp(F.try_to_timestamp("bedtime_end")).alias("end_ts"), F.col("average_hrv").alias("avg_hrv"), F.col("lowest_heart_rate").alias("resting_hr"), spans.alias("stages"))


def _positive(c: str) -> Column:
    return F.when(F.col(c) > 0, F.col(c))


def _iso_seconds(c: str) -> Column:
    return F.unix_timestamp(F.try_to_timestamp(F.col(c)))


def read_ring_activity(spark: SparkSession, path: str) -> DataFrame:
    """Daily activity documents: day, steps, active_kcal, total_kcal; what is not positive is null."""
    raw = spark.read.json(path, schema="day string, steps int, active_calories double, total_calories double").filter("day IS NOT NULL")
    return raw.select(F.to_date("day").alias("day"), _positive("steps").alias("steps"), _positive("active_calories").alias("active_kcal"), _positive("total_calories").alias("total_kcal"))


def read_ring_readiness(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Daily readiness documents: (day, skin_temp_dev_c, score), and (day, key, value) of the positive contributors."""
    raw = spark.read.json(path, schema="day string, score int, temperature_deviation double, contributors map<string,double>").filter("day IS NOT NULL")
    days = raw.select(F.to_date("day").alias("day"), F.col("temperature_deviation").alias("skin_temp_dev_c"), _positive("score").alias("score"))
    extras = raw.select(F.to_date("day").alias("day"), F.explode("contributors").alias("key", "value")).filter("value > 0")
    return days, extras.withColumn("key", F.concat(F.lit("readiness_"), "key"))


def read_ring_heart(spark: SparkSession, path: str) -> DataFrame:
    """ts and bpm of heart rate documents; a rate that is not positive is left out."""
    raw = spark.read.json(path, schema="timestamp string, bpm int")
    return raw.select(_iso_seconds("timestamp").alias("ts"), "bpm").filter("ts IS NOT NULL AND bpm > 0")


def read_ring_workouts(spark: SparkSession, path: str) -> DataFrame:
    """Workout documents with a span that can be read and is not empty."""
    raw = spark.read.json(path, schema="start_datetime string, end_datetime string, activity string, source string, calories double, distance double")
    rows = raw.select(
        _iso_seconds("start_datetime").alias("start_ts"), _iso_seconds("end_datetime").alias("end_ts"), F.coalesce("activity", F.lit("workout")).alias("sport"),
        F.coalesce("source", F.lit("ring")).alias("source"), _positive("calories").alias("energy_kcal"), _positive("distance").alias("distance_m"),
    )
    return rows.filter("end_ts > start_ts")


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    """session, position, ts and bytes of the frames of captures in JSON, given as hexadecimal text; other text is left out."""
    raw = spark.read.json(path, schema="session string, frames array<struct<ts:long,hex:string>>")
    frames = raw.select("session", F.posexplode("frames").alias("position", "f"))
    plain = F.regexp_replace("f.hex", r"[\s:]", "")
    return frames.select("session", "position", F.col("f.ts").alias("ts"), F.when(plain.rlike(r"^([0-9A-Fa-f]{2})+$"), F.unhex(plain)).alias("data")).filter("data IS NOT NULL")


def read_batches(spark: SparkSession, path: str, streams: list[str]) -> tuple[DataFrame, DataFrame]:
    """Newline-delimited batches, a header line and records: the records of known streams once each, and the rejected."""
    raw = spark.read.json(path, schema="batchId string, stream string, key map<string,string>, data map<string,string>", multiLine=False)
    records = raw.filter("key IS NOT NULL")
    known = F.col("stream").isin(streams) & F.col("batchId").isNotNull()
    marked = records.withColumn("_digest", F.sha2(F.to_json(F.struct("stream", "key", "data")), 256))
    return marked.filter(known).dropDuplicates(["batchId", "_digest"]).drop("_digest"), records.filter(~known | known.isNull())


def detect_kind(names: list[str]) -> str | None:
    """Which importer a set of file names calls for."""
    low = [n.rsplit("/", 1)[-1].lower() for n in names]
    rules = (("health_xml", lambda n: n == "export.xml"), ("gpx", lambda n: n.endswith(".gpx")), ("tcx", lambda n: n.endswith(".tcx")), ("fit", lambda n: n.endswith(".fit")), ("cycles_csv", lambda n: "cycle" in n and n.endswith(".csv")), ("sleep_json", lambda n: n.endswith(".json") and "sleep" in n), ("batches", lambda n: n.endswith(".ndjson")), ("csv", lambda n: n.endswith(".csv")))
    return next((kind for kind, rule in rules if any(map(rule, low))), None)
