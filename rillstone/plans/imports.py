"""Files written in the layout of an import and read back by its reader, against SQL over the same rows.

Each query writes whole tables to the shared folder, in as many files as there are partitions, and returns what the
reader of ``sources`` makes of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..catalog import query
from ..session import shared_folder
from ..sources import binary, exports, files, sensors
from .aggregates import R
from .bindings import SESSIONS, STREAM, sessions, stream, table


def _csv(rows: DataFrame) -> str:
    path = shared_folder(rows.sparkSession, "import")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return path


def _text(rows: DataFrame, *keys: str) -> str:
    """Lines of text, in a folder for each value of ``keys``."""
    path = shared_folder(rows.sparkSession, "import")
    (rows.write.partitionBy(*keys) if keys else rows.write).text(path)
    return path


def _json(rows: DataFrame) -> str:
    path = shared_folder(rows.sparkSession, "import")
    rows.write.option("ignoreNullFields", False).json(path)
    return path


def _rooted(tag: str):
    """A partition's lines between a start and an end tag, batch by batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [f"<{tag}>"]})
        yield from frames
        yield pd.DataFrame({"value": [f"</{tag}>"]})

    return run


def _wall(t: str):
    """Wall time an hour and a half east of UTC."""
    return F.date_format(F.timestamp_seconds(F.col(t) + 5400), "yyyy-MM-dd HH:mm:ss")


def _order_days(spark, sf):
    return table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"), R(F.sum("o_totalprice"), 2).alias("price"))


ORDER_DAYS = "d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY ALL)"


@query(f"WITH {ORDER_DAYS} SELECT day, CAST(n % 100 + 0.5 AS DOUBLE) AS recovery, CAST(40 + n AS INT) AS resting_hr, round(price, 4) AS hrv, round(30 + n / 10.0, 4) AS skin_temp_c, CAST(n % 7 AS DOUBLE) AS strain, CAST(0.9 AS DOUBLE) AS efficiency FROM d", days="day")
def file_cycles(spark, sf):
    d = _order_days(spark, sf).select("day", (F.col("n") % 100 + 0.5).alias("recovery"), (40 + F.col("n")).alias("resting_hr"), F.col("price").alias("hrv"), (30 + F.col("n") / 10.0).alias("skin_temp_c"), (F.col("n") % 7).cast("double").alias("strain"), F.lit(0.9).alias("efficiency"))
    path = shared_folder(spark, "import")
    exports.write_cycles(d, path)
    return files.read_cycles(spark, path).withColumns({c: R(c, 4) for c in ("recovery", "hrv", "skin_temp_c", "strain", "efficiency")})


@query(f"WITH {SESSIONS} SELECT start_t AS start_ts, end_t AS end_ts, n % 5 = 0 AS is_nap, CAST(n + 0.25 AS DOUBLE) AS asleep_min, round((80 + n % 20) / 100.0, 4) AS efficiency FROM ss")
def file_sleeps(spark, sf):
    s = sessions(spark, sf)
    path = _csv(s.select(
        _wall("start_t").alias("Cycle start time"), F.lit("UTC+01:30").alias("Cycle timezone"), _wall("start_t").alias("Sleep onset"), _wall("end_t").alias("Wake onset"),
        F.when(F.col("n") % 5 == 0, "true").otherwise("false").alias("Nap"), (F.col("n") + 0.25).alias("Asleep duration (min)"), (80 + F.col("n") % 20).alias("Sleep efficiency %"),
    ))
    return files.read_sleeps(spark, path).select("start_ts", "end_ts", "is_nap", R("asleep_min", 4).alias("asleep_min"), R("efficiency", 4).alias("efficiency"))


@query(f"WITH {SESSIONS} SELECT start_t AS start_ts, end_t AS end_ts, CASE WHEN n % 2 = 0 THEN 'Run, easy' ELSE 'Say \"go\"' END AS sport, round(n % 21 * 100.0 / 21, 4) AS strain, CAST(n % 60 AS DOUBLE) AS zone_2, CAST(NULL AS DOUBLE) AS distance_m FROM ss")
def file_workouts(spark, sf):
    """Activity names hold commas and quotes."""
    path = _csv(sessions(spark, sf).select(
        F.lit("UTC+01:30").alias("Cycle timezone"), _wall("start_t").alias("Workout start time"), _wall("end_t").alias("Workout end time"),
        F.when(F.col("n") % 2 == 0, "Run, easy").otherwise('Say "go"').alias("Activity name"), (F.col("n") % 21).alias("Activity Strain"), (F.col("n") % 60).alias("HR Zone 2 %"),
    ))
    w = files.read_workouts(spark, path)
    return w.select("start_ts", "end_ts", "sport", R("strain", 4).alias("strain"), F.get("zones", F.lit(1)).alias("zone_2"), "distance_m")


@query(f"WITH {SESSIONS} SELECT start_t AS cycle_start, 'q' || (n % 3) AS question, CASE WHEN n % 3 = 0 THEN 'yes' END AS answer, count(*) AS n FROM ss GROUP BY ALL")
def file_journal(spark, sf):
    s = sessions(spark, sf)
    path = _csv(s.select(_wall("start_t").alias("Cycle start time"), F.lit("UTC+01:30").alias("Cycle timezone"), F.concat(F.lit("q"), F.col("n") % 3).alias("Question text"), F.when(F.col("n") % 3 == 0, "yes").alias("Answered yes"), F.lit(None).cast("string").alias("Notes")))
    return files.read_journal(spark, path).groupBy("cycle_start", "question", "answer").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT DISTINCT event_type AS kind, user_id % 4 AS source, epoch_us(ts) // 1000000 AS t, value FROM events WHERE event_type IN ('view', 'click', 'signup')), k AS (SELECT *, CAST(make_timestamp(t * 1000000) AS DATE) AS day FROM r),
s AS (SELECT day, source, sum(value) AS v FROM k WHERE kind = 'view' GROUP BY ALL), a AS (SELECT day, max(v) AS steps FROM s GROUP BY day), h AS (SELECT day, avg(value) AS avg_hr, max(value) AS max_hr FROM k WHERE kind = 'click' GROUP BY day), d AS (SELECT DISTINCT day FROM k WHERE kind IN ('view', 'click'))
SELECT day, round(steps, 4) AS steps, round(avg_hr, 7) AS avg_hr, round(max_hr, 4) AS max_hr FROM d LEFT JOIN a USING (day) LEFT JOIN h USING (day)""", days="day")
def file_health_days(spark, sf):
    """Every record is written twice, as exports do that overlap."""
    names = F.when(F.col("kind") == "view", "StepCount").when(F.col("kind") == "click", "HeartRate").when(F.col("kind") == "signup", "Noise")
    at = F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd HH:mm:ss")
    line = F.concat(F.lit('<Record type="HKQuantityTypeIdentifier'), "name", F.lit('" sourceName="s'), F.expr("user_id % 4"), F.lit('" unit="u" startDate="'), at, F.lit(' +0000" endDate="'), at, F.lit(' +0000" value="'), F.col("value"), F.lit('"/>'))
    rows = table(spark, sf, "events").select("user_id", "value", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.col("event_type").alias("kind")).withColumn("name", names).filter("name IS NOT NULL")
    twice = rows.withColumn("_twice", F.explode(F.array(F.lit(0), F.lit(1))))
    path = _text(twice.select(line.alias("value")).mapInPandas(_rooted("HealthData"), "value string"))  # a file a partition, a line a record
    days = files.health_days(files.read_health_records(spark, path))
    return days.select("day", R("steps", 4).alias("steps"), R("avg_hr", 7).alias("avg_hr"), R("max_hr", 4).alias("max_hr"))


ROUTE = f"""{STREAM}, p AS (SELECT device, t // 86400 AS day, t, round(40 + max(value) / 1000, 7) AS lat, round(10 + max(value) / 500, 7) AS lon, round(max(value), 0) AS ele, CAST(max(50 + seq % 100) AS INT) AS hr FROM s GROUP BY ALL),
q AS (SELECT *, radians(lat) AS y, radians(lon) AS x, radians(lag(lat) OVER w) AS y0, radians(lag(lon) OVER w) AS x0, greatest(0.0, ele - lag(ele) OVER w) AS up FROM p WINDOW w AS (PARTITION BY device, day ORDER BY t)),
r AS (SELECT *, 2 * 6371000 * asin(sqrt(pow(sin((y - y0) / 2), 2) + cos(y0) * cos(y) * pow(sin((x - x0) / 2), 2))) AS hop FROM q)"""


def route_points(spark, sf) -> DataFrame:
    """A point a device and second, in files of one day."""
    g = stream(spark, sf).groupBy("device", F.expr("t DIV 86400").alias("day"), "t").agg(F.max("value").alias("v"), F.max(50 + F.col("seq") % 100).cast("int").alias("hr"))
    return g.select("device", "day", F.timestamp_seconds("t").alias("ts"), R(40 + F.col("v") / 1000, 7).alias("lat"), R(10 + F.col("v") / 500, 7).alias("lon"), R("v", 0).alias("ele"), "hr")


@query(f"WITH {ROUTE} SELECT device, day, count(*) AS n, min(t) AS start_t, max(t) AS end_t, round(coalesce(sum(hop), 0), 1) AS distance_m, round(coalesce(sum(up), 0), 1) AS ascent_m FROM r GROUP BY ALL")
def file_gpx_routes(spark, sf):
    """Routes exported as GPX, a device and day each, read again and summed up."""
    points = route_points(spark, sf).withColumn("key", F.struct("device", "day"))
    docs = exports.route_gpx(points, "key").select(F.col("gpx").alias("value"), F.col("key.device").alias("device"), F.col("key.day").alias("day"))
    return _summed(files.read_gpx(spark, _text(docs, "device", "day"), ("device", "day")))


def _summed(points: DataFrame) -> DataFrame:
    a = files.activity(points, ["device", "day"])
    return a.select(F.col("device").cast("long").alias("device"), F.col("day").cast("long").alias("day"), "n", F.unix_seconds("start").alias("start_t"), F.unix_seconds("end").alias("end_t"), R("distance_m", 1).alias("distance_m"), R("ascent_m", 1).alias("ascent_m"))


@query(f"WITH {ROUTE} SELECT device, day, count(*) AS n, round(coalesce(sum(hop), 0), 1) AS distance_m, round(avg(hr), 4) AS avg_hr FROM r GROUP BY ALL")
def file_tcx_activities(spark, sf):
    """Track points as TCX, a file a device and day."""
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.format_string("<Trackpoint><Time>%s</Time><Position><LatitudeDegrees>%.7f</LatitudeDegrees><LongitudeDegrees>%.7f</LongitudeDegrees></Position><AltitudeMeters>%.1f</AltitudeMeters><HeartRateBpm><Value>%d</Value></HeartRateBpm></Trackpoint>", at, "lat", "lon", "ele", "hr")
    rows = route_points(spark, sf).groupBy("device", "day").agg(F.concat(F.lit("<Track>"), F.array_join(F.collect_list(line), ""), F.lit("</Track>")).alias("value"))
    a = files.activity(files.read_tcx(spark, _text(rows, "device", "day"), ("device", "day")), ["device", "day"])
    return a.select(F.col("device").cast("long").alias("device"), F.col("day").cast("long").alias("day"), "n", R("distance_m", 1).alias("distance_m"), R("avg_hr", 4).alias("avg_hr"))


@query(f"WITH {ROUTE} SELECT device, day, count(*) AS n, min(t) AS start_t, max(t) AS end_t, round(sum(round(lat, 5)), 5) AS lats, round(sum(ele), 1) AS eles, CAST(sum(hr) AS BIGINT) AS hrs FROM r GROUP BY ALL")
def file_fit_routes(spark, sf):
    """Routes exported as FIT, a device and day each, decoded again."""
    docs = exports.route_fit(route_points(spark, sf).withColumn("key", F.concat_ws(":", "device", "day")), "key")
    parts = F.split("path", ":")
    p = binary.fit_points(docs, "key", "fit").select(parts[0].cast("long").alias("device"), parts[1].cast("long").alias("day"), F.unix_seconds("ts").alias("t"), "lat", "ele", F.col("hr").cast("long").alias("hr"))
    return p.groupBy("device", "day").agg(F.count("*").alias("n"), F.min("t").alias("start_t"), F.max("t").alias("end_t"), R(F.sum(F.round("lat", 5)), 5).alias("lats"), R(F.sum("ele"), 1).alias("eles"), F.sum("hr").alias("hrs"))


@query("""SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS start, l_returnflag AS title, count(*) AS sets, count(DISTINCT l_suppkey) AS exercises, round(sum(l_quantity * l_linenumber), 4) AS volume FROM lineitem GROUP BY ALL""")
def file_lifting(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    path = _csv(l.select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("start_time"), F.col("l_returnflag").alias("title"), F.concat(F.lit("lift "), "l_suppkey").alias("exercise_title"), F.col("l_quantity").alias("weight_kg"), F.col("l_linenumber").alias("reps")))
    return files.read_lifting(spark, path).withColumn("volume", R("volume", 4))


@query("SELECT CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS kcal, CAST(sum(o_custkey) AS DOUBLE) AS protein, CAST(count(*) AS DOUBLE) AS carbs FROM orders GROUP BY ALL", days="day")
def file_nutrition(spark, sf):
    path = _csv(table(spark, sf, "orders").select(F.date_format("o_orderdate", "dd.MM.yyyy").alias("Date"), F.col("o_totalprice").alias("Calories (kcal)"), F.col("o_custkey").alias("Protein (g)"), F.lit(1).alias("Carbs (g)"), F.lit(None).cast("int").alias("Fat (g)")))
    return files.read_nutrition(spark, path).select("day", R("kcal", 2).alias("kcal"), "protein", "carbs")


@query("""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey AS k, o_custkey AS c FROM orders), m AS (SELECT day, 'ferritin' AS marker, c + 0.5 AS value, 'ug/L' AS unit FROM o WHERE k % 3 = 0
UNION ALL SELECT day, 'systolic', 100 + c % 50, 'mmHg' FROM o WHERE k % 3 = 1 UNION ALL SELECT day, 'diastolic', 60 + c % 30, 'mmHg' FROM o WHERE k % 3 = 1) SELECT day, marker, unit, count(*) AS n, CAST(round(sum(value), 2) AS DOUBLE) AS total FROM m GROUP BY ALL""", days="day")
def file_markers(spark, sf):
    """Values with their units in one cell, blood pressures, and cells that say that there are no data."""
    k, c = F.col("o_orderkey") % 3, F.col("o_custkey")
    value = F.when(k == 0, F.concat(c + 0.5, F.lit(" ug/L"))).when(k == 1, F.concat(100 + c % 50, F.lit("/"), 60 + c % 30, F.lit(" mmHg"))).otherwise("no data")
    path = _csv(table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"), F.when(k == 1, "Blood Pressure").otherwise("Ferritin").alias("Marker"), value.alias("Value")))
    return files.read_markers(spark, path).groupBy("day", "marker", "unit").agg(F.count("*").alias("n"), R(F.sum("value"), 2).alias("total"))


@query(f"""WITH {SESSIONS}, c AS (SELECT device, start_t, k, CASE (n + k) % 4 WHEN 0 THEN 'deep' WHEN 1 THEN 'light' WHEN 2 THEN 'rem' ELSE 'awake' END AS stage FROM (SELECT *, unnest(range(n)) AS k FROM ss))
SELECT device || ':' || start_t AS id, stage, count(*) AS n, min(start_t + k * 300) AS first_t FROM c GROUP BY ALL""")
def file_ring_sleep(spark, sf):
    """One code of the hypnogram a stream row of the session."""
    code = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - 1), lambda k: ((F.col("n") + k) % 4 + 1).cast("string")), "")
    iso = lambda t: F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    docs = sessions(spark, sf).select(F.concat_ws(":", "device", "start_t").alias("id"), F.to_date(F.timestamp_seconds("start_t")).cast("string").alias("day"), iso("start_t").alias("bedtime_start"), iso("end_t").alias("bedtime_end"), code.alias("sleep_phase_5_min"))
    s = files.read_ring_sleep(spark, _json(docs)).select("id", F.explode("stages").alias("s"))
    return s.groupBy("id", F.col("s.stage").alias("stage")).agg(F.count("*").alias("n"), F.min("s.start").alias("first_t"))


@query(f"WITH {ORDER_DAYS} SELECT day, CASE WHEN n > 1 THEN CAST(n - 1 AS INT) END AS steps, price AS active_kcal, CAST(NULL AS DOUBLE) AS total_kcal FROM d", days="day")
def file_ring_activity(spark, sf):
    d = _order_days(spark, sf).select(F.col("day").cast("string").alias("day"), (F.col("n") - 1).alias("steps"), F.col("price").alias("active_calories"), F.lit(-1.0).alias("total_calories"))
    return files.read_ring_activity(spark, _json(d))


@query(f"WITH {ORDER_DAYS} SELECT day, 'readiness_balance' AS key, round(price, 4) AS value FROM d UNION ALL SELECT day, 'readiness_rest', n - 1.0 FROM d WHERE n > 1", days="day")
def file_ring_readiness(spark, sf):
    d = _order_days(spark, sf).select(F.col("day").cast("string").alias("day"), F.col("n").alias("score"), F.lit(0.5).alias("temperature_deviation"), F.struct(F.col("price").alias("balance"), (F.col("n") - 1.0).alias("rest")).alias("contributors"))
    return files.read_ring_readiness(spark, _json(d))[1].withColumn("value", R("value", 4))


@query(f"WITH {STREAM} SELECT t AS ts, CAST(floor(value) AS INT) AS bpm, count(*) AS n FROM s WHERE floor(value) > 0 GROUP BY ALL")
def file_ring_heart(spark, sf):
    d = stream(spark, sf).select(F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp"), F.floor("value").cast("int").alias("bpm"), F.lit("rest").alias("source"))
    return files.read_ring_heart(spark, _json(d)).groupBy("ts", "bpm").agg(F.count("*").alias("n"))


@query(f"WITH {SESSIONS} SELECT start_t AS start_ts, end_t AS end_ts, CASE WHEN n % 2 = 0 THEN 'ride' ELSE 'workout' END AS sport, 'ring' AS source, CAST(n AS DOUBLE) AS energy_kcal, CAST(NULL AS DOUBLE) AS distance_m FROM ss WHERE end_t > start_t")
def file_ring_workouts(spark, sf):
    iso = lambda t: F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    d = sessions(spark, sf).select(iso("start_t").alias("start_datetime"), iso("end_t").alias("end_datetime"), F.when(F.col("n") % 2 == 0, "ride").alias("activity"), F.col("n").cast("double").alias("calories"), F.lit(0.0).alias("distance"))
    return files.read_ring_workouts(spark, _json(d))


@query("SELECT event_type AS stream, 'b' || (event_id % 5) AS batch, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE event_type <> 'error' GROUP BY ALL")
def file_batches(spark, sf):
    """Records that were sent twice, a stream that is not known, and header lines."""
    e = table(spark, sf, "events").select(F.concat(F.lit("b"), F.col("event_id") % 5).alias("batchId"), F.col("event_type").alias("stream"), F.struct(F.col("event_id").cast("string").alias("id")).alias("key"), F.struct(F.col("value").cast("string").alias("v")).alias("data"))
    heads = e.select("batchId", "stream").distinct()
    path = _text(e.withColumn("_twice", F.explode(F.array(F.lit(0), F.lit(1)))).select(F.to_json(F.struct("batchId", "stream", "key", "data")).alias("line")).unionAll(heads.select(F.to_json(F.struct("batchId", "stream")))))
    good, _ = files.read_batches(spark, path, ["view", "click", "purchase", "signup"])
    return good.groupBy("stream", F.col("batchId").alias("batch")).agg(F.count("*").alias("n"), F.sum(F.col("key")["id"].cast("long")).alias("ids"))


#: Rows of a batch that goes back to the JVM.
OUT = 16_384


def _per_row(rows: DataFrame, make: Callable[[dict], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows that ``make`` gives for each row, in Arrow batches: a worker holds one row as Python values, and OUT of its results."""
    types = rows.sparkSession.createDataFrame([], schema).schema
    kinds = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = iter(make(batch.slice(k, 1).to_pylist()[0]))
                while part := list(islice(found, OUT)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), kinds, strict=True)], schema=kinds)

    return rows.mapInArrow(run, types)


def _day_rows(spark, sf) -> DataFrame:
    """device, day and its rows (t, value, seq) in order: a day of a device bounds the array."""
    item = F.struct("t", "value", F.col("seq").cast("int").alias("seq"))
    return stream(spark, sf).groupBy("device", F.expr("t DIV 86400").alias("day")).agg(F.array_sort(F.collect_list(item)).alias("rows"))


@query(f"WITH {STREAM} SELECT device, t // 86400 AS day, t, round(value, 4) AS value, CAST(seq AS INT) AS seq FROM s")
def packed_rows(spark, sf):
    """Sample rows packed in one blob a device and day, and unpacked."""

    def pack(r):
        return [(r["device"], r["day"], binary.pack_rows([(x["t"], x["value"], x["seq"]) for x in r["rows"]]))]

    def unpack(r):
        return ((r["device"], r["day"], *x) for x in binary.iter_rows(r["blob"]))

    blobs = _per_row(_day_rows(spark, sf), pack, "device long, day long, blob binary")
    return _per_row(blobs, unpack, "device long, day long, t long, value double, seq int").withColumn("value", R("value", 4))


@query(f"WITH {STREAM} SELECT device, t // 86400 AS day, row_number() OVER (PARTITION BY device, t // 86400 ORDER BY t, value, CAST(seq AS INT)) - 1 AS place, CAST(t AS VARCHAR) || '|' || CAST(seq AS VARCHAR) AS payload FROM s")
def framed_blobs(spark, sf):
    """Payloads framed behind checksums, the frames' stream cut in chunks of 7 bytes, stored as a compressed blob, and reassembled."""

    def pack(r):
        payloads = [f"{x['t']}|{x['seq']}".encode() for x in r["rows"]]
        data = b"\x00".join(b"\xaa" + bytes([len(p)]) + p + bytes([binary.crc8(p)]) for p in payloads)
        return [(r["device"], r["day"], binary.pack_frames([data[k : k + 7] for k in range(0, len(data), 7)]))]

    def unpack(r):
        return ((r["device"], r["day"], k, p.decode()) for k, p in enumerate(binary.reassembled(binary.unpack_frames(r["blob"]))))

    blobs = _per_row(_day_rows(spark, sf), pack, "device long, day long, blob binary")
    return _per_row(blobs, unpack, "device long, day long, place long, payload string")


@query(f"WITH {STREAM} SELECT device, seq, CAST(seq % 200 AS INT) AS bpm, true AS contact, round((500 + seq % 1000) * 1000 / 1024.0, 4) AS rr_ms FROM s")
def sensor_heart_rates(spark, sf):
    """Notifications with a contact bit and a beat interval, from captures in JSON with hexadecimal frames."""
    low = lambda c: F.hex(c.cast("int") % 256)
    byte = lambda c: F.lpad(low(c), 2, "0")
    rr = 500 + F.col("seq") % 1000
    data = F.concat(F.lit("16 "), byte(F.col("seq") % 200), F.lit(":"), byte(rr), byte(F.floor(rr / 256)))
    frames = stream(spark, sf).groupBy("device", "seq").agg(F.array(F.struct(F.max("t").alias("ts"), F.max(data).alias("hex")), F.struct(F.max("t").alias("ts"), F.lit("zz").alias("hex"))).alias("frames"))
    path = _json(frames.select(F.concat_ws(":", "device", "seq").alias("session"), "frames"))
    found = sensors.decoded(files.read_capture(spark, path), sensors.heart_rate, "bpm int, contact boolean, rr_ms array<double>", ["session"])
    parts = F.split("session", ":")
    return found.select(parts[0].cast("long").alias("device"), parts[1].cast("long").alias("seq"), "bpm", "contact", R(F.get("rr_ms", F.lit(0)), 4).alias("rr_ms"))


@query(f"WITH {STREAM} SELECT device, seq, round((seq % 3000) / 100.0, 4) AS speed, round((seq % 250) / 2.0, 4) AS cadence, CAST(seq % 500 AS DOUBLE) AS power FROM s")
def sensor_indoor_bikes(spark, sf):
    """Bike data with speed, cadence (bit 2) and power (bit 6)."""
    short = lambda m: F.concat(F.lpad(F.hex(F.col("seq") % m % 256), 2, "0"), F.lpad(F.hex(F.expr(f"seq % {m} DIV 256")), 2, "0"))
    data = F.unhex(F.concat(F.lit("4400"), short(3000), short(250), short(500)))
    found = sensors.decoded(stream(spark, sf).select("device", "seq", data.alias("data")), sensors.indoor_bike, "speed double, cadence double, power double", ["device", "seq"])
    return found.select("device", "seq", R("speed", 4).alias("speed"), R("cadence", 4).alias("cadence"), F.col("power"))


@query(f"WITH {STREAM} SELECT device, t // 86400 AS day, count(*) AS n, CAST(sum(seq % 1000 - 500) AS BIGINT) AS total FROM s GROUP BY ALL")
def decoded_waveforms(spark, sf):
    """Little-endian 16-bit samples of a device and day in one blob, decoded in native functions."""
    wrapped = lambda x: F.pmod(x["seq"] % 1000 - 500, F.lit(65536))
    hexed = F.array_join(F.transform("rows", lambda x: F.concat(F.lpad(F.hex(wrapped(x) % 256), 2, "0"), F.lpad(F.hex(F.floor(wrapped(x) / 256)), 2, "0"))), "")
    w = binary.decoded_samples(_day_rows(spark, sf).select("device", "day", F.unhex(hexed).alias("samples")))
    return w.select("device", "day", F.size("values").cast("long").alias("n"), F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"WITH {STREAM} SELECT device, t, round(value, 4) AS value, CAST(NULL AS BIGINT) AS missing FROM s")
def sqlite_samples(spark, sf):
    """Samples in one SQLite file a device and day; a column that the file lacks is null."""

    def make(r):
        import sqlite3

        con = sqlite3.connect(":memory:")
        con.execute("CREATE TABLE samples (device INTEGER, t INTEGER, value REAL)")
        con.executemany("INSERT INTO samples VALUES (?, ?, ?)", [(r["device"], x["t"], x["value"]) for x in r["rows"]])
        con.commit()
        data = con.serialize()
        con.close()
        return [(data,)]

    blobs = _per_row(_day_rows(spark, sf), make, "content binary")
    return binary.sqlite_rows(blobs, "samples", "device long, t long, value double, missing long").withColumn("value", R("value", 4))


@query(f"WITH {ORDER_DAYS} SELECT CAST(year(day) AS VARCHAR) AS key, day, price AS value FROM d", days="day")
def export_metric_json(spark, sf):
    """The JSON of each key, parsed again."""
    d = _order_days(spark, sf).select(F.year("day").cast("string").alias("key"), "day", F.col("price").alias("value"))
    back = exports.metric_json(d).select("key", F.explode(F.from_json("json", "array<struct<day:date,value:double>>")).alias("p"))
    return back.select("key", F.col("p.day").alias("day"), F.col("p.value").alias("value"))


@query(f"WITH {STREAM}, b AS (SELECT device, t // 30 AS bin, avg(bpm) AS v FROM s GROUP BY ALL) SELECT device, bin * 30 // 3600 * 3600 AS start, count(*) AS n, round(sum(v), 4) AS total FROM b GROUP BY ALL")
def export_decimated(spark, sf):
    d = exports.decimated(stream(spark, sf), "device", "t", "bpm")
    return d.select("device", F.col("start").cast("long").alias("start"), F.size("series").cast("long").alias("n"), R(F.aggregate("series", F.lit(0.0), lambda a, x: a + x["v"]), 4).alias("total"))


@query(f"WITH {STREAM} SELECT kind AS stream, CAST(device AS VARCHAR) AS device, count(*) AS n, round(sum(value), 4) AS total FROM s WHERE kind IN ('view', 'click') GROUP BY ALL")
def export_sensor_csv(spark, sf):
    s = stream(spark, sf)
    path = shared_folder(spark, "export")
    exports.sensor_csv({k: s.filter(F.col("kind") == k) for k in ("view", "click")}, path)
    return files.read_delimited(spark, path).groupBy("stream", "device").agg(F.count("*").alias("n"), R(F.sum(files.number(F.col("value"))), 4).alias("total"))
