"""Scalar functions: days and zones, text, JSON, arrays, geometry, hashes, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text
from ..functions.stats import ERF_SQL, erf, logistic
from .aggregates import R
from .bindings import DAILY, SHIPPED, STREAM, daily, shipped, stream, table


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS utc_day, strftime(ts + INTERVAL 5 HOUR + INTERVAL 30 MINUTE, '%Y-%m-%d') AS local_day FROM events")
def day_keys(spark, sf):
    at = F.col("ts").cast("timestamp_ntz")
    return table(spark, sf, "events").select("event_id", F.date_format(at, "yyyy-MM-dd").alias("utc_day"), F.date_format(at + F.expr("INTERVAL '5:30' HOUR TO MINUTE"), "yyyy-MM-dd").alias("local_day"))


@query("SELECT event_id, strftime(timezone('America/New_York', timezone('UTC', ts)), '%Y-%m-%d %H') AS local_hour FROM events")
def zone_local_day(spark, sf):
    at = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York")
    return table(spark, sf, "events").select("event_id", F.date_format(at, "yyyy-MM-dd HH").alias("local_hour"))


@query("""WITH k AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01') SELECT day, CAST((epoch(timezone('America/New_York', CAST(day + 1 AS TIMESTAMP))) - epoch(timezone('America/New_York', CAST(day AS TIMESTAMP)))) / 3600 AS BIGINT) AS hours FROM k""", days="day")
def day_bounds(spark, sf):
    """Hours from one local midnight to the next: 23 or 25 where clocks change."""
    k = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).filter("day < DATE '1997-01-01'").distinct()
    start = lambda d: F.to_utc_timestamp(d.cast("timestamp"), "America/New_York")
    return k.select("day", ((F.unix_timestamp(start(F.date_add("day", 1))) - F.unix_timestamp(start(F.col("day")))) / 3600).cast("long").alias("hours"))


@query(f"""WITH {DAILY} SELECT DISTINCT day, day + 10 AS later, CAST(date_trunc('week', day) AS DATE) AS monday, CAST(isodow(day) AS BIGINT) AS weekday, CAST(day(last_day(day)) AS BIGINT) AS month_days, CAST(day - DATE '1970-01-01' + 2440588 AS BIGINT) AS julian FROM d""", days="day later monday")
def civil_days(spark, sf):
    d = daily(spark, sf).select("day").distinct()
    return d.select("day", F.date_add("day", 10).alias("later"), F.to_date(F.date_trunc("week", "day")).alias("monday"), (F.weekday("day") + 1).cast("long").alias("weekday"), F.dayofmonth(F.last_day("day")).cast("long").alias("month_days"), (F.datediff("day", F.lit("1970-01-01").cast("date")) + 2440588).cast("long").alias("julian"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(extract('hour' FROM ts) * 60 + extract('minute' FROM ts) AS DOUBLE) END AS minutes FROM events""")
def wall_times(spark, sf):
    label = F.when(F.col("event_type") != "error", F.date_format(F.col("ts").cast("timestamp_ntz"), "HH:mm")).otherwise("none")
    parts = F.split(label, ":")
    return table(spark, sf, "events").select("event_id", (F.get(parts, F.lit(0)).try_cast("long") * 60 + F.get(parts, F.lit(1)).try_cast("long")).cast("double").alias("minutes"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS iso, CAST(o_orderdate AS DATE) AS slashed FROM orders", days="iso slashed")
def parsed_days(spark, sf):
    """Days from ISO and from d/m/y text."""
    o = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("a"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("b"))
    both = lambda c: F.coalesce(F.expr(f"try_to_date({c}, 'yyyy-MM-dd')"), F.expr(f"try_to_date({c}, 'dd/MM/yyyy')"))
    return o.select("o_orderkey", both("a").alias("iso"), both("b").alias("slashed"))


@query(f"WITH {STREAM} SELECT seq, CAST(round(value) AS BIGINT) % 24 AS hour, ((CAST(round(value) AS BIGINT) % 24) - ((t // 3600) % 24) + 36) % 24 - 12 AS apart, CAST(greatest(100, least(5000, round(value * 10))) AS BIGINT) // 50 * 50 AS snapped FROM s")
def wrapped_hours(spark, sf):
    """Hours modulo 24, the shortest signed way between two, and a value clamped and snapped to a step."""
    hour, clock = F.round("value").cast("long") % 24, F.expr("t DIV 3600") % 24
    snapped = F.greatest(F.lit(100.0), F.least(F.lit(5000.0), F.round(F.col("value") * 10))).cast("long")
    return stream(spark, sf).select("seq", hour.alias("hour"), ((hour - clock + 36) % 24 - 12).alias("apart"), (snapped - snapped % 50).alias("snapped"))


X = "((value - 50) / 30)"


@query(f"WITH {STREAM} SELECT seq, round(sign({X}) * {ERF_SQL.format(t=f'(1 / (1 + 0.3275911 * abs({X})))', x=X)}, 6) AS erf, round(100 / (1 + exp(-1.6 * ({X} + 0.2))), 6) AS logistic, round(3 / (1 + exp(-{X})), 6) AS squash FROM s")
def normal_and_logistic(spark, sf):
    x = (F.col("value") - 50) / 30
    return stream(spark, sf).select("seq", R(erf(x)).alias("erf"), R(logistic(x, 1.6, -0.2)).alias("logistic"), R(3 / (1 + F.exp(-x))).alias("squash"))


@query(f"""WITH {STREAM}, p AS (SELECT device, seq, t, radians(48 + value / 100) AS lat, radians(11 + bpm / 100) AS lon FROM s), q AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM p WINDOW w AS (PARTITION BY device ORDER BY t, seq))
SELECT device, round(sum(2 * 6371000 * asin(sqrt(power(sin((lat - lat0) / 2), 2) + cos(lat0) * cos(lat) * power(sin((lon - lon0) / 2), 2)))), 2) AS metres FROM q GROUP BY device""")
def haversine_route(spark, sf):
    from ..operators.windows import by

    w = by("device", ["t", "seq"])
    p = stream(spark, sf).select("device", "seq", "t", F.radians(48 + F.col("value") / 100).alias("lat"), F.radians(11 + F.col("bpm") / 100).alias("lon"))
    p = p.withColumn("lat0", F.lag("lat").over(w)).withColumn("lon0", F.lag("lon").over(w))
    half = lambda a, b: F.pow(F.sin((F.col(a) - F.col(b)) / 2), 2)
    return p.groupBy("device").agg(R(F.sum(2 * 6371000 * F.asin(F.sqrt(half("lat", "lat0") + F.cos("lat0") * F.cos("lat") * half("lon", "lon0")))), 2).alias("metres"))


@query(f"WITH {STREAM} SELECT seq, round(value * power(0.5, (t % 86400) / 3600.0 / 5.5), 6) AS remaining, round((value - 32) * 5 / 9, 6) AS celsius, CASE WHEN value BETWEEN 20 AND 45 THEN 'absolute' WHEN value < 10 THEN 'deviation' ELSE 'fahrenheit' END AS kind FROM s")
def decay_and_units(spark, sf):
    v = F.col("value")
    return stream(spark, sf).select("seq", R(v * F.pow(F.lit(0.5), (F.col("t") % 86400) / 3600.0 / 5.5)).alias("remaining"), R((v - 32) * 5 / 9).alias("celsius"), F.when(v.between(20, 45), "absolute").when(v < 10, "deviation").otherwise("fahrenheit").alias("kind"))


@query("SELECT c_custkey, CAST(CASE c_nationkey % 3 WHEN 0 THEN 3700 WHEN 1 THEN 2700 ELSE 3200 END + least(700, greatest(0, floor(c_acctbal / 20))) AS BIGINT) // 50 * 50 AS goal FROM customer")
def goal_by_group(spark, sf):
    k = F.col("c_nationkey") % 3
    raw = (F.when(k == 0, 3700).when(k == 1, 2700).otherwise(3200) + F.least(F.lit(700), F.greatest(F.lit(0), F.floor(F.col("c_acctbal") / 20)))).cast("long")
    return table(spark, sf, "customer").select("c_custkey", (raw - raw % 50).alias("goal"))


@query(f"WITH {STREAM} SELECT seq, CASE WHEN bpm / 190 >= 0.9 THEN 5 WHEN bpm / 190 >= 0.8 THEN 4 WHEN bpm / 190 >= 0.7 THEN 3 WHEN bpm / 190 >= 0.6 THEN 2 WHEN bpm / 190 >= 0.5 THEN 1 ELSE 0 END AS zone FROM s")
def zone_numbers(spark, sf):
    share = F.col("bpm") / 190
    zone = F.lit(0)
    for k, edge in enumerate((0.5, 0.6, 0.7, 0.8, 0.9), 1):
        zone = F.when(share >= edge, k).otherwise(zone)
    return stream(spark, sf).select("seq", zone.alias("zone"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, json_object('t', event_type, 'k', CAST(json_extract_string(props, '$.k') AS BIGINT)) AS built FROM events""")
def json_path_and_build(spark, sf):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_type").alias("t"), k.cast("long").alias("k"))).alias("built"))


@query(f"WITH {STREAM}, a AS (SELECT device, t // 86400 AS day, list(value ORDER BY t, seq) AS vs FROM s GROUP BY ALL) SELECT device, day, CAST(pos AS BIGINT) AS pos, v FROM (SELECT device, day, unnest(range(len(vs))) AS pos, unnest(vs) AS v FROM a) WHERE pos < 3")
def json_array_explode(spark, sf):
    """An ordered array as JSON text, parsed and exploded again."""
    a = stream(spark, sf).groupBy("device", F.expr("t DIV 86400").alias("day")).agg(F.array_sort(F.collect_list(F.struct("t", "seq", "value"))).alias("a"))
    text_ = a.select("device", "day", F.to_json(F.transform("a", lambda x: x["value"])).alias("j"))
    return text_.select("device", "day", F.posexplode(F.from_json("j", "array<double>")).alias("pos", "v")).filter("pos < 3").select("device", "day", F.col("pos").cast("long").alias("pos"), "v")


@query(f"WITH {STREAM}, a AS (SELECT device, kind, sum(CAST(round(value) AS BIGINT)) AS v FROM s WHERE seq % 2 = 0 GROUP BY ALL UNION ALL SELECT device, kind, sum(CAST(round(value) AS BIGINT)) FROM s WHERE seq % 2 = 1 GROUP BY ALL) SELECT device, kind, CAST(sum(v) AS BIGINT) AS total FROM a GROUP BY ALL")
def map_merge_and_sum(spark, sf):
    """Two maps of a device merged by adding, then read back."""
    s = stream(spark, sf).withColumn("v", F.round("value").cast("long"))
    maps = lambda odd, n: s.filter(f"seq % 2 = {odd}").groupBy("device", "kind").agg(F.sum("v").alias("v")).groupBy("device").agg(F.map_from_entries(F.collect_list(F.struct("kind", "v"))).alias(n))
    m = maps(0, "a").join(maps(1, "b"), "device", "full").select("device", F.map_zip_with(F.coalesce("a", F.create_map().cast("map<string,bigint>")), F.coalesce("b", F.create_map().cast("map<string,bigint>")), lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))).alias("m"))
    return m.select("device", F.explode("m").alias("kind", "total"))


@query(f"WITH {STREAM}, a AS (SELECT device, t // 86400 AS day, list(t ORDER BY seq) AS ts, min(t) AS lo, max(t) AS hi FROM s GROUP BY ALL) SELECT device, day, ts = list_sort(ts) AS ordered, lo // 86400 = day AND hi // 86400 = day AS inside FROM a")
def array_validity(spark, sf):
    a = stream(spark, sf).groupBy("device", F.expr("t DIV 86400").alias("day")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "t"))), lambda x: x["t"]).alias("ts"))
    return a.select("device", "day", (F.col("ts") == F.array_sort("ts")).alias("ordered"), F.forall("ts", lambda t: F.floor(t / 86400) == F.col("day")).alias("inside"))


@query("SELECT c_custkey, sha256(c_name || ':' || c_mktsegment) AS id, md5(c_name) AS short FROM customer")
def stable_ids(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.sha2(F.concat_ws(":", "c_name", "c_mktsegment"), 256).alias("id"), F.md5("c_name").alias("short"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '<mail>', 'g'), '[0-9]{6,}', '<number>', 'g') AS clean FROM documents")
def redacted_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.redacted(F.col("text")).alias("clean"))


@query("SELECT DISTINCT p_type, trim(regexp_replace(replace(lower(p_type), '%', ' pct '), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM part")
def header_names(spark, sf):
    return table(spark, sf, "part").select("p_type", text.snake(F.col("p_type")).alias("name")).distinct()


@query("SELECT o_orderkey, 'Order of ' || lower(o_orderpriority) || ' worth ' || CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) || '.' AS sentence, CASE WHEN o_orderkey % 1000 >= 60 THEN CAST((o_orderkey % 1000) // 60 AS VARCHAR) || 'h ' || lpad(CAST((o_orderkey % 1000) % 60 AS VARCHAR), 2, '0') || 'm' ELSE CAST(o_orderkey % 1000 AS VARCHAR) || 'm' END AS span FROM orders")
def sentences(spark, sf):
    said = F.concat(F.lit("Order of "), F.lower("o_orderpriority"), F.lit(" worth "), F.round("o_totalprice").cast("long"), F.lit("."))
    return table(spark, sf, "orders").select("o_orderkey", said.alias("sentence"), text.duration((F.col("o_orderkey") % 1000) * 60).alias("span"))


@query("SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS user_id FROM events")
def log_fields(spark, sf):
    """Fields read back out of tagged lines."""
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("[sync] kind="), "event_type", F.lit(" user="), "user_id", F.lit(" done")).alias("line"))
    return e.select("event_id", text.field_of(F.col("line"), "kind").alias("kind"), text.field_of(F.col("line"), "user").alias("user_id"))


@query("SELECT conv_id, string_agg(text, '|' ORDER BY turn, role, text) AS whole, count(*) AS turns FROM conversations GROUP BY conv_id")
def reassembled_stream(spark, sf):
    """Chunks put together in order."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("a"), F.count("*").alias("turns"))
    return c.select("conv_id", F.array_join(F.transform("a", lambda x: x["text"]), "|").alias("whole"), "turns")


@query("SELECT p_partkey, (p_size // 10, p_size % 10) < (3, 5) AS older FROM part")
def version_compare(spark, sf):
    v = F.concat_ws(".", F.expr("p_size DIV 10"), F.col("p_size") % 10)
    return table(spark, sf, "part").select("p_partkey", (text.version_key(v) < text.version_key(F.lit("3.5"))).alias("older"))


@query(f"WITH {DAILY}, {SHIPPED} SELECT device, day, 'price' AS source FROM d WHERE urgent > 1 UNION ALL SELECT device, day, 'quantity' FROM sh WHERE quantity > 300", days="day")
def union_of_sources(spark, sf):
    of = lambda df, n: df.select("device", "day", F.lit(n).alias("source"))
    return of(daily(spark, sf).filter("urgent > 1"), "price").unionByName(of(shipped(spark, sf).filter("quantity > 300"), "quantity"))


@query(f"WITH {DAILY}, {SHIPPED} SELECT device, greatest(max(a), max(b)) AS latest FROM (SELECT device, max(day) AS a, NULL::DATE AS b FROM d GROUP BY device UNION ALL SELECT device, NULL, max(day) FROM sh GROUP BY device) GROUP BY device", days="latest")
def latest_of_two(spark, sf):
    one = lambda df: df.groupBy("device").agg(F.max("day").alias("day"))
    return one(daily(spark, sf)).unionByName(one(shipped(spark, sf))).groupBy("device").agg(F.max("day").alias("latest"))


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation WHERE n_name <> ''")
def distinct_union(spark, sf):
    one = lambda t, c: table(spark, sf, t).select(F.col(c).alias("nation"))
    return one("customer", "c_nationkey").union(one("supplier", "s_nationkey")).union(one("nation", "n_nationkey")).distinct()


@query(f"WITH {DAILY}, {SHIPPED} SELECT device, day FROM d EXCEPT SELECT device, day FROM sh", days="day")
def stale_days(spark, sf):
    return daily(spark, sf).select("device", "day").exceptAll(shipped(spark, sf).select("device", "day")).distinct()


@query(f"WITH {DAILY}, {SHIPPED} SELECT device, day FROM d WHERE urgent > 0 INTERSECT SELECT device, day FROM sh", days="day")
def common_days(spark, sf):
    return daily(spark, sf).filter("urgent > 0").select("device", "day").intersect(shipped(spark, sf).select("device", "day"))


@query(f"WITH {STREAM}, f AS (SELECT device, kind, min(seq) AS first_seq FROM s GROUP BY ALL) SELECT device, string_agg(kind, ',' ORDER BY first_seq) AS kinds FROM f GROUP BY device")
def ordered_distinct(spark, sf):
    """Distinct values in the order they were first seen."""
    f = stream(spark, sf).groupBy("device", "kind").agg(F.min("seq").alias("first_seq")).groupBy("device").agg(F.array_sort(F.collect_list(F.struct("first_seq", "kind"))).alias("a"))
    return f.select("device", F.array_join(F.transform("a", lambda x: x["kind"]), ",").alias("kinds"))


@query(f"WITH {STREAM} SELECT device, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM s WHERE kind IN ('view', 'click', 'error') GROUP BY device")
def array_union_sorted(spark, sf):
    s = stream(spark, sf)
    a = s.groupBy("device").agg(F.collect_set(F.when(F.col("kind").isin("view", "click"), F.col("kind"))).alias("a"), F.collect_set(F.when(F.col("kind").isin("click", "error"), F.col("kind"))).alias("b"))
    return a.select("device", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("kinds"))
