"""Nights and their signals: spot readings, watch rules, cycle onsets and phase, hypnogram coverage, ring records, pacing."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import query
from ..operators.joins import contained
from ..operators.windows import by, islands
from .aggregates import BEATS, ECTOPIC, R, beats
from .bindings import DAILY, SESSIONS, STREAM, daily, sessions, stream


@query("SELECT event_id, props, lower(trim(CASE event_id % 4 WHEN 0 THEN ' Awake ' WHEN 1 THEN 'WAKE' WHEN 2 THEN 'deep' ELSE event_type END)) IN ('wake', 'awake') AS is_wake FROM events")
def wake_stages(spark, sf):
    """Either spelling of the wake stage, in any case and with space around it."""
    from .bindings import table

    stage = F.when(F.col("event_id") % 4 == 0, " Awake ").when(F.col("event_id") % 4 == 1, "WAKE").when(F.col("event_id") % 4 == 2, "deep").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", "props", is_wake(stage).alias("is_wake"))


def is_wake(stage):
    return F.lower(F.trim(stage)).isin("wake", "awake")


@query(f"""WITH {STREAM}, {BEATS}, {ECTOPIC}, c AS (SELECT device, day, count(*) AS clean, avg(rr) AS mean, sqrt(avg(CASE WHEN hop = 1 THEN gap * gap END)) AS rmssd FROM k GROUP BY ALL), a AS (SELECT device, t // 86400 AS day, count(*) AS n FROM s GROUP BY ALL)
SELECT device, day, n, coalesce(clean, 0) AS clean, ok, CASE WHEN ok THEN round(rmssd, 6) END AS rmssd, CASE WHEN ok THEN round(60000 / mean, 6) END AS bpm FROM (SELECT a.device, a.day, n, clean, mean, rmssd, coalesce(clean >= 20 AND n - clean <= 0.35 * n, false) AS ok FROM a LEFT JOIN c USING (device, day))""")
def spot_reading(spark, sf):
    """A reading of a day's beats, refused where fewer than 20 are clean or over 35 % were out of range or ectopic."""
    w = by(["device", "day"], ["t", "seq"])
    m = beats(spark, sf).withColumn("mid", F.percentile("rr", 0.5).over(w.rowsBetween(-2, 2))).withColumn("i", F.row_number().over(w)).filter(F.abs(F.col("rr") - F.col("mid")) <= 0.2 * F.col("mid"))
    v = by(["device", "day"], ["i"])
    gap = F.when(F.col("i") - F.lag("i").over(v) == 1, F.col("rr") - F.lag("rr").over(v))
    c = m.withColumn("gap", gap).groupBy("device", "day").agg(F.count("*").alias("clean"), F.avg("rr").alias("mean"), F.sqrt(F.avg(F.col("gap") * F.col("gap"))).alias("rmssd"))
    a = stream(spark, sf).groupBy("device", F.expr("t DIV 86400").alias("day")).agg(F.count("*").alias("n"))
    ok = F.coalesce((F.col("clean") >= 20) & (F.col("n") - F.col("clean") <= 0.35 * F.col("n")), F.lit(False))
    return a.join(c, ["device", "day"], "left").select("device", "day", "n", F.coalesce("clean", F.lit(0)).alias("clean"), ok.alias("ok"), R(F.when(ok, F.col("rmssd"))).alias("rmssd"), R(F.when(ok, 60000 / F.col("mean"))).alias("bpm"))


@query(f"""WITH {DAILY}, z AS (SELECT device, day, count(*) OVER (PARTITION BY device ORDER BY day ROWS UNBOUNDED PRECEDING) AS k, avg(n) OVER recent AS n2, avg(n) OVER base AS n28, avg(price) OVER recent AS p2, avg(price) OVER base AS p28, avg(high) OVER recent AS h2, avg(10 + urgent) OVER recent AS u2, avg(10 + urgent) OVER base AS u28, count(urgent) OVER base AS uk
FROM d WINDOW recent AS (PARTITION BY device ORDER BY day ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), base AS (PARTITION BY device ORDER BY day ROWS BETWEEN 30 PRECEDING AND 3 PRECEDING)),
f AS (SELECT device, day, coalesce(n2 >= n28 + 5, false) AS a, coalesce(p28 > 0 AND p2 <= 0.8 * p28, false) AS b, h2 >= 0.6 AS c, coalesce(uk >= 10 AND u2 BETWEEN 8 AND 25 AND u28 BETWEEN 8 AND 25 AND u2 >= u28 + 2.5, false) AS e FROM z WHERE k >= 14)
SELECT device, day, a AS rest_up, b AS variability_down, c AS warm, e AS breath_up, a::INT + b::INT + c::INT + e::INT >= 2 AS strained FROM f""", days="day")
def illness_watch(spark, sf):
    """Two recent days against the 28 that end three days before: two flags of four are needed, and two weeks of rows."""
    w = by("device", ["day"])
    recent, base = w.rowsBetween(-1, 0), w.rowsBetween(-30, -3)
    no = lambda c: F.coalesce(c, F.lit(False))
    mean = lambda c, o: F.avg(c).over(o)
    breath = 10 + F.col("urgent")
    plausible = mean(breath, recent).between(8, 25) & mean(breath, base).between(8, 25)
    flags = {
        "rest_up": no(mean("n", recent) >= mean("n", base) + 5),
        "variability_down": no((mean("price", base) > 0) & (mean("price", recent) <= 0.8 * mean("price", base))),
        "warm": no(mean("high", recent) >= 0.6),
        "breath_up": no((F.count("urgent").over(base) >= 10) & plausible & (mean(breath, recent) >= mean(breath, base) + 2.5)),
    }
    d = daily(spark, sf).withColumns({**flags, "k": F.count("*").over(w.rowsBetween(W.unboundedPreceding, 0))}).filter("k >= 14")
    return d.select("device", "day", *flags, (sum(F.col(c).cast("int") for c in flags) >= 2).alias("strained"))


FUSED = """z AS (SELECT device, day, (price - avg(price) OVER w) / nullif(stddev_samp(price) OVER w, 0) AS a, (n - avg(n) OVER w) / nullif(stddev_samp(n) OVER w, 0) AS b FROM d WINDOW w AS (PARTITION BY device ORDER BY day ROWS BETWEEN 42 PRECEDING AND 1 PRECEDING)),
f AS (SELECT device, day, (coalesce(0.6 * a, 0) - coalesce(0.2 * b, 0)) / (CASE WHEN a IS NULL THEN 0 ELSE 0.6 END + CASE WHEN b IS NULL THEN 0 ELSE 0.2 END) AS idx FROM z WHERE a IS NOT NULL OR b IS NOT NULL),
m AS (SELECT device, median(idx) AS mid, count(*) AS nights FROM f GROUP BY device), k AS (SELECT f.device, mid, nights, greatest(1e-9, median(abs(idx - mid))) AS mad FROM f JOIN m USING (device) GROUP BY ALL),
e AS (SELECT f.device, f.day, nights, idx - mid >= 0.5 * mad AS elevated FROM f JOIN k USING (device) WHERE nights >= 42),
o AS (SELECT *, elevated AND NOT coalesce(lag(elevated) OVER (PARTITION BY device ORDER BY day), false) AS onset FROM e)"""


def _onsets(spark, sf):
    """device, day, nights, elevated, onset: present signals are weighted anew, a night stands out by half a median deviation."""
    w = by("device", ["day"]).rowsBetween(-42, -1)
    z = lambda c: (F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_samp(c).over(w), F.lit(0.0))
    f = daily(spark, sf).select("device", "day", z("price").alias("a"), z("n").alias("b")).filter("a IS NOT NULL OR b IS NOT NULL")
    weight = F.when(F.col("a").isNull(), 0.0).otherwise(0.6) + F.when(F.col("b").isNull(), 0.0).otherwise(0.2)
    f = f.select("device", "day", ((F.coalesce(0.6 * F.col("a"), F.lit(0.0)) - F.coalesce(0.2 * F.col("b"), F.lit(0.0))) / weight).alias("idx"))
    m = f.groupBy("device").agg(F.percentile("idx", 0.5).alias("mid"), F.count("*").alias("nights"))
    far = f.join(m, "device").withColumn("off", F.col("idx") - F.col("mid"))
    mad = far.groupBy("device").agg(F.greatest(F.lit(1e-9), F.percentile(F.abs("off"), 0.5)).alias("mad"))
    e = far.filter("nights >= 42").join(mad, "device").select("device", "day", "nights", (F.col("off") >= 0.5 * F.col("mad")).alias("elevated"))
    return e.withColumn("onset", F.col("elevated") & ~F.coalesce(F.lag("elevated").over(by("device", ["day"])), F.lit(False)))


@query(f"WITH {DAILY}, {FUSED} SELECT device, day FROM o WHERE onset", days="day")
def cycle_onsets(spark, sf):
    """The days on which an elevated run begins, of devices with 42 nights."""
    return _onsets(spark, sf).filter("onset").select("device", "day")


@query(f"""WITH {DAILY}, {FUSED}, g AS (SELECT device, median(day - before) AS gap FROM (SELECT device, day, lag(day) OVER (PARTITION BY device ORDER BY day) AS before FROM o WHERE onset) WHERE before IS NOT NULL GROUP BY device),
l AS (SELECT device, max(day) AS last_day, max(day) FILTER (onset) AS last_onset, arg_max(elevated, day) AS now FROM o GROUP BY device),
r AS (SELECT l.*, CASE WHEN round(gap) BETWEEN 21 AND 40 THEN CAST(round(gap) AS INT) END AS cycle_days FROM l LEFT JOIN g USING (device))
SELECT device, last_day, last_onset, cycle_days, CASE WHEN last_onset IS NULL THEN 'unknown' WHEN last_day - last_onset <= 2 THEN 'turning' WHEN now THEN 'high' ELSE 'low' END AS phase, CASE WHEN cycle_days IS NULL THEN 'building' ELSE 'solid' END AS confidence,
CAST(greatest(1, coalesce(cycle_days, 28) // 2 + (last_day - last_onset) - 2) AS BIGINT) AS day_low, CAST(coalesce(cycle_days, 28) // 2 + (last_day - last_onset) + 2 AS BIGINT) AS day_high,
CASE WHEN last_onset + cycle_days + 2 >= last_day THEN greatest(last_day, last_onset + cycle_days - 2) END AS next_from, CASE WHEN last_onset + cycle_days + 2 >= last_day THEN last_onset + cycle_days + 2 END AS next_to FROM r""", days="last_day last_onset next_from next_to")
def cycle_state(spark, sf):
    """The phase of the last night, the median gap of onsets if it is a plausible cycle, a range of cycle days and the next window."""
    o = _onsets(spark, sf)
    hop = o.filter("onset").select("device", F.date_diff("day", F.lag("day").over(by("device", ["day"]))).alias("gap"))
    g = hop.groupBy("device").agg(F.round(F.percentile("gap", 0.5)).cast("int").alias("gap"))
    l = o.groupBy("device").agg(F.max("day").alias("last_day"), F.max(F.when(F.col("onset"), F.col("day"))).alias("last_onset"), F.max_by("elevated", "day").alias("now"))  # noqa: E741
    r = l.join(g, "device", "left").withColumn("cycle_days", F.when(F.col("gap").between(21, 40), F.col("gap"))).withColumn("since", F.date_diff("last_day", "last_onset"))
    phase = F.when(F.col("last_onset").isNull(), "unknown").when(F.col("since") <= 2, "turning").when(F.col("now"), "high").otherwise("low")
    mid = F.floor(F.coalesce("cycle_days", F.lit(28)) / 2) + F.col("since")
    end = F.date_add("last_onset", F.col("cycle_days") + 2)
    due = lambda d: F.when(end >= F.col("last_day"), d)
    return r.select(
        "device", "last_day", "last_onset", "cycle_days", phase.alias("phase"), F.when(F.col("cycle_days").isNull(), "building").otherwise("solid").alias("confidence"),
        F.when(mid.isNotNull(), F.greatest(F.lit(1).cast("long"), mid - 2)).alias("day_low"), (mid + 2).alias("day_high"), due(F.greatest("last_day", F.date_add("last_onset", F.col("cycle_days") - 2))).alias("next_from"), due(end).alias("next_to"),
    )


@query(f"""WITH {SESSIONS}, h AS (SELECT device, start_t // 86400 AS day, sum(end_t - start_t) AS span, sum(CASE WHEN n % 3 = 0 THEN 0 ELSE (end_t - start_t) * (n % 10) // 10 END) AS covered FROM ss GROUP BY ALL)
SELECT device, day, CAST(span AS BIGINT) AS span, CAST(covered AS BIGINT) AS covered, CASE WHEN covered > 0 AND span > 0 THEN round(least(1.0, covered / span), 6) END AS fraction, coalesce(covered > 0 AND span > 0 AND covered / span < 0.95, false) AS holed FROM h""")
def hypnogram_coverage(spark, sf):
    """Seconds of a night's timed stages over its spans; stages without times cover nothing, and a night without any is unknown."""
    s = sessions(spark, sf)
    timed = F.format_string('[{"start":%d,"end":%d,"stage":"deep"},{"start":9,"end":9}]', F.col("start_t"), F.expr("start_t + (end_t - start_t) * (n % 10) DIV 10"))
    rows = s.withColumn("stages", F.when(F.col("n") % 3 == 0, '{"light":3}').otherwise(timed))
    spans = F.from_json("stages", "array<struct<start:long,end:long,stage:string>>")
    seconds = F.aggregate(F.filter(spans, lambda x: x["end"] > x["start"]), F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    g = rows.groupBy("device", F.expr("start_t DIV 86400").alias("day")).agg(F.sum(F.col("end_t") - F.col("start_t")).alias("span"), F.sum(F.coalesce(seconds, F.lit(0).cast("long"))).alias("covered"))
    fraction = F.when((F.col("covered") > 0) & (F.col("span") > 0), F.least(F.lit(1.0), F.col("covered") / F.col("span")))
    return g.select("device", "day", "span", "covered", R(fraction).alias("fraction"), F.coalesce(fraction < 0.95, F.lit(False)).alias("holed"))


@query(f"WITH {STREAM}, r AS (SELECT device, t // 3600 AS record, CAST(floor(60000 / bpm) AS INT) AS rr FROM s), m AS (SELECT device, record, CAST(floor(median(rr)) AS INT) AS mid FROM r WHERE rr BETWEEN 300 AND 2000 GROUP BY ALL) SELECT device, record, mid AS rr_ms, CAST(round(60000.0 / mid) AS INT) AS bpm FROM m WHERE round(60000.0 / mid) BETWEEN 30 AND 220")
def record_heart_rates(spark, sf):
    """One heart rate a record, of the whole median of its plausible beat intervals."""
    r = stream(spark, sf).select("device", F.expr("t DIV 3600").alias("record"), F.floor(60000 / F.col("bpm")).cast("int").alias("rr")).filter(F.col("rr").between(300, 2000))
    m = r.groupBy("device", "record").agg(F.floor(F.percentile("rr", 0.5)).cast("int").alias("rr_ms"))
    return m.withColumn("bpm", F.round(60000.0 / F.col("rr_ms")).cast("int")).filter(F.col("bpm").between(30, 220))


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'rate' ELSE 'waveform' END AS use, round(CASE WHEN user_id % 2 = 0 THEN CAST(value * 100 AS INT) / 1000.0 ELSE CAST(value * 100 AS INT) END, 6) AS shown FROM events")
def respiration_scale(spark, sf):
    """Rows of rings are rates in thousandths a minute and never go to the stager; others are raw waveforms as they are."""
    from .bindings import table

    raw, ring = F.round(F.col("value") * 100).cast("int"), F.concat(F.when(F.col("user_id") % 2 == 0, "ring-").otherwise("band-"), F.col("user_id")).startswith("ring-")
    return table(spark, sf, "events").select("event_id", F.when(ring, "rate").otherwise("waveform").alias("use"), R(F.when(ring, raw / 1000.0).otherwise(raw)).alias("shown"))


@query(f"""WITH {SESSIONS}, c AS (SELECT device, start_t, end_t, k, end_t - (n - k) * 300 AS t, (start_t + k) % 5 AS code FROM (SELECT *, unnest(range(n)) AS k FROM ss)), w AS (SELECT *, t >= start_t AS within FROM c WHERE code < 4),
v AS (SELECT * FROM w QUALIFY within OR NOT bool_or(within) OVER (PARTITION BY device, start_t)), r AS (SELECT *, CASE WHEN code = lag(code) OVER o AND t - lag(t) OVER o = 300 THEN 0 ELSE 1 END AS cut FROM v WINDOW o AS (PARTITION BY device, start_t ORDER BY k)),
s2 AS (SELECT *, sum(cut) OVER (PARTITION BY device, start_t ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM r) SELECT device, start_t, CAST(min(t) AS BIGINT) AS from_t, CAST(max(t) + 300 AS BIGINT) AS to_t, CAST(code AS BIGINT) AS code FROM s2 GROUP BY device, start_t, run, code""")
def ring_hypnogram(spark, sf):
    """Codes are laid back from the end; unwritten ones (4) are gaps, those before the onset go unless nothing stays; equal ones merge."""
    c = sessions(spark, sf).select("device", "start_t", "end_t", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    c = c.select("device", "start_t", "k", (F.col("end_t") - (F.col("n") - F.col("k")) * 300).alias("t"), F.pmod(F.col("start_t") + F.col("k"), F.lit(5)).alias("code")).filter("code < 4")
    night = W.partitionBy("device", "start_t")
    v = c.withColumn("within", F.col("t") >= F.col("start_t")).withColumn("some", F.bool_or("within").over(night)).filter("within OR NOT some")
    o = night.orderBy("k")
    cut = F.when((F.col("code") == F.lag("code").over(o)) & (F.col("t") - F.lag("t").over(o) == 300), 0).otherwise(1)
    r = v.withColumn("cut", cut).withColumn("run", F.sum("cut").over(o.rowsBetween(W.unboundedPreceding, 0)))
    return r.groupBy("device", "start_t", "run", "code").agg(F.min("t").alias("from_t"), (F.max("t") + 300).alias("to_t")).drop("run")


@query(f"""WITH {SESSIONS}, j AS (SELECT ss.device, ss.start_t // 86400 AS day, s.value / 10 AS c, s.bpm FROM ss JOIN s ON s.device = ss.device AND s.t BETWEEN ss.start_t AND ss.end_t WHERE ss.n >= 5)
SELECT device, day, round(avg(c) FILTER (c BETWEEN 5 AND 45), 6) AS skin_c, count(*) FILTER (c BETWEEN 5 AND 45) AS n FROM j GROUP BY ALL HAVING count(*) FILTER (bpm BETWEEN 30 AND 220) >= 5 AND count(*) FILTER (c BETWEEN 5 AND 45) >= 3""")
def skin_temperature_nights(spark, sf):
    """The mean plausible temperature inside a night's sessions, if the device was worn (heart rates there) and there are samples."""
    s = sessions(spark, sf).filter("n >= 5").drop("n").withColumn("day", F.expr("start_t DIV 86400"))
    j = contained(stream(spark, sf), s, "device", "t", "start_t", "end_t", 86400).withColumn("c", F.when((F.col("value") / 10).between(5, 45), F.col("value") / 10))
    g = j.groupBy("device", "day").agg(R(F.avg("c")).alias("skin_c"), F.count("c").alias("n"), F.count_if(F.col("bpm").between(30, 220)).alias("worn"))
    return g.filter("worn >= 5 AND n >= 3").drop("worn")


@query(f"""WITH {SESSIONS}, v AS (SELECT device, t, seq, value, CASE WHEN t - lag(t) OVER (PARTITION BY device ORDER BY t, seq) <= 1800 THEN 0 ELSE 1 END AS cut FROM s WHERE value > 20), b AS (SELECT *, sum(cut) OVER (PARTITION BY device ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS bout FROM v),
k AS (SELECT *, count(*) OVER (PARTITION BY device, bout) AS ticks, max(t) OVER (PARTITION BY device, bout) - min(t) OVER (PARTITION BY device, bout) AS span FROM b), a AS (SELECT k.*, EXISTS (SELECT 1 FROM ss WHERE ss.device = k.device AND k.t BETWEEN ss.start_t AND ss.end_t AND ss.n BETWEEN 5 AND 30) AS asleep FROM k WHERE ticks >= 3 AND span >= 1200)
SELECT device, t // 86400 AS day, count(*) FILTER (NOT asleep) AS ticks, round(coalesce(sum(value) FILTER (NOT asleep), 0), 4) AS steps, round(coalesce(sum(value) FILTER (asleep), 0), 4) AS asleep_steps FROM a GROUP BY ALL""")
def awake_steps(spark, sf):
    """Steps of long enough bouts, without those inside sleep spans (which are counted apart)."""
    b = islands(stream(spark, sf).filter("value > 20"), "device", ["t", "seq"], "t", 1800, "bout")
    w = W.partitionBy("device", "bout")
    b = b.withColumn("ticks", F.count("*").over(w)).withColumn("span", F.max("t").over(w) - F.min("t").over(w)).filter("ticks >= 3 AND span >= 1200").select("device", "t", "seq", "value")
    inside = contained(b, sessions(spark, sf).filter("n BETWEEN 5 AND 30").drop("n"), "device", "t", "start_t", "end_t", 86400).select("seq", F.lit(True).alias("asleep")).distinct()
    a = b.join(inside, "seq", "left")
    awake = F.col("asleep").isNull()
    part = lambda c: R(F.coalesce(F.sum(F.when(c, F.col("value"))), F.lit(0.0)), 4)
    return a.groupBy("device", F.expr("t DIV 86400").alias("day")).agg(F.count_if(awake).alias("ticks"), part(awake).alias("steps"), part(~awake).alias("asleep_steps"))


RHYTHM = f"""{STREAM}, x0 AS (SELECT device, t // 86400 AS day, t // 21600 AS win, t, seq, 60000.0 / bpm AS rr FROM s WHERE 60000.0 / bpm BETWEEN 300 AND 2000),
x AS (SELECT *, rr - lag(rr) OVER w AS step, (rr - lag(rr) OVER w) * (lead(rr) OVER w - rr) AS turn, abs(rr - median(rr) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) > 0.2 * median(rr) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS odd FROM x0 WINDOW w AS (PARTITION BY device, win ORDER BY t, seq)),
g AS (SELECT device, day, win, count(*) AS n, avg(rr) AS mean, sqrt(avg(step * step)) AS rmssd, var_samp(rr) AS v, count(*) FILTER (turn < 0) / nullif(count(turn), 0) / (2.0 / 3) AS tp, count(*) FILTER (odd) / count(*) AS ectopic, min(t) AS a, max(t) AS b FROM x GROUP BY ALL HAVING count(*) >= 5),
q AS (SELECT *, rmssd / sqrt(2) / nullif(sqrt(greatest(0, 2 * v - rmssd * rmssd / 2)), 0) AS ratio, rmssd / mean AS nr FROM g),
l AS (SELECT *, CASE WHEN ratio IS NULL OR nr IS NULL OR tp IS NULL THEN 'unreadable' WHEN ratio >= 0.55 AND nr >= 0.12 AND tp >= 0.9 THEN 'varied' WHEN ectopic >= 0.04 AND tp < 0.9 THEN 'occasional' ELSE 'steady' END AS label FROM q)"""


def rhythm_windows(spark, sf):
    """Scatter, variation, turning points and ectopic share of windows of six hours with five beats, and a neutral label."""
    x = stream(spark, sf).select("device", F.expr("t DIV 86400").alias("day"), F.expr("t DIV 21600").alias("win"), "t", "seq", (60000.0 / F.col("bpm")).alias("rr")).filter(F.col("rr").between(300, 2000))
    w = by(["device", "win"], ["t", "seq"])
    mid, back = F.percentile("rr", 0.5).over(w.rowsBetween(-2, 2)), F.col("rr") - F.lag("rr").over(w)
    x = x.withColumn("step", back).withColumn("turn", back * (F.lead("rr").over(w) - F.col("rr"))).withColumn("odd", F.abs(F.col("rr") - mid) > 0.2 * mid)
    g = x.groupBy("device", "day", "win").agg(
        F.count("*").alias("n"), F.avg("rr").alias("mean"), F.sqrt(F.avg(F.col("step") * F.col("step"))).alias("rmssd"), F.var_samp("rr").alias("v"),
        (F.count_if(F.col("turn") < 0) / F.nullif(F.count("turn"), F.lit(0)) / (2.0 / 3)).alias("tp"), (F.count_if("odd") / F.count("*")).alias("ectopic"), F.min("t").alias("a"), F.max("t").alias("b"),
    ).filter("n >= 5")
    ratio = F.col("rmssd") / F.sqrt(F.lit(2.0)) / F.nullif(F.sqrt(F.greatest(F.lit(0.0), 2 * F.col("v") - F.col("rmssd") * F.col("rmssd") / 2)), F.lit(0.0))
    q = g.withColumn("ratio", ratio).withColumn("nr", F.col("rmssd") / F.col("mean"))
    label = F.when(F.col("ratio").isNull() | F.col("nr").isNull() | F.col("tp").isNull(), "unreadable").when(F.expr("ratio >= 0.55 AND nr >= 0.12 AND tp >= 0.9"), "varied").when(F.expr("ectopic >= 0.04 AND tp < 0.9"), "occasional").otherwise("steady")
    return q.withColumn("label", label)


@query(f"WITH {RHYTHM} SELECT device, win, n, round(ratio, 5) AS ratio, round(nr, 5) AS nr, round(tp, 5) AS tp, round(ectopic, 5) AS ectopic, label FROM l")
def rhythm_labels(spark, sf):
    return rhythm_windows(spark, sf).select("device", "win", "n", *(R(c, 5).alias(c) for c in ("ratio", "nr", "tp", "ectopic")), "label")


@query(f"WITH {RHYTHM} SELECT device, day, count(*) AS windows, count(*) FILTER (label = 'varied') AS varied, count(*) FILTER (label = 'occasional') AS occasional, CAST(sum(n) AS BIGINT) AS beats, (count(*) FILTER (label = 'varied') >= 3 AND max(b) FILTER (label = 'varied') - min(a) FILTER (label = 'varied') >= 1800) IS TRUE AS notable FROM l WHERE label <> 'unreadable' GROUP BY ALL")
def rhythm_nights(spark, sf):
    """A day's windows by label, read back from its exported table; notable with three varied windows over half an hour."""
    from ..session import shared_folder

    path = shared_folder(spark, "export")
    rhythm_windows(spark, sf).filter("label <> 'unreadable'").select("device", "day", "n", "a", "b", "label").write.option("header", True).csv(path)
    l = spark.read.option("header", True).schema("device long, day long, n long, a long, b long, label string").csv(path)  # noqa: E741
    varied = F.col("label") == "varied"
    span = F.max(F.when(varied, F.col("b"))) - F.min(F.when(varied, F.col("a")))
    return l.groupBy("device", "day").agg(F.count("*").alias("windows"), F.count_if(varied).alias("varied"), F.count_if(F.col("label") == "occasional").alias("occasional"), F.sum("n").alias("beats"), F.coalesce((F.count_if(varied) >= 3) & (span >= 1800), F.lit(False)).alias("notable"))


@query(f"""WITH {SESSIONS}, j AS (SELECT i.device, i.seq, i.bpm, i.t - min(i.t) OVER (PARTITION BY device, island) AS elapsed FROM i), k AS (SELECT *, CASE WHEN bpm <= 0 THEN 'invalid' WHEN elapsed >= 7200 THEN 'timeout' WHEN bpm <= 55 THEN 'settled' END AS stop FROM j),
v AS (SELECT *, greatest(45.0, least(bpm - (2 + 6 * least(1.0, elapsed / 3600.0)), bpm - 1)) AS target FROM k) SELECT device, seq, stop, CASE WHEN stop IS NULL THEN round(target, 6) END AS target, CASE WHEN stop IS NULL THEN CAST(round(60000 / target) AS INT) END AS interval_ms FROM v""")
def pacer_steps(spark, sf):
    """A tempo below the heart rate by an amount that grows from 2 to 8 over an hour of the session, never under a floor."""
    from .bindings import GAP

    i = islands(stream(spark, sf), "device", ["t", "seq"], "t", GAP)
    elapsed = F.col("t") - F.min("t").over(W.partitionBy("device", "island"))
    k = i.select("device", "seq", "bpm", elapsed.alias("elapsed"))
    stop = F.when(F.col("bpm") <= 0, "invalid").when(F.col("elapsed") >= 7200, "timeout").when(F.col("bpm") <= 55, "settled")
    target = F.greatest(F.lit(45.0), F.least(F.col("bpm") - (2 + 6 * F.least(F.lit(1.0), F.col("elapsed") / 3600.0)), F.col("bpm") - 1))
    on = lambda c: F.when(F.col("stop").isNull(), c)
    return k.withColumn("stop", stop).select("device", "seq", "stop", R(on(target)).alias("target"), on(F.round(60000 / target).cast("int")).alias("interval_ms"))
