"""Aggregates: series statistics, comparisons, correlations, effects, loads, composites."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.stats import correlation, erf, logistic, p_of_r, two_sided, two_sided_sql
from ..operators.joins import lagged_days
from ..operators.windows import by, capped_durations, quantile
from .bindings import DAILY, SESSIONS, SHIPPED, STREAM, daily, sessions, shipped, stream, table
from .scans import long_metrics

R = lambda c, n=6: F.round(c, n)


@query(f"""WITH {DAILY}, z AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY day) - 1 AS i FROM d)
SELECT device, count(*) AS n, round(avg(price), 6) AS mean, round(median(price), 6) AS median, round(min(price), 6) AS low, round(max(price), 6) AS high, round(stddev_samp(price), 6) AS sd, round(regr_slope(price, i), 6) AS slope FROM z GROUP BY device""")
def series_statistics(spark, sf):
    z = daily(spark, sf).withColumn("i", F.row_number().over(by("device", ["day"])) - 1)
    return z.groupBy("device").agg(F.count("*").alias("n"), R(F.avg("price")).alias("mean"), R(F.percentile("price", 0.5)).alias("median"), R(F.min("price")).alias("low"), R(F.max("price")).alias("high"), R(F.stddev_samp("price")).alias("sd"), R(F.regr_slope("price", "i")).alias("slope"))


MONTHS = "m AS (SELECT device, date_trunc('month', day) AS month, avg(price) AS mean, count(*) AS n FROM d GROUP BY ALL)"


@query(f"""WITH {DAILY}, {MONTHS} SELECT a.device, CAST(a.month AS DATE) AS month, a.n, b.n AS n_before, round(a.mean - b.mean, 6) AS delta, CASE WHEN b.mean <> 0 THEN round(100 * (a.mean - b.mean) / abs(b.mean), 6) END AS percent, CAST(sign(a.mean - b.mean) AS DOUBLE) AS direction
FROM m a JOIN m b ON a.device = b.device AND b.month = a.month - INTERVAL 1 MONTH""", days="month")
def month_over_month(spark, sf):
    m = daily(spark, sf).groupBy("device", F.trunc("day", "month").alias("month")).agg(F.avg("price").alias("mean"), F.count("*").alias("n"))
    before = m.select("device", F.to_date(F.add_months("month", 1)).alias("month"), F.col("mean").alias("mean_before"), F.col("n").alias("n_before"))
    delta = F.col("mean") - F.col("mean_before")
    return m.join(before, ["device", "month"]).select("device", "month", "n", "n_before", R(delta).alias("delta"), R(F.when(F.col("mean_before") != 0, 100 * delta / F.abs("mean_before"))).alias("percent"), F.signum(delta).alias("direction"))


@query(f"""WITH {DAILY}, {SHIPPED}, j AS (SELECT device, price AS x, quantity AS y FROM d JOIN sh USING (device, day)), c AS (SELECT device, count(*) AS n, corr(y, x) AS r, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM j GROUP BY device)
SELECT device, n, round(r, 6) AS r, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round({two_sided_sql('(r * sqrt((n - 2) / (1 - r * r)))')}, 6) AS p FROM c""")
def pearson(spark, sf):
    c = daily(spark, sf).join(shipped(spark, sf), ["device", "day"]).groupBy("device").agg(*correlation("price", "quantity"))
    return c.select("device", "n", R("r").alias("r"), R("slope").alias("slope"), R("intercept").alias("intercept"), R(p_of_r(F.col("r"), F.col("n"))).alias("p"))


EFFECT = f"""e AS (SELECT sh.device, count(*) FILTER (u) AS n1, count(*) FILTER (NOT u) AS n0, avg(quantity) FILTER (u) AS m1, avg(quantity) FILTER (NOT u) AS m0, var_samp(quantity) FILTER (u) AS v1, var_samp(quantity) FILTER (NOT u) AS v0
FROM (SELECT d.device, d.day, d.urgent > 0 AS u, quantity FROM d JOIN sh ON d.device = sh.device AND sh.day = d.day + 1) sh GROUP BY sh.device),
t AS (SELECT *, (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS t, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS cohen FROM e)"""


def effects(spark, sf):
    """Next-day outcome after days with and without a behaviour: Welch's t with a normal tail and Cohen's d."""
    pairs = lagged_days(daily(spark, sf), shipped(spark, sf), "device", 1).withColumn("u", F.col("urgent") > 0)
    on, off = F.when(F.col("u"), F.col("quantity")), F.when(~F.col("u"), F.col("quantity"))
    e = pairs.groupBy("device").agg(F.count(on).alias("n1"), F.count(off).alias("n0"), F.avg(on).alias("m1"), F.avg(off).alias("m0"), F.var_samp(on).alias("v1"), F.var_samp(off).alias("v0"))
    t = (F.col("m1") - F.col("m0")) / F.sqrt(F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    return e.withColumn("t", t).withColumn("cohen", (F.col("m1") - F.col("m0")) / pooled).withColumn("p", two_sided(F.col("t")))


@query(f"WITH {DAILY}, {SHIPPED}, {EFFECT} SELECT device, n1, n0, round(m1, 6) AS m1, round(m0, 6) AS m0, round(t, 6) AS t, round(cohen, 6) AS cohen, round({two_sided_sql('t')}, 6) AS p, (n1 >= 5 AND n0 >= 5 AND {two_sided_sql('t')} < 0.05) AS significant FROM t")
def behaviour_effect(spark, sf):
    return effects(spark, sf).select("device", "n1", "n0", *(R(c).alias(c) for c in ("m1", "m0", "t", "cohen", "p")), ((F.col("n1") >= 5) & (F.col("n0") >= 5) & (F.col("p") < 0.05)).alias("significant"))


@query(f"WITH {DAILY}, {SHIPPED}, {EFFECT} SELECT device, round(cohen, 6) AS cohen, row_number() OVER (ORDER BY abs(cohen) DESC, device) AS place FROM t")
def effect_ranking(spark, sf):
    w = W.orderBy(F.desc(F.abs("cohen")), "device")  # one row per behaviour
    return effects(spark, sf).select("device", R("cohen").alias("cohen"), F.row_number().over(w).alias("place"))


@query(f"""WITH {DAILY}, {SHIPPED}, j AS (SELECT d.device, least(d.urgent, 3) AS dose, quantity FROM d JOIN sh ON d.device = sh.device AND sh.day = d.day + 1),
f AS (SELECT device, count(*) AS n, regr_slope(quantity, dose) AS slope, avg(quantity) FILTER (dose = 0) AS base FROM j GROUP BY device),
g AS (SELECT *, greatest(-20, least(20, -2.0 + (n / (n + 8.0)) * (slope + 2.0))) AS shrunk FROM f), k AS (SELECT unnest([0, 1, 2, 3]) AS dose)
SELECT device, k.dose, n, round(shrunk, 6) AS slope, round(base + k.dose * shrunk, 6) AS expected FROM g CROSS JOIN k""")
def dose_response(spark, sf):
    """A slope on the dose, shrunk to a prior of -2 by n/(n+8), clamped, and its curve over doses 0 to 3."""
    j = lagged_days(daily(spark, sf).withColumn("dose", F.least("urgent", F.lit(3))), shipped(spark, sf), "device", 1)
    f = j.groupBy("device").agg(F.count("*").alias("n"), F.regr_slope("quantity", "dose").alias("slope"), F.avg(F.when(F.col("dose") == 0, F.col("quantity"))).alias("base"))
    shrunk = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), -2.0 + (F.col("n") / (F.col("n") + 8.0)) * (F.col("slope") + 2.0)))
    f = f.withColumn("slope", shrunk).withColumn("dose", F.explode(F.array(*map(F.lit, range(4)))))
    return f.select("device", "dose", "n", R("slope").alias("slope"), R(F.col("base") + F.col("dose") * F.col("slope")).alias("expected"))


@query(f"""WITH {DAILY}, {SHIPPED}, a AS (SELECT device, day, 'urgent' AS sport FROM d WHERE urgent >= 2 UNION ALL SELECT device, day, 'low' FROM d WHERE low >= 2),
rest AS (SELECT sh.device, avg(quantity) AS base FROM sh WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.device = sh.device AND a.day = sh.day - 1) GROUP BY sh.device)
SELECT a.device, sport, count(*) AS n, round(any_value(base) - avg(quantity), 6) AS cost FROM a JOIN sh ON a.device = sh.device AND sh.day = a.day + 1 JOIN rest ON rest.device = a.device GROUP BY a.device, sport HAVING count(*) >= 4""")
def activity_cost(spark, sf):
    d, sh = daily(spark, sf), shipped(spark, sf)
    a = d.select("device", "day", F.explode(F.filter(F.array(F.when(F.col("urgent") >= 2, "urgent"), F.when(F.col("low") >= 2, "low")), lambda x: x.isNotNull())).alias("sport"))
    after = a.withColumn("day", F.date_add("day", 1))
    base = sh.join(after, ["device", "day"], "left_anti").groupBy("device").agg(F.avg("quantity").alias("base"))
    out = after.join(sh, ["device", "day"]).groupBy("device", "sport").agg(F.count("*").alias("n"), F.avg("quantity").alias("mean")).filter("n >= 4")
    return out.join(base, "device").select("device", "sport", "n", R(F.col("base") - F.col("mean")).alias("cost"))


@query(f"""WITH {DAILY}, w AS (SELECT device, CAST(date_trunc('week', day) AS DATE) AS week, avg(price) AS mean, count(*) AS n FROM d GROUP BY ALL)
SELECT a.device, a.week, a.n, round(a.mean, 6) AS mean, round(a.mean - b.mean, 6) AS vs_last, round(a.mean - avg(c.mean), 6) AS vs_baseline FROM w a LEFT JOIN w b ON b.device = a.device AND b.week = a.week - 7
LEFT JOIN w c ON c.device = a.device AND c.week BETWEEN a.week - 28 AND a.week - 7 GROUP BY a.device, a.week, a.n, a.mean, b.mean""", days="week")
def weekly_digest(spark, sf):
    """Each week against the one before and the mean of the four before."""
    w = daily(spark, sf).groupBy("device", F.to_date(F.date_trunc("week", "day")).alias("week")).agg(F.avg("price").alias("mean"), F.count("*").alias("n"))
    w = w.withColumn("k", F.expr("datediff(week, DATE '1994-01-03') DIV 7"))
    last = W.partitionBy("device").orderBy("k").rangeBetween(-1, -1)
    base = W.partitionBy("device").orderBy("k").rangeBetween(-4, -1)
    return w.select("device", "week", "n", R("mean").alias("mean"), R(F.col("mean") - F.first("mean").over(last)).alias("vs_last"), R(F.col("mean") - F.avg("mean").over(base)).alias("vs_baseline"))


@query(f"""WITH {DAILY}, z AS (SELECT *, ntile(2) OVER (PARTITION BY device ORDER BY day) AS half FROM d WHERE day BETWEEN DATE '1997-01-01' AND DATE '1997-12-31')
SELECT device, count(*) AS n, round(avg(price), 6) AS mean, round(min(price), 6) AS low, arg_min(day, (price, day)) AS low_day, round(max(price), 6) AS high, arg_min(day, (-price, day)) AS high_day,
round(avg(price) FILTER (half = 1), 6) AS first_half, round(avg(price) FILTER (half = 2), 6) AS second_half, round(arg_max(price, day), 6) AS latest FROM z GROUP BY device""", days="low_day high_day")
def range_report(spark, sf):
    """Statistics of a range of days; extremes carry their first day, and halves show the trend."""
    z = daily(spark, sf).filter(F.col("day").between("1997-01-01", "1997-12-31")).withColumn("half", F.ntile(2).over(by("device", ["day"])))
    half = lambda k: R(F.avg(F.when(F.col("half") == k, F.col("price"))))
    return z.groupBy("device").agg(
        F.count("*").alias("n"), R(F.avg("price")).alias("mean"), R(F.min("price")).alias("low"), F.min_by("day", F.struct("price", "day")).alias("low_day"), R(F.max("price")).alias("high"),
        F.min_by("day", F.struct(-F.col("price"), F.col("day"))).alias("high_day"), half(1).alias("first_half"), half(2).alias("second_half"), R(F.max_by("price", "day")).alias("latest"),
    )


BEATS = "r AS (SELECT device, t // 86400 AS day, seq, t, 60000.0 / bpm AS rr FROM s), x AS (SELECT *, rr - lag(rr) OVER (PARTITION BY device, day ORDER BY t, seq) AS step FROM r WHERE rr BETWEEN 300 AND 2000)"


def beats(spark, sf):
    s = stream(spark, sf).select("device", F.expr("t DIV 86400").alias("day"), "seq", "t", (60000.0 / F.col("bpm")).alias("rr"))
    return s.filter(F.col("rr").between(300, 2000)).withColumn("step", F.col("rr") - F.lag("rr").over(by(["device", "day"], ["t", "seq"])))


@query(f"WITH {STREAM}, {BEATS} SELECT device, day, count(*) AS n, round(avg(rr), 6) AS mean_nn, round(stddev_samp(rr), 6) AS sdnn, round(sqrt(avg(step * step)), 6) AS rmssd, round(100.0 * count(*) FILTER (abs(step) > 50) / nullif(count(step), 0), 6) AS pnn50 FROM x GROUP BY ALL")
def hrv_time_domain(spark, sf):
    x = beats(spark, sf)
    return x.groupBy("device", "day").agg(F.count("*").alias("n"), R(F.avg("rr")).alias("mean_nn"), R(F.stddev_samp("rr")).alias("sdnn"), R(F.sqrt(F.avg(F.col("step") * F.col("step")))).alias("rmssd"), R(100.0 * F.count_if(F.abs("step") > 50) / F.nullif(F.count("step"), F.lit(0))).alias("pnn50"))


ECTOPIC = """m AS (SELECT *, median(rr) OVER (PARTITION BY device, day ORDER BY t, seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS mid, row_number() OVER (PARTITION BY device, day ORDER BY t, seq) AS i FROM x),
k AS (SELECT *, rr - lag(rr) OVER (PARTITION BY device, day ORDER BY i) AS gap, i - lag(i) OVER (PARTITION BY device, day ORDER BY i) AS hop FROM m WHERE abs(rr - mid) <= 0.2 * mid)"""


@query(f"WITH {STREAM}, {BEATS}, {ECTOPIC} SELECT device, day, count(*) AS kept, round(sqrt(avg(CASE WHEN hop = 1 THEN gap * gap END)), 6) AS rmssd FROM k GROUP BY ALL")
def hrv_gap_aware(spark, sf):
    """Beats far from the median of five are dropped, and no difference is taken across a dropped beat."""
    w = by(["device", "day"], ["t", "seq"])
    m = beats(spark, sf).withColumn("mid", F.percentile("rr", 0.5).over(w.rowsBetween(-2, 2))).withColumn("i", F.row_number().over(w)).filter(F.abs(F.col("rr") - F.col("mid")) <= 0.2 * F.col("mid"))
    v = by(["device", "day"], ["i"])
    m = m.withColumn("gap", F.col("rr") - F.lag("rr").over(v)).withColumn("hop", F.col("i") - F.lag("i").over(v))
    return m.groupBy("device", "day").agg(F.count("*").alias("kept"), R(F.sqrt(F.avg(F.when(F.col("hop") == 1, F.col("gap") * F.col("gap"))))).alias("rmssd"))


@query(f"""WITH {STREAM}, {BEATS}, z AS (SELECT *, max(t) OVER (PARTITION BY device) AS newest FROM x) SELECT device, count(*) AS n, round(sqrt(avg(step * step)), 6) AS rmssd, max(newest) - max(t) <= 900 AS fresh FROM z WHERE t > newest - 6 * 3600 GROUP BY device""")
def hrv_current(spark, sf):
    z = beats(spark, sf).withColumn("newest", F.max("t").over(W.partitionBy("device"))).filter(F.col("t") > F.col("newest") - 6 * 3600)
    return z.groupBy("device").agg(F.count("*").alias("n"), R(F.sqrt(F.avg(F.col("step") * F.col("step")))).alias("rmssd"), (F.max("newest") - F.max("t") <= 900).alias("fresh"))


@query(f"""WITH {STREAM}, {BEATS}, b AS (SELECT device, day, floor(rr / 50) AS bin, count(*) AS c FROM x GROUP BY ALL), n AS (SELECT device, day, count(*) AS n, max(rr) - min(rr) AS spread FROM x GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY device, day ORDER BY c DESC, bin) AS k FROM b) SELECT device, day, n, round((100.0 * c / n) / (2 * ((bin + 0.5) * 0.05) * (spread / 1000)), 6) AS stress FROM n JOIN k USING (device, day) WHERE k = 1 AND n >= 20 AND spread > 0""")
def stress_index(spark, sf):
    """Amplitude of the commonest 50 ms bin over twice its middle times the range."""
    x = beats(spark, sf).withColumn("bin", F.floor(F.col("rr") / 50))
    b = x.groupBy("device", "day", "bin").agg(F.count("*").alias("c"), F.min("rr").alias("a"), F.max("rr").alias("b"))
    g = b.groupBy("device", "day").agg(F.sum("c").alias("n"), (F.max("b") - F.min("a")).alias("spread"), F.min_by(F.struct("bin", "c"), F.struct(-F.col("c"), F.col("bin"))).alias("k")).filter("n >= 20 AND spread > 0")
    return g.select("device", "day", "n", R((100.0 * F.col("k.c") / F.col("n")) / (2 * ((F.col("k.bin") + 0.5) * 0.05) * (F.col("spread") / 1000))).alias("stress"))


@query(f"""WITH {STREAM}, m AS (SELECT device, t // 600 AS slot, count(*) AS c FROM s GROUP BY ALL), g AS (SELECT *, slot - lag(slot) OVER (PARTITION BY device ORDER BY slot) AS gap FROM m)
SELECT device, count(*) AS slots, count(*) FILTER (c = 1) AS one, count(*) FILTER (c = 2) AS two, count(*) FILTER (c = 3) AS three, count(*) FILTER (c >= 4) AS more, count(*) FILTER (gap = 1) AS next_slot, count(*) FILTER (gap BETWEEN 2 AND 7) AS near, count(*) FILTER (gap >= 8) AS far FROM g GROUP BY device""")
def emission_census(spark, sf):
    m = stream(spark, sf).groupBy("device", F.expr("t DIV 600").alias("slot")).agg(F.count("*").alias("c"))
    g = m.withColumn("gap", F.col("slot") - F.lag("slot").over(by("device", ["slot"])))
    count = lambda e, n: F.count_if(F.expr(e)).alias(n)
    return g.groupBy("device").agg(F.count("*").alias("slots"), count("c = 1", "one"), count("c = 2", "two"), count("c = 3", "three"), count("c >= 4", "more"), count("gap = 1", "next_slot"), count("gap BETWEEN 2 AND 7", "near"), count("gap >= 8", "far"))


EFFORT = """e AS (SELECT device, t // 86400 AS day, t, bpm, value, least(120.0, coalesce(lead(t) OVER w - t, t - lag(t) OVER w, 1.0)) AS sec FROM s WINDOW w AS (PARTITION BY device, t // 86400 ORDER BY t, seq)),
h AS (SELECT *, (bpm - 50) / (190 - 50) AS hrr FROM e), z AS (SELECT *, CASE WHEN hrr >= 0.9 THEN 5 WHEN hrr >= 0.8 THEN 4 WHEN hrr >= 0.7 THEN 3 WHEN hrr >= 0.6 THEN 2 WHEN hrr >= 0.5 THEN 1 ELSE 0 END AS zone FROM h)"""


def effort_rows(spark, sf):
    """Per row: how long it stands for, its share of the heart-rate reserve, and its zone."""
    s = stream(spark, sf).withColumn("day", F.expr("t DIV 86400"))
    s = s.withColumn("sec", capped_durations("t", by(["device", "day"], ["t", "seq"]), 120, 1.0)).withColumn("hrr", (F.col("bpm") - 50) / (190 - 50))
    zone = F.when(F.col("hrr") >= 0.9, 5).when(F.col("hrr") >= 0.8, 4).when(F.col("hrr") >= 0.7, 3).when(F.col("hrr") >= 0.6, 2).when(F.col("hrr") >= 0.5, 1).otherwise(0)
    return s.withColumn("zone", zone)


@query(f"""WITH {STREAM}, {EFFORT}, g AS (SELECT device, day, count(*) AS n, max(t) - min(t) AS span, sum(zone * sec) / 60 AS edwards, sum(sec / 60 * greatest(greatest(0, hrr) * 0.64 * exp(1.92 * greatest(0, hrr)) - 0.1 * 0.64 * exp(1.92 * 0.1), 0)) AS banister FROM z GROUP BY ALL)
SELECT device, day, n, round(edwards, 6) AS edwards, round(banister, 6) AS banister, CASE WHEN n >= 600 OR (n >= 20 AND span >= 600) THEN round(least(100, 100 * ln(edwards + 1) / ln(7201)), 6) END AS effort FROM g""")
def daily_session_summary(spark, sf):
    """Effort of each device and day: zone-weighted minutes, exponential load, and a logarithmic score where data suffice."""
    x = F.greatest(F.lit(0.0), F.col("hrr"))
    load = F.greatest(x * 0.64 * F.exp(1.92 * x) - 0.1 * 0.64 * F.exp(F.lit(1.92 * 0.1)), F.lit(0.0))
    g = effort_rows(spark, sf).groupBy("device", "day").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span"), (F.sum(F.col("zone") * F.col("sec")) / 60).alias("edwards"), F.sum(F.col("sec") / 60 * load).alias("banister"))
    enough = (F.col("n") >= 600) | ((F.col("n") >= 20) & (F.col("span") >= 600))
    return g.select("device", "day", "n", R("edwards").alias("edwards"), R("banister").alias("banister"), F.when(enough, R(F.least(F.lit(100.0), 100 * F.log(F.col("edwards") + 1) / F.log(F.lit(7201.0))))).alias("effort"))


@query(f"WITH {STREAM}, {EFFORT}, md AS (SELECT device, median(sec) AS cap FROM z GROUP BY device) SELECT z.device, zone, count(*) AS n, round(sum(least(sec, cap)), 6) AS seconds FROM z JOIN md USING (device) GROUP BY ALL")
def time_in_zone(spark, sf):
    z = effort_rows(spark, sf)
    caps = quantile(z, "device", "sec", 0.5, "cap")
    return z.join(caps, "device").groupBy("device", "zone").agg(F.count("*").alias("n"), R(F.sum(F.least("sec", "cap"))).alias("seconds"))


@query(f"""WITH {STREAM}, {EFFORT}, g AS (SELECT device, day, sum(zone * sec) / 60 AS x, avg(bpm) AS y FROM z GROUP BY ALL) SELECT device, round(exp(sum(ln(x + 1) * ln(y + 1)) / sum(ln(y + 1) * ln(y + 1))), 6) AS denominator FROM g WHERE x > 0 GROUP BY device""")
def denominator_fit(spark, sf):
    """Least squares through the origin in logarithms."""
    g = effort_rows(spark, sf).groupBy("device", "day").agg((F.sum(F.col("zone") * F.col("sec")) / 60).alias("x"), F.avg("bpm").alias("y")).filter("x > 0")
    lx, ly = F.log(F.col("x") + 1), F.log(F.col("y") + 1)
    return g.groupBy("device").agg(R(F.exp(F.sum(lx * ly) / F.sum(ly * ly))).alias("denominator"))


@query(f"WITH {STREAM} SELECT device, count(*) AS n, round(CASE WHEN count(*) >= 600 THEN greatest(quantile_cont(bpm, 0.995), 208 - 0.7 * 35) ELSE 208 - 0.7 * 35 END, 6) AS hr_max FROM s GROUP BY device")
def hr_max_estimate(spark, sf):
    floor = F.lit(208 - 0.7 * 35)
    s = stream(spark, sf)
    many = s.groupBy("device").agg(F.count("*").alias("n")).join(quantile(s, "device", "bpm", 0.995, "high"), "device", "left")
    return many.select("device", "n", R(F.when((F.col("n") >= 600) & F.col("high").isNotNull(), F.greatest("high", floor)).otherwise(floor)).alias("hr_max"))


@query(f"""WITH {STREAM}, h AS (SELECT device, t // 3600 AS hour, avg(bpm) AS hr, count(*) AS n FROM s GROUP BY ALL), b AS (SELECT device, avg(hr) AS mean, stddev_pop(hr) AS sd FROM h GROUP BY device)
SELECT h.device, hour, n, round(3 / (1 + exp(-(hr - mean) / sd)), 6) AS stress, hour % 24 BETWEEN 6 AND 21 AS waking FROM h JOIN b USING (device) WHERE n >= 2""")
def hourly_stress(spark, sf):
    h = stream(spark, sf).groupBy("device", F.expr("t DIV 3600").alias("hour")).agg(F.avg("bpm").alias("hr"), F.count("*").alias("n"))
    b = h.groupBy("device").agg(F.avg("hr").alias("mean"), F.stddev_pop("hr").alias("sd"))
    return h.join(b, "device").filter("n >= 2").select("device", "hour", "n", R(3 / (1 + F.exp(-(F.col("hr") - F.col("mean")) / F.col("sd")))).alias("stress"), (F.col("hour") % 24).between(6, 21).alias("waking"))


@query(f"WITH {STREAM} SELECT device, t // 86400 AS day, round(quantile_cont(bpm, 0.1), 6) AS p10, round(quantile_cont(60000 / bpm, 0.5), 6) AS p50, quantile_disc(seq, 0.9) AS p90_rank FROM s WHERE t % 86400 BETWEEN 21600 AND 79199 GROUP BY ALL")
def daytime_baselines(spark, sf):
    s = stream(spark, sf).filter((F.col("t") % 86400).between(21600, 79199))
    return s.groupBy("device", F.expr("t DIV 86400").alias("day")).agg(R(F.percentile("bpm", 0.1)).alias("p10"), R(F.percentile(60000 / F.col("bpm"), 0.5)).alias("p50"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY seq)").cast("long").alias("p90_rank"))


@query(f"""WITH {DAILY}, {SHIPPED}, q AS (SELECT device, quantity / price AS ratio, price AS weight FROM d JOIN sh USING (device, day) WHERE price > 1), c AS (SELECT *, sum(weight) OVER (PARTITION BY device ORDER BY ratio, weight) AS cum, sum(weight) OVER (PARTITION BY device) AS total FROM q),
m AS (SELECT device, min(ratio) AS mid FROM c WHERE cum >= total / 2 GROUP BY device) SELECT m.device, round(mid, 6) AS ratio, round(median(abs(ratio - mid)) / mid, 6) AS tightness FROM m JOIN q USING (device) GROUP BY m.device, mid""")
def weighted_median_ratio(spark, sf):
    q = daily(spark, sf).filter("price > 1").join(shipped(spark, sf), ["device", "day"]).select("device", (F.col("quantity") / F.col("price")).alias("ratio"), F.col("price").alias("weight"))
    c = q.withColumn("cum", F.sum("weight").over(by("device", ["ratio", "weight"]))).withColumn("total", F.sum("weight").over(W.partitionBy("device")))
    m = c.filter(F.col("cum") >= F.col("total") / 2).groupBy("device").agg(F.min("ratio").alias("mid"))
    return q.join(m, "device").groupBy("device", "mid").agg(R(F.percentile(F.abs(F.col("ratio") - F.col("mid")), 0.5) / F.col("mid")).alias("tightness")).select("device", R("mid").alias("ratio"), "tightness")


@query(f"""WITH {STREAM}, c AS (SELECT device, t // 86400 AS day, t, (CAST(value * 1000 AS BIGINT)) % 65536 AS counter, seq FROM s), g AS (SELECT *, (counter - lag(counter) OVER w + 65536) % 65536 AS delta, t - lag(t) OVER w AS gap FROM c WINDOW w AS (PARTITION BY device ORDER BY t, seq))
SELECT device, day, coalesce(sum(CAST(delta AS BIGINT)) FILTER (delta <= 20000 AND delta <= 40 * gap), 0) AS steps, count(*) FILTER (delta > 20000) AS rejected FROM g GROUP BY ALL""")
def counter_deltas(spark, sf):
    """Increases of a 16-bit counter that are plausible in size and rate."""
    s = stream(spark, sf).select("device", F.expr("t DIV 86400").alias("day"), "t", "seq", (F.round(F.col("value") * 1000).cast("long") % 65536).alias("counter"))
    w = by("device", ["t", "seq"])
    g = s.withColumn("delta", F.pmod(F.col("counter") - F.lag("counter").over(w), F.lit(65536))).withColumn("gap", F.col("t") - F.lag("t").over(w))
    ok = (F.col("delta") <= 20000) & (F.col("delta") <= 40 * F.col("gap"))
    return g.groupBy("device", "day").agg(F.coalesce(F.sum(F.when(ok, F.col("delta"))), F.lit(0)).alias("steps"), F.count_if(F.col("delta") > 20000).alias("rejected"))


@query(f"""WITH {DAILY}, p AS (SELECT device, unnest([sum(urgent), sum(high), sum(low), sum(n) - sum(urgent) - sum(high) - sum(low)]) AS v, unnest([0, 1, 2, 3]) AS part, sum(n) AS total FROM d GROUP BY device),
f AS (SELECT *, floor(100.0 * v / total) AS base, 100.0 * v / total - floor(100.0 * v / total) AS rest FROM p), g AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY rest DESC, part) AS k, 100 - sum(base) OVER (PARTITION BY device) AS missing FROM f)
SELECT device, part, CAST(base + CASE WHEN k <= missing THEN 1 ELSE 0 END AS BIGINT) AS percent FROM g""")
def largest_remainder(spark, sf):
    """Whole percentages that add to 100."""
    g = daily(spark, sf).groupBy("device").agg(*(F.sum(c).alias(c) for c in ("urgent", "high", "low", "n")))
    parts = F.array("urgent", "high", "low", F.col("n") - F.col("urgent") - F.col("high") - F.col("low"))
    f = g.select("device", F.col("n").alias("total"), F.posexplode(parts).alias("part", "v")).withColumn("exact", 100.0 * F.col("v") / F.col("total")).withColumn("base", F.floor("exact"))
    w = W.partitionBy("device")
    f = f.withColumn("k", F.row_number().over(w.orderBy(F.desc(F.col("exact") - F.col("base")), "part"))).withColumn("missing", 100 - F.sum("base").over(w))
    return f.select("device", "part", (F.col("base") + F.when(F.col("k") <= F.col("missing"), 1).otherwise(0)).alias("percent"))


@query(f"""WITH {STREAM} SELECT device, t // 86400 AS day, round(sum(value), 4) AS kcal, round(avg(value), 6) AS mean, round(max(value), 6) AS peak, count(*) FILTER (value > 50) AS active, arg_max(kind, seq) AS latest FROM s GROUP BY ALL""")
def energy_day_rollup(spark, sf):
    return stream(spark, sf).groupBy("device", F.expr("t DIV 86400").alias("day")).agg(R(F.sum("value"), 4).alias("kcal"), R(F.avg("value")).alias("mean"), R(F.max("value")).alias("peak"), F.count_if(F.col("value") > 50).alias("active"), F.max_by("kind", "seq").alias("latest"))


@query(f"WITH {STREAM}, b AS (SELECT device, t // 21600 AS bucket, round(sum(value), 4) AS kcal, count(*) AS n FROM s GROUP BY ALL) SELECT device, bucket // 4 AS day, count(*) AS buckets, string_agg(bucket % 4 || ':' || n, ',' ORDER BY bucket) AS series FROM b GROUP BY ALL")
def bucketed_series(spark, sf):
    b = stream(spark, sf).groupBy("device", F.expr("t DIV 21600").alias("bucket")).agg(F.count("*").alias("n"))
    g = b.groupBy("device", F.expr("bucket DIV 4").alias("day")).agg(F.count("*").alias("buckets"), F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("a"))
    return g.select("device", "day", "buckets", F.array_join(F.transform("a", lambda x: F.concat(x["bucket"] % 4, F.lit(":"), x["n"])), ",").alias("series"))


@query(f"WITH {STREAM}, c AS (SELECT device, t // 86400 AS day, kind, count(*) AS c FROM s WHERE kind <> 'error' GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY device, day ORDER BY c DESC, kind) AS k FROM c) SELECT device, day, kind, c FROM k WHERE k = 1")
def mode_with_tiebreak(spark, sf):
    c = stream(spark, sf).filter("kind <> 'error'").groupBy("device", F.expr("t DIV 86400").alias("day"), "kind").agg(F.count("*").alias("c"))
    return c.groupBy("device", "day").agg(F.min_by(F.struct("kind", "c"), F.struct(-F.col("c"), F.col("kind"))).alias("k")).select("device", "day", "k.kind", "k.c")


@query(f"WITH {STREAM}, z AS (SELECT length(props) + length(kind) + 24 AS bytes, row_number() OVER (ORDER BY t, seq) AS k FROM s WHERE device = 2) SELECT sum(bytes) AS bytes, count(*) AS n FROM z WHERE k <= 500")
def size_estimate(spark, sf):
    z = stream(spark, sf).filter("device = 2").orderBy("t", "seq").limit(500)
    return z.agg(F.sum(F.length("props") + F.length("kind") + 24).alias("bytes"), F.count("*").alias("n"))


@query(f"""WITH {DAILY}, z AS (SELECT *, day - DATE '1997-01-01' AS i FROM d WHERE day BETWEEN DATE '1997-01-01' AND DATE '1997-02-11') SELECT device, count(*) AS n, round(avg(price) - regr_slope(n, i) * 7700, 6) AS expenditure, count(*) >= 14 AND count(*) >= 0.7 * 42 AS enough FROM z GROUP BY device""")
def adaptive_expenditure(spark, sf):
    z = daily(spark, sf).filter(F.col("day").between("1997-01-01", "1997-02-11")).withColumn("i", F.datediff("day", F.lit("1997-01-01").cast("date")))
    return z.groupBy("device").agg(F.count("*").alias("n"), R(F.avg("price") - F.regr_slope("n", "i") * 7700).alias("expenditure"), ((F.count("*") >= 14) & (F.count("*") >= 0.7 * 42)).alias("enough"))


@query(f"WITH {STREAM} SELECT device, kind, t // 86400 AS day, round(arg_max(value, (t, seq)), 6) AS latest, round(avg(value), 6) AS mean FROM s GROUP BY ALL")
def marker_day_fold(spark, sf):
    return stream(spark, sf).groupBy("device", "kind", F.expr("t DIV 86400").alias("day")).agg(R(F.max_by("value", F.struct("t", "seq"))).alias("latest"), R(F.avg("value")).alias("mean"))


@query(f"WITH {STREAM}, x AS (SELECT device, kind, t // 86400 AS day, sum(value) AS v, avg(value) AS a FROM s GROUP BY ALL) SELECT device, day, round(max(v), 4) AS steps, round(avg(a), 6) AS mean, round(max(a), 6) AS top FROM x GROUP BY ALL")
def max_over_sources(spark, sf):
    """Sums per source first, then the largest source of a day, so that two recorders do not add up."""
    x = stream(spark, sf).groupBy("device", "kind", F.expr("t DIV 86400").alias("day")).agg(F.sum("value").alias("v"), F.avg("value").alias("a"))
    return x.groupBy("device", "day").agg(R(F.max("v"), 4).alias("steps"), R(F.avg("a")).alias("mean"), R(F.max("a")).alias("top"))


@query("SELECT r_regionkey, count(DISTINCT c_custkey) AS customers, count(DISTINCT c_mktsegment) AS segments, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def exact_distinct(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.groupBy("r_regionkey").agg(F.count_distinct("c_custkey").alias("customers"), F.count_distinct("c_mktsegment").alias("segments"), F.count("*").alias("n"))


@query(f"""WITH {STREAM}, {EFFORT}, p AS (SELECT zone, CAST(least(5, greatest(0, floor(value / 30))) AS INTEGER) AS guess FROM z), m AS (SELECT zone, guess, count(*) AS n FROM p GROUP BY ALL), t AS (SELECT sum(n) AS total, sum(n) FILTER (zone = guess) AS hit FROM m),
ex AS (SELECT sum(a.n * b.n) AS e FROM (SELECT zone AS k, sum(n) AS n FROM m GROUP BY 1) a JOIN (SELECT guess AS k, sum(n) AS n FROM m GROUP BY 1) b USING (k))
SELECT CAST(total AS BIGINT) AS n, round(hit / total, 6) AS accuracy, round((hit / total - e / (total * total)) / (1 - e / (total * total)), 6) AS kappa FROM t, ex""")
def agreement_kappa(spark, sf):
    p = effort_rows(spark, sf).select("zone", F.least(F.lit(5), F.greatest(F.lit(0), F.floor(F.col("value") / 30))).cast("int").alias("guess"))
    m = p.groupBy("zone", "guess").agg(F.count("*").alias("n"))
    either = m.select(F.explode(F.array(F.struct(F.col("zone").alias("k"), F.col("n").alias("a"), F.lit(0).cast("long").alias("b")), F.struct(F.col("guess").alias("k"), F.lit(0).cast("long").alias("a"), F.col("n").alias("b")))).alias("x"), F.lit(0).alias("hit"))
    hits = m.select(F.struct(F.lit(-1).alias("k"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("x"), F.when(F.col("zone") == F.col("guess"), F.col("n")).otherwise(0).alias("hit"))
    g = either.unionByName(hits).groupBy("x.k").agg(F.sum("x.a").alias("a"), F.sum("x.b").alias("b"), F.sum("hit").alias("hit")).agg(F.sum("a").alias("n"), F.sum("hit").alias("hit"), F.sum(F.col("a") * F.col("b")).alias("e"))
    chance, hit = F.col("e") / (F.col("n") * F.col("n")), F.col("hit") / F.col("n")
    return g.select("n", R(hit).alias("accuracy"), R((hit - chance) / (1 - chance)).alias("kappa"))


@query(f"""WITH {DAILY} SELECT device, day, key, round(value, 6) AS value FROM (SELECT device, day, price, CAST(n AS DOUBLE) AS n, CAST(nullif(urgent, 0) AS DOUBLE) AS urgent FROM d) UNPIVOT (value FOR key IN (price, n, urgent))""", days="day")
def unpivot_points(spark, sf):
    d = daily(spark, sf).withColumn("urgent", F.nullif("urgent", F.lit(0)))
    return long_metrics(d).withColumn("value", R("value"))


@query(f"""WITH {STREAM}, h AS (SELECT device, (t // 3600) % 24 AS hour, avg(bpm) AS y FROM s GROUP BY ALL), f AS (SELECT device, count(*) AS n, avg(y) AS mesor, 2 * avg(y * cos(2 * pi() * hour / 24)) AS a, 2 * avg(y * sin(2 * pi() * hour / 24)) AS b FROM h GROUP BY device HAVING count(*) = 24)
SELECT device, n, round(mesor, 6) AS mesor, round(sqrt(a * a + b * b), 6) AS amplitude, round(((atan2(b, a) * 24 / (2 * pi())) + 24) % 24, 4) AS acrophase FROM f""")
def cosinor(spark, sf):
    """Over all 24 hour bins the cosine and sine are orthogonal, so the normal equations are three means."""
    h = stream(spark, sf).groupBy("device", (F.expr("t DIV 3600") % 24).alias("hour")).agg(F.avg("bpm").alias("y"))
    turn = 2 * F.pi() * F.col("hour") / 24
    f = h.groupBy("device").agg(F.count("*").alias("n"), F.avg("y").alias("mesor"), (2 * F.avg(F.col("y") * F.cos(turn))).alias("a"), (2 * F.avg(F.col("y") * F.sin(turn))).alias("b")).filter("n = 24")
    return f.select("device", "n", R("mesor").alias("mesor"), R(F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b"))).alias("amplitude"), R((F.atan2("b", "a") * 24 / (2 * F.pi()) + 24) % 24, 4).alias("acrophase"))


@query(f"""WITH {DAILY}, z AS (SELECT *, avg(price) OVER w AS m, stddev_samp(price) OVER w AS sd, avg(n) OVER w AS mn, stddev_samp(n) OVER w AS sn FROM d WINDOW w AS (PARTITION BY device ORDER BY day ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, (price - m) / sd AS z1, (n - mn) / sn AS z2 FROM z WHERE sd > 0 AND sn > 0)
SELECT device, day, round(least(40, greatest(0, (z1 - 1) * 22)) + least(40, greatest(0, (z2 - 1) * 22)), 6) AS score, (z1 >= 2) AND (z2 >= 2) AS corroborated FROM q""", days="day")
def illness_signal(spark, sf):
    w = by("device", ["day"]).rowsBetween(-28, -1)
    d = daily(spark, sf)
    for c in ("price", "n"):
        d = d.withColumn(f"sd_{c}", F.stddev_samp(c).over(w)).withColumn(f"z_{c}", F.when(F.col(f"sd_{c}") > 0, (F.col(c) - F.avg(c).over(w)) / F.col(f"sd_{c}")))
    d = d.filter("sd_price > 0 AND sd_n > 0")
    part = lambda z: F.least(F.lit(40.0), F.greatest(F.lit(0.0), (F.col(z) - 1) * 22))
    return d.select("device", "day", R(part("z_price") + part("z_n")).alias("score"), ((F.col("z_price") >= 2) & (F.col("z_n") >= 2)).alias("corroborated"))


CHARGE = """z AS (SELECT *, avg(price) OVER w AS m, stddev_samp(price) OVER w AS sd, avg(n) OVER w AS mn, stddev_samp(n) OVER w AS sn, count(*) OVER w AS k FROM d WINDOW w AS (PARTITION BY device ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
q AS (SELECT device, day, (price - m) / nullif(sd, 0) AS z1, -(n - mn) / nullif(sn, 0) AS z2, CASE WHEN urgent > 0 THEN (high - 1) / 0.5 END AS z3 FROM z WHERE k >= 7),
c AS (SELECT *, 0.55 * (z1 IS NOT NULL)::INT + 0.20 * (z2 IS NOT NULL)::INT + 0.15 * (z3 IS NOT NULL)::INT AS weight, coalesce(0.55 * z1, 0) + coalesce(0.20 * z2, 0) + coalesce(0.15 * z3, 0) AS total FROM q)"""


def charge_rows(spark, sf):
    w = by("device", ["day"]).rowsBetween(-30, -1)
    d = daily(spark, sf).withColumn("k", F.count("*").over(w))
    z1 = (F.col("price") - F.avg("price").over(w)) / F.nullif(F.stddev_samp("price").over(w), F.lit(0.0))
    z2 = -(F.col("n") - F.avg("n").over(w)) / F.nullif(F.stddev_samp("n").over(w), F.lit(0.0))
    d = d.withColumn("z1", z1).withColumn("z2", z2).withColumn("z3", F.when(F.col("urgent") > 0, (F.col("high") - 1) / 0.5)).filter("k >= 7")
    parts = (("z1", 0.55), ("z2", 0.20), ("z3", 0.15))
    total = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return d.withColumn("weight", weight).withColumn("total", total)


@query(f"WITH {DAILY}, {CHARGE} SELECT device, day, round(100 / (1 + exp(-1.6 * (total / weight + 0.2))), 6) AS charge, CASE WHEN 100 / (1 + exp(-1.6 * (total / weight + 0.2))) < 34 THEN 'red' WHEN 100 / (1 + exp(-1.6 * (total / weight + 0.2))) < 67 THEN 'yellow' ELSE 'green' END AS band FROM c WHERE weight > 0", days="day")
def charge_composite(spark, sf):
    """A weighted mean of z-scores through a logistic; missing terms are left out and the weights renormalised."""
    c = charge_rows(spark, sf).filter("weight > 0").withColumn("charge", logistic(F.col("total") / F.col("weight"), 1.6, -0.2))
    return c.select("device", "day", R("charge").alias("charge"), F.when(F.col("charge") < 34, "red").when(F.col("charge") < 67, "yellow").otherwise("green").alias("band"))


@query(f"""WITH {DAILY}, {CHARGE}, f AS (SELECT device, day, unnest([1, 2, 3]) AS driver, unnest([0.55 * z1, 0.20 * z2, 0.15 * z3]) AS part, total, weight FROM c WHERE weight > 0)
SELECT device, day, driver, round(100 / (1 + exp(-1.6 * (total / weight + 0.2))) - 100 / (1 + exp(-1.6 * ((total - part) / weight + 0.2))), 6) AS points FROM f WHERE part IS NOT NULL""", days="day")
def charge_drivers(spark, sf):
    """What each driver adds: the score less the score with that driver neutral."""
    c = charge_rows(spark, sf).filter("weight > 0")
    c = c.select("device", "day", "total", "weight", F.posexplode(F.array(F.col("z1") * 0.55, F.col("z2") * 0.20, F.col("z3") * 0.15)).alias("k", "part")).filter("part IS NOT NULL")
    score = lambda t: logistic(t / F.col("weight"), 1.6, -0.2)
    return c.select("device", "day", (F.col("k") + 1).alias("driver"), R(score(F.col("total")) - score(F.col("total") - F.col("part"))).alias("points"))
