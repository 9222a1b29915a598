"""Composite scores and energy: calories, rest, saturation, fitness age, recovery of a watch, step bouts, activity types."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.stats import logistic
from ..operators.windows import by, capped_durations
from .aggregates import R
from .bindings import DAILY, SESSIONS, SHIPPED, STREAM, daily, sessions, shipped, stream, table

# Resting energy by weight, height and age, and energy by heart rate, weight and age, for men and women.
RESTING = {"m": (88.362, 13.397, 4.799, -5.677), "f": (447.593, 9.247, 3.098, -4.330)}
WORKING = {"m": (-55.0969, 0.6309, 0.1988, 0.2017), "f": (-20.4022, 0.4472, -0.1263, 0.074)}
DIVISOR, WEIGHT, HEIGHT, AGE = 251.04, 75, 178, 35


def _resting(sex: str) -> float:
    a, w, h, y = RESTING[sex]
    return (a + w * WEIGHT + h * HEIGHT + y * AGE) / 86400


CALORIES = f"""e AS (SELECT device, t // 86400 AS day, bpm, least(60.0, coalesce(lead(t) OVER w - t, t - lag(t) OVER w, 1.0)) AS sec FROM s WINDOW w AS (PARTITION BY device, t // 86400 ORDER BY t, bpm DESC)),
m AS (SELECT device, day, median(sec) AS cap FROM e GROUP BY ALL), r AS (SELECT e.*, cap, CASE WHEN device % 2 = 0 THEN {_resting("m")!r} ELSE {_resting("f")!r} END AS rest,
CASE WHEN device % 2 = 0 THEN -55.0969 + 0.6309 * bpm + 0.1988 * 75 + 0.2017 * 35 ELSE -20.4022 + 0.4472 * bpm - 0.1263 * 75 + 0.074 * 35 END / 251.04 AS gross FROM e JOIN m USING (device, day))"""


@query(f"WITH {STREAM}, {CALORIES} SELECT device, day, round(sum(rest * sec), 2) AS resting, round(sum(CASE WHEN bpm > 50 + 0.5 * (190 - 50) THEN greatest(0, gross - rest) * least(sec, cap) ELSE 0 END), 4) AS active FROM r GROUP BY ALL")
def day_calories(spark, sf):
    """A resting rate over the seconds seen, and what exceeds it while the heart works hard; coefficients by sex."""
    w = W.partitionBy("device", "day").orderBy("t", F.desc("bpm"))
    e = stream(spark, sf).withColumn("day", F.expr("t DIV 86400")).withColumn("sec", capped_durations("t", w, 60, 1.0))
    caps = e.groupBy("device", "day").agg(F.percentile("sec", 0.5).alias("cap"))
    men = F.col("device") % 2 == 0
    work = lambda a, h, w, y: (a + h * F.col("bpm") + w * WEIGHT + y * AGE) / DIVISOR
    rest = F.when(men, _resting("m")).otherwise(_resting("f"))
    gross = F.when(men, work(*WORKING["m"])).otherwise(work(*WORKING["f"]))
    active = F.when(F.col("bpm") > 50 + 0.5 * (190 - 50), F.greatest(F.lit(0.0), gross - rest) * F.least("sec", "cap")).otherwise(0.0)
    return e.join(caps, ["device", "day"]).groupBy("device", "day").agg(R(F.sum(rest * F.col("sec")), 2).alias("resting"), R(F.sum(active), 4).alias("active"))


@query(f"""WITH {DAILY}, z AS (SELECT *, stddev_samp(n) OVER (PARTITION BY device ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS spread FROM d)
SELECT device, day, round(100 * (0.50 * least(1, price / 480) + 0.20 * (n / (n + 1.0)) + 0.20 * ((urgent + high) / CAST(n AS DOUBLE)) + 0.10 * greatest(0, 1 - coalesce(spread, 0) / 3)), 4) AS rest FROM z""", days="day")
def rest_composite(spark, sf):
    """Half duration, a fifth each efficiency and restorative share, a tenth consistency."""
    spread = F.coalesce(F.stddev_samp("n").over(by("device", ["day"]).rowsBetween(-6, 0)), F.lit(0.0))
    n = F.col("n")
    score = 0.50 * F.least(F.lit(1.0), F.col("price") / 480) + 0.20 * (n / (n + 1.0)) + 0.20 * ((F.col("urgent") + F.col("high")) / n) + 0.10 * F.greatest(F.lit(0.0), 1 - spread / 3)
    return daily(spark, sf).select("device", "day", R(100 * score, 4).alias("rest"))


SATURATION = """z AS (SELECT device, day, (price - avg(price) OVER w) / nullif(stddev_samp(price) OVER w, 0) AS zh, (n - avg(n) OVER w) / nullif(stddev_samp(n) OVER w, 0) AS zr FROM d WINDOW w AS (PARTITION BY device ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))"""


@query(f"WITH {DAILY}, {SATURATION} SELECT device, day, round(CASE WHEN zh < 0 AND zr < -0.5 THEN zh * (1 - 0.5 * least(1, (-zr - 0.5) / (1.5 - 0.5))) ELSE zh END, 6) AS damped FROM z WHERE zh IS NOT NULL AND zr IS NOT NULL", days="day")
def saturation_damping(spark, sf):
    """A low first score counts less when the second is low too."""
    w = by("device", ["day"]).rowsBetween(-30, -1)
    z = lambda c: (F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_samp(c).over(w), F.lit(0.0))
    rows = daily(spark, sf).select("device", "day", z("price").alias("zh"), z("n").alias("zr")).filter("zh IS NOT NULL AND zr IS NOT NULL")
    damp = 1 - 0.5 * F.least(F.lit(1.0), (-F.col("zr") - 0.5) / (1.5 - 0.5))
    return rows.select("device", "day", R(F.when((F.col("zh") < 0) & (F.col("zr") < -0.5), F.col("zh") * damp).otherwise(F.col("zh"))).alias("damped"))


@query(f"""WITH {DAILY}, z AS (SELECT device, day, ln(price) AS x, avg(ln(price)) OVER w AS m, stddev_samp(ln(price)) OVER w AS sd, count(*) OVER w AS k FROM d WINDOW w AS (PARTITION BY device ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
SELECT device, day, round(100 / (1 + exp(-1.6 * ((x - m) / sd + 0.2))), 4) AS recovery FROM z WHERE k >= 7 AND sd > 0""", days="day")
def watch_recovery(spark, sf):
    w = by("device", ["day"]).rowsBetween(-30, -1)
    x = F.log("price")
    z = daily(spark, sf).select("device", "day", x.alias("x"), F.avg(x).over(w).alias("m"), F.stddev_samp(x).over(w).alias("sd"), F.count("*").over(w).alias("k")).filter("k >= 7 AND sd > 0")
    return z.select("device", "day", R(logistic((F.col("x") - F.col("m")) / F.col("sd"), 1.6, -0.2), 4).alias("recovery"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'm' ELSE 'f' END AS sex, round(CASE WHEN c_nationkey % 2 = 0 THEN 92.05 - 0.327 * (20 + c_custkey % 60) - 0.933 * 24 ELSE 70.77 - 0.244 * (20 + c_custkey % 60) - 0.749 * 24 END + 0.167 * (c_acctbal / 500), 6) AS vo2,
round(least(80, greatest(20, (20 + c_custkey % 60) - (c_acctbal / 500 - 5) * 0.5)), 6) AS fitness_age FROM customer""")
def fitness_age(spark, sf):
    """A linear model of oxygen uptake by sex, and an age shifted by an activity index."""
    age, men, active = 20 + F.col("c_custkey") % 60, F.col("c_nationkey") % 2 == 0, F.col("c_acctbal") / 500
    vo2 = F.when(men, 92.05 - 0.327 * age - 0.933 * 24).otherwise(70.77 - 0.244 * age - 0.749 * 24) + 0.167 * active
    return table(spark, sf, "customer").select("c_custkey", F.when(men, "m").otherwise("f").alias("sex"), R(vo2).alias("vo2"), R(F.least(F.lit(80.0), F.greatest(F.lit(20.0), age - (active - 5) * 0.5))).alias("fitness_age"))


@query(f"""WITH {STREAM}, g AS (SELECT device, t, seq, value, CASE WHEN t - lag(t) OVER (PARTITION BY device ORDER BY t, seq) <= 1800 THEN 0 ELSE 1 END AS cut FROM s WHERE value > 20), b AS (SELECT *, sum(cut) OVER (PARTITION BY device ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS bout FROM g)
SELECT device, min(t) AS start_t, count(*) AS ticks, round(sum(value), 4) AS steps FROM b GROUP BY device, bout HAVING count(*) >= 3 AND max(t) - min(t) >= 1200""")
def gait_bouts(spark, sf):
    """Runs of active rows without long gaps, if they have enough rows and last long enough."""
    from ..operators.windows import islands

    b = islands(stream(spark, sf).filter("value > 20"), "device", ["t", "seq"], "t", 1800, "bout")
    g = b.groupBy("device", "bout").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("ticks"), R(F.sum("value"), 4).alias("steps"))
    return g.filter((F.col("ticks") >= 3) & (F.col("end_t") - F.col("start_t") >= 1200)).select("device", "start_t", "ticks", "steps")


@query(f"""WITH {SESSIONS}, j AS (SELECT ss.device, ss.start_t, s.t, s.kind, s.value FROM ss JOIN s ON s.device = ss.device AND s.t BETWEEN ss.start_t AND ss.end_t), m AS (SELECT device, start_t, t // 1800 AS slot, var_pop(value) AS v, count(*) FILTER (kind = 'click') AS ticks FROM j GROUP BY ALL)
SELECT device, start_t, count(*) AS slots, count(*) FILTER (v <= 400) AS stable, (count(*) FILTER (v <= 400) >= 0.5 * count(*) AND max(ticks) < 3) AS flipped FROM m GROUP BY ALL""")
def wake_refinement(spark, sf):
    """A span counts as asleep if posture is stable in half its bins and no bin holds a walk."""
    from ..operators.joins import contained

    j = contained(stream(spark, sf), sessions(spark, sf).drop("n"), "device", "t", "start_t", "end_t", 86400)
    m = j.groupBy("device", "start_t", F.expr("t DIV 1800").alias("slot")).agg(F.var_pop("value").alias("v"), F.count_if(F.col("kind") == "click").alias("ticks"))
    calm = F.count_if(F.col("v") <= 400)
    return m.groupBy("device", "start_t").agg(F.count("*").alias("slots"), calm.alias("stable"), ((calm >= 0.5 * F.count("*")) & (F.max("ticks") < 3)).alias("flipped"))


@query(f"""WITH {SESSIONS}, f AS (SELECT ss.device, ss.start_t, avg(s.bpm) AS hr, stddev_pop(s.value) AS spread, count(*) FILTER (s.kind = 'view') * 1.0 / count(*) AS views FROM ss JOIN s ON s.device = ss.device AND s.t BETWEEN ss.start_t AND ss.end_t GROUP BY ALL),
q AS (SELECT *, greatest(0, 1 - abs(hr - 60) / 20) * 0.5 + least(1, spread / 60) * 0.5 AS run, greatest(0, 1 - abs(hr - 58) / 20) * 0.5 + greatest(0, 1 - spread / 60) * 0.5 AS ride, views AS walk FROM f)
SELECT device, start_t, round(run, 6) AS run, round(ride, 6) AS ride, round(walk, 6) AS walk, CASE WHEN greatest(run, ride, walk) < 0.4 THEN 'other' WHEN run >= ride AND run >= walk THEN 'run' WHEN ride >= walk THEN 'ride' ELSE 'walk' END AS sport FROM q""")
def activity_type(spark, sf):
    """Fuzzy scores of a session's features; the best one names it if it is good enough."""
    from ..operators.joins import contained

    f = contained(stream(spark, sf), sessions(spark, sf).drop("n"), "device", "t", "start_t", "end_t", 86400).groupBy("device", "start_t").agg(F.avg("bpm").alias("hr"), F.stddev_pop("value").alias("spread"), (F.count_if(F.col("kind") == "view") * 1.0 / F.count("*")).alias("walk"))
    zero, one = F.lit(0.0), F.lit(1.0)
    near = lambda c: F.greatest(zero, 1 - F.abs(F.col("hr") - c) / 20) * 0.5
    f = f.withColumn("run", near(60) + F.least(one, F.col("spread") / 60) * 0.5).withColumn("ride", near(58) + F.greatest(zero, 1 - F.col("spread") / 60) * 0.5)
    sport = F.when(F.greatest("run", "ride", "walk") < 0.4, "other").when((F.col("run") >= F.col("ride")) & (F.col("run") >= F.col("walk")), "run").when(F.col("ride") >= F.col("walk"), "ride").otherwise("walk")
    return f.select("device", "start_t", R("run").alias("run"), R("ride").alias("ride"), R("walk").alias("walk"), sport.alias("sport"))


def band_ratio(t: np.ndarray, x: np.ndarray, low: float, high: float, n: int = 256) -> tuple[float, float]:
    """The strongest frequency of a band after even resampling, and its share of all power."""
    if len(x) < 8 or t[-1] <= t[0]:
        return np.nan, np.nan
    grid = np.linspace(t[0], t[-1], n)
    y = np.interp(grid, t, x)
    power = np.abs(np.fft.rfft((y - y.mean()) * np.hanning(n))) ** 2
    f = np.fft.rfftfreq(n, (t[-1] - t[0]) / (n - 1))
    inside = (f >= low) & (f <= high)
    if not inside.any() or not power.sum():
        return np.nan, np.nan
    best = int(np.argmax(np.where(inside, power, -1)))
    return float(f[best]), float(power[best] / power.sum())


def _regularity(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["t", "seq"])
    beat = np.cumsum(60 / pdf["bpm"].to_numpy())
    f, share = band_ratio(beat, pdf["bpm"].to_numpy(), 0.1, 0.5)
    return pd.DataFrame({"device": pdf["device"].iloc[:1], "day": pdf["day"].iloc[:1], "frequency": [f], "share": [share]})


@query()
def breathing_regularity(spark, sf):
    s = stream(spark, sf).select("device", F.expr("t DIV 86400").alias("day"), "t", "seq", "bpm")
    return s.groupBy("device", "day").applyInPandas(_regularity, "device long, day long, frequency double, share double")


def _sweep(pdf: pd.DataFrame) -> pd.DataFrame:
    """Amplitude at each pace by least squares on a cosine and a sine."""
    pdf = pdf.sort_values(["t", "seq"])
    x, beat = pdf["bpm"].to_numpy(), np.cumsum(60 / pdf["bpm"].to_numpy())
    out = []
    for pace in (4.5, 5.0, 5.5, 6.0, 6.5):
        w = 2 * np.pi * pace / 60 * beat
        a = np.column_stack([np.cos(w), np.sin(w), np.ones(len(x))])
        c = np.linalg.lstsq(a, x, rcond=None)[0]
        out.append((pace, float(np.hypot(c[0], c[1]))))
    frame = pd.DataFrame(out, columns=["pace", "amplitude"])
    frame["best"] = frame["amplitude"] == frame["amplitude"].max()
    frame.insert(0, "device", pdf["device"].iloc[0])
    frame.insert(1, "day", pdf["day"].iloc[0])
    return frame


@query()
def resonance_sweep(spark, sf):
    """The response of each device and day at five breathing paces, and the best of them."""
    s = stream(spark, sf).select("device", F.expr("t DIV 86400").alias("day"), "t", "seq", "bpm")
    return s.groupBy("device", "day").applyInPandas(_sweep, "device long, day long, pace double, amplitude double, best boolean")


@query(f"""WITH {STREAM} SELECT device, t // 86400 AS day, count(*) FILTER (value >= 30) AS minutes, round(sum(CASE WHEN value >= 30 THEN (value / 20 - 1) * 70 / 60 ELSE 0 END), 6) AS kcal FROM s GROUP BY ALL""")
def met_minutes(spark, sf):
    active = F.col("value") >= 30
    return stream(spark, sf).groupBy("device", F.expr("t DIV 86400").alias("day")).agg(F.count_if(active).alias("minutes"), R(F.sum(F.when(active, (F.col("value") / 20 - 1) * 70 / 60).otherwise(0.0))).alias("kcal"))


@query(f"""WITH {STREAM}, z AS (SELECT device, t // 86400 AS day, CASE WHEN bpm < 55 THEN 0 WHEN bpm < 75 THEN 1 ELSE 2 END AS truth, CASE WHEN value < 25 THEN 0 WHEN value < 100 THEN 1 ELSE 2 END AS guess FROM s), k AS (SELECT unnest([0, 1, 2]) AS label)
SELECT label, count(*) FILTER (truth = label AND guess = label) AS hit, round(2.0 * count(*) FILTER (truth = label AND guess = label) / (count(*) FILTER (truth = label) + count(*) FILTER (guess = label)), 6) AS f1 FROM z, k GROUP BY label""")
def label_f1(spark, sf):
    z = stream(spark, sf).select(F.when(F.col("bpm") < 55, 0).when(F.col("bpm") < 75, 1).otherwise(2).alias("truth"), F.when(F.col("value") < 25, 0).when(F.col("value") < 100, 1).otherwise(2).alias("guess"))
    m = z.groupBy("truth", "guess").agg(F.count("*").alias("n"))
    both = m.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("seen"), F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("guess").alias("label"), F.col("n").alias("seen"), F.lit(0).cast("long").alias("hit")))).alias("x"))
    g = both.groupBy("x.label").agg(F.sum("x.hit").alias("hit"), F.sum("x.seen").alias("seen"))
    return g.select("label", "hit", R(2.0 * F.col("hit") / F.col("seen")).alias("f1"))
