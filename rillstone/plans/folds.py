"""Folds over daily histories: winsorised baseline, training load, sleep debt, Viterbi labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..catalog import query
from ..operators.folds import states
from ..operators.joins import day_spine
from .aggregates import R
from .bindings import DAILY, daily, stream

EPOCH = "2000-06-01"


#: Half-lives of centre and spread in nights (young ones are shorter), floor of the spread, young nights, clips.
CENTRE, SPREAD, FLOOR, YOUNG, YOUNG_HALF, INFLATE, WINSOR, HARD = 14, 21, 5.0, 8, 3.0, 2.5, 3.0, 5.0


@query(f"""WITH RECURSIVE {DAILY}, q AS (SELECT device, day, price, row_number() OVER (PARTITION BY device ORDER BY day) AS k FROM d),
f AS (SELECT device, k, day, price AS base, CAST(100 AS DOUBLE) AS spread, CAST(1 AS BIGINT) AS n FROM q WHERE k = 1
UNION ALL SELECT q.device, q.k, q.day,
 CASE WHEN f.n >= 8 AND abs(q.price - f.base) > 5 * f.spread THEN f.base ELSE f.base + (1 - power(0.5, 1.0 / CASE WHEN f.n < 8 THEN 3.0 ELSE 14.0 END)) * (least(greatest(q.price, f.base - 3 * f.spread * CASE WHEN f.n < 8 THEN 2.5 ELSE 1 END), f.base + 3 * f.spread * CASE WHEN f.n < 8 THEN 2.5 ELSE 1 END) - f.base) END,
 CASE WHEN f.n >= 8 AND abs(q.price - f.base) > 5 * f.spread THEN f.spread ELSE greatest(5.0, f.spread + (1 - power(0.5, 1.0 / 21)) * (abs(least(greatest(q.price, f.base - 3 * f.spread * CASE WHEN f.n < 8 THEN 2.5 ELSE 1 END), f.base + 3 * f.spread * CASE WHEN f.n < 8 THEN 2.5 ELSE 1 END) - f.base) * 1.2533 - f.spread)) END,
 CASE WHEN f.n >= 8 AND abs(q.price - f.base) > 5 * f.spread THEN f.n ELSE f.n + 1 END
 FROM f JOIN q ON q.device = f.device AND q.k = f.k + 1)
SELECT device, day, round(base, 4) AS base, round(spread, 4) AS spread, n, CASE WHEN n < 4 THEN 'calibrating' WHEN n < 14 THEN 'provisional' ELSE 'trusted' END AS status FROM f""", days="day")
def ewma_baseline(spark, sf):
    """A winsorised moving baseline: young nights adapt faster and clip wider, far outliers are held, the spread has a floor."""

    def step(s, row):
        x, base, spread, n = row["price"], s["base"], s["spread"], s["n"]
        young = n < YOUNG
        reach = WINSOR * spread * F.when(young, INFLATE).otherwise(1.0)
        clipped = F.least(F.greatest(x, base - reach), base + reach)
        alpha = 1 - F.pow(F.lit(0.5), 1.0 / F.when(young, YOUNG_HALF).otherwise(float(CENTRE)))
        held = (n >= YOUNG) & (F.abs(x - base) > HARD * spread)
        new_spread = F.greatest(F.lit(FLOOR), spread + (1 - 0.5 ** (1.0 / SPREAD)) * (F.abs(clipped - base) * 1.2533 - spread))
        later = F.struct(F.when(held, base).otherwise(base + alpha * (clipped - base)).alias("base"), F.when(held, spread).otherwise(new_spread).alias("spread"), (n + F.when(held, 0).otherwise(1)).cast("long").alias("n"))
        first = F.struct(x.alias("base"), F.lit(100.0).alias("spread"), F.lit(1).cast("long").alias("n"))
        return F.when(n == 0, first).otherwise(later)

    start = F.struct(F.lit(0.0).alias("base"), F.lit(0.0).alias("spread"), F.lit(0).cast("long").alias("n"))
    f = states(daily(spark, sf), "device", "day", ["price"], start, step)
    n = F.col("state.n")
    return f.select("device", "day", R("state.base", 4).alias("base"), R("state.spread", 4).alias("spread"), n.alias("n"), F.when(n < 4, "calibrating").when(n < 14, "provisional").otherwise("trusted").alias("status"))


@query(f"""WITH RECURSIVE {DAILY}, q AS (SELECT device, day, price, day >= DATE '{EPOCH}' AS since, row_number() OVER (PARTITION BY device, day >= DATE '{EPOCH}' ORDER BY day) AS k FROM d),
f AS (SELECT device, since, k, day, price AS base FROM q WHERE k = 1 UNION ALL SELECT q.device, q.since, q.k, q.day, f.base + (1 - power(0.5, 1.0 / 14)) * (q.price - f.base) FROM f JOIN q ON q.device = f.device AND q.since = f.since AND q.k = f.k + 1) SELECT device, day, since, round(base, 4) AS base FROM f""", days="day")
def baseline_since_epoch(spark, sf):
    """A fold that starts anew at an epoch: nights before it do not reach those since."""
    rows = daily(spark, sf).withColumn("since", F.col("day") >= F.lit(EPOCH).cast("date")).withColumn("part", F.struct("device", "since"))
    f = states(rows, "part", "day", ["price"], F.lit(None).cast("double"), lambda s, row: F.when(s.isNull(), row["price"]).otherwise(s + (1 - 0.5 ** (1.0 / 14)) * (row["price"] - s)))
    return f.select("part.device", "day", "part.since", R("state", 4).alias("base"))


@query(f"""WITH RECURSIVE {DAILY}, r AS (SELECT device, min(day) AS a, max(day) AS b FROM d GROUP BY device), sp AS (SELECT device, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM r), x AS (SELECT sp.device, sp.day, coalesce(price, 0) AS load FROM sp LEFT JOIN d USING (device, day)),
q AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY day) AS k FROM x), p AS (SELECT device, avg(load) AS prime FROM q WHERE k <= 7 GROUP BY device),
f AS (SELECT q.device, k, day, prime AS slow, prime AS fast FROM q JOIN p USING (device) WHERE k = 7 UNION ALL SELECT q.device, q.k, q.day, f.slow + (1 - exp(-1.0 / 42)) * (load - f.slow), f.fast + (1 - exp(-1.0 / 7)) * (load - f.fast) FROM f JOIN q ON q.device = f.device AND q.k = f.k + 1)
SELECT device, day, round(slow, 4) AS fitness, round(fast, 4) AS fatigue, round(slow - fast, 4) AS form FROM f""", days="day")
def training_load(spark, sf):
    """Two exponential averages (42 and 7 days) over a gapless calendar, both from the mean of the first week."""
    d = daily(spark, sf)
    x = day_spine(d, "device").join(d, ["device", "day"], "left").select("device", "day", F.coalesce("price", F.lit(0.0)).alias("load"))

    def step(s, row):
        k = s["k"] + 1
        prime = s["prime"] + F.when(k <= 7, row["load"] / 7).otherwise(0.0)
        move = lambda c, tau: F.when(k == 7, prime).when(k > 7, s[c] + (1 - np.exp(-1.0 / tau)) * (row["load"] - s[c])).otherwise(0.0)
        return F.struct(k.alias("k"), prime.alias("prime"), move("slow", 42).alias("slow"), move("fast", 7).alias("fast"))

    start = F.struct(F.lit(0).alias("k"), *(F.lit(0.0).alias(c) for c in ("prime", "slow", "fast")))
    f = states(x, "device", "day", ["load"], start, step).filter("state.k >= 7")
    return f.select("device", "day", R("state.slow", 4).alias("fitness"), R("state.fast", 4).alias("fatigue"), R(F.col("state.slow") - F.col("state.fast"), 4).alias("form"))


@query(f"""WITH RECURSIVE {DAILY}, z AS (SELECT device, day, price, row_number() OVER (PARTITION BY device ORDER BY day DESC) AS back FROM d), q AS (SELECT device, day, price, row_number() OVER (PARTITION BY device ORDER BY day) AS k FROM z WHERE back <= 14),
f AS (SELECT device, k, day, 0.55 * greatest(0, 480 - price) AS debt FROM q WHERE k = 1 UNION ALL SELECT q.device, q.k, q.day, CASE WHEN 0.55 * greatest(0, 480 + f.debt - q.price) < 10 THEN 0 ELSE 0.55 * greatest(0, 480 + f.debt - q.price) END FROM f JOIN q ON q.device = f.device AND q.k = f.k + 1)
SELECT device, day, round(CASE WHEN debt < 10 THEN 0 ELSE debt END, 4) AS debt FROM f""", days="day")
def debt_recurrence(spark, sf):
    """What is owed carries on by 0.55 a night and is forgotten below ten, over the last fourteen nights."""
    from pyspark.sql import Window as W

    last = daily(spark, sf).withColumn("back", F.row_number().over(W.partitionBy("device").orderBy(F.desc("day")))).filter("back <= 14")

    def step(debt, row):
        raw = 0.55 * F.greatest(F.lit(0.0), 480 + debt - row["price"])
        return F.when(raw < 10, 0.0).otherwise(raw)

    return states(last, "device", "day", ["price"], F.lit(0.0), step).select("device", "day", R("state", 4).alias("debt"))


# Transition probabilities of the four labels (deep, rem, light, awake), and their priors.
LABELS = ("deep", "rem", "light", "awake")
TRANSITIONS = np.array([[0.86, 0.007, 0.126, 0.007], [0.005, 0.88, 0.10, 0.015], [0.06, 0.06, 0.85, 0.03], [0.0, 0.0, 0.10, 0.90]])
PRIORS = np.array([0.18, 0.22, 0.50, 0.10])


def viterbi(emissions: np.ndarray) -> np.ndarray:
    """The likeliest label sequence for log emissions (rows of four)."""
    log_t, score = np.log(np.maximum(TRANSITIONS, 1e-9)), np.log(PRIORS) + emissions[0]
    back = np.zeros(emissions.shape, np.int64)
    for k in range(1, len(emissions)):
        paths = score[:, None] + log_t
        back[k] = paths.argmax(0)
        score = paths.max(0) + emissions[k]
    out = np.empty(len(emissions), np.int64)
    out[-1] = score.argmax()
    for k in range(len(emissions) - 1, 0, -1):
        out[k - 1] = back[k, out[k]]
    return out


#: Epochs asleep in a row that make the onset; how long after it rem is held back, and by how much.
ONSET_EPOCHS, GUARD_S, GUARD_PENALTY = 10, 3600, 3.0


def guarded(emissions: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Two decodes: the first finds the onset, the second holds rem back for a while after it."""
    labels = viterbi(emissions)
    asleep = labels != LABELS.index("awake")
    onset = next((k for k in range(len(asleep) - ONSET_EPOCHS + 1) if asleep[k : k + ONSET_EPOCHS].all()), None)
    if onset is None:
        return labels
    early = (t >= t[onset]) & (t < t[onset] + GUARD_S)
    again = emissions.copy()
    again[early, LABELS.index("rem")] -= GUARD_PENALTY
    return viterbi(again)


def _label_night(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["t", "seq"])
    z = lambda c: ((c - c.mean()) / (c.std(ddof=0) or 1.0)).fillna(0).to_numpy()
    move, hr = z(pdf["value"]), z(pdf["bpm"])
    var = z(pdf["bpm"].rolling(11, center=True, min_periods=1).std(ddof=0).fillna(0))
    e = np.stack([-1.1 * var - 0.5 * move, 0.6 * var - 0.6 * move + 0.4 * hr, np.zeros(len(pdf)), move + 0.8 * var + 0.4 * hr], 1)
    return pd.DataFrame({"device": pdf["device"], "day": pdf["day"], "seq": pdf["seq"], "label": [LABELS[k] for k in guarded(e, pdf["t"].to_numpy())]})


@query()
def viterbi_labels(spark, sf):
    """A four-label hidden Markov decode of each device's day; a day bounds the group."""
    s = stream(spark, sf).select("device", F.expr("t DIV 86400").alias("day"), "seq", "t", "value", "bpm")
    return s.groupBy("device", "day").applyInPandas(_label_night, "device long, day long, seq long, label string")


@query()
def hypnogram_rollup(spark, sf):
    """Counts of each label, transitions and latency over the decoded days."""
    from ..operators.windows import by

    v = viterbi_labels(spark, sf).withColumn("moved", (F.col("label") != F.lag("label").over(by(["device", "day"], ["seq"]))).cast("int"))
    count = lambda n: F.count_if(F.col("label") == n).alias(n)
    return v.groupBy("device", "day").agg(*map(count, LABELS), F.sum("moved").alias("transitions"), (F.count_if(F.col("label") != "awake") / F.count("*")).alias("efficiency"))
