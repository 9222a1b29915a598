"""The nightly bundle of signals over daily rows, and the catalogue of metrics by source and category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..operators.windows import by
from .aggregates import R
from .bindings import DAILY, STREAM, daily, stream

# Nights of a baseline and how many it needs, the score at which a signal is told, and when a distance fires.
WINDOW, TRUSTED, TOLD, FAR, DEVIATING, EACH = 30, 14, 2.0, 2.5, 2, 2.0
#: Signals, the column that stands for each, and the direction that is like illness.
SIGNALS = {"resting": ("price", 1), "warmth": ("high", 1), "variability": ("n", -1), "breath": ("urgent", 1)}


def nightly(days: DataFrame, key: str, day: str, signals: dict[str, tuple[str, int]]) -> DataFrame:
    """Per key and day: each signal's score against the nights before (null until enough of them have a value), turned so that
    high is like illness; the signals told; their distance from usual with equal weights; whether it fires; whether the
    baseline is trusted. Nights without any value count as nights of the window, not of the baseline."""
    w = by(key, [day]).rowsBetween(-WINDOW, -1)
    any_value = F.coalesce(*(F.col(c).cast("double") for c, _ in signals.values())).isNotNull()
    z = {}
    for name, (c, sign) in signals.items():
        x = F.col(c).cast("double")
        score = (x - F.avg(x).over(w)) / F.greatest(F.stddev_samp(x).over(w), F.lit(1e-6))
        z[f"{name}_z"] = F.when(F.count(x).over(w) >= TRUSTED, sign * score)
    rows = days.withColumns(z | {"trusted": F.count_if(any_value).over(by(key, [day]).rowsBetween(-(1 << 30), 0)) >= TRUSTED})
    told = F.array_compact(F.array(*(F.when(F.col(f"{n}_z") >= TOLD, F.lit(n)) for n in signals)))
    square = sum((F.coalesce(F.col(f"{n}_z") * F.col(f"{n}_z"), F.lit(0.0)) for n in signals), F.lit(0.0))
    far = sum((F.coalesce(F.col(f"{n}_z") >= EACH, F.lit(False)).cast("int") for n in signals), F.lit(0))
    return rows.select(key, day, "trusted", *z, F.array_join(told, ",").alias("told"), F.sqrt(square).alias("distance"), ((F.sqrt(square) > FAR) & (far >= DEVIATING) & F.col("trusted")).alias("fires"))


_Z = ", ".join(f"CASE WHEN count({c}) OVER w >= {TRUSTED} THEN {sign} * (({c})::DOUBLE - avg({c}) OVER w) / greatest(stddev_samp({c}) OVER w, 1e-6) END AS {n}_z" for n, (c, sign) in SIGNALS.items())
_TOLD = ", ".join(f"CASE WHEN {n}_z >= {TOLD} THEN '{n}' END" for n in SIGNALS)
_SQUARE = " + ".join(f"coalesce({n}_z * {n}_z, 0)" for n in SIGNALS)
_COUNT = " + ".join(f"coalesce({n}_z >= {EACH}, false)::INT" for n in SIGNALS)


@query(
    f"""WITH {DAILY}, z AS (SELECT device, day, count(*) OVER (PARTITION BY device ORDER BY day ROWS UNBOUNDED PRECEDING) >= {TRUSTED} AS trusted, {_Z} FROM d WINDOW w AS (PARTITION BY device ORDER BY day ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING))
SELECT device, day, trusted, {", ".join(f"round({n}_z, 5) + 0.0 AS {n}_z" for n in SIGNALS)}, concat_ws(',', {_TOLD}) AS told, round(sqrt({_SQUARE}), 5) AS distance, sqrt({_SQUARE}) > {FAR} AND {_COUNT} >= {DEVIATING} AND trusted AS fires FROM z""",
    days="day",
)
def nightly_signals(spark, sf):
    """Scores of four signals, what they tell and how far the night is from usual, in one pass over the days."""
    b = nightly(daily(spark, sf), "device", "day", SIGNALS)
    return b.select("device", "day", "trusted", *(R(f"{n}_z", 5).alias(f"{n}_z") for n in SIGNALS), "told", R("distance", 5).alias("distance"), "fires")


# Key, source, title, category, unit, decimals, whether higher is better (null: no judgement).
METRICS = (
    ("steps", "band", "Steps", "Effort", "", 0, True), ("steps", "phone", "Steps", "Effort", "", 0, True), ("steps_est", "band", "Steps (estimate)", "Effort", "", 0, True), ("strain", "band", "Strain", "Effort", "", 1, None),
    ("active_kcal", "phone", "Active energy", "Effort", "kcal", 0, None), ("energy_kcal", "band", "Energy", "Effort", "kcal", 0, None), ("recovery", "band", "Recovery", "Charge", "%", 0, True), ("hrv", "band", "Heart rate variability", "Charge", "ms", 0, True),
    ("resting_hr", "band", "Resting heart rate", "Charge", "bpm", 0, False), ("sleep_min", "band", "Sleep", "Rest", "min", 0, True), ("sleep_deep_min", "band", "Deep sleep", "Rest", "min", 0, True), ("sleep_rem_min", "band", "REM sleep", "Rest", "min", 0, True),
    ("stress", "band", "Stress", "Health", "/100", 0, False), ("weight", "phone", "Weight", "Health", "kg", 1, None),
)
#: What a day shows of a quantity: the first of these that it has.
PRECEDENCE = {"steps": (("steps", "band"), ("steps", "phone"), ("steps_est", "band"))}


def metrics(spark) -> DataFrame:
    """The catalogue: key, source, title, category, unit, decimals, higher_is_better."""
    return spark.createDataFrame(list(METRICS), "key string, source string, title string, category string, unit string, decimals int, higher_is_better boolean")


def shown(points: DataFrame, spark, quantity: str) -> DataFrame:
    """Of each device and day the point of a quantity that takes precedence, with its title, category and text."""
    order = PRECEDENCE[quantity]
    rank = F.lit(None).cast("int")
    for k, (key, source) in enumerate(order):
        rank = F.when((F.col("key") == key) & (F.col("source") == source), k).otherwise(rank)
    rows = points.withColumn("_rank", rank).filter("_rank IS NOT NULL AND value IS NOT NULL")
    best = rows.groupBy("device", "day").agg(F.min(F.struct("_rank", "key", "source", "value")).alias("b")).select("device", "day", "b.key", "b.source", "b.value")
    # The catalogue is a list of a few rows in this module.
    named = best.join(F.broadcast(metrics(spark)), ["key", "source"])
    text = F.concat(F.round("value", 0).cast("long").cast("string"), F.when(F.col("unit") != "", F.concat(F.lit(" "), "unit")).otherwise(""))
    return named.select("device", "day", "key", "source", "title", "category", "value", text.alias("text"))


_METRIC_ROWS = ", ".join(f"('{k}', '{s}', '{t}', '{c}')" for k, s, t, c, *_ in METRICS)


@query(f"""WITH {STREAM}, m(key, source, title, category) AS (VALUES {_METRIC_ROWS}), p AS (SELECT device, t // 86400 AS day, CASE kind WHEN 'view' THEN 'band' WHEN 'click' THEN 'phone' ELSE 'estimate' END AS source, sum(value) AS value FROM s WHERE kind IN ('view', 'click', 'signup') AND seq % 5 < 2 GROUP BY ALL),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY device, day ORDER BY CASE source WHEN 'band' THEN 0 WHEN 'phone' THEN 1 ELSE 2 END) = 1),
k AS (SELECT device, day, CASE WHEN source = 'estimate' THEN 'steps_est' ELSE 'steps' END AS key, CASE WHEN source = 'estimate' THEN 'band' ELSE source END AS source, value FROM b)
SELECT device, day, key, source, title, category, round(value, 4) AS value FROM k JOIN m USING (key, source)""")
def shown_steps(spark, sf):
    """Which of three counts of a day is shown, by the catalogue's precedence."""
    s = stream(spark, sf).filter(F.col("kind").isin("view", "click", "signup") & (F.col("seq") % 5 < 2))
    key = F.when(F.col("kind") == "signup", "steps_est").otherwise("steps")
    source = F.when(F.col("kind") == "click", "phone").otherwise("band")
    p = s.groupBy("device", F.expr("t DIV 86400").alias("day"), key.alias("key"), source.alias("source")).agg(F.sum("value").alias("value"))
    return shown(p, spark, "steps").select("device", "day", "key", "source", "title", "category", R("value", 4).alias("value"))


@query(f"WITH m(key, source, title, category) AS (VALUES {_METRIC_ROWS}), {STREAM}, p AS (SELECT device, {[c for c in dict.fromkeys(m[3] for m in METRICS)]}[seq % 4 + 1] AS category, count(*) AS n FROM s GROUP BY ALL) SELECT device, key, source, category, n FROM p JOIN m USING (category)")
def metrics_in_category(spark, sf):
    """The metrics of the categories that a device's rows ask for."""
    names = list(dict.fromkeys(m[3] for m in METRICS))
    p = stream(spark, sf).groupBy("device", F.get(F.array(*map(F.lit, names)), (F.col("seq") % len(names)).cast("int")).alias("category")).agg(F.count("*").alias("n"))
    return p.join(F.broadcast(metrics(spark).select("key", "source", "category")), "category").select("device", "key", "source", "category", "n")
