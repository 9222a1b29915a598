"""Catalogues, predictors that plug in, exact thresholds, and models over subsets of features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import catalogs
from ..operators.ablation import ablation, best_f1
from ..operators.joins import contained
from ..operators.predictors import Ramps, Registry, predicted
from ..session import stored
from .aggregates import R
from .bindings import SESSIONS, STREAM, sessions, stream

#: A second entry that claims the alias of potassium.
CATALOGUE = (*catalogs.MARKERS, ("vitamin_k", "Vitamin K", "blood_panel", "µg/L", 1, ("k",)))
#: Names and units as reports spell them, and what they come to: key, status, factor, shift, unit.
SPELT = (
    ("LDL-C", "mg/dL", "ldl", "known", 0.02586, 0.0, "mmol/L"), (" Hemoglobin ", "g/dL", "haemoglobin", "known", 10.0, 0.0, "g/L"), ("vit. D", None, "vitamin_d", "known", 1.0, 0.0, "nmol/L"), ("HbA1c", "%", "hba1c", "known", 10.929, -23.497, "mmol/mol"),
    ("Häm-Globin", "g/L", "hamglobin", "unknown", 1.0, 0.0, "g/L"), ("K", "mmol/L", None, "ambiguous", None, None, None), ("C-reactive protein (CRP)", "mg/dl", "crp", "known", 10.0, 0.0, "mg/L"), ("TSH", "furlong", "tsh", "unknown unit", None, None, None),
    ("Weight", "LB", "weight", "known", 0.45359237, 0.0, "kg"), ("--", "x", None, "unknown", 1.0, 0.0, "x"),
)
_TEXT = lambda v: "NULL" if v is None else f"'{v}'"
_SPELT = ", ".join(f"({k}, {_TEXT(n)}, {_TEXT(u)}, {_TEXT(key)}, '{s}', {'NULL' if f is None else f}::DOUBLE, {'NULL' if f is None else o}::DOUBLE, {_TEXT(to)})" for k, (n, u, key, s, f, o, to) in enumerate(SPELT))


@query(f"WITH c(i, name, unit, key, status, factor, shift, canonical_unit) AS (VALUES {_SPELT}) SELECT event_id, name, unit, key, status, round(value * factor + shift, 6) AS canonical, canonical_unit FROM events JOIN c ON c.i = event_id % {len(SPELT)}")
def marker_catalogue(spark, sf):
    """Measurements under names and units as reports have them, resolved to catalogue rows in canonical units."""
    said = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(u).cast("string").alias("unit")) for n, u, *_ in SPELT))
    rows = stream(spark, sf).select(F.col("seq").alias("event_id"), "value", F.get(said, (F.col("seq") % len(SPELT)).cast("int")).alias("x")).select("event_id", "value", "x.name", "x.unit")
    return catalogs.resolved(rows, catalogue=CATALOGUE).select("event_id", "name", "unit", "key", "status", R("canonical").alias("canonical"), "canonical_unit")


def workouts() -> Registry:
    """Two versions of a predictor of a session's kind, by ramps over its features."""
    registry = Registry()
    ramp = lambda low, high: Ramps(["run", "walk", "ride"], ["hr", "spread", "clicks"], np.array(low, float), np.array(high, float), np.array([[2, 1, 1], [1, 1, 2], [1, 2, 1]], float))
    registry.register("workout", 1, ramp([[50, 10, 0], [90, 80, 0], [60, 90, 1]], [[90, 60, 1], [50, 10, 1], [100, 20, 0]]))
    registry.register("workout", 2, ramp([[60, 20, 0], [80, 60, 0.1], [70, 80, 1]], [[80, 50, 0.6], [60, 20, 0.5], [90, 40, 0]]))
    registry.activate("workout", 1)
    return registry


def _ramp_sql(version: int) -> str:
    model = workouts().get("workout", version)[1]
    way = lambda c, k: f"least(greatest(({model.features[k]} - {model.low[c][k]}) / ({model.high[c][k] - model.low[c][k]}), 0), 1) * {model.weight[c][k]}"
    return ", ".join(f"({' + '.join(way(c, k) for k in range(3))}) / {model.weight[c].sum()} AS s{c}" for c in range(3))


@query(f"""WITH {SESSIONS}, f AS (SELECT ss.device, ss.start_t, avg(s.bpm) AS hr, stddev_pop(s.value) AS spread, count(*) FILTER (s.kind = 'click') * 1.0 / count(*) AS clicks FROM ss JOIN s ON s.device = ss.device AND s.t BETWEEN ss.start_t AND ss.end_t GROUP BY ALL),
v AS (SELECT device, start_t, 1 AS version, {_ramp_sql(1)} FROM f UNION ALL SELECT device, start_t, 2, {_ramp_sql(2)} FROM f), o AS (SELECT *, list_reverse_sort([s0, s1, s2]) AS l FROM v)
SELECT device, start_t, CAST(version AS INT) AS version, CASE WHEN l[1] < 0.4 OR l[1] - l[2] < 0.05 THEN 'other' WHEN s0 = l[1] THEN 'run' WHEN s1 = l[1] THEN 'walk' ELSE 'ride' END AS predicted, round(l[1] + 1e-9, 6) AS confidence FROM o""")
def predicted_workouts(spark, sf):
    """Sessions under both versions of a registered predictor."""
    f = contained(stream(spark, sf), sessions(spark, sf).drop("n"), "device", "t", "start_t", "end_t", 86400).groupBy("device", "start_t").agg(F.avg("bpm").alias("hr"), F.stddev_pop("value").alias("spread"), (F.count_if(F.col("kind") == "click") * 1.0 / F.count("*")).cast("double").alias("clicks"))
    f, registry = stored(f), workouts()
    both = [predicted(f, ["device", "start_t"], registry, "workout", v) for v in (1, 2)]
    return both[0].unionByName(both[1]).select("device", "start_t", "version", "predicted", R(F.col("confidence") + 1e-9).alias("confidence"))


@query(f"""WITH {STREAM}, d AS (SELECT device, round(value / 10, 1) AS score, count(*) FILTER (kind IN ('view', 'click') AND seq % 3 <> 0 OR value > 100) AS hits, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT *, sum(hits) OVER w AS tp, sum(n) OVER w AS taken, sum(hits) OVER (PARTITION BY device) AS every FROM d WINDOW w AS (PARTITION BY device ORDER BY score DESC))
SELECT device, score AS threshold, round(2 * tp / (taken + every), 6) AS f1, round(tp / taken, 6) AS precision, round(tp / every, 6) AS recall FROM c QUALIFY row_number() OVER (PARTITION BY device ORDER BY 2 * tp / (taken + every) DESC, score DESC) = 1""")
def best_thresholds(spark, sf):
    """Of each device the cut of a score with the highest F1."""
    truth = (F.col("kind").isin("view", "click") & (F.col("seq") % 3 != 0)) | (F.col("value") > 100)
    b = best_f1(stream(spark, sf).select("device", R(F.col("value") / 10, 1).alias("score"), truth.alias("truth")), ["device"])
    return b.select("device", "threshold", R("f1").alias("f1"), R("precision").alias("precision"), R("recall").alias("recall"))


SUBSETS = [["a"], ["b"], ["a", "b"], ["a", "b", "c"]]


@query()
def feature_ablation(spark, sf):
    """Which features of a device's hour tell its busy hours, each hour judged by models that its device had no part in."""
    s = stream(spark, sf).groupBy("device", F.expr("t DIV 3600").alias("hour")).agg((F.avg("bpm") / 100).alias("a"), (F.stddev_pop("bpm") / 100).alias("b"), (F.count("*") / 10).alias("c"), (F.max("value") > 60).cast("int").alias("y"))
    rows = stored(s)
    out = ablation(rows, SUBSETS, "device", ["a", "b", "c"], "y")
    return out.select("subset", "n", *(R(c).alias(c) for c in ("f1", "precision", "recall")))
