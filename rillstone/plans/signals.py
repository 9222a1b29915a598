"""Signal functions over one window of samples: they need the whole window at once, so each runs per (device, day)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..session import shared_folder
from .aggregates import R, beats
from .bindings import DAILY, STREAM, daily, stream, table


def band_powers(t: np.ndarray, x: np.ndarray) -> tuple[float, float, float]:
    """Lomb-Scargle power in the very low, low and high band; a band without enough span is not a number."""
    if len(x) < 20 or t[-1] <= t[0]:
        return (np.nan,) * 3
    y, span = x - x.mean(), t[-1] - t[0]
    f = np.arange(0.0033, 0.40, 0.005)
    w = 2 * np.pi * f[:, None]
    tau = np.arctan2(np.sin(2 * w * t).sum(1), np.cos(2 * w * t).sum(1))[:, None] / (2 * w)
    c, s = np.cos(w * (t - tau)), np.sin(w * (t - tau))
    power = 0.5 * ((c @ y) ** 2 / np.maximum((c * c).sum(1), 1e-12) + (s @ y) ** 2 / np.maximum((s * s).sum(1), 1e-12))
    band = lambda a, b, least: float(power[(f >= a) & (f < b)].sum()) if span >= least else np.nan
    return band(0.0033, 0.04, 250), band(0.04, 0.15, 250), band(0.15, 0.40, 60)


def _spectra(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["t", "seq"])
    beat_times = np.cumsum(pdf["rr"].to_numpy()) / 1000
    vlf, lf, hf = band_powers(beat_times, pdf["rr"].to_numpy())
    return pd.DataFrame({"device": pdf["device"].iloc[:1], "day": pdf["day"].iloc[:1], "n": [len(pdf)], "vlf": [vlf], "lf": [lf], "hf": [hf]})


@query()
def hrv_frequency_domain(spark, sf):
    return beats(spark, sf).select("device", "day", "seq", "t", "rr").groupBy("device", "day").applyInPandas(_spectra, "device long, day long, n long, vlf double, lf double, hf double")


@query(f"""WITH {STREAM}, r AS (SELECT device, t // 86400 AS day, seq, t, 60000.0 / bpm AS rr FROM s), x AS (SELECT *, rr - lag(rr) OVER w AS step, sign(rr - lag(rr) OVER w) <> sign(lead(rr) OVER w - rr) AS turn, lag(rr) OVER w IS NOT NULL AND lead(rr) OVER w IS NOT NULL AS inner_row FROM r WINDOW w AS (PARTITION BY device, day ORDER BY t, seq))
SELECT device, day, count(*) AS n, round(stddev_pop(step) / sqrt(2), 6) AS sd1, round(sqrt(greatest(0, 2 * var_pop(rr) - var_pop(step) / 2)), 6) AS sd2, round(sqrt(avg(step * step)) / avg(rr), 6) AS nrmssd, round(avg(CASE WHEN turn THEN 1.0 ELSE 0.0 END) FILTER (inner_row), 6) AS turning FROM x GROUP BY ALL""")
def rhythm_screening(spark, sf):
    """Poincare axes, normalised successive difference and the rate of turning points of each window."""
    from ..operators.windows import by

    w = by(["device", "day"], ["t", "seq"])
    x = stream(spark, sf).select("device", F.expr("t DIV 86400").alias("day"), "seq", "t", (60000.0 / F.col("bpm")).alias("rr"))
    back, ahead = F.lag("rr").over(w), F.lead("rr").over(w)
    x = x.withColumn("step", F.col("rr") - back).withColumn("turn", F.when(back.isNotNull() & ahead.isNotNull(), F.when(F.signum(F.col("rr") - back) != F.signum(ahead - F.col("rr")), 1.0).otherwise(0.0)))
    return x.groupBy("device", "day").agg(
        F.count("*").alias("n"), R(F.stddev_pop("step") / F.sqrt(F.lit(2.0))).alias("sd1"), R(F.sqrt(F.greatest(F.lit(0.0), 2 * F.var_pop("rr") - F.var_pop("step") / 2))).alias("sd2"),
        R(F.sqrt(F.avg(F.col("step") * F.col("step"))) / F.avg("rr")).alias("nrmssd"), R(F.avg("turn")).alias("turning"),
    )


def autocorrelation_peak(x: np.ndarray, low: int, high: int) -> tuple[int, float]:
    """The lag in [low, high] with the largest normalised autocorrelation, and that value."""
    y = x - np.polyval(np.polyfit(np.arange(len(x)), x, 1), np.arange(len(x))) if len(x) > 2 else x - x.mean()
    energy = float(y @ y)
    lags = range(low, min(high, len(y) - 2) + 1)
    if not energy or not len(lags):
        return 0, 0.0
    values = [float(y[:-k] @ y[k:]) / energy for k in lags]
    best = int(np.argmax(values))
    return lags[best], values[best]


def _periodicity(pdf: pd.DataFrame) -> pd.DataFrame:
    x = pdf.sort_values(["t", "seq"])["value"].to_numpy(float)
    lag, strength = autocorrelation_peak(x, 2, 12)
    rms = float(np.sqrt(np.mean((x - x.mean()) ** 2)))
    jerk = float(np.sqrt(np.mean(np.diff(x) ** 2))) if len(x) > 1 else 0.0
    return pd.DataFrame({"device": pdf["device"].iloc[:1], "day": pdf["day"].iloc[:1], "lag": [lag if strength >= 0.2 else None], "strength": [strength], "rms": [rms], "jerk": [jerk]})


@query()
def periodicity_features(spark, sf):
    """Detrended autocorrelation peak, spread and jerk of each device's day."""
    s = stream(spark, sf).select("device", F.expr("t DIV 86400").alias("day"), "seq", "t", "value")
    return s.groupBy("device", "day").applyInPandas(_periodicity, "device long, day long, lag double, strength double, rms double, jerk double")




def mahalanobis(mean: np.ndarray, cov: np.ndarray, x: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    try:
        inverse = np.linalg.inv(cov + ridge * np.eye(len(cov)))
    except np.linalg.LinAlgError:
        inverse = np.diag(1 / np.maximum(np.diag(cov), ridge))
    d = x - mean
    return np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", d, inverse, d), 0))


@query()
def mahalanobis_distance(spark, sf):
    """Distance of each vector from the centre of all, over all of its dimensions."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    return distances(e, ["vec_id", "label"], "embedding").withColumn("distance", F.round("distance", 6))


def _matrix(column: pd.Series, p: int) -> np.ndarray:
    """The vectors of that length as rows; others as not-a-number."""
    return np.stack([np.asarray(v, float) if v is not None and len(v) == p else np.full(p, np.nan) for v in column]) if len(column) else np.zeros((0, p))


def distances(rows: DataFrame, keep: list[str], vector: str, ridge: float = 1e-6) -> DataFrame:
    """``keep`` and the Mahalanobis distance of each vector; null where it is null, of another length or not a number.

    A task sums its vectors and their products, numbers of the matrices meet by place, and a second pass over the rows
    measures them; the length is the commonest one.
    """
    sizes = rows.filter(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("p")).count().orderBy(F.desc("count"), "p").first()
    p = sizes["p"] if sizes else 0

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((p + 1, p + 1))
        for frame in frames:
            x = _matrix(frame[vector], p)
            x = np.column_stack([np.ones(len(x)), x])[~np.isnan(x).any(1)]
            total += x.T @ x
        yield pd.DataFrame({"place": np.arange(total.size), "value": total.ravel()})

    found = rows.select(vector).mapInPandas(sums, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas().sort_values("place")
    total = found["value"].to_numpy().reshape(p + 1, p + 1) if len(found) else np.zeros((p + 1, p + 1))
    n = max(total[0, 0], 1.0)
    mean = total[0, 1:] / n
    cov = (total[1:, 1:] - n * np.outer(mean, mean)) / max(n - 1, 1)
    inverse = np.linalg.inv(cov + ridge * np.eye(p))
    schema = rows.select(*keep).schema.add("distance", "double")

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            d = _matrix(frame[vector], p) - mean
            yield frame[keep].assign(distance=np.sqrt(np.maximum(np.einsum("ni,ij,nj->n", d, inverse, d, optimize=True), 0)))

    return rows.select(*keep, vector).mapInPandas(measured, schema).withColumn("distance", F.nanvl("distance", F.lit(None).cast("double")))


@query(f"""WITH {DAILY}, z AS (SELECT device, day, (price - avg(price) OVER w) / nullif(stddev_samp(price) OVER w, 0) AS a, (n - avg(n) OVER w) / nullif(stddev_samp(n) OVER w, 0) AS b FROM d WINDOW w AS (PARTITION BY device ORDER BY day ROWS BETWEEN 42 PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, 0.6 * a - 0.4 * b AS idx FROM z WHERE a IS NOT NULL AND b IS NOT NULL), m AS (SELECT device, median(idx) AS mid FROM f GROUP BY device), k AS (SELECT f.device, mid, median(abs(idx - mid)) AS mad FROM f JOIN m USING (device) GROUP BY f.device, mid)
SELECT f.device, f.day, round(idx, 6) AS idx, idx > mid + 0.5 * mad AS elevated FROM f JOIN k USING (device)""", days="day")
def cycle_phase(spark, sf):
    """A fused index and whether it stands above the device's median by half a median deviation."""
    from ..operators.windows import by

    w = by("device", ["day"]).rowsBetween(-42, -1)
    z = lambda c: (F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_samp(c).over(w), F.lit(0.0))
    f = daily(spark, sf).select("device", "day", z("price").alias("a"), z("n").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").withColumn("idx", 0.6 * F.col("a") - 0.4 * F.col("b"))
    m = f.groupBy("device").agg(F.percentile("idx", 0.5).alias("mid"))
    k = f.join(m, "device").groupBy("device", "mid").agg(F.percentile(F.abs(F.col("idx") - F.col("mid")), 0.5).alias("mad"))
    return f.join(k, "device").select("device", "day", R("idx").alias("idx"), (F.col("idx") > F.col("mid") + 0.5 * F.col("mad")).alias("elevated"))


def _newton_sums(subjects: list, weights: np.ndarray):
    """For each left-out subject the gradient and Hessian of a batch's other rows, summed over the batches of a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slope, bend = np.zeros((len(subjects), 3)), np.zeros((len(subjects), 3, 3))
        for frame in frames:
            x = np.column_stack([frame[["a", "b"]].to_numpy(float), np.ones(len(frame))])
            others = frame["device"].to_numpy()[:, None] != np.array(subjects)[None, :]
            p = 1 / (1 + np.exp(-np.clip(x @ weights.T, -30, 30)))
            slope += (others * (frame["y"].to_numpy(float)[:, None] - p)).T @ x
            bend += np.einsum("ns,ni,nj->sij", others * p * (1 - p), x, x)
        yield pd.DataFrame({"subject": subjects, **{f"g{i}": slope[:, i] for i in range(3)}, **{f"h{i}{j}": bend[:, i, j] for i in range(3) for j in range(3)}})

    return run


SUMS = [*(f"g{i}" for i in range(3)), *(f"h{i}{j}" for i in range(3) for j in range(3))]


def left_out_weights(rows: DataFrame, ridge: float = 1.0, steps: int = 25) -> dict:
    """Weights (a, b, bias) of a ridge logistic model of all other devices' rows, for each device.

    A step is one pass over the rows, which stay where they are; twelve sums a device come to the driver, which takes the
    Newton step. No device's rows, and no copy of the others', are gathered.
    """
    subjects = sorted(r[0] for r in rows.select("device").distinct().collect())
    weights, shrink = np.zeros((len(subjects), 3)), np.array([ridge, ridge, 0.0])
    for _ in range(steps if subjects else 0):
        sums = rows.mapInPandas(_newton_sums(subjects, weights), ", ".join(["subject long", *(f"{c} double" for c in SUMS)]))
        found = sums.groupBy("subject").agg(*(F.sum(c).alias(c) for c in SUMS)).toPandas().set_index("subject").loc[subjects, SUMS].to_numpy()
        slope, bend = found[:, :3] - shrink * weights, found[:, 3:].reshape(-1, 3, 3) + np.diag(shrink + 1e-9)
        move = np.linalg.solve(bend, slope[:, :, None])[:, :, 0]
        weights += move
        if np.abs(move).max() < 1e-8:
            break
    return dict(zip(subjects, weights.tolist(), strict=True))


@query()
def left_out_models(spark, sf):
    """Leave-one-subject-out: each device is scored by a ridge logistic model of the others' daily means (a row a day)."""
    s = stream(spark, sf).groupBy("device", F.expr("t DIV 86400").alias("day")).agg(F.avg("bpm").alias("a"), F.stddev_pop("bpm").alias("b"), (F.avg("value") > 50).cast("double").alias("y")).fillna(0.0)
    path = f"{shared_folder(spark, 'left_out')}/rows"
    s.write.parquet(path)  # read once a step
    rows = spark.read.schema(s.schema).parquet(path)
    models = spark.createDataFrame([(d, *w) for d, w in left_out_weights(rows).items()], "device long, wa double, wb double, bias double")
    right = (F.col("wa") * F.col("a") + F.col("wb") * F.col("b") + F.col("bias") > 0).cast("double") == F.col("y")
    return rows.join(models, "device").groupBy("device").agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("accuracy"))
