"""Left-out models over feature subsets, and exact best thresholds.

``fitted`` fits a ridge logistic model for every subset of features and every left-out subject: a Newton step is one pass
over the rows in Arrow batches, in which a task sums the gradients and Hessians of all models together; what comes to the
driver is one row of sums a model. ``best_f1`` finds the cut of a score that gives the highest F1, exactly: distinct scores
are counted, dealt by ranges, summed within a range and on from range to range, so no group's scores meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def best_f1(scored: DataFrame, keys: list[str], score: str = "score", truth: str = "truth", ranges: int = 32) -> DataFrame:
    """keys, threshold, f1, precision, recall: the cut ``score >= threshold`` with the highest F1, the highest such cut.

    Rows with a null score or truth do not count; a group without true rows has F1 0 at its highest score.
    """
    rows = scored.filter(F.col(score).isNotNull() & F.col(truth).isNotNull())
    d = rows.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(F.sum(F.col(truth).cast("long")).alias("hits"), F.count("*").alias("n"))
    # Stored, so that the ranges that were drawn are the ranges that are summed.
    d = stored(d.repartitionByRange(ranges, *keys, F.desc("score")).withColumn("part", F.spark_partition_id()), "ranges")
    parts = d.groupBy(*keys, "part").agg(F.sum("hits").alias("part_hits"), F.sum("n").alias("part_n"))
    before, whole = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    off = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    parts = parts.select(*keys, "part", off("part_hits").alias("hits0"), off("part_n").alias("n0"), F.sum("part_hits").over(whole).alias("all"))
    run = Window.partitionBy(*keys, "part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(parts, [*keys, "part"]).withColumn("tp", F.col("hits0") + F.sum("hits").over(run)).withColumn("taken", F.col("n0") + F.sum("n").over(run))
    f1 = 2 * F.col("tp") / (F.col("taken") + F.col("all"))
    best = d.groupBy(*keys).agg(F.max(F.struct(f1.alias("f1"), "score", "tp", "taken", "all")).alias("b"))
    return best.select(*keys, F.col("b.score").alias("threshold"), F.col("b.f1").alias("f1"), (F.col("b.tp") / F.col("b.taken")).alias("precision"), (F.col("b.tp") / F.nullif(F.col("b.all"), F.lit(0))).alias("recall"))


def _sums(subsets: list[list[int]], subjects: list, weights: np.ndarray, subject: str, features: list[str], truth: str):
    """Gradients and Hessians of all (subset, left-out subject) models over a task's rows; columns not in a subset are zero."""
    p = len(features) + 1
    inside = np.array([[k == p - 1 or k in s for k in range(p)] for s in subsets], float)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slope, bend = np.zeros((len(subsets), len(subjects), p)), np.zeros((len(subsets), len(subjects), p, p))
        for frame in frames:
            x = np.column_stack([frame[features].to_numpy(float), np.ones(len(frame))])
            y = frame[truth].to_numpy(float)
            others = (frame[subject].to_numpy()[:, None] != np.array(subjects)[None, :]).astype(float)
            for k, mask in enumerate(inside):
                own = x * mask
                mu = 1 / (1 + np.exp(-np.clip(own @ weights[k].T, -40, 40)))
                slope[k] += (others * (y[:, None] - mu)).T @ own
                bend[k] += np.einsum("nu,ni,nj->uij", others * np.maximum(1e-8, mu * (1 - mu)), own, own, optimize=True)
        m = len(subsets) * len(subjects)
        yield pd.DataFrame({"model": range(m), "g": list(slope.reshape(m, p)), "h": list(bend.reshape(m, p * p))})

    return run


def fitted(rows: DataFrame, subsets: list[list[str]], subject: str, features: list[str], truth: str, ridge: float = 1e-4, steps: int = 30) -> dict[tuple[int, object], np.ndarray]:
    """Weights (a number a feature, zero outside the subset, and the bias) by (subset's place, left-out subject).

    ``rows`` are read once a step. Subjects are few (a study's), as are subsets; both are bounded by what a driver holds.
    """
    subjects = sorted(r[0] for r in rows.select(subject).distinct().collect())
    places, p = [[features.index(f) for f in s] for s in subsets], len(features) + 1
    if not subjects:
        return {}
    sizes = {r[0]: r[1] for r in rows.groupBy(subject).count().collect()}
    n = np.array([max(sum(sizes.values()) - sizes[u], 1) for u in subjects], float)
    weights = np.zeros((len(subsets), len(subjects), p))
    inside = np.array([[k == p - 1 or k in s for k in range(p)] for s in places])
    for _ in range(steps):
        sums = rows.select(subject, *features, truth).mapInPandas(_sums(places, subjects, weights, subject, features, truth), "model int, g array<double>, h array<double>")
        each = lambda c, size: [F.sum(F.col(c)[k]).alias(f"{c}{k}") for k in range(size)]
        found = sums.groupBy("model").agg(*each("g", p), *each("h", p * p)).toPandas().sort_values("model")
        slope = found[[f"g{k}" for k in range(p)]].to_numpy().reshape(len(subsets), len(subjects), p)
        bend = found[[f"h{k}" for k in range(p * p)]].to_numpy().reshape(len(subsets), len(subjects), p, p)
        slope = slope - ridge * n[None, :, None] * weights
        bend = bend + ridge * n[None, :, None, None] * np.eye(p)
        slope = np.where(inside[:, None, :], slope, 0)
        move = np.linalg.solve(bend, slope[..., None])[..., 0]
        weights += move
        if np.abs(move).max() < 1e-8:
            break
    return {(k, u): weights[k, j] for k in range(len(subsets)) for j, u in enumerate(subjects)}


def scored(rows: DataFrame, models: dict, subject: str, features: list[str]) -> DataFrame:
    """Every row under every subset and left-out subject: subset, held, score, and whether the row is that subject's."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(k, u, [float(v) for v in w]) for (k, u), w in models.items()], f"subset int, held {rows.schema[subject].dataType.simpleString()}, w array<double>")
    z = sum((F.col("w")[k] * F.col(f).cast("double") for k, f in enumerate(features)), F.col("w")[len(features)])
    # A row meets the models, a bounded list in the driver: an explode of a literal, not a join.
    listed = F.array(*(F.struct(F.lit(r["subset"]).alias("subset"), F.lit(r["held"]).alias("held"), F.array(*map(F.lit, r["w"])).alias("w")) for r in table.collect()))
    out = rows.withColumn("_m", F.explode(listed)).select(*rows.columns, "_m.*")
    return out.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))).withColumn("own", F.col(subject) == F.col("held")).drop("w")


def ablation(rows: DataFrame, subsets: list[list[str]], subject: str, features: list[str], truth: str, ridge: float = 1e-4) -> DataFrame:
    """subset, n, f1, precision, recall over all rows, each judged by the model and the cut that its own subject had no part in."""
    held = scored(rows, fitted(rows, subsets, subject, features, truth, ridge), subject, features)
    cuts = best_f1(held.filter(~F.col("own")), ["subset", "held"], "score", truth).select("subset", "held", "threshold")
    judged = held.filter("own").join(cuts, ["subset", "held"]).withColumn("said", F.col("score") >= F.col("threshold"))
    true, said = F.col(truth).cast("boolean"), F.col("said")
    c = judged.groupBy("subset").agg(F.count("*").alias("n"), F.count_if(true & said).alias("tp"), F.count_if(~true & said).alias("fp"), F.count_if(true & ~said).alias("fn"))
    ratio = lambda a, b: a / F.nullif(b, F.lit(0))
    return c.select("subset", "n", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
