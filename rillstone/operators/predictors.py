"""Predictors that plug in: a registry of models by name and version, applied to batches of features.

A model is anything with ``classes`` and ``scores(features) -> array``; a version is registered once and does not change.
``predicted`` sends one version's parameters to the tasks and scores Arrow batches with numpy; the class with the highest
score is named if it is plausible and stands out, else it is ``other``. A stream takes the version that is current when
a batch begins (``predicting``), so models are swapped between batches and each row says by which version it was scored.

Defined results: a null feature counts as the model's ``missing`` value; rows without any feature are ``other`` with no
confidence; ties go to the class that the model names first; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Predictor(Protocol):
    classes: list[str]
    features: list[str]
    missing: float

    def scores(self, x: np.ndarray) -> np.ndarray: ...


@dataclass(frozen=True)
class Ramps:
    """Scores by straight ramps: of a class, each feature's share of the way from ``low`` to ``high``, weighted."""

    classes: list[str]
    features: list[str]
    low: np.ndarray  # a row a class, a column a feature
    high: np.ndarray
    weight: np.ndarray
    missing: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        way = np.clip((x[:, None, :] - self.low) / (self.high - self.low), 0, 1)
        return (way * self.weight).sum(2) / self.weight.sum(1)


@dataclass(frozen=True)
class Linear:
    """Soft-maximum of linear scores."""

    classes: list[str]
    features: list[str]
    weight: np.ndarray
    bias: np.ndarray
    missing: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weight.T + self.bias
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


@dataclass
class Registry:
    """Models by (name, version); ``current`` is the version that new batches take."""

    models: dict[tuple[str, int], Predictor] = field(default_factory=dict)
    current: dict[str, int] = field(default_factory=dict)

    def register(self, name: str, version: int, model: Predictor, activate: bool = True) -> None:
        if (name, version) in self.models:
            raise ValueError(f"{name} {version} is registered, and versions do not change")
        self.models[name, version] = model
        if activate:
            self.current[name] = version

    def activate(self, name: str, version: int) -> None:
        if (name, version) not in self.models:
            raise KeyError(f"{name} {version}")
        self.current[name] = version

    def get(self, name: str, version: int | None = None) -> tuple[int, Predictor]:
        version = self.current[name] if version is None else version
        return version, self.models[name, version]


def labelled(model: Predictor, frame: pd.DataFrame, plausible: float, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """The class of each row and its score; ``other`` where no score is plausible or the second is too near."""
    raw = frame[model.features].to_numpy(float)
    x = np.where(np.isnan(raw), model.missing, raw)
    scores = model.scores(x)
    order = np.argsort(-scores, axis=1, kind="stable")
    best = np.take_along_axis(scores, order[:, :1], 1)[:, 0]
    second = np.take_along_axis(scores, order[:, 1:2], 1)[:, 0] if scores.shape[1] > 1 else np.zeros(len(best))
    sure = (best >= plausible) & (best - second >= margin) & ~np.isnan(raw).all(1)
    return np.where(sure, np.array(model.classes, object)[order[:, 0]], "other"), np.where(np.isnan(raw).all(1), np.nan, best)


def predicted(rows: DataFrame, keep: list[str], registry: Registry, name: str, version: int | None = None, plausible: float = 0.40, margin: float = 0.05) -> DataFrame:
    """The columns ``keep`` with predicted, confidence and version."""
    version, model = registry.get(name, version)
    sent = rows.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), "predicted string, confidence double, version int"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame[keep].copy()
            out["predicted"], out["confidence"] = labelled(sent.value, frame, plausible, margin)
            out["version"] = version
            yield out

    return rows.select(*dict.fromkeys([*keep, *model.features])).mapInPandas(run, schema)


def predicting(registry: Registry, name: str, keep: list[str], write: Callable[[DataFrame, int], None], **how) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch by the version that is current when it begins."""

    def take(batch: DataFrame, batch_id: int) -> None:
        write(predicted(batch, keep, registry, name, **how), batch_id)

    return take
