import random

import numpy as np
import pandas as pd
import pytest

from rillstone.functions import catalogs
from rillstone.operators import ablation
from rillstone.operators.predictors import Linear, Ramps, Registry, labelled, predicted, predicting


def test_catalogue_is_sound():
    keys = [r[0] for r in catalogs.MARKERS]
    assert len(set(keys)) == len(keys)
    assert all(key is None or key in keys for key, _, _ in catalogs.UNITS)
    assert catalogs.plain("Häm-Globin ") == "hamglobin"


def test_names_units_and_clashes(spark):
    catalogue = (("a", "Alpha", "x", "kg", 1, ("shared", "b")), ("b", "Beta", "x", "cm", 1, ("shared",)))
    rows = spark.createDataFrame([(1, "ALPHA!", 2.0, "lb"), (2, "shared", 1.0, None), (3, "b", 1.0, "in"), (4, "b", 1.0, "kg"), (5, None, 1.0, None), (6, "", 1.0, ""), (7, "Neu", None, "q"), (8, "a", None, " ")], "id int, name string, value double, unit string")
    got = {r["id"]: r for r in catalogs.resolved(rows.selectExpr("*", "1 AS factor_", "2 AS category"), catalogue=catalogue).collect()}
    assert got[1]["key"] == "a" and got[1]["canonical"] == pytest.approx(0.90718474) and got[1]["canonical_unit"] == "kg"
    assert got[2]["status"] == "ambiguous" and got[2]["keys"] == ["a", "b"] and got[2]["key"] is None
    assert got[3]["key"] == "b" and got[3]["canonical"] == pytest.approx(2.54)  # a key beats an alias
    assert got[4]["status"] == "unknown unit" and got[4]["canonical"] is None
    assert got[5]["status"] == got[6]["status"] == "unknown" and got[5]["key"] is None
    assert (got[7]["key"], got[7]["canonical"], got[7]["canonical_unit"]) == ("neu", None, "q")
    assert (got[8]["status"], got[8]["canonical_unit"]) == ("known", "kg")
    assert catalogs.resolved(rows.limit(0)).count() == 0


def linear(shift):
    return Linear(["up", "down"], ["x", "y"], np.array([[3.0, 0], [-3.0, 0]]), np.array([shift, 0.0]))


def test_registry_versions_do_not_change():
    registry = Registry()
    registry.register("m", 1, linear(0))
    registry.register("m", 2, linear(1), activate=False)
    assert registry.get("m")[0] == 1
    with pytest.raises(ValueError, match="do not change"):
        registry.register("m", 1, linear(5))
    with pytest.raises(KeyError):
        registry.activate("m", 3)
    registry.activate("m", 2)
    assert registry.get("m")[0] == 2


def test_unsure_missing_and_tied_rows():
    frame = pd.DataFrame({"x": [1.0, -1.0, 0.01, np.nan, np.nan], "y": [0.0, 0.0, 0.0, 1.0, np.nan]})
    said, sure = labelled(linear(0), frame, 0.4, 0.05)
    assert said.tolist() == ["up", "down", "other", "other", "other"] and np.isnan(sure[4]) and sure[3] == 0.5
    assert labelled(linear(0), frame, 0.4, 0.0)[0].tolist() == ["up", "down", "up", "up", "other"]
    ramps = Ramps(["r"], ["x"], np.array([[0.0]]), np.array([[2.0]]), np.array([[1.0]]))
    assert labelled(ramps, frame, 0.4, 0.05)[0].tolist() == ["r", "other", "other", "other", "other"]


def test_models_swap_between_batches(spark):
    registry, seen = Registry(), []
    registry.register("m", 1, linear(0))
    take = predicting(registry, "m", ["id"], lambda df, k: seen.extend((k, r["id"], r["version"], r["predicted"]) for r in df.collect()))
    batch = spark.createDataFrame([(1, -0.1, 0.0)], "id int, x double, y double")
    take(batch, 0)
    registry.register("m", 2, linear(4))
    take(batch, 1)
    assert seen == [(0, 1, 1, "down"), (1, 1, 2, "up")]
    assert predicted(batch.limit(0), ["id"], registry, "m").count() == 0


@pytest.mark.parametrize("ranges", [1, 7])
def test_best_f1_is_exact(spark, ranges):
    draw = random.Random(1)
    rows = [(k, round(draw.random(), 2), draw.random() < 0.3 + 0.1 * k) for k in range(3) for _ in range(300)] + [(9, 0.5, False), (9, 0.7, False), (8, 0.5, None), (8, None, True), (7, 0.1, True)]
    got = {r["k"]: r for r in ablation.best_f1(spark.createDataFrame(rows, "k int, score double, truth boolean"), ["k"], ranges=ranges).collect()}
    for k in range(3):
        mine = [(s, t) for g, s, t in rows if g == k]
        f1 = lambda c: 2 * sum(t for s, t in mine if s >= c) / (sum(s >= c for s, _ in mine) + sum(t for _, t in mine))  # noqa: E731, B023
        best = max((f1(c), c) for c, _ in mine)
        assert (got[k]["f1"], got[k]["threshold"]) == pytest.approx(best)
    assert (got[9]["f1"], got[9]["threshold"], got[9]["recall"]) == (0, 0.7, None) and 8 not in got and got[7]["f1"] == 1


def test_fits_equal_plain_newton(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(240, 3))
    y = (x[:, 0] - 0.5 * x[:, 1] + draw.normal(size=240) > 0).astype(int)
    who = np.arange(240) % 4
    rows = spark.createDataFrame([(int(w), *map(float, r), int(t)) for w, r, t in zip(who, x, y, strict=True)], "who long, a double, b double, c double, y int").repartition(3)
    subsets = [["a"], ["a", "b", "c"]]
    got = ablation.fitted(rows, subsets, "who", ["a", "b", "c"], "y")
    for k, s in enumerate(subsets):
        cols = [*("abc".index(c) for c in s), 3]
        for u in range(4):
            m = np.column_stack([x, np.ones(240)])[who != u][:, cols]
            t, w = y[who != u], np.zeros(len(cols))
            for _ in range(40):
                mu = 1 / (1 + np.exp(-m @ w))
                h = (m * np.maximum(1e-8, mu * (1 - mu))[:, None]).T @ m + 1e-4 * len(t) * np.eye(len(cols))
                w = w + np.linalg.solve(h, m.T @ (t - mu) - 1e-4 * len(t) * w)
            assert got[k, u][cols] == pytest.approx(w, abs=1e-6)
            assert np.count_nonzero(got[k, u]) == len(cols)
    table = {r["subset"]: r for r in ablation.ablation(rows, subsets, "who", ["a", "b", "c"], "y").collect()}
    assert table[0]["n"] == table[1]["n"] == 240 and table[1]["f1"] > table[0]["f1"] > 0.6
    assert ablation.fitted(rows.limit(0), subsets, "who", ["a", "b", "c"], "y") == {}
