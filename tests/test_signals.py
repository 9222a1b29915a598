import numpy as np

from rillstone.plans.signals import left_out_weights


def ridge_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Newton steps; the last weight is the bias and is not shrunk."""
    x = np.column_stack([x, np.ones(len(x))])
    w, shrink = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 0.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-9)
        move = np.linalg.solve(hessian, x.T @ (y - p) - shrink * w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w


def test_left_out_weights_equal_plain_fits_at_any_partitioning(spark):
    draw = np.random.default_rng(5)
    rows = [(int(d), float(a), float(b), float(a - b + 0.001 * d + draw.normal() > 0.5)) for d in (3, 4, 900) for a, b in draw.normal(size=(40, 2))]
    table = spark.createDataFrame(rows, "device long, a double, b double, y double")
    x = np.array(rows)
    for parts in (1, 7):
        got = left_out_weights(table.repartition(parts))
        assert sorted(got) == [3, 4, 900]
        for d, w in got.items():
            others = x[x[:, 0] != d]
            assert np.allclose(w, ridge_logistic(others[:, 1:3], others[:, 3]), atol=1e-6)
    assert left_out_weights(table.limit(0)) == {}


def test_distances_use_every_dimension(spark):
    import numpy as np
    import pytest

    from rillstone.plans.signals import distances, mahalanobis

    x = np.random.default_rng(4).normal(size=(300, 12)) @ np.diag(range(1, 13))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, [float("nan")] * 12)], "k long, v array<double>").repartition(3)
    got = {r["k"]: r["distance"] for r in distances(rows, ["k"], "v").collect()}
    want = mahalanobis(x.mean(0), np.cov(x.T), x)
    assert [got[k] for k in range(300)] == pytest.approx(want.tolist(), rel=1e-6)
    assert got[900] is None and got[901] is None and got[902] is None
    assert distances(rows.limit(0), ["k"], "v").count() == 0


def test_smoothed_labels_of_rows_with_equal_seconds_and_rates(spark, tmp_path):
    """From one to nine rows of a device with equal second and rate, and rows without second, rate, device or number."""
    import duckdb
    from oracle import rows

    from rillstone import catalog

    draw = np.random.default_rng(6)
    found, second = [], 0
    for _ in range(300):
        second, user, value = second + 7, int(draw.integers(0, 16)), float(draw.integers(0, 450))
        found += [(len(found) + k, second, user, "k", value, None) for k in range(int(draw.integers(1, 10)))]
    found = [(int(i), *r[1:]) for i, r in zip(draw.permutation(len(found)), found, strict=True)]
    found += [(9001, None, 1, "k", 3.0, None), (9002, 5, None, "k", 3.0, None), (9003, 5, 1, "k", None, None), (9004, 6, 1, "k", float("nan"), None), (9005, 6, 1, "k", float("nan"), None), (None, 9, 2, "k", 400.0, None)]
    events = spark.createDataFrame(found, "event_id long, s long, user_id long, event_type string, value double, props string")
    events.selectExpr("event_id", "cast(timestamp_seconds(s) AS timestamp_ntz) AS ts", "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = catalog.queries()["median_smoothed_labels"](spark, str(tmp_path)).toPandas()
    assert len(got) > 2 * len(found)
    assert rows(got) == rows(con.execute(catalog.oracle_sql()["median_smoothed_labels"]).df())
