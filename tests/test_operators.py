"""Edge cases of the operators: empty input, ties, single rows, nulls."""

import pytest
from pyspark.sql import functions as F

from rillstone.operators import folds, joins, windows


def test_islands_on_ties_and_exact_gaps(spark):
    rows = spark.createDataFrame([("a", 0, 1), ("a", 10, 2), ("a", 10, 3), ("a", 21, 4), ("b", 0, 5)], "k string, t long, seq int")
    got = sorted((r["seq"], r["island"]) for r in windows.islands(rows, "k", ["t", "seq"], "t", 10).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 2), (5, 1)]
    assert windows.islands(rows.limit(0), "k", ["t", "seq"], "t", 10).count() == 0


def test_runs_keep_null_labels_apart(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("a", 3, "x"), ("a", 4, None)], "k string, t int, label string")
    assert [r["run"] for r in windows.runs(rows, "k", ["t"], "label").orderBy("t").collect()] == [1, 1, 2, 3]


def test_nearest_takes_the_later_of_a_tie_and_respects_tolerance(spark):
    left = spark.createDataFrame([("a", 10), ("a", 100), ("b", 10)], "k string, t long")
    right = spark.createDataFrame([("a", 5, 1.0), ("a", 15, 2.0), ("a", 15, 0.0)], "k string, t long, v double")
    got = {(r["k"], r["t"]): r["nearest"] for r in joins.nearest(left, right, "k", "t", "v", 5).collect()}
    assert got == {("a", 10): 2.0, ("a", 100): None, ("b", 10): None}


def test_contained_meets_each_point_once_across_buckets(spark):
    points = spark.createDataFrame([("a", t) for t in (0, 9, 10, 25, 40)], "k string, t long")
    spans = spark.createDataFrame([("a", 5, 25)], "k string, s long, e long")
    assert sorted(r["t"] for r in joins.contained(points, spans, "k", "t", "s", "e", 10).collect()) == [9, 10, 25]


def test_overlapping_gives_each_pair_once(spark):
    a = spark.createDataFrame([("a", 0, 100)], "k string, a_start long, a_end long")
    b = spark.createDataFrame([("a", 50, 200), ("a", 100, 120), ("a", -5, 1)], "k string, b_start long, b_end long")
    assert sorted(r["b_start"] for r in joins.overlapping(a, b, "k", 7).collect()) == [-5, 50]


def test_fold_states_in_order(spark):
    rows = spark.createDataFrame([("a", 2, 10.0), ("a", 1, 5.0), ("b", 1, 1.0)], "k string, d int, x double")
    got = folds.states(rows, "k", "d", ["x"], F.lit(0.0), lambda s, row: s * 2 + row["x"])
    assert {(r["k"], r["d"]): r["state"] for r in got.collect()} == {("a", 1): 5.0, ("a", 2): 20.0, ("b", 1): 1.0}


def test_streaks_ignore_repeats(spark):
    days = spark.sql("SELECT 'a' AS k, explode(array(DATE'2024-02-28', DATE'2024-02-29', DATE'2024-02-29', DATE'2024-03-01', DATE'2024-03-05')) AS day")
    assert sorted(r["length"] for r in windows.day_streaks(days, "k", "day").collect()) == [1, 3]


def test_second_decode_holds_early_rem_back():
    import numpy as np

    from rillstone.plans.folds import LABELS, guarded, viterbi

    e = np.zeros((200, 4))
    e[:, LABELS.index("rem")] = 2.0
    t = np.arange(200) * 60
    assert set(viterbi(e)) == {LABELS.index("rem")}
    labels = guarded(e, t)
    assert LABELS.index("rem") not in labels[5:55] and (labels[70:] == LABELS.index("rem")).all()


def test_nearest_reaches_over_bucket_edges_and_quantiles_interpolate(spark):
    import random

    import numpy as np

    from rillstone.operators import joins, windows

    draw = random.Random(3)
    left = [(draw.randrange(3), draw.randrange(5000)) for _ in range(300)]
    right = [(draw.randrange(3), draw.randrange(5000), float(draw.randrange(100))) for _ in range(200)]
    got = joins.nearest(spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(left)], "k long, t long, i long"), spark.createDataFrame(right, "k long, t long, v double"), "k", "t", "v", 3)
    found = {r["i"]: r["nearest"] for r in got.collect()}
    assert len(found) == len(left) and sum(v is not None for v in found.values()) > 20
    for i, (k, t) in enumerate(left):
        near = sorted((abs(t - u), -u, -v) for h, u, v in right if h == k and abs(t - u) <= 3)
        assert found[i] == (-near[0][2] if near else None)
    q = windows.quantile(spark.createDataFrame(right, "k long, t long, v double"), "k", "v", 0.995, "q").collect()
    for r in q:
        assert abs(r["q"] - np.quantile([v for k, _, v in right if k == r["k"]], 0.995)) < 1e-9


def test_statistics_of_ranges_against_sql(spark):
    """Counts, sums, means and deviations of ranges of time, edges of the blocks, negative times and nulls included."""
    import random

    import duckdb
    import pandas as pd

    from rillstone.operators.windows import ranged

    rng = random.Random(7)
    times = [rng.randrange(-300, 300) for _ in range(400)] + [-12, -11, -10, -1, 0, 9, 10, 11, 12, 21, 22, 10**6, None, None]
    rows = [(k, rng.choice([0, 1, 1, None]), t, None if k % 13 == 0 else 1e7 + rng.random()) for k, t in enumerate(times)]
    frame = spark.createDataFrame(rows, "id int, key int, t long, v double")
    told = pd.DataFrame({"id": range(len(rows)), "key": pd.array([r[1] for r in rows], "Int64"), "t": pd.array([r[2] for r in rows], "Int64"), "v": [r[3] for r in rows]})
    con = duckdb.connect()
    con.register("told", told)
    for before, after in ((10, 0), (5, 5), (0, 0), (3, 9), (0, 4)):
        got = {r["id"]: r for r in ranged(frame, "key", "t", before, after, row=F.lit(1), v=F.col("v")).collect()}
        want = con.execute(f"SELECT id, count(*) OVER w, count(v) OVER w, sum(v) OVER w, avg(v) OVER w, stddev_pop(v) OVER w FROM told WINDOW w AS (PARTITION BY key ORDER BY t RANGE BETWEEN {before} PRECEDING AND {after} FOLLOWING)").fetchall()
        assert len(got) == len(want) == len(rows)
        for k, n, m, total, mean, sd in want:
            r = got[k]
            assert (r["row_n"], r["v_n"]) == (n, m)
            for a, b in ((r["v_sum"], total), (r["v_mean"], mean), (r["v_sd"], sd)):
                assert (a is None) == (b is None or b != b) and (a is None or abs(a - b) <= 1e-9 * abs(b) + 1e-6)


@pytest.mark.parametrize("name", ["centred_time_sd", "trailing_time_mean", "nap_detection", "ingest_quota"])
def test_dense_ranges_take_work_in_proportion_to_the_rows(spark, tmp_path, name):
    """Every row used to add up its whole range: 200,000 rows of one hour made 2 * 10^10 steps and more."""
    import time

    from rillstone import catalog

    spark.range(200_000).selectExpr("id AS event_id", "timestamp_seconds(1704067200 + id DIV 56) AS ts", "CAST(8 AS LONG) AS user_id", "'view' AS event_type", "CAST(id % 50 AS DOUBLE) AS value", "'{}' AS props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    start = time.monotonic()
    got = catalog.queries()[name](spark, str(tmp_path)).collect()
    assert time.monotonic() - start < 45
    if name == "centred_time_sd":
        assert len(got) == 200_000 and {r["n"] for r in got} == {200_000}
    elif name == "trailing_time_mean":
        assert len(got) == 200_000
    elif name == "ingest_quota":
        assert [tuple(r) for r in got] == [(0, 200_000, 200_000, 200_000)]
