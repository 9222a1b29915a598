import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstone.llm import mixing


def plain_projected_gradient(n, p, targets, rounds=20000):
    """Many short projected-gradient steps on the rates themselves, in the fixed metric of all documents."""
    rates = np.ones(len(n))
    inverse = np.linalg.inv((p * n[:, None]).T @ p)
    for _ in range(rounds):
        rates = np.maximum(0, rates - 0.5 * p @ (inverse @ ((rates * n) @ p - targets)))
    return rates


@pytest.mark.parametrize("lift", [(0.4, 1.5, 1.1, 0.3), (1.0, 1.0, 1.0, 1.0), (3.0, 0.1, 0.6, 0.2)])
def test_rates_meet_targets_as_plain_projected_gradient_does(spark, lift):
    draw = np.random.default_rng(3)
    p = draw.dirichlet([0.2, 0.1, 1.0, 0.3], 500)
    n = draw.integers(1, 400, 500)
    rows = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n long, p array<double>")
    targets = (n[:, None] * p).sum(0) * np.array(lift)
    steps, miss = mixing.fit(rows, targets.tolist())
    rates = np.array([r[0] for r in rows.select(mixing.rate(rows["p"], steps)).collect()])
    assert np.allclose(rates, [mixing.rate_of(x, steps) for x in p])
    other = plain_projected_gradient(n, p, targets)
    assert (rates >= 0).all() and miss < 1e-4
    assert np.allclose((rates * n) @ p, targets, rtol=2e-3) and np.allclose((other * n) @ p, targets, rtol=2e-3)
    # Both move rates little from one: their weighted distances are alike.
    assert (n * (rates - 1) ** 2).sum() <= 1.5 * (n * (other - 1) ** 2).sum() + 1e-6


def test_targets_out_of_reach_are_told(spark):
    rows = spark.createDataFrame([(10, [0.25] * 4)] * 20, "n long, p array<double>")
    _, miss = mixing.fit(rows, [160.0, 20.0, 10.0, 10.0])
    assert abs(miss - 0.55) < 1e-6


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_shares_of_the_tables_meet_the_weights(spark, size):
    rows = mixing.op2_mixing(spark, f"/root/testdata/{size}")
    got = rows.agg(*(F.sum(F.col("n_words") * F.col("rate") * F.col(f"p_{d}")).alias(d) for d in mixing.DOMAINS), F.max("max_miss").alias("miss"), F.count_distinct("rate").alias("rates")).first()
    total = sum(got[d] for d in mixing.DOMAINS)
    for d, w in zip(mixing.DOMAINS, mixing.WEIGHTS, strict=True):
        assert abs(got[d] / total - w) < 0.01, d
    assert got["miss"] < 0.01 and got["rates"] > 10


def test_labelled_domains_are_told_apart(spark, docs_of):
    rows = [(k, f"plain words number {k} in a row") for k in range(80)] + [(100 + k, f"spam&&& spam&&& junk*** {k}") for k in range(40)] + [(200 + k, f"you awful fool {k}") for k in range(40)]
    labels = spark.createDataFrame([(i, 0 if 100 <= i < 200 else 1, int(i >= 200)) for i, _ in rows if i % 2] + [(None, 1, 1), (7, None, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in mixing.mixed(docs_of(rows), labels).collect()}
    assert got[100]["p_q0t0"] > 0.9 and got[200]["p_q1t1"] > 0.9 and got[2]["p_q1t0"] > 0.8
    total = sum(r["n_words"] * r["rate"] * r["p_q1t0"] for r in got.values())
    assert abs(total / sum(r["n_words"] for r in got.values()) - 0.85 / 0.98) < 0.05


@pytest.mark.parametrize("labels", [[], [(4, 1, 0)]])
def test_edges(spark, docs_of, edge, labels):
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = mixing.mixed(docs_of(edge), frame).collect()
    assert len(got) == len(edge) and all(r["rate"] >= 0 and abs(sum(r[f"p_{d}"] for d in mixing.DOMAINS) - 1) < 1e-9 for r in got)
    assert mixing.mixed(docs_of([]), frame).count() == 0


def test_no_python_in_the_plan(spark, docs_of, edge):
    df = mixing.mixed(docs_of(edge), spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_the_stage_brings_domains_to_their_weights(spark, docs_of, tmp_path):
    """Faulty and toxic texts hold half of the tokens that come in; counted by label, the result has the weights."""
    kinds = {"q1t0": "plain", "q0t0": "junk***", "q1t1": "fool", "q0t1": "spam&&&"}
    sizes = {"q1t0": 600, "q0t0": 200, "q1t1": 200, "q0t1": 200}
    rows = [(1000 * d + k, f"{word} words number {k} in a row") for d, (name, word) in enumerate(kinds.items()) for k in range(sizes[name])]
    label = [(i, int(list(kinds)[i // 1000][1]), int(list(kinds)[i // 1000][3])) for i, _ in rows]
    spark.createDataFrame(label, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = [list(kinds)[r["doc_id"] // 1000] for r in mixing.mix_kept(spark, docs_of(rows), str(tmp_path)).collect()]
    for name, weight in zip(mixing.DOMAINS, mixing.WEIGHTS, strict=True):
        assert abs(got.count(name) / len(got) - weight) < 0.02, name
    assert got.count("q1t0") >= 590
