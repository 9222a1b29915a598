"""Mixing sources to target weights with soft memberships, in DataFrame functions only.

Domains are the four pairs of a quality and a toxicity label. A naive Bayes classifier over the presence of selected
words, fitted on at most ``MAX_LABELLED`` rows of ``labels`` (in order of a hash of their ids; the bound is a
parameter), gives every document a posterior over the domains: soft memberships, no hard assignment. Words are chosen by
their evidence (that of their presence alone: a text in another language is not faulty for lacking the words of this one), and a word's rates are smoothed towards its overall rate by ``PRIOR_TEXTS`` texts, so that few texts say
little; nothing is switched off by the size of the table.

Document i with n_i words adds n_i p_id to domain d's expected tokens. Rates r_i >= 0 are fitted by projected-gradient
least squares so that A r, the sums of r_i n_i p_id, are the domains' targets T. A step takes the gradient of
|A r - T|^2 (in the metric of the inverse Gram matrix of the documents whose rate is not at the bound), and every
document's rate is projected after every step: r_i <- max(0, r_i - p_i . s). A rate is a function of p_i and the steps
so far, so none is stored or gathered: a step is one pass over a narrow table, whose sums are a few numbers.
Rates start at one; where posteriors cannot tell documents apart the targets may not be reached, and ``max_miss`` says by
how much the worst domain's share of tokens misses.

Defined results: null and empty texts have no words; their posterior is the prior and their rate follows from it.
Labels that are null or have no document are not used; without labels posteriors are uniform. Domains that no document
can belong to have no target. Repeated rows are each given a rate. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, read_table

#: quality 0/1, toxic 0/1: their names, and the share of tokens that each should have.
DOMAINS = ("q0t0", "q0t1", "q1t0", "q1t1")
WEIGHTS = (0.08, 0.02, 0.85, 0.05)
#: The domain whose texts the pipeline keeps at least once, unless their fitted rate is next to nothing.
CLEAN, LEAST_CLEAN = 2, 1e-3
MAX_LABELLED, FEATURES = 20_000, 128
#: Texts of the overall rate that are added to each domain's rate of a word.
PRIOR_TEXTS = 10.0
STEPS, CLOSE, STALLED = 40, 1e-7, 5


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def classifier(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, features: int = FEATURES) -> tuple[list[float], dict[str, list[float]]]:
    """The log-prior of each domain (with all words absent), and of each chosen word what its presence adds."""
    chosen = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1) AND toxic IN (0, 1)").select(F.col("doc_id").alias("_id"), (2 * F.col("quality") + F.col("toxic")).cast("int").alias("d"))
    chosen = bounded(chosen, "_id", most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    # Equal texts count once a domain, so that a group of copies does not choose the words.
    rows = cut(rows.select("d", F.xxhash64("text").alias("h"), F.array_distinct(words_of(F.col("text"))).alias("words")).dropDuplicates(["d", "h"]))
    n = {r["d"]: r["n"] for r in rows.groupBy("d").agg(F.count("*").alias("n")).collect()}
    total, k = sum(n.values()), len(DOMAINS)
    counts = [F.count_if(F.col("d") == d).alias(f"n{d}") for d in range(k)]
    by_word = rows.select("d", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), *counts).filter("n > 1")
    overall = (F.col("n") + 0.5) / (F.lit(total) + 1.0)
    rate = lambda d: (F.col(f"n{d}") + PRIOR_TEXTS * overall) / (F.lit(n.get(d, 0)) + PRIOR_TEXTS)
    # Words that tell by being there: texts of the domain that hold them, times the squared logarithm of the smoothed lift,
    # so that a word that is common everywhere says little however many texts hold it.
    gain = F.greatest(*(F.col(f"n{d}") * F.pow(F.greatest(F.lit(0.0), F.log(rate(d) / overall)), F.lit(2.0)) for d in range(k)))
    best = by_word.withColumn("gain", gain).orderBy(F.desc("gain"), "word").limit(features).collect()
    prior = [math.log((n.get(d, 0) + 0.5) / (total + 0.5 * k)) if total else 0.0 for d in range(k)]
    words = {}
    for r in best:
        most = (r["n"] + 0.5) / (total + 1.0)
        p = [(r[f"n{d}"] + PRIOR_TEXTS * most) / (n.get(d, 0) + PRIOR_TEXTS) for d in range(k)]
        prior = [a + math.log(1 - q) for a, q in zip(prior, p, strict=True)]
        words[r["word"]] = [math.log(q / (1 - q)) for q in p]
    return prior, words


def with_posterior(rows: DataFrame, prior: list[float], weights: dict[str, list[float]], words: str = "_words") -> DataFrame:
    """``rows`` with p, each domain's probability given the text's words. Each step is computed once a row."""
    vector = lambda v: F.array(*map(F.lit, v))
    z = vector(prior)
    if weights:
        table = F.map_from_arrays(F.array(*map(F.lit, weights)), F.array(*map(vector, weights.values())))
        z = F.aggregate(F.array_intersect(F.col(words), F.array(*map(F.lit, weights))), z, lambda a, w: F.zip_with(a, F.element_at(table, w), lambda x, y: x + y))
    rows = rows.withColumn("_z", z).withColumn("_top", F.array_max("_z")).withColumn("_e", F.transform("_z", lambda x: F.exp(x - F.col("_top"))))
    rows = rows.withColumn("_sum", F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)).withColumn("p", F.transform("_e", lambda x: x / F.col("_sum")))
    return rows.drop("_z", "_top", "_e", "_sum")


def rate(p: Column, steps: list[list[float]]) -> Column:
    """The rate of a document with posterior p: from one, projected after each step."""
    r = F.lit(1.0)
    for s in steps:
        r = F.greatest(F.lit(0.0), r - sum((p[d] * F.lit(float(x)) for d, x in enumerate(s)), F.lit(0.0)))
    return r


def rate_of(p: np.ndarray, steps: list[list[float]]) -> float:
    r = 1.0
    for s in steps:
        r = max(0.0, r - float(p @ np.array(s)))
    return r


def fit(rows: DataFrame, targets: list[float], steps: int = STEPS, close: float = CLOSE) -> tuple[list[list[float]], float]:
    """The steps, and by which part of all tokens the worst domain misses its target after them. rows: n, p."""
    k, whole = len(targets), sum(targets) or 1.0
    done: list[list[float]] = []
    best, least, stalled = done, float("inf"), 0
    while True:
        r, n, p = F.col("r"), F.col("n"), F.col("p")
        total = [F.sum(r * n * p[d]).alias(f"t{d}") for d in range(k)]
        gram = [F.sum(F.when(r > 0, n * p[d] * p[e])).alias(f"m{d}_{e}") for d in range(k) for e in range(d, k)]
        got = rows.select("n", "p", rate(F.col("p"), done).alias("r")).agg(*total, *gram).first()
        miss = np.array([got[f"t{d}"] or 0.0 for d in range(k)]) - np.array(targets)
        worst = float(abs(miss).max()) / whole
        best, least, stalled = (done, worst, 0) if worst < 0.99 * least else (best, least, stalled + 1)
        if least < close or stalled > STALLED or len(done) == steps:
            return best, least
        m = np.array([[got[f"m{min(d, e)}_{max(d, e)}"] or 0.0 for e in range(k)] for d in range(k)])
        move = np.linalg.pinv(m, rcond=1e-9, hermitian=True) @ miss
        done = [*done, ((1.0 if stalled == 0 else 0.5) * move).tolist()]


def memberships(docs: DataFrame, prior: list[float], weights: dict[str, list[float]], keep: list[str]) -> DataFrame:
    """The columns ``keep``, n (words) and p (posterior) of each row."""
    words = docs.select(*keep, words_of(F.col("text")).alias("_words"))
    return with_posterior(words, prior, weights).select(*keep, F.size("_words").cast("long").alias("n"), "p")


def expected_tokens(rows: DataFrame) -> list[float]:
    got = rows.agg(*(F.sum(F.col("n") * F.col("p")[d]).alias(f"e{d}") for d in range(len(DOMAINS)))).first()
    return [x or 0.0 for x in got]


def targets_of(expected: list[float], weights: tuple = WEIGHTS) -> list[float]:
    """The weights' shares of all expected tokens, over the domains that have any."""
    live = sum(w for w, e in zip(weights, expected, strict=True) if e > 0) or 1.0
    return [sum(expected) * w / live if e > 0 else 0.0 for w, e in zip(weights, expected, strict=True)]


def mixed(docs: DataFrame, labels: DataFrame, weights: tuple = WEIGHTS, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, the posterior of each domain, the rate at which the document should be taken, and max_miss."""
    rows = cut(memberships(docs, *classifier(docs, labels), [doc_id]))
    steps, miss = fit(rows, targets_of(expected_tokens(rows), weights))
    return rows.select(doc_id, F.col("n").alias("n_words"), *(F.col("p")[d].alias(f"p_{name}") for d, name in enumerate(DOMAINS)), rate(F.col("p"), steps).alias("rate"), F.lit(miss).alias("max_miss"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def mix_kept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each row is repeated floor(rate + u) times, where u in [0, 1) is a hash of its id and text.

    Targets are ``WEIGHTS`` of all tokens. Rates are then divided by that of a text without telling words, or that of a
    surely clean text if it is less: the shares stay, and clean texts stay at least once.
    """
    names = docs.columns
    labels = read_table(spark, sf_dir, "labels")
    prior, weights = classifier(docs, labels)
    rows = cut(memberships(docs, prior, weights, []))
    steps, _ = fit(rows, targets_of(expected_tokens(rows)))
    plain = np.exp(np.array(prior) - max(prior))
    plain, sure = plain / plain.sum(), np.eye(len(DOMAINS))[CLEAN]
    clean = min(rate_of(plain, steps), rate_of(sure, steps))
    scale = clean if clean > LEAST_CLEAN else 1.0
    rated = with_posterior(docs.select(F.struct(*names).alias("_row"), words_of(F.col("text")).alias("_words")), prior, weights).withColumn("_rate", rate(F.col("p"), steps) / F.lit(scale) + F.lit(1e-9))
    u = F.pmod(F.xxhash64("_row.doc_id", "_row.text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rated = rated.select("_row", F.explode(F.sequence(F.lit(0), F.floor(F.col("_rate") + u))).alias("_copy"))
    return rated.filter("_copy > 0").select("_row.*")


QUERIES = {"op2_mixing": op2_mixing}
ORACLES: dict[str, str] = {}
