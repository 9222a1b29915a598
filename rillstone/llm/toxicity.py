"""Toxicity categories by a classifier chain.

Categories are predicted in order: fault (a quality label of 0), toxic, and both. Each category has a linear (logistic)
model over the presence of selected words, word beginnings and endings, and the probabilities of the earlier categories. In training those
probabilities are out-of-fold predictions, so a later model sees what it will see on new texts; in scoring they come
from the earlier models.

Training uses at most ``MAX_LABELLED`` labelled rows (in order of a hash of their ids); this bound is a parameter. Their
words are counted on the cluster, ``FEATURES`` words with the strongest association with fault or toxicity are kept,
and only their presence is brought to the driver. Near copies (equal smallest shingle hashes) share a weight of one and
a fold, so that a group of copies with one label does not teach its words. Every row of ``documents`` is scored, on
its whole text.

Defined results: null and empty texts have no words and get the base rates; labels that are null, or whose document is
missing, are not used; of documents with equal ids one text is learned from; without labels every probability is 0.5 and nothing is toxic (the rule is above 0.5); repeated
rows are each scored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, chunks, cut, read_table, texts_of

CATEGORIES = ("fault", "toxic", "toxic_fault")
MAX_LABELLED, FEATURES, LEAST_TEXTS, FOLDS, STEPS, RIDGE = 12_000, 400, 5, 4, 400, 0.05
#: The log-likelihood ratio that a word needs: among a million words, chance seldom reaches it.
LEAST_GAIN = 20.0
SHINGLE = 5
PUNCTUATION = str.maketrans(dict.fromkeys(".,;:!?\"'()[]{}", " "))


def words_of(data: bytes) -> set[str]:
    """A text's distinct words, their beginnings of four to six characters (``abcd*``) and last three (``*xyz``)."""
    words = set(data.decode("utf-8", "replace").lower().translate(PUNCTUATION).split())
    out = set(words)
    for n in (4, 5, 6):
        out.update([w[:n] + "*" for w in words if len(w) > n])
    out.update(["*" + w[-3:] for w in words if len(w) > 3])
    return out


def sketch(data: bytes) -> int:
    """The smallest hash of a text's five-word shingles."""
    words = data.lower().split()
    return min((zlib.crc32(b" ".join(words[k : k + SHINGLE])) for k in range(max(1, len(words) - SHINGLE + 1))), default=0)


def labelled_words(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """fault, toxic, weight, fold and the distinct words of a bounded set of labelled rows."""
    chosen = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").alias("_id"), (F.col("quality") == 0).alias("fault"), (F.col("toxic") == 1).alias("toxic"))
    chosen = bounded(chosen.distinct(), "_id", most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    # Of documents with equal ids one text is learned from, so that no more rows come than labels.
    rows = rows.groupBy("_id", "fault", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("fault", "toxic", "text")

    def run(batches):
        for batch in chunks(batches):
            texts = texts_of(batch)
            yield pa.RecordBatch.from_arrays([batch.column("fault"), batch.column("toxic"), pa.array(map(sketch, texts), pa.int64()), pa.array([sorted(words_of(b)) for b in texts], pa.list_(pa.string()))], names=["fault", "toxic", "sketch", "words"])

    found = cut(rows.mapInArrow(run, "fault boolean, toxic boolean, sketch long, words array<string>"))
    sizes = found.groupBy(F.col("sketch").alias("_s")).agg((F.lit(1.0) / F.count("*")).alias("weight"))
    return found.join(sizes, F.col("sketch") == F.col("_s")).select("fault", "toxic", "weight", (F.hash("sketch") % FOLDS).alias("fold"), "words")


def chosen_words(rows: DataFrame, most: int) -> list[str]:
    """The words whose presence tells most of a category: the largest likelihood ratios, half for each."""
    total = rows.agg(F.sum("weight").alias("n"), *(F.sum(F.when(F.col(c), F.col("weight")).otherwise(0)).alias(c) for c in CATEGORIES[:2])).first()
    if not total["n"]:
        return []
    by_word = rows.select(F.explode("words").alias("word"), "weight", *CATEGORIES[:2]).groupBy("word")
    by_word = by_word.agg(F.sum("weight").alias("n"), *(F.sum(F.when(F.col(c), F.col("weight")).otherwise(0)).alias(c) for c in CATEGORIES[:2])).filter(F.col("n") >= LEAST_TEXTS)
    out: dict[str, None] = {}
    for c in CATEGORIES[:2]:
        share = min(1 - 1e-9, max(1e-9, total[c] / total["n"]))
        rate = (F.col(c) + share) / (F.col("n") + 1)
        gain = F.col("n") * (rate * F.log(rate / share) + (1 - rate) * F.log((1 - rate) / (1 - share)))
        best = by_word.select("word", gain.alias("gain")).filter(F.col("gain") >= LEAST_GAIN).orderBy(F.desc("gain"), "word").limit(most // 2).collect()
        out |= dict.fromkeys(r["word"] for r in best)
    return list(out)


def fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights and, last, the bias of a ridge logistic model: accelerated gradient steps of a safe length."""
    total, positive = weight.sum(), float(weight @ y)
    w = np.zeros(x.shape[1] + 1, np.float32)
    w[-1] = np.log((positive + 0.5) / (total - positive + 0.5))
    if not positive or positive == total:
        return w
    # A power iteration bounds the curvature.
    v = np.ones(x.shape[1], np.float32)
    for _ in range(15):
        v = x.T @ (weight * (x @ v))
        v /= np.linalg.norm(v) + 1e-12
    curve = 0.25 * (float(v @ (x.T @ (weight * (x @ v)))) + total) * 1.1 + RIDGE
    ahead, before = w.copy(), w.copy()
    for k in range(STEPS):
        miss = weight * (1 / (1 + np.exp(-np.clip(x @ ahead[:-1] + ahead[-1], -30, 30))) - y)
        grad = np.append(x.T @ miss + RIDGE * ahead[:-1], miss.sum())
        w = ahead - grad / curve
        ahead = w + (k / (k + 3)) * (w - before)
        before = w
    return w.astype(np.float32)


def predicted(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def train_chain(x: np.ndarray, ys: list[np.ndarray], weight: np.ndarray, fold: np.ndarray) -> list[np.ndarray]:
    """A model for each category over the words and the earlier categories' probabilities."""
    models = []
    for y in ys:
        models.append(fitted(x, y, weight))
        out = np.zeros(len(y), np.float32)
        for k in range(FOLDS):
            inside = fold == k
            out[inside] = predicted(x[inside], fitted(x[~inside], y[~inside], weight[~inside]))
        x = np.concatenate([x, out[:, None]], 1)
    return models


def chain_of(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, features: int = FEATURES) -> tuple[list[str], list[np.ndarray]]:
    rows = cut(labelled_words(docs, labels, most))
    words = chosen_words(rows, features)
    known = {w: k for k, w in enumerate(words)}

    def run(batches):
        for batch in batches:
            at = pa.array([[known[w] for w in ws if w in known] for ws in batch.column("words").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("fault", "toxic", "weight", "fold")), at], names=["fault", "toxic", "weight", "fold", "at"])

    # At most `most` rows of small integers.
    held = rows.mapInArrow(run, "fault boolean, toxic boolean, weight double, fold int, at array<int>").collect()
    x = np.zeros((len(held), len(words)), np.float32)
    for k, r in enumerate(held):
        x[k, r["at"]] = 1
    fault, toxic = (np.array([r[c] for r in held], np.float32) for c in CATEGORIES[:2])
    return words, train_chain(x, [fault, toxic, fault * toxic], np.array([r["weight"] for r in held], np.float32), np.abs(np.array([r["fold"] for r in held], np.int64)))


def scored(docs: DataFrame, words: list[str], models: list[np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the probability of each category, and whether the text is toxic."""
    schema = docs.select(doc_id).schema
    for c in CATEGORIES:
        schema = schema.add(f"p_{c}", "double")
    shared = docs.sparkSession.sparkContext.broadcast((words, models))

    def run(batches):
        words, models = shared.value
        known = {w: k for k, w in enumerate(words)}
        for batch in chunks(batches, text):
            found = [[known[w] for w in known.keys() & words_of(b)] for b in texts_of(batch, text)]
            doc = np.repeat(np.arange(len(found)), list(map(len, found)))
            at = np.fromiter(chain.from_iterable(found), np.int64, len(doc))
            earlier: list[np.ndarray] = []
            for w in models:
                z = np.bincount(doc, w[at], len(found)) + w[-1]
                for k, p in enumerate(earlier):
                    z = z + w[len(words) + k] * p
                earlier.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), *map(pa.array, earlier)], names=schema.names)

    return docs.select(doc_id, text).mapInArrow(run, schema).withColumn("toxic", F.col("p_toxic") > 0.5)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return scored(docs, *chain_of(docs, read_table(spark, sf_dir, "labels")))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
