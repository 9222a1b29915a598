"""Scoring texts with a log-bilinear language model trained by noise-contrastive estimation.

Tokens are lower-cased words and one end per text. Word counts of all training texts are aggregated over the cluster.
The model has ``CLASSES`` outputs: the end, the ``WORDS`` most frequent words (one each), and ``SURFACE`` classes of all
other words by their last bytes. Outputs lie in ``GROUPS`` groups by frequency. The ``CONTEXT`` classes before a token
predict a vector (each context vector weighted by its place); a group scores by its product with it plus a bias, and so
does a member within its group. Scoring normalises exactly: batched products give all groups' scores and all scores
within the token's group. A word of a surface class has the probability of the class times its smoothed share of the
counts in it, so the probabilities of all words sum to one.

Training goes in ``ROUNDS`` rounds. A hash of id and text deals the training texts to rounds, so every training token is
used once. In a round the tasks sum the gradients of the noise-contrastive objective over the round's tokens (noise: the
corpus unigrams; its expectation is taken exactly over the members of a group, so nothing is drawn), the sums are added
up over the cluster, and one step (Adam) is made from their mean. What a round does depends on its texts and not on how
they are partitioned, but for the rounding of sums.

Counts of the most frequent words, ``HEAD`` at most, are broadcast (that number bounds them), so no frequent word is shuffled by
key; all rarer words meet their counts in a join.

Defined results: null and empty texts hold the end alone; a null id counts as the empty string when texts are held out;
repeated rows are each trained on and scored; with no training text the model is uniform; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, cut, read_table, shared_folder, texts_of

#: Outputs: the end, then words by frequency, then classes of other words by their last SUFFIX bytes.
GROUPS, MEMBERS, SURFACE, SUFFIX = 32, 64, 768, 4
CLASSES = GROUPS * MEMBERS
WORDS = CLASSES - 1 - SURFACE
END, BEGIN = 0, CLASSES
DIMENSION, CONTEXT = 32, 6
HEAD = 65_536
#: Bins of a doubling of the count; the head is the highest whole bins that hold HEAD words at most.
BINS = 16
SMOOTHING = 0.1
ROUNDS, NOISE, RATE, SEED = 32, 25.0, 0.08, 7
MOMENTS, LEAST_MOVE = (0.8, 0.95), 1e-7
#: Tokens of a block of matrix products.
BLOCK = 16_384
#: Distinct words that a worker gathers before it passes them on; bytes of a file of a round.
GATHER, FILE = 1_500_000, 64 << 20
FOLDS = 10


def held_out(ids: list) -> list[bool]:
    return [zlib.crc32(b"" if k is None else str(k).encode()) % FOLDS == 0 for k in ids]


def surface(word: bytes) -> int:
    """The class of a word that has no class of its own."""
    return 1 + WORDS + zlib.crc32(word[-SUFFIX:]) % SURFACE


def word_counts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """word, c over the training texts; the end is not among them."""

    def run(batches):
        held: Counter = Counter()
        for batch in chunks(batches, text):
            out = held_out(batch.column(doc_id).to_pylist())
            held.update(chain.from_iterable(b.lower().split() for b, no in zip(texts_of(batch, text), out, strict=True) if not no))
            if len(held) > GATHER:
                yield rows(held)
                held = Counter()
        yield rows(held)

    def rows(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

    return docs.select(doc_id, text).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Counts:
    """What all workers need of the corpus: bounded by HEAD and CLASSES."""

    words: list[bytes]  # by falling count
    counts: np.ndarray
    n_tokens: int  # training tokens, ends included
    n_texts: int
    n_distinct: int  # the end included
    class_tokens: np.ndarray  # by class
    class_words: np.ndarray

    def classes(self) -> list[int]:
        """The class of each head word."""
        return [1 + k if k < WORDS else surface(w) for k, w in enumerate(self.words)]

    def noise(self) -> np.ndarray:
        seen = self.class_tokens + SMOOTHING
        return seen / seen.sum()

    def share_logs(self) -> np.ndarray:
        """The decimal logarithm of a class's denominator for the shares of its words; 0 where the class is one word."""
        out = np.log10(self.class_tokens + SMOOTHING * (self.class_words + 1))
        out[: 1 + WORDS] = 0
        return out


class Model:
    """Parameters as rows of one matrix: context vectors, member vectors, group vectors, place weights, biases."""

    rows = (CLASSES + 1) + CLASSES + GROUPS + CONTEXT + (CLASSES + GROUPS) // DIMENSION

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        self.context, self.member, self.group, self.place, rest = np.split(matrix, np.cumsum([CLASSES + 1, CLASSES, GROUPS, CONTEXT]))
        self.member_bias, self.group_bias = rest.reshape(-1)[:CLASSES], rest.reshape(-1)[CLASSES:]

    @classmethod
    def start(cls, noise: np.ndarray) -> Model:
        """Small random context vectors, no output vectors, and the noise's logarithms as biases: the unigram model."""
        out = cls(np.zeros((cls.rows, DIMENSION)))
        out.context[:] = np.random.default_rng(SEED).normal(0, 0.2, out.context.shape)
        out.place[:] = 1 / np.sqrt(CONTEXT)
        by_group = noise.reshape(GROUPS, MEMBERS)
        out.group_bias[:] = np.log(by_group.sum(1))
        out.member_bias[:] = np.log(by_group / by_group.sum(1, keepdims=True)).ravel()
        return out

    def single(self) -> Model:
        return Model(self.matrix.astype(np.float32))

    def blocks(self, seq: np.ndarray):
        """Of each block of a padded sequence: its first position, context vectors, places of tokens in order of their groups, their
        predicted vectors, and the edges of the groups among them."""
        for a in range(CONTEXT, len(seq), BLOCK):
            b = min(len(seq), a + BLOCK)
            seen = self.context[seq[a - CONTEXT : b]]
            vectors = sum(self.place[k] * seen[CONTEXT - 1 - k : CONTEXT - 1 - k + b - a] for k in range(CONTEXT))
            group = seq[a:b] // MEMBERS
            order = np.argsort(group.astype(np.uint8), kind="stable")
            edges = np.searchsorted(group[order], np.arange(GROUPS + 1))
            order = order[: edges[-1]]  # what begins a text has a group beyond the last and is not predicted
            yield a, seen, order, vectors[order], edges

    def log_probability(self, seq: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each token of a padded sequence; 0 where a text begins."""
        out = np.zeros(len(seq), np.float64)
        for a, _, order, vectors, edges in self.blocks(seq):
            classes = seq[a + order]
            scores = vectors @ self.group.T + self.group_bias
            got = scores[np.arange(len(order)), classes // MEMBERS] - _log_sum(scores)
            for g in np.flatnonzero(np.diff(edges)):
                on, of = slice(edges[g], edges[g + 1]), slice(g * MEMBERS, (g + 1) * MEMBERS)
                scores = vectors[on] @ self.member[of].T + self.member_bias[of]
                got[on] += scores[np.arange(len(scores)), classes[on] % MEMBERS] - _log_sum(scores)
            out[a + order] = got
        return out

    def gradient(self, seq: np.ndarray, noise: np.ndarray, total: Model) -> int:
        """Add the objective's gradient over a padded sequence to ``total``; the number of tokens."""
        by_group = noise.reshape(GROUPS, MEMBERS)
        group_noise = by_group.sum(1)
        add, add_group = (np.log(NOISE * x).astype(np.float32) for x in (by_group / group_noise[:, None], group_noise))
        many = 0
        for a, seen, order, vectors, edges in self.blocks(seq):
            classes = seq[a + order]
            many += len(order)
            up = _contrast(vectors @ self.group.T + (self.group_bias - add_group), np.exp(add_group), classes // MEMBERS)
            back = up @ self.group
            total.group += up.T @ vectors
            total.group_bias += up.sum(0)
            for g in np.flatnonzero(np.diff(edges)):
                on, of = slice(edges[g], edges[g + 1]), slice(g * MEMBERS, (g + 1) * MEMBERS)
                up = _contrast(vectors[on] @ self.member[of].T + (self.member_bias[of] - add[g]), np.exp(add[g]), classes[on] % MEMBERS)
                back[on] += up @ self.member[of]
                total.member[of] += up.T @ vectors[on]
                total.member_bias[of] += up.sum(0)
            # Back from each token to the CONTEXT classes before it, by shifts.
            spread = np.zeros((len(seen) - CONTEXT, DIMENSION), np.float32)
            spread[order] = back
            past = np.zeros_like(seen)
            for k in range(CONTEXT):
                on = slice(CONTEXT - 1 - k, CONTEXT - 1 - k + len(spread))
                past[on] += self.place[k] * spread
                total.place[k] += np.einsum("ij,ij->j", spread, seen[on])
            who = seq[a - CONTEXT : a - CONTEXT + len(seen)].astype(np.uint16)
            sort = np.argsort(who, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], who[sort][1:] != who[sort][:-1]]))
            total.context[who[sort][first]] += np.add.reduceat(past[sort], first, axis=0)
        return many


def _log_sum(scores: np.ndarray) -> np.ndarray:
    top = scores.max(1)
    return top + np.log(np.exp(scores - top[:, None]).sum(1))


def _contrast(odds: np.ndarray, noise: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gradient by score of telling the target from noise, whose expectation is exact. odds: score less log expected noise."""
    np.clip(odds, -30, 30, out=odds)
    np.negative(odds, out=odds)
    np.exp(odds, out=odds)
    odds += 1
    np.reciprocal(odds, out=odds)
    row = np.arange(len(odds))
    own = 1 - odds[row, target]
    odds *= -noise
    odds[row, target] += own
    return odds


def padded(classes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of texts of n words each, with CONTEXT begins before and an end after each; and where each word is in it."""
    size = n + CONTEXT + 1
    stop = np.cumsum(size)
    out = np.full(int(stop[-1]) if len(n) else 0, BEGIN, np.int32)
    out[stop - 1] = END
    at = np.arange(int(n.sum())) + np.repeat(stop - size + CONTEXT - (np.cumsum(n) - n), n)
    out[at] = classes
    return out, at


def _words(known: dict[bytes, int], own: np.ndarray, texts: list[bytes]):
    """Words, words per text, the head number of each word (-1: not in it) and its class. own: the class of each head word."""
    words = [b.lower().split() for b in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    flat = list(chain.from_iterable(words))
    number = np.fromiter(map(known.get, flat, repeat(-1)), np.int64, len(flat))
    classes = own[number] if len(own) else np.zeros(len(flat), np.int32)
    far = np.flatnonzero(number < 0)
    classes[far] = np.fromiter((surface(flat[k]) for k in far.tolist()), np.int32, len(far))
    return flat, n, number, classes


class Steps:
    """Adam, from mean gradients."""

    def __init__(self, model: Model):
        self.model, self.k = model, 0
        self.first, self.second = np.zeros_like(model.matrix), np.zeros_like(model.matrix)

    def make(self, gradient: np.ndarray) -> None:
        self.k += 1
        a, b = MOMENTS
        self.first = a * self.first + (1 - a) * gradient
        self.second = b * self.second + (1 - b) * gradient * gradient
        self.model.matrix += RATE * (self.first / (1 - a**self.k)) / (np.sqrt(self.second / (1 - b**self.k)) + LEAST_MOVE)


def sequences(docs: DataFrame, counts: Counts, doc_id: str, text: str) -> DataFrame:
    """round and the padded classes (16-bit) of some of its training texts, as a table in files by round."""
    shared = docs.sparkSession.sparkContext.broadcast((counts.words, np.array(counts.classes(), np.int32)))

    def run(batches):
        words, own = shared.value
        known = {w: k for k, w in enumerate(words)}
        for batch in chunks(batches, text):
            ids = batch.column(doc_id).to_pylist()
            texts = texts_of(batch, text)
            rounds: dict[int, list[bytes]] = {}
            for k, b, no in zip(ids, texts, held_out(ids), strict=True):
                if not no:
                    rounds.setdefault(zlib.crc32(b, zlib.crc32(str(k).encode())) % ROUNDS, []).append(b)
            data = []
            for some in rounds.values():
                _, n, _, classes = _words(known, own, some)
                data.append(padded(classes, n)[0].astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rounds.keys(), pa.int32()), pa.array(data, pa.binary())], names=["round", "seq"])

    return docs.select(doc_id, text).mapInArrow(run, "round int, seq binary")


def files_of(spark: SparkSession, counts: Counts) -> int:
    """Files of a round: as many as there are cores, or more that are not too large."""
    return max(spark.sparkContext.defaultParallelism, 2 * counts.n_tokens // ROUNDS // FILE)


def written(docs: DataFrame, counts: Counts, doc_id: str, text: str) -> DataFrame:
    """``sequences`` in the shared folder, files by round: a round reads its own, as many at once as there are cores."""
    spark = docs.sparkSession
    files = files_of(spark, counts)
    rows = sequences(docs, counts, doc_id, text).withColumn("_salt", F.pmod(F.xxhash64("seq"), F.lit(files)))
    path = shared_folder(spark, "rounds")
    rows.repartition(ROUNDS * files, "round", "_salt").drop("_salt").write.partitionBy("round").parquet(path)
    return spark.read.schema("seq binary, round int").parquet(path)


def summed(rows: DataFrame, model: Model, noise: np.ndarray, ways: int = 1) -> tuple[int, np.ndarray]:
    """Tokens and gradient of the rows' sequences, added up over the cluster."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((model.matrix.astype(np.float32), noise))

    def run(batches):
        matrix, noise = shared.value
        model, total, many, held, size = Model(matrix), Model(np.zeros(matrix.shape)), 0, [], 0
        for batch in batches:
            for seq in batch.column("seq").to_pylist():
                held.append(np.frombuffer(seq, "<u2"))
                size += len(held[-1])
                if size > 4 * BLOCK:
                    many += model.gradient(np.concatenate(held).astype(np.int32), noise, total)
                    held, size = [], 0
        if held:
            many += model.gradient(np.concatenate(held).astype(np.int32), noise, total)
        if many:
            yield one(many, total.matrix)

    def one(many, matrix):
        return pa.RecordBatch.from_arrays([pa.array([many]), pa.array([matrix.tobytes()], pa.binary())], names=["many", "sums"])

    def add(batches):
        many, matrix = 0, np.zeros(Model.rows * DIMENSION)
        for batch in batches:
            for k, data in zip(batch.column("many").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                many += k
                matrix += np.frombuffer(data)
        if many:
            yield one(many, matrix)

    # Sums of a task are about a megabyte. They meet in as many tasks as the root of their number, and as many come to the driver.
    parts = rows.select("seq").mapInArrow(run, "many long, sums binary")
    got = parts.repartition(ways).mapInArrow(add, "many long, sums binary").collect()
    shared.destroy()
    many, gradient = 0, np.zeros_like(model.matrix)
    for r in got:
        many += r["many"]
        gradient += np.frombuffer(r["sums"]).reshape(gradient.shape)
    return many, gradient


def trained(docs: DataFrame, counts: Counts, doc_id: str, text: str) -> Model:
    """The model after a step for each round that has texts."""
    noise = counts.noise()
    model = Model.start(noise)
    if not counts.n_texts:
        return model
    steps, rows = Steps(model), written(docs, counts, doc_id, text)
    ways = math.isqrt(files_of(docs.sparkSession, counts))
    for k in range(ROUNDS):
        many, gradient = summed(rows.filter(F.col("round") == k), model, noise, ways)
        if many:
            steps.make(gradient / many)
    return model


def _bin():
    return F.floor(F.log2("c") * BINS).cast("int")


def by_surface(counts: DataFrame) -> DataFrame:
    """class, c and n: the counts and number of all words by the class of their last bytes."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surface(w) for w in batch.column("word").to_pylist()], pa.int32()), batch.column("c")], names=["class", "c"])

    return counts.select("word", "c").mapInArrow(run, "class int, c long").groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("n"))


def corpus_counts(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, Counts]:
    counts = cut(word_counts(docs, doc_id, text))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    out = F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0
    n_texts = docs.filter(~out).select(doc_id).count()
    # Logarithmic bins of the counts: at most BINS * 64 rows come back, then at most HEAD words.
    bins = counts.groupBy(_bin().alias("bin")).agg(F.count("*").alias("n")).collect()
    lowest, taken = None, 0
    for r in sorted(bins, key=lambda r: -r["bin"]):
        taken += r["n"]
        if taken > HEAD:
            break
        lowest = r["bin"]
    head = [] if lowest is None else counts.filter(_bin() >= lowest).collect()
    head.sort(key=lambda r: (-r["c"], bytes(r["word"])))
    tokens, words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_surface(counts).collect():  # SURFACE rows
        tokens[r["class"]], words[r["class"]] = r["c"], r["n"]
    # Words with a class of their own leave their surface class.
    for k, r in enumerate(head[:WORDS]):
        other = surface(bytes(r["word"]))
        tokens[other] -= r["c"]
        words[other] -= 1
        tokens[1 + k], words[1 + k] = r["c"], 1
    tokens[END] = n_texts
    return counts, Counts([bytes(r["word"]) for r in head], np.array([r["c"] for r in head], np.int64), total["n"] + n_texts, n_texts, total["v"] + (n_texts > 0), tokens, words)


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``."""
    table, counts = corpus_counts(docs, doc_id, text)
    model = trained(docs, counts, doc_id, text)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((counts, model.matrix.astype(np.float32)))
    fields = (("held_out", "boolean"), ("n_tokens", "long"), ("n_head", "long"), ("head_log", "double"), ("other_log", "double"), ("class_log", "double"))
    schema = docs.select(doc_id).schema
    for name, kind in (*fields, ("rid", "long"), ("word", "binary"), ("tf", "long")):
        schema = schema.add(name, kind)

    def run(batches):
        counts, matrix = shared.value
        model, known, own = Model(matrix), {w: k for k, w in enumerate(counts.words)}, np.array(counts.classes(), np.int32)
        logs = np.append(np.log10(counts.counts + SMOOTHING), 0.0)
        end_log, share_logs = np.log10(counts.n_texts + SMOOTHING), counts.share_logs()
        rid = TaskContext.get().partitionId() << 33
        for batch in chunks(batches, text):
            texts, rows = texts_of(batch, text), batch.num_rows
            flat, n, number, classes = _words(known, own, texts)
            seq, _ = padded(classes, n)
            doc = np.repeat(np.arange(rows), n)
            by_doc = lambda w, on=slice(None): np.bincount(doc[on], w[on], rows).astype(np.float64)
            of = np.repeat(np.arange(rows), n + CONTEXT + 1)
            class_log = np.bincount(of, model.log_probability(seq), rows) / np.log(10) - by_doc(share_logs[classes])
            ones = np.ones(len(flat))
            ids = np.arange(rid, rid + rows)
            rid += rows
            columns = [batch.column(doc_id), pa.array(held_out(batch.column(doc_id).to_pylist())), n + 1, (by_doc(ones, number >= 0) + (counts.n_texts > 0)).astype(np.int64), by_doc(logs[number]) + end_log, by_doc(logs[number], number >= WORDS), class_log, ids, pa.array([b" %d" % k for k in ids.tolist()], pa.binary()), np.zeros(rows, np.int64)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=schema.names)
            far = np.flatnonzero(number < 0)
            tail = Counter(zip(ids[doc[far]].tolist(), map(flat.__getitem__, far.tolist()), strict=True))
            if tail:
                keys, words = zip(*tail.keys(), strict=True)
                none = [pa.nulls(len(tail), batch.column(doc_id).type), *(pa.nulls(len(tail), {"boolean": pa.bool_(), "long": pa.int64(), "double": pa.float64()}[k]) for _, k in fields)]
                yield pa.RecordBatch.from_arrays([*none, pa.array(keys, pa.int64()), pa.array(words, pa.binary()), pa.array(list(tail.values()), pa.int64())], names=schema.names)

    # A text's own row has a key with a space, which no word has: it meets no count and does not gather at a null key.
    rows = docs.select(doc_id, text).mapInArrow(run, schema).join(table, "word", "left")
    tail_log = F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTHING)
    sums = rows.groupBy("rid").agg(*(F.max(c).alias(c) for c in (doc_id, *(k for k, _ in fields))), F.sum(tail_log).alias("tail_log"), F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("n_tail"))
    whole = np.log10(counts.n_tokens + SMOOTHING * (counts.n_distinct + 1))
    return sums.select(
        doc_id, "held_out", "n_tokens", (F.col("n_head") + F.col("n_tail")).alias("n_known"), F.lit(int(counts.n_tokens)).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.col("tail_log") - F.col("n_tokens") * float(whole)).alias("base_score"),
        (F.col("class_log") + F.col("other_log") + F.col("tail_log")).alias("score"),
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read_table(spark, sf_dir, "documents"))


QUERIES = {"op1_lm_scoring": op1_lm_scoring}
ORACLES: dict[str, str] = {}
