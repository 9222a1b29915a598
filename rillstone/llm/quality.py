"""Host-level quality rules: document rules, failures by host, shrunken rates, verdicts joined back.

Each document is measured alone (words, symbols, repeated lines, repeated five-word windows). The failures of the
base rules are counted by host; each host's rate is shrunk towards the corpus by an empirical beta prior (its mean is
the corpus rate, its weight comes from the variance between hosts). A host is rejected with all its documents when its
posterior says that it fails ``max_lift`` times as often as the corpus: when the rate is above that by ``DOUBT`` standard
deviations of the posterior. So a host with few documents, or one that is merely worse than most, stays. Host counts are pre-aggregated before the shuffle, so a host with a third of all rows
costs one row a task; the way back is a join on (host, salt).

Defined results: null text is an empty text, which fails; a null host is a host of its own; rows with equal ids are
each measured and returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import WHITE, chunks, cut, read_table, texts_of

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 10, 20, 5
#: A host is rejected when its failure rate is surely above so many times the corpus rate.
MAX_LIFT, DOUBT = 3.0, 2.0
#: Bounds of the prior's weight in documents.
PRIOR_WEIGHT = (1.0, 1e6)
SALTS = 32
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[list[bytes]], size: int = WINDOW) -> np.ndarray:
    """For each text, its words that lie in a window of ``size`` words found twice or more in that text."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    n = int(lengths.sum())
    if n < size:
        return np.zeros(len(words), np.int64)
    known: defaultdict = defaultdict(count().__next__)
    ids = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64, n)
    doc = np.repeat(np.arange(len(words)), lengths)
    # Windows get exact numbers by doubling: a window is a number for its first words and the number of the next word.
    code, top = ids, len(known)
    for k in range(1, size):
        code, seen = pd.factorize(code[: n - k] * len(known) + ids[k:])
        top = len(seen)
    ends = np.cumsum(lengths)
    inside = np.arange(n - size + 1) + size <= ends[doc[: n - size + 1]]
    at = np.flatnonzero(inside)
    code, _ = pd.factorize(doc[at] * top + code[at])
    again = at[np.bincount(code)[code] > 1] if len(code) else at
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + size, -1)
    return np.bincount(doc[np.cumsum(edge[:n]) > 0], minlength=len(words))


def measure(texts: list[bytes]) -> list[np.ndarray]:
    """The five measures of each text, in the order of ``MEASURES``."""
    words = [b.split() for b in texts]
    dup_lines = []
    for b in texts:
        lines = [x for x in b.split(b"\n") if x and not x.isspace()]
        dup_lines.append(len(lines) - len(set(lines)))
    n = [len(x) for x in words]
    chars = [len(b.decode("utf-8", "surrogatepass")) - (len(b) - len(b.translate(None, WHITE))) for b in texts]
    symbols = [len(b) - len(b.translate(None, SYMBOLS)) for b in texts]
    return [np.asarray(x, np.int64) for x in (n, chars, symbols, dup_lines, repeated_words(words))]


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and the five measures of each row."""
    source = docs.select(*dict.fromkeys([*keep, text]))
    schema = source.select(*keep).schema
    for m in MEASURES:
        schema = schema.add(m, "long")

    def run(batches):
        names = [*keep, *MEASURES]
        for batch in chunks(batches, text):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, measure(texts_of(batch, text)))], names=names)

    return source.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def host_rates(flags: DataFrame, host: str = "source", failed: str = "base_failed", max_lift: float = MAX_LIFT) -> DataFrame:
    """One row per host: documents, failures, the shrunken failure rate and the verdict."""
    hosts = cut(flags.groupBy(host).agg(F.count("*").alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed")))
    total = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f")).first()
    n, f = total["n"] or 0, total["f"] or 0
    mean = f / n if n else 0.0
    spread = hosts.agg((F.sum(F.col("n_docs") * F.pow(F.col("n_failed") / F.col("n_docs") - F.lit(mean), 2)) / F.sum("n_docs")).alias("v")).first()["v"] or 0.0
    low, high = PRIOR_WEIGHT
    weight = min(high, max(low, mean * (1 - mean) / spread - 1)) if spread > 0 else high
    shrunk, many = (F.col("n_failed") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight)), F.col("n_docs") + F.lit(weight)
    sure = F.col("host_rate") - DOUBT * F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (many + 1))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_rejected", sure > F.lit(max_lift * mean))


def with_host_rate(rows: DataFrame, rates: DataFrame, host: str = "source", salts: int = SALTS) -> DataFrame:
    """Join each row with its host's rate; null hosts meet each other."""
    key = lambda c: (F.col(c).isNull().alias("_none"), F.coalesce(F.col(c), F.lit("")).alias("_host"))
    right = rates.select(*key(host), "host_rate", "host_rejected", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    left = rows.select("*", *key(host), F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int").alias("_salt"))
    return left.join(right, ["_none", "_host", "_salt"]).drop("_none", "_host", "_salt")


def quality_rules(docs: DataFrame, host: str = "source", max_lift: float = MAX_LIFT, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, the measures, base_failed, host_rate, host_rejected and kept for each row of ``docs``."""
    rows = cut(measured(docs, [doc_id, host]).withColumn("base_failed", base_failed()))
    out = with_host_rate(rows, host_rates(rows, host, max_lift=max_lift), host)
    return out.select(doc_id, *MEASURES, "base_failed", "host_rate", "host_rejected", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 6))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows of ``docs`` that pass their own rules and whose host passes.

    Texts do not move: a bounded Bloom filter of the rejected hosts lets all other rows through where they are, and only
    what it may hold meets the list of rejected hosts.
    """
    names = docs.columns
    key = F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce(F.col("source"), F.lit("")))
    flags = cut(measured(docs, ["source"]).select("source", base_failed().alias("base_failed")))
    bad = cut(host_rates(flags).filter("host_rejected").select(key.alias("_bad")))
    # Under other names meanwhile, so that no column clashes with a measure.
    own = [f"_c{k}" for k in range(len(names))]
    renamed = docs.select(*(F.col(c).alias(k) for c, k in zip(names, own, strict=True)), key.alias("_host"))
    good = measured(renamed, [*own, "_host"], own[names.index("text")]).filter(~base_failed()).select(*own, "_host")
    if not bad.limit(1).count():
        return good.select(*own).toDF(*names)
    tested = bloom.sieved(good, "_host", bad, "_bad")
    hits = tested.filter("_hit").join(bad, F.col("_host") == F.col("_bad"), "left_anti")
    return tested.filter("NOT _hit").select(*own).unionByName(hits.select(*own)).toDF(*names)


ORACLE_SQL = """
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i:i+4]) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM g WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
      WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m),
h AS (SELECT source, count(*) AS n_docs, sum(CAST(base_failed AS BIGINT)) AS n_failed FROM b GROUP BY source),
t AS (SELECT sum(n_failed) / sum(n_docs) AS mean FROM h),
v AS (SELECT mean, (SELECT sum(n_docs * power(n_failed / n_docs - mean, 2)) / sum(n_docs) FROM h) AS v FROM t),
s AS (SELECT mean, CASE WHEN v > 0 THEN least(1e6, greatest(1.0, mean * (1 - mean) / v - 1)) ELSE 1e6 END AS weight FROM v),
x AS (SELECT source, (n_failed + mean * weight) / (n_docs + weight) AS host_rate, n_docs + weight AS many, mean FROM h, s),
k AS (SELECT source, host_rate, host_rate - 2 * sqrt(host_rate * (1 - host_rate) / (many + 1)) > 3 * mean AS host_rejected FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       round(host_rate, 6) AS host_rate, host_rejected, (NOT base_failed AND NOT host_rejected) AS kept
FROM b JOIN k ON b.source IS NOT DISTINCT FROM k.source
"""
QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLES = {"op3_quality_rules": ORACLE_SQL}
