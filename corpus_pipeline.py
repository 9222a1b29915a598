"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, and encoding, in that order.

Each stage is (name, function of (spark, docs, sf_dir)); its result is the next stage's documents. A stage that ends in
Python writes its result as Parquet, which ``run`` deletes once the next such table is there; the others end in DataFrame
functions and leave them to whoever reads the result. All but the last return the columns of documents:

1. ``quality_rules`` drops documents that fail their own rules or whose host is rejected;
2. ``near_duplicates`` keeps one document of each component of near copies, that with the smallest id: fingerprints of
   five-word shingles within two bits (SimHash, multi-index hashing), and beyond their reach sets of similarity 0.8;
3. ``secret_scans`` masks secrets in the text (and sets n_chars anew); every document stays;
4. ``mixing`` repeats or drops documents by rates that bring expected domain tokens to their target weights;
5. ``byte_bpe`` encodes and decodes each text: doc_id, n_tokens and the digests of the ids and the decoded bytes.

Nulls, empty tables and repeated rows are handled as each stage's docstring says. An SQL form does not exist: XXH64
fingerprints, byte-pair merges and the fitted rates are not expressible in SQL, so tests hold each stage against a plain
computation on a small table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from rillstone.llm import bpe, mixing, quality, secrets, simhash
from rillstone.llm.common import deleted, short_batches, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def short(stage: Stage) -> Stage:
    """The stage with the Python work that it does itself in short Arrow batches; its last step must be without Python.

    That step is left to the caller, so that texts are not written once here and once more there.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with short_batches(spark):
            return stage(spark, docs, sf_dir)

    return run


def written(stage: Stage) -> Stage:
    """The stage with its result as a table, so that all its Python work is done here, in short Arrow batches, whoever calls it."""
    return short(wraps(stage)(lambda spark, docs, sf_dir: table(stage(spark, docs, sf_dir))))


STAGES = [
    ("quality_rules", written(quality.keep_good)),
    ("near_duplicates", short(simhash.keep_one)),
    ("secret_scans", written(secrets.mask_secrets)),
    ("mixing", short(mixing.mix_kept)),
    ("byte_bpe", written(bpe.encode_kept)),
]
#: The stages whose results are tables.
WRITTEN = ("quality_rules", "secret_scans", "byte_bpe")
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table of documents; what lies between them is in the folder that spark.checkpoint.dir names.

    Two tables of texts are there at once at most, the last one and the one that is being written.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name in WRITTEN:
            if last is not None:
                deleted(last)
            last = docs
    return docs
