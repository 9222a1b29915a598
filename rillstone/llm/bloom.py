"""A blocked Bloom filter in DataFrame functions, of bounded size.

Blocks have 256 bits in four words; a key sets two bits in each word of one block. The filter is an aggregate over blocks with ``MAX_BLOCKS``
blocks at most (8 MB), so that broadcasting it is bounded whatever the number of keys: more keys only let more false
positives through. It never misses a key. ``sieved`` uses it only up to ``CAPACITY`` keys: beyond that it would hold back next to
nothing, so nothing is broadcast and every row is left to the exact join that follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS, BITS_A_KEY, MAX_BLOCKS = 256, 16, 1 << 18
WORDS = BLOCK_BITS // 64
CAPACITY = MAX_BLOCKS * BLOCK_BITS // BITS_A_KEY


def _block(key: Column, blocks: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(blocks - 1)).cast("int")


def _masks(key: Column) -> list[Column]:
    """The words of a block that has the key's eight bits set, two in each word."""
    bits = F.xxhash64(key, F.lit("bits"))
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(bits, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    return [one(2 * w).bitwiseOR(one(2 * w + 1)) for w in range(WORDS)]


def built(keys: DataFrame, key: str, n: int, max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, int]:
    """The filter of the ``n`` keys: each block's number and words; and how many blocks there are."""
    blocks = 1
    while blocks < max_blocks and blocks * BLOCK_BITS < n * BITS_A_KEY:
        blocks *= 2
    rows = keys.select(_block(F.col(key), blocks).alias("_block"), *(m.alias(f"_w{k}") for k, m in enumerate(_masks(F.col(key)))))
    return rows.groupBy("_block").agg(*(F.bit_or(f"_w{k}").alias(f"_w{k}") for k in range(WORDS))), blocks


def tested(rows: DataFrame, key: str, table: DataFrame, blocks: int, flag: str = "_hit") -> DataFrame:
    """``rows`` with a boolean column: false where the filter rules ``key`` out. A null key is ruled out."""
    names = rows.columns
    probe = rows.withColumn("_at", _block(F.col(key), blocks)).join(F.broadcast(table), F.col("_at") == F.col("_block"), "left")
    hit = F.col(key).isNotNull() & F.col("_block").isNotNull()
    for k, m in enumerate(_masks(F.col(key))):
        hit = hit & (F.col(f"_w{k}").bitwiseAND(m) == m)
    return probe.select(*names, F.coalesce(hit, F.lit(False)).alias(flag))


def sieved(rows: DataFrame, key: str, keys: DataFrame, column: str, flag: str = "_hit") -> DataFrame:
    """``rows`` with a boolean column: whether an exact join with ``keys`` still has to look at the row."""
    n = keys.count()
    if n > CAPACITY:
        return rows.withColumn(flag, F.lit(True))
    return tested(rows, key, *built(keys, column, n), flag=flag)
