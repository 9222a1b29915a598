"""Context-triggered piecewise hashing of documents.

A rolling hash of the last seven bytes ends a piece wherever its low bits are all one; as many bits as the block size
has. Each piece gives one of 64 characters. The block size starts where about 64 pieces are expected and is halved
while the signature is too short, so that texts of like length have like block sizes; it is doubled while there are too
many pieces and enough are left. A fingerprint is ``block:signature:signature at twice the block``. Every piece of a text
counts: its last character covers what follows the last boundary alone, and only a run of more than three equal
characters is written shorter, a character for each doubling of its length.
Fingerprints compare at equal or neighbouring block sizes: one less the edit distance (insertions and deletions) over
the summed lengths, and 0 unless the signatures share a run of seven characters (half the shorter one, if that is less).
Where repetitive texts leave signatures of more than ``LONG`` characters, whose distance would take time in the square
of the text, the runs of seven that both have, as multisets, take its place: time in proportion to the text.

The neighbour of a document in descending order of ids comes from one shuffle by id ranges: the largest document of
each range also goes to the next range above it, and the largest of all to the lowest one. Only ids and range numbers,
one per range, are brought together.

Defined results: null text is empty; its fingerprint is ``4::``, and likeness of two empty texts is 1. Rows of equal
ids follow each other in order of their texts. A row without an id has no place in that order: it is its own neighbour.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, read_table

ROLL, PIECES, SHORTER, LEAST_BLOCK, SHARED = 7, 64, 32, 4, 7
#: Pieces above which the block is doubled, and characters above which signatures are compared by their runs.
MANY, LONG = 512, 4096
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
PRIME = 0x9E3779B97F4A7C15
INVERSE = pow(PRIME, -1, 1 << 64)
ROLL_FACTORS = [np.uint32(pow(0x01000193, k + 1, 1 << 32)) for k in range(ROLL)]
#: Ranges that a nested comparison tells apart; each is cut in equal widths beyond that.
COARSE = 256


@lru_cache(2)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _power(base: int, n: int) -> np.ndarray:
    return _powers(base, max(16, n.bit_length()))


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the seven bytes that end at each position."""
    wide = data.astype(np.uint32)
    out = np.zeros(len(data), np.uint32)
    for k, factor in enumerate(ROLL_FACTORS):
        out[k:] += wide[: max(0, len(data) - k)] * factor
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(13)
    return out


def shortened(codes: np.ndarray) -> np.ndarray:
    """Runs of more than three equal numbers with one more for each doubling of three."""
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    sizes = np.diff(starts, append=len(codes))
    kept = np.where(sizes <= 3, sizes, 3 + np.floor(np.log2(np.maximum(sizes, 3) / 3)).astype(np.int64))
    return np.repeat(codes[starts], kept)


def fingerprint(data: bytes) -> str:
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    if not n:
        return f"{LEAST_BLOCK}::"
    hashes = rolling(raw)
    at = np.flatnonzero((hashes & np.uint32(LEAST_BLOCK - 1)) == LEAST_BLOCK - 1)
    hashes = hashes[at]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(PRIME, n)[:n], out=sums[1:])
    back = _power(INVERSE, n)

    def signature(block: int) -> bytes:
        ends = at[(hashes & np.uint32(block - 1)) == block - 1] + 1
        if not len(ends) or ends[-1] < n:
            ends = np.append(ends, n)
        begins = np.concatenate([[0], ends[:-1]])
        pieces = (sums[ends] - sums[begins]) * back[begins]
        pieces ^= pieces >> np.uint64(29)
        pieces *= np.uint64(0xBF58476D1CE4E5B9)
        return ALPHABET[shortened((pieces >> np.uint64(58)).astype(np.int64))].tobytes()

    block = LEAST_BLOCK
    while block * PIECES < n:
        block *= 2
    first = signature(block)
    while len(first) < SHORTER and block > LEAST_BLOCK:
        block //= 2
        first = signature(block)
    while len(first) > MANY and len(coarser := signature(2 * block)) >= SHORTER:
        block, first = 2 * block, coarser
    return f"{block}:{first.decode()}:{signature(2 * block).decode()}"


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _score(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    run = min(SHARED, max(1, min(len(a), len(b)) // 2))
    if max(len(a), len(b)) > LONG:
        here, there = (Counter(x[k : k + run] for k in range(len(x) - run + 1)) for x in (a, b))
        return 2 * (here & there).total() / (here.total() + there.total())
    seen = {a[k : k + run] for k in range(len(a) - run + 1)}
    if not any(b[k : k + run] in seen for k in range(len(b) - run + 1)):
        return 0.0
    return 2 * common_length(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1: how alike two fingerprints are."""
    if a == b:
        return 1.0
    (x, a1, a2), (y, b1, b2) = a.split(":"), b.split(":")
    p, q = int(x), int(y)
    if p == q:
        return max(_score(a1, b1), _score(a2, b2))
    if p == 2 * q:
        return _score(a1, b2)
    if q == 2 * p:
        return _score(a2, b1)
    return 0.0


def _range_number(column, bounds: list[int], width: int):
    """Which range an id lies in: a nested comparison over the bounds, then equal widths inside."""

    def tree(low: int, high: int):
        if low == high:
            if width == 1:
                return F.lit(low)
            begin, end = bounds[low - 1] if low else bounds[0], bounds[low] if low < len(bounds) else bounds[-1]
            part = F.floor((column - F.lit(begin)) / F.lit(max(1.0, (end - begin) / width)))
            return F.lit(low * width) + F.least(F.lit(width - 1), F.greatest(F.lit(0), part)).cast("int")
        mid = (low + high) // 2
        return F.when(column < F.lit(bounds[mid]), tree(low, mid)).otherwise(tree(mid + 1, high))

    return tree(0, len(bounds)).cast("int") if bounds else F.lit(0)


def with_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """part, extra, doc_id, text: rows of a part in descending order of ids, its last row (extra) the next one's text."""
    spark = docs.sparkSession
    parts = 8 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))  # several to a task even out
    cuts = min(parts, COARSE)
    found = docs.agg(F.percentile_approx(doc_id, [k / cuts for k in range(1, cuts)] or [0.5], 10_000).alias("b")).first()["b"]
    bounds = sorted(set(found or []))
    part = F.when(F.col(doc_id).isNull(), F.lit(-1)).otherwise(_range_number(F.col(doc_id), bounds, -(-parts // cuts)))
    # At most one row per range, so this table is small whatever the input.
    tops = docs.filter(F.col(doc_id).isNotNull()).groupBy(part.alias("p")).agg(F.max(doc_id).alias("top")).orderBy("p").collect()
    extra = [(above["p"], row["top"]) for row, above in zip(tops, tops[1:] + tops[:1], strict=True)]
    if not extra:
        extra = [(-2, 0)]
    to = spark.createDataFrame(extra, "_to int, _top long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), part.alias("_part"))
    rows = rows.join(F.broadcast(to), rows["doc_id"] == to["_top"], "left")
    copies = F.array(F.struct(F.col("_part").alias("part"), F.lit(False).alias("extra")), F.struct(F.col("_to").alias("part"), F.lit(True).alias("extra")))
    rows = rows.select("doc_id", "text", F.explode(F.filter(copies, lambda c: c["part"].isNotNull())).alias("k"))
    rows = rows.select("k.part", "k.extra", "doc_id", "text", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("_salt"))
    return rows.repartition("part", "_salt").sortWithinPartitions("part", "extra", F.desc("doc_id"), "text").drop("_salt")


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many characters of the following text, or all of it."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprinted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row."""
    rows = with_neighbours(docs, doc_id, text)
    schema = rows.select(F.col("doc_id").alias(doc_id)).schema
    for name, kind in (("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")):
        schema = schema.add(name, kind)
    names = schema.names

    def made(held, after):
        _, _, key, own, print_ = held
        _, _, _, following, next_print = after
        changed = edited(own, following)
        data = changed.encode()
        print2 = print_ if changed == own else fingerprint(data)
        return key, len(own), hashlib.sha256(data).hexdigest(), print_, print2, likeness(print_, print2), likeness(print_, next_print)

    def run(batches):
        held = None
        for batch in chunks(batches):
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "extra", "doc_id", "text")), strict=True):
                own = row[3] or ""
                now = (*row[:3], own, fingerprint(own.encode()))
                if row[2] is None:
                    out.append(made(now, now))
                    continue
                if held and not held[1]:
                    out.append(made(held, now))
                held = now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out, strict=True), KINDS, strict=True)], names=names)

    return rows.select("part", "extra", "doc_id", "text").mapInArrow(run, schema)


KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def op7_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(read_table(spark, sf_dir, "documents"))


QUERIES = {"op7_ctph": op7_ctph}
ORACLES: dict[str, str] = {}
