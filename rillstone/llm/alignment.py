"""Alignment of two tokenizers by a dictionary of groups.

Byte offsets at which tokens of both tokenizers end cut a text in groups of A ids and B ids, written ``a1,a2|b1``. No
group crosses a space that is a boundary of both (``wordcache``), so a worker aligns each distinct word once and a text
is the run of its words' groups. The texts of a partition are dealt to blocks; a block interns its groups: documents keep
numbers and counts, the dictionary keeps each group once with the documents that hold it. The dictionaries meet by group;
links are expanded once a distinct group and weighted by its documents. A pair of ids that a document holds in several
groups would count twice there; blocks report these pairs and the surplus is taken off, so counts are exact. What is
known of each pair then goes back by group to the dictionaries and by block to the documents. A group comes at most once
from a block, so the most frequent group has no more rows than there are blocks.

Defined results: null and empty texts have no tokens, nor do texts that the B tokenizer does not give back byte for byte
(a literal U+2581 among them): zeros, and an empty digest. Repeated rows and equal or null keys each count as a document.
Very long texts are read whole; a group's links are held at once. Special strings in a text are plain text. An empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from .common import chunks, extended, read_table, table
from .wordcache import CUT, byte_level

#: Distinct words after which a block ends.
BLOCK_WORDS = 300_000
#: Rows of a batch of dictionary entries.
ENTRIES = 50_000
SPACE, NO_TOKENS = "▁", ""
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
DOC, ENTRY, SURPLUS = range(3)
FIELDS = "kind int, block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, steps array<int>, times array<int>, place int, pieces string, n long, a int, b int"


class _Irregular(Exception):
    pass


class Pair:
    """The two tokenizers: ids of a string by each, and the bytes that each id stands for."""

    def __init__(self, ranks: str | None, pieces: str | None):
        import public_tokenizers
        import sentencepiece

        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces or public_tokenizers.path("piece_bpe_32k.model"))
        self.a = byte_level(ranks)
        names = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any(SPACE in x.lstrip(SPACE) and not self.b.is_control(k) for k, x in enumerate(names)):
            raise ValueError("the pieces of this model cross spaces")
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(k) else x.replace(SPACE, " ").encode() for k, x in enumerate(names)]
        self.a_size = self.a.__self__.decode_single_token_bytes

    def aligned(self, word: str, a: list[int], b: list[int]) -> list[tuple[list[int], list[int]]] | None:
        """The groups of a string with these ids; None if B does not give its bytes back."""
        parts = [self.b_bytes[k] for k in b]
        if b"".join(parts) != word.encode():
            return None
        if len(a) == 1 or len(b) == 1:
            return [(a, b)]
        a_ends, b_ends = list(accumulate(len(self.a_size(k)) for k in a)), list(accumulate(map(len, parts)))
        place = {e: k + 1 for k, e in enumerate(b_ends)}
        out, i, j = [], 0, 0
        for k, e in enumerate(a_ends, 1):
            if e in place:
                out.append((a[i:k], b[j : place[e]]))
                i, j = k, place[e]
        return out


@lru_cache(2)
def pair(ranks: str | None = None, pieces: str | None = None) -> Pair:
    """Opened once in each process."""
    return Pair(ranks, pieces)


class _Words(dict):
    """word -> its number in the block; new words wait in ``fresh``."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        if not word or word[0].isspace():
            raise _Irregular
        return self.number(word, word)

    def number(self, key: str, word: str) -> int:
        found = self[key] = len(self)
        self.fresh.append(word)
        return found

    def of(self, text: str) -> list[int]:
        """The numbers of the words of a text that is not empty."""
        try:
            return self._numbers(text.split(" "))
        except _Irregular:
            return self._numbers(CUT.split(text))

    def _numbers(self, parts: list[str]) -> list[int]:
        first, rest = parts[0], list(map(self.__getitem__, parts[1:]))
        if not first:
            raise _Irregular
        key = " " + first if first[0].isspace() else first  # only a text's first word may begin so
        known = self.get(key)
        return [self.number(key, first) if known is None else known, *rest]


class Block:
    """Words and groups interned by number."""

    def __init__(self, both: Pair):
        self.both, self.words = both, _Words()
        self.bad, self.counts = array("b"), [array("i") for _ in COUNTS]  # a place a word
        self.texts: list[bytes] = []
        self.groups: dict[str, int] = {}
        self.word_groups, self.word_ends = array("i"), array("i", [0])
        self.links, self.link_ends = array("q"), array("i", [0])  # of a group, its distinct pairs as a << 16 | b
        self.docs_of = np.zeros(0, np.int64)  # documents that hold a group
        self.surplus: dict[int, int] = {}

    def _learn(self) -> None:
        """Align the new words."""
        fresh, both = self.words.fresh, self.both
        for word, b in zip(fresh, both.b.encode(fresh, num_threads=1), strict=True):
            a = both.a(" " + word)
            found = both.aligned(" " + word, a, b)
            self.bad.append(found is None)
            names = []
            for left, right in found or []:
                name = f"{','.join(map(str, left))}|{','.join(map(str, right))}"
                names.append(name)
                place = self.groups.get(name)
                if place is None:
                    place = self.groups[name] = len(self.groups)
                    self.links.extend(x << 16 | y for x in dict.fromkeys(left) for y in dict.fromkeys(right))
                    self.link_ends.append(len(self.links))
                self.word_groups.append(place)
            self.word_ends.append(len(self.word_groups))
            self.texts.append(";".join(names).encode())
            for held, n in zip(self.counts, (len(a), len(b), len(names), sum(len(x) * len(y) for x, y in found or [])), strict=True):
                held.append(n)
        fresh.clear()

    def add(self, texts: list[str | None]) -> dict:
        """Columns of the documents with these texts."""
        words = [self.words.of(t) if t else [] for t in texts]
        self._learn()
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        doc = np.repeat(np.arange(len(words)), sizes)
        flat = np.fromiter((w for x in words for w in x), np.int64, int(sizes.sum()))
        total = lambda held: np.bincount(doc, np.array(held)[flat], len(words)).astype(np.int64)
        bad = total(self.bad) > 0
        columns = {c: np.where(bad, 0, total(held)) for c, held in zip(COUNTS, self.counts, strict=True)}
        text = self.texts.__getitem__
        columns["groups_sha256"] = [NO_TOKENS if bad[k] or not w else hashlib.sha256(b";".join(map(text, w))).hexdigest() for k, w in enumerate(words)]
        doc, flat = doc[~bad[doc]], flat[~bad[doc]]
        places, owner = spread(np.array(self.word_groups), np.array(self.word_ends), flat)
        code, times = np.unique(doc[owner] << 32 | places, return_counts=True)
        holder, place = code >> 32, code & 0xFFFFFFFF
        found = np.bincount(place, minlength=len(self.groups))
        found[: len(self.docs_of)] += self.docs_of
        self.docs_of = found
        # Pairs that a document holds in several of its groups.
        pairs, owner = spread(np.array(self.links), np.array(self.link_ends), place)
        held = np.sort(holder[owner] << 32 | pairs)
        again, n = np.unique(held[1:][held[1:] == held[:-1]] & 0xFFFFFFFF, return_counts=True)
        for x, k in zip(again.tolist(), n.tolist(), strict=True):
            self.surplus[x] = self.surplus.get(x, 0) + k
        steps = np.diff(place, prepend=0)
        starts = np.flatnonzero(np.diff(holder, prepend=-1))
        steps[starts] = place[starts]
        offsets = pa.array(np.searchsorted(holder, np.arange(len(words) + 1)).astype(np.int32))
        columns["steps"], columns["times"] = (pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (steps, times))
        return columns

    def entries(self) -> Iterator[dict]:
        """The dictionary, and the pairs' surplus."""
        names = list(self.groups)
        held = np.flatnonzero(self.docs_of)
        for at in range(0, len(held), ENTRIES):
            part = held[at : at + ENTRIES]
            yield {"kind": ENTRY, "place": part, "pieces": [names[k] for k in part.tolist()], "n": self.docs_of[part]}
        codes = np.fromiter(self.surplus, np.int64, len(self.surplus))
        n = np.fromiter(self.surplus.values(), np.int64, len(codes))
        for at in range(0, len(codes), ENTRIES):
            part = codes[at : at + ENTRIES]
            yield {"kind": SURPLUS, "a": part >> 16, "b": part & 0xFFFF, "n": n[at : at + ENTRIES]}


def spread(values: np.ndarray, ends: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the chosen lists one after the other, and for each the place in ``chosen`` that it comes from."""
    sizes = ends[chosen + 1] - ends[chosen]
    owner = np.repeat(np.arange(len(chosen)), sizes)
    at = np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner] + ends[chosen][owner]
    return values[at].astype(np.int64), owner


def interned(docs: DataFrame, keep: list[str], text: str, ranks: str | None, pieces: str | None) -> DataFrame:
    """Documents, dictionary entries and surplus pairs of all blocks, told apart by ``kind``; stored as a table."""
    from pyspark.sql.pandas.types import to_arrow_schema

    source = docs.select(*(F.col(c).alias(f"_k{k}") for k, c in enumerate(keep)), F.col(text).alias("text"))
    schema = extended(source.drop("text").schema, FIELDS)
    arrow, most = to_arrow_schema(schema), BLOCK_WORDS

    def run(batches):
        both, number = pair(ranks, pieces), TaskContext.get().partitionId() << 32
        block = Block(both)

        def rows(n: int, columns: dict) -> pa.RecordBatch:
            columns = {"block": np.full(n, number), **columns}
            columns["kind"] = np.full(n, columns["kind"])
            return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow)

        for batch in chunks(batches):
            found = block.add(batch.column("text").to_pylist())
            yield rows(batch.num_rows, {"kind": DOC, **found, **{f"_k{k}": batch.column(k) for k in range(len(keep))}})
            if len(block.words) >= most:
                yield from (rows(len(x["n"]), x) for x in block.entries())
                number, block = number + 1, Block(both)
        yield from (rows(len(x["n"]), x) for x in block.entries())

    path = shared_folder(docs.sparkSession, "interned")
    source.mapInArrow(run, schema).write.partitionBy("kind").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def linked(entries: DataFrame, surplus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each distinct group (pieces, count_sum, n_best), and of each linked pair of ids the documents (a, b, count)."""
    groups = table(entries.groupBy("pieces").agg(F.sum("n").alias("n")))
    side = lambda k: F.split(F.split_part("pieces", F.lit("|"), F.lit(k)), ",")
    rows = groups.select("pieces", "n", side(1).alias("x"), side(2).alias("y"))
    rows = rows.select("*", F.explode(F.array_distinct("x")).alias("a")).select("*", F.explode(F.array_distinct("y")).alias("b"))
    times = lambda ids, one: F.when(F.size(ids) == 1, 1).otherwise(F.size(F.filter(ids, lambda z: z == F.col(one)))).cast("long")
    links = rows.select("pieces", "n", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), (times("x", "a") * times("y", "b")).alias("times"))
    counts = links.select("a", "b", "n").unionByName(surplus.select("a", "b", (-F.col("n")).alias("n"))).groupBy("a", "b").agg(F.sum("n").alias("count"))
    counts = table(counts)
    best = counts.groupBy("a").agg(F.max("count").alias("best"))  # as many rows as A has ids
    known = counts.join(F.broadcast(best), "a")
    values = links.join(known, ["a", "b"]).groupBy("pieces").agg(F.sum(F.col("times") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("count") == F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    return table(values), counts


def aligned(docs: DataFrame, keep: list[str], text: str = "text", ranks: str | None = None, pieces: str | None = None) -> DataFrame:
    """The columns ``keep`` of each row, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    from pyspark.sql.types import StructType

    rows = interned(docs, keep, text, ranks, pieces)
    held = [f"_k{k}" for k in range(len(keep))]
    of = lambda kind: rows.filter(F.col("kind") == kind)
    entries = of(ENTRY).select("block", "place", "pieces", "n")
    values, _ = linked(entries.select("pieces", "n"), of(SURPLUS).select("a", "b", "n"))
    back = entries.select(F.col("block").alias("of"), "place", "pieces").join(values, "pieces").select("of", "place", "count_sum", "n_best")
    texts = of(DOC).select("block", *held, *COUNTS, "groups_sha256", "steps", "times")
    schema = StructType([*(rows.schema[c] for c in held), *(rows.schema[c] for c in (*COUNTS, "groups_sha256"))]).add("n_best", "long").add("count_sum", "long")

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        place = right.column("place").to_numpy()
        out = left.select([*held, *COUNTS, "groups_sha256"])
        if not left.num_rows:
            return out.append_column("n_best", pa.array([], pa.int64())).append_column("count_sum", pa.array([], pa.int64()))
        lists = [pa.concat_arrays(left.column(c).chunks) for c in ("steps", "times")]
        steps, times = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
        sizes = lists[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(steps)
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        at = ends - np.repeat(ends[starts] - steps[starts], sizes[sizes > 0])
        for name in ("n_best", "count_sum"):
            value = np.zeros(int(place.max(initial=-1)) + 1, np.int64)
            value[place] = right.column(name).to_numpy()
            sums = np.concatenate([[0], np.cumsum(value[at] * times)])
            stop = np.cumsum(sizes)
            out = out.append_column(name, pa.array(sums[stop] - sums[stop - sizes]))
        return out

    result = texts.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(summed, schema)
    return result.select(*(F.col(h).alias(c) for h, c in zip(held, keep, strict=True)), *COUNTS, "n_best", "count_sum", "groups_sha256")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(read_table(spark, sf_dir, "documents"), ["doc_id"])


QUERIES = {"op11_alignment": op11_alignment}
ORACLES: dict[str, str] = {}
