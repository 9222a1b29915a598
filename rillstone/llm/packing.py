"""Packing of examples into sequences: vector bin packing with the dot-product rule.

A sequence has three limits that hold together: tokens, segments (pieces of examples) and loss-bearing tokens. An example
is cut in pieces that meet the limits; pieces as long as a sequence are sequences, the others wait in a pool. A sequence
is filled by the waiting piece whose vector of needs, in parts of the limits, has the largest dot product with the vector
of what is left, among those that fit whole. Where none fits (or one segment is left), and cutting is allowed, the longest
piece is cut at what is left. What no piece of a partition fills up at its end is laid out, if cutting is allowed, in
sequences whose lengths are powers of two, which are not padded.

Each partition of the input packs its own rows in one pass, with a pool of bounded size: nothing is shuffled, a lost task
is repeated over the same rows and gives the same sequences, and one unfilled sequence a partition is all that packing
apart costs. ``sequence_id`` is the partition's number and a count.

Defined results: an example without ids makes no piece; null and empty texts are examples with the end id alone; repeated
rows and equal or null keys are packed each for itself; an empty table gives no rows; other columns are not read. A very
long example is cut like any other. Without cutting, an example above a limit
raises an error, as do limits below 1.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, extended, read_table
from .wordcache import ByteLevel

FIELDS = "start long, length long, n_loss long, example_tokens long, sequence_id long, offset long, ids binary"
#: Pieces that wait; a partition packs when it has as many, and keeps half of them to choose from.
POOL = 4096
#: Rows of a result batch.
BATCH = 2048
#: Fixed values of the vocabulary: its special string, and the id that ends a document here.
SPECIAL, END = {"<|endoftext|>": 50256}, 1


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss: int = 2048

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits are 1 at least")


@dataclass
class Piece:
    keys: tuple
    start: int
    ids: bytes  # little-endian 32-bit integers
    loss: np.ndarray | None  # which ids bear loss; None: all
    total: int

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def n_loss(self) -> int:
        return self.length if self.loss is None else int(self.loss.sum())

    def split(self, at: int) -> tuple[Piece, Piece]:
        head, tail = (None, None) if self.loss is None else (self.loss[:at], self.loss[at:])
        return Piece(self.keys, self.start, self.ids[: 4 * at], head, self.total), Piece(self.keys, self.start + at, self.ids[4 * at :], tail, self.total)

    def prefix(self, tokens: int, loss: int) -> int:
        """The length of the longest beginning within both limits."""
        if self.loss is None:
            return min(self.length, tokens, loss)
        over = np.flatnonzero(np.cumsum(self.loss[:tokens]) > loss)
        return int(over[0]) if len(over) else min(self.length, tokens)


class Packer:
    """The pieces of one partition that wait, and the sequences that they make: lists of pieces."""

    def __init__(self, limits: Limits, cut: bool = True):
        self.limits, self.cut = limits, cut
        self.caps = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.pieces: list[Piece] = []
        self.needs = np.zeros((POOL + 8, 3))  # a row a waiting piece: tokens, segments, loss-bearing tokens

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Take an example; sequences that are full at once, or that the pool fills when it has enough, come back."""
        if not piece.length:
            return
        while piece.length > self.limits.tokens or piece.n_loss() > self.limits.loss:
            if not self.cut:
                raise ValueError(f"an example of {piece.length} tokens is above a limit, and cutting is not allowed")
            at = max(1, piece.prefix(self.limits.tokens, self.limits.loss))
            head, piece = piece.split(at)
            if at == self.limits.tokens:
                yield [head]
            else:
                self._wait(head)
                yield from self._fill(POOL)
        if piece.length == self.limits.tokens:
            yield [piece]
        else:
            self._wait(piece)
            yield from self._fill(POOL)

    def _wait(self, piece: Piece) -> None:
        self.needs[len(self.pieces)] = piece.length, 1, piece.n_loss()
        self.pieces.append(piece)

    def _take(self, k: int) -> Piece:
        """Out of the pool; the last piece takes its place."""
        piece, last = self.pieces[k], self.pieces.pop()
        if k < len(self.pieces):
            self.pieces[k] = last
            self.needs[k] = self.needs[len(self.pieces)]
        return piece

    def _fill(self, most: int) -> Iterator[list[Piece]]:
        """Sequences, if as many as ``most`` pieces wait, until half of that many do."""
        if len(self.pieces) >= max(most, 1):
            while len(self.pieces) > most // 2:
                yield self._sequence()

    def _sequence(self) -> list[Piece]:
        left, chosen = self.caps.copy(), []
        while left[0] >= 1 and left[1] >= 1 and self.pieces:
            needs = self.needs[: len(self.pieces)]
            fits = (needs <= left).all(1)
            last = left[1] < 2 and self.cut and bool((needs[:, 0] >= left[0]).any())
            if last:  # one segment is left: a piece that fills the sequence, cut if need be
                fits &= needs[:, 0] == left[0]
            if fits.any():
                dots = np.where(fits, needs @ (left / self.caps**2), -1.0)
                piece = self._take(int(dots.argmax()))
            elif self.cut:
                k = int(needs[:, 0].argmax())
                at = self.pieces[k].prefix(int(left[0]), int(left[2]))
                if not at or at == self.pieces[k].length:
                    break
                piece, rest = self._take(k).split(at)
                self._wait(rest)
            else:
                break
            chosen.append(piece)
            left -= piece.length, 1, piece.n_loss()
        return chosen

    def rest(self) -> Iterator[list[Piece]]:
        """All that still waits."""
        while self.pieces:
            chosen = self._sequence()
            if self.cut and not self.pieces:
                yield from self._powers(chosen)
            else:
                yield chosen

    def _powers(self, chosen: list[Piece]) -> Iterator[list[Piece]]:
        """The pieces in their order, in sequences of the powers of two that add up to their length."""
        left = sum(p.length for p in chosen)
        chosen = chosen[::-1]
        while chosen:
            room = 1 << (left.bit_length() - 1)
            left -= room
            out = []
            while room:
                piece = chosen.pop()
                if piece.length > room:
                    piece, rest = piece.split(room)
                    chosen.append(rest)
                out.append(piece)
                room -= piece.length
            yield out


def _rows(examples: Iterable[Piece], limits: Limits, cut: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    packer, n = Packer(limits, cut), TaskContext.get().partitionId() << 32
    rows: list[tuple] = []

    def sequences():
        for e in examples:
            yield from packer.add(e)
        yield from packer.rest()

    for sequence in sequences():
        offset = 0
        for p in sequence:
            rows.append((*p.keys, p.start, p.length, p.n_loss(), p.total, n, offset, p.ids))
            offset += p.length
        n += 1
        if len(rows) >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _packed(source: DataFrame, keep: list[str], examples, limits: Limits, cut: bool) -> DataFrame:
    """Run ``examples``, a function from batches to pieces, and the packer over each partition."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = extended(source.select(*keep).schema, FIELDS)
    arrow = to_arrow_schema(schema)
    return source.mapInArrow(lambda batches: _rows(examples(batches), limits, cut, arrow), schema)


def packed(rows: DataFrame, keep: list[str], ids: str = "ids", loss: str | None = None, limits: Limits = Limits(), cut: bool = True) -> DataFrame:
    """Pieces of the examples in ``rows`` and their places in sequences.

    ``ids`` names a column of integer lists, ``loss`` one of boolean lists of the same lengths (none, or a null: every id
    bears loss). Returned are the columns ``keep``, start, length, n_loss and example_tokens of each piece, sequence_id,
    offset, and the piece's ids as little-endian 32-bit integers.
    """
    source = rows.select(*dict.fromkeys([*keep, ids, *([loss] if loss else [])]))

    def examples(batches):
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in keep), strict=True) if keep else iter([()] * batch.num_rows)
            marks = batch.column(loss).to_pylist() if loss else [None] * batch.num_rows
            for key, x, m in zip(keys, batch.column(ids).to_pylist(), marks, strict=True):
                x = np.asarray([] if x is None else x, "<u4")
                if m is not None and len(m) != len(x):
                    raise ValueError("as many loss marks as ids are needed")
                yield Piece(key, 0, x.tobytes(), None if m is None else np.asarray(m, bool), len(x))

    return _packed(source, keep, examples, limits, cut)


def packed_texts(docs: DataFrame, keep: list[str], text: str = "text", limits: Limits = Limits(), path: str | None = None) -> DataFrame:
    """As ``packed``, of texts encoded here (special strings have their ids), each with the end id behind it."""
    source = docs.select(*dict.fromkeys([*keep, text]))

    def examples(batches):
        encode, end = ByteLevel(path, SPECIAL), np.array([END], "<u4").tobytes()
        for batch in chunks(batches, text):
            keys = zip(*(batch.column(c).to_pylist() for c in keep), strict=True) if keep else iter([()] * batch.num_rows)
            for key, t in zip(keys, batch.column(text).to_pylist(), strict=True):
                ids = encode(t or "") + end
                yield Piece(key, 0, ids, None, len(ids) // 4)

    return _packed(source, keep, examples, limits, True)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens and 64 pieces; every token bears loss."""
    pieces = packed_texts(read_table(spark, sf_dir, "documents"), ["doc_id"])
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), F.col("example_tokens").alias("doc_tokens"), "sequence_id", "offset")


QUERIES = {"op13_packing": op13_packing}
ORACLES: dict[str, str] = {}
