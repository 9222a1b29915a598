"""Byte-level BPE encoding and decoding with a vectorised pre-tokeniser.

A chunk of texts becomes one array of code points, and a table gives each its class (letter, number, space, other white
space, mark, and apostrophes that open a contraction of two or three characters). Token starts come from a finite
automaton over the classes. Transition functions compose associatively, so the array is cut in rows that are scanned
side by side: first each row's function from every state, then a doubling scan over the rows' functions gives the
state in which each row begins, then one pass over all rows yields the starts. White-space runs are settled after that
by looking at the character that follows. No regular expression is used.

The slices between starts feed the pair merging: known slices come from a cache, unknown ones of a chunk are merged
together, one lowest-ranked pair a round in each, by array lookups. Offsets of the slices and of the ids in each text
are kept, so that decoding a text is a lookup of its ids' bytes.

Defined results: null and empty texts have no ids; rows are independent, so ties and repeated rows are each encoded;
an empty table gives an empty result; columns other than the named ones are not read.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, extended, read_table, texts_of

#: Pre-token slices whose ids a worker remembers; beyond it the cache starts anew.
CACHE_SLICES = 100_000
ROW = 512

# Classes of code points.
LETTER, NUMBER, SPACE, WHITE, MARK, SHORT, LONG, FIRST = range(8)
# States: the class of the open token, and how many letters of a contraction are still to come.
NONE, IN_LETTERS, IN_NUMBERS, IN_MARKS, AFTER_SPACE, ONE_LEFT, TWO_LEFT, CLOSED = range(8)
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def class_table() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], MARK) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[WHITE_SPACE] = WHITE
    table[0x20] = SPACE
    return table


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """The next state by (class, state), and whether a token starts there. FIRST is added for a text's first character."""
    step, starts = np.zeros((8, 8), np.uint8), np.zeros((8, 8), bool)
    opened = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, MARK: IN_MARKS}
    for state in range(8):
        for kind, to in opened.items():
            step[kind, state], starts[kind, state] = to, state not in (to, AFTER_SPACE)
        if state == TWO_LEFT:
            step[LETTER, state], starts[LETTER, state] = ONE_LEFT, False
        elif state == ONE_LEFT:
            step[LETTER, state], starts[LETTER, state] = CLOSED, False
        for kind, to in ((SHORT, ONE_LEFT), (LONG, TWO_LEFT)):
            joins = state in (IN_MARKS, AFTER_SPACE)
            step[kind, state], starts[kind, state] = (IN_MARKS, False) if joins else (to, True)
        step[SPACE, state], step[WHITE, state] = AFTER_SPACE, NONE  # their starts are settled by runs
    return step, starts


STEP, STARTS = _automaton()
S_TWO = np.array([ord(c) for c in "stmd"], np.uint32)
S_THREE = np.array([[ord(a), ord(b)] for a, b in ("re", "ve", "ll")], np.uint32)


def token_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Positions where tokens start. points: code points of all texts; firsts: where non-empty texts begin."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kinds = class_table()[points]
    first = np.zeros(n + 1, bool)
    first[firsts] = first[n] = True
    ticks = np.flatnonzero(points == 0x27)
    if len(ticks):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        a, b = padded[ticks + 1], padded[ticks + 2]
        inside = ~first[ticks + 1]
        two = inside & np.isin(a, S_TWO)
        three = inside & ~first[np.minimum(ticks + 2, n)] & ((a[:, None] == S_THREE[:, 0]) & (b[:, None] == S_THREE[:, 1])).any(1)
        kinds[ticks[two]] = SHORT
        kinds[ticks[three]] = LONG
    # A text's first character meets the state NONE, whatever came before: eight more classes whose functions are constant.
    step = np.concatenate([STEP, np.repeat(STEP[:, :1], 8, axis=1)])
    symbols = kinds.copy()
    symbols[firsts] += 8
    rows = -(-n // ROW)
    grid = np.zeros(rows * ROW, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, ROW).T)
    flat = step.ravel()
    function = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for column in grid:
        function = flat[(column.astype(np.uint16) << 3)[:, None] + function]
    reach = 1  # doubling: afterwards row r holds the composition of rows 0 to r
    while reach < rows:
        function[reach:] = np.take_along_axis(function[reach:], function[:-reach].copy(), 1)
        reach *= 2
    state = np.concatenate([[NONE], function[:-1, NONE]]).astype(np.uint16)
    before = np.empty((ROW, rows), np.uint8)
    for k, column in enumerate(grid):
        before[k] = state
        state = flat[(column.astype(np.uint16) << 3) + state].astype(np.uint16)
    before = before.T.ravel()[:n]
    before[firsts] = NONE
    is_start = STARTS.ravel()[(kinds.astype(np.uint16) << 3) + before]
    blank = (kinds == SPACE) | (kinds == WHITE)
    # In a run of white space the first starts a token; so does the last, if a character of the same text follows.
    follows = np.append(~blank[1:], False) & ~first[1:]
    opens = np.concatenate([[True], ~blank[:-1]]) | first[:-1]
    is_start |= blank & (opens | follows)
    is_start[firsts] = True
    return np.flatnonzero(is_start)


class Vocabulary:
    """Ranks read from a rank file: bytes of each id, and the pairs of ids that merge."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        ranks = self.ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        bits = max(10, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NO_RANK, np.int64)
        keys, values = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        slots = self._slot(keys)
        while len(keys):  # open addressing: one of those that want a free slot gets it, the others go on
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]
            here = self.keys[slots] == keys
            self.values[slots[here]] = values[here]
            keys, values, slots = keys[~here], values[~here], (slots[~here] + 1) & self.mask
        self.cache: dict[bytes, bytes] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], NO_RANK)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self.mask
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def merge_all(self, slices: list[bytes]) -> list[bytes]:
        """The ids of each slice, as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(slices)
        rest = []
        for k, s in enumerate(slices):
            rank = self.ranks.get(s)
            if rank is None:
                rest.append(k)
            else:
                out[k] = rank.to_bytes(4, "little")
        rest.sort(key=lambda k: len(slices[k]))
        at = 0
        while at < len(rest):  # groups of like length fill matrices of bounded size
            wide = min(len(rest) - at, max(1, 400_000 // max(1, len(slices[rest[at]]))))
            group = rest[at : at + wide]
            while len(group) > 1 and len(slices[group[-1]]) > 1.5 * len(slices[group[0]]) + 4:
                group = group[: len(group) // 2]
            at += len(group)
            if len(slices[group[-1]]) > LONG_SLICE:
                for k in group:
                    out[k] = self._merge_long(slices[k])
            else:
                for k, ids in zip(group, self._merge_group([slices[k] for k in group]), strict=True):
                    out[k] = ids
        return out

    def _merge_group(self, slices: list[bytes]) -> list[bytes]:
        n, lengths = len(slices), np.fromiter(map(len, slices), np.int64, len(slices))
        width = int(lengths.max())
        inside = np.arange(width) < lengths[:, None]
        ids = np.full((n, width + 1), -1, np.int64)
        ids[:, :width][inside] = self.byte_ids[np.frombuffer(b"".join(slices), np.uint8)]
        ranks = np.full((n, width), NO_RANK, np.int64)
        both = np.arange(1, width) < lengths[:, None]
        ranks[:, : width - 1][both] = self.pair_ranks(ids[:, : width - 1][both], ids[:, 1:width][both])
        rows, length = np.arange(n), lengths.copy()
        columns = np.arange(width)
        live = rows
        while len(live):
            sub = ranks[live]
            at = sub.argmin(1)
            best = sub[np.arange(len(live)), at]
            more = best < NO_RANK
            live, at, best = live[more], at[more], best[more]
            if not len(live):
                break
            # Close the gap behind the merged pair, then look up the two pairs that changed.
            take = np.minimum(columns + (columns > at[:, None]), width)
            row_ids = np.take_along_axis(ids[live], take, 1)
            row_ids[np.arange(len(live)), at] = best
            ids[live, :width] = row_ids
            padded = np.concatenate([ranks[live], np.full((len(live), 1), NO_RANK)], 1)
            row_ranks = np.take_along_axis(padded, take, 1)
            length[live] -= 1
            for shift in (-1, 0):
                k = at + shift
                ok = k >= 0
                row_ranks[np.flatnonzero(ok), k[ok]] = NO_RANK
                ok &= k + 1 < length[live]
                row_ranks[np.flatnonzero(ok), k[ok]] = self.pair_ranks(ids[live[ok], k[ok]], ids[live[ok], k[ok] + 1])
            ranks[live] = row_ranks
        packed = ids.astype("<u4")
        return [packed[k, : length[k]].tobytes() for k in range(n)]

    def _merge_long(self, piece: bytes) -> bytes:
        """One very long slice, by a heap over a linked list: n log n."""
        import heapq

        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        bytes_of, ranks = self.bytes_of, self.ranks
        rank = lambda i: ranks.get(bytes_of[ids[i]] + bytes_of[ids[after[i]]]) if after[i] < n else None
        first = self.pair_ranks(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first.tolist()) if r < NO_RANK]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if i < n else n
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                ahead[after[i]] = i
            for k in (ahead[i], i):
                if k >= 0 and (new := rank(k)) is not None:
                    heapq.heappush(heap, (new, k, ids[k], ids[after[k]]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
        """Of each text: its ids as little-endian 32-bit integers, and the byte offset at which each pre-token starts."""
        data = b"".join(texts)
        if not data:
            return [(b"", np.zeros(0, np.int64)) for _ in texts]
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), "<u4")
        raw = np.frombuffer(data, np.uint8)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)  # byte offset of each code point
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        begins = np.concatenate([[0], ends[:-1]])[: len(texts)]
        firsts = np.searchsorted(lead, begins[ends > begins])
        starts = lead[token_starts(points, firsts)]
        stops = np.append(starts[1:], len(data))
        slices = [data[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        cache = self.cache
        new = [s for s in set(slices) if s not in cache]
        if len(cache) + len(new) > CACHE_SLICES:
            cache.clear()
            new = list(set(slices))
        cache.update(zip(new, self.merge_all(new), strict=True))
        ids = [cache[s] for s in slices]
        cuts = np.searchsorted(starts, np.append(begins, len(data)))
        return [(b"".join(ids[a:b]), starts[a:b] - base) for a, b, base in zip(cuts[:-1].tolist(), cuts[1:].tolist(), begins.tolist(), strict=True)]

    def decode(self, ids: bytes) -> bytes:
        bytes_of = self.bytes_of
        return b"".join([bytes_of[k] for k in np.frombuffer(ids, "<u4").tolist()])


NO_RANK = 1 << 40
#: Slices longer than this are merged one at a time.
LONG_SLICE = 256
_OPEN: dict[str, Vocabulary] = {}


def vocabulary(path: str | None = None) -> Vocabulary:
    """The vocabulary of a rank file, opened once in each process."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _OPEN:
        _OPEN[path] = Vocabulary(path)
    return _OPEN[path]


def encoded(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """The columns ``keep``, the ids of each text and the byte offsets of its pre-tokens."""
    source = docs.select(*dict.fromkeys([*keep, text]))

    def run(batches):
        vocab = vocabulary(path)
        for batch in chunks(batches, text):
            found = vocab.encode(texts_of(batch, text))
            ids = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x, _ in found], pa.list_(pa.int32()))
            offsets = pa.array([o for _, o in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), ids, offsets], names=[*keep, "ids", "offsets"])

    return source.mapInArrow(run, extended(source.select(*keep).schema, "ids array<int>, offsets array<long>"))


def decoded(rows: DataFrame, keep: list[str], ids: str = "ids", path: str | None = None) -> DataFrame:
    """The columns ``keep`` and the bytes that each list of ids stands for."""
    source = rows.select(*dict.fromkeys([*keep, ids]))

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            texts = pa.array([vocab.decode(np.asarray(x or [], "<u4").tobytes()) for x in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), texts], names=[*keep, "bytes"])

    return source.mapInArrow(run, source.select(*keep).schema.add("bytes", "binary"))


def round_trip(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """The columns ``keep``, n_tokens, and digests of the ids and of the bytes decoded from them."""
    source = docs.select(*dict.fromkeys([*keep, text]))
    schema = source.select(*keep).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches):
        vocab = vocabulary(path)
        try:
            for batch in chunks(batches, text):
                ids = [x for x, _ in vocab.encode(texts_of(batch, text))]
                hexed = lambda parts: pa.array([hashlib.sha256(x).hexdigest() for x in parts])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([len(x) // 4 for x in ids]), hexed(ids), hexed(map(vocab.decode, ids))], names=schema.names)
        finally:  # the worker goes on to other tasks, maybe of other queries
            vocab.cache.clear()
            pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, schema)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"), ["doc_id"])


def encode_kept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: doc_id, the number of ids and the digests of the encoded and decoded text of each row."""
    return round_trip(docs, ["doc_id"])


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
ORACLES: dict[str, str] = {}
