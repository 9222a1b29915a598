"""Phrase collocations by vertical positional inverted lists.

The texts of a partition are dealt to blocks of about ``BLOCK`` words. A block holds, for every word, the list of its
positions; a position is left empty where a piece of a text ends, so that neighbours in position are neighbours in a
piece. A list's length is the exact count of its word in the block, and the sum over blocks its frequency. Lists of
frequent phrases are extended by a word at a time: the positions of a phrase meet the postings of the word that follows,
as far as these are the ends of frequent phrases of the same length (a phrase is at most as frequent as its parts). What
travels between blocks are lengths, not positions: a block sends the sorted hashes of its lists with their lengths, cut in
ranges, and a range meets in one group, of which there are in proportion to the blocks. Frequent lists are stored as
Parquet rows, a row a block, after every round; the table before them is deleted then.

Hashes have 44 bits. A collision can only let a rare phrase pass as frequent for a while: final counts are grouped by the
words themselves and held against the least frequency again.

Defined results: a null text is empty, a null language is ``und``; texts without words add nothing; repeated rows count
each; ties are ordered by count and phrase, so the result is the same however rows are dealt; very long texts are cut at
ends of pieces and may fill several blocks; an empty table gives no rows; other columns are not read. Languages are
strings like any other, the empty one included.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import deleted, read_table, texts_of
from .common import table as _table

table = partial(_table, tidy=True)
#: Words of a block; a piece is never cut.
BLOCK = 3 << 20
#: Bytes of a text that are cut in words at once, about.
SLICE = 1 << 20
#: Bits of the hashes that blocks compare, and the most ranges that these are cut in (powers of two).
BITS, RANGES = 44, 1 << 20
#: Languages up to which their word totals are broadcast.
LANGS = 10_000
#: Parts in which a language's phrases are ranked before they are ranked together.
SALT = 64
# The fixed lower-casing and the fixed separators of pieces and words.
END, LOWER = b"\xff", bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\xff" * 10 + b" ")
#: A block's lists in one row: the languages with their words, and of each list its language, phrase, hash and length, then
#: all positions; each as compressed bytes.
LISTS = "block long, langs array<string>, totals array<long>, m int, lang binary, phrase binary, key binary, n binary, positions binary"
TYPES = pa.schema([("block", pa.int64()), ("langs", pa.list_(pa.string())), ("totals", pa.list_(pa.int64())), ("m", pa.int32()), *((c, pa.binary()) for c in ("lang", "phrase", "key", "n", "positions"))])


class _Ids(dict):
    """word -> its number in the block; a new word gets the next one."""

    def __init__(self, lang: int, words: list, langs: list):
        super().__init__({END: -1})
        self.lang, self.words, self.langs = lang, words, langs

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self.words)
        self.words.append(word)
        self.langs.append(self.lang)
        return found


class _Block:
    def __init__(self):
        self.words, self.lang_of, self.parts, self.n, self.langs = [], [], [], 0, {}

    def add(self, lang: str, text: bytes) -> None:
        """A text that begins and ends between pieces."""
        if lang not in self.langs:
            self.langs[lang] = _Ids(len(self.langs), self.words, self.lang_of)
        words = text.replace(END, b" \xff ").split()
        words.append(END)
        self.parts.append(np.fromiter(map(self.langs[lang].__getitem__, words), np.int32, len(words)))
        self.n += len(words)

    def row(self, block: int) -> pa.RecordBatch:
        ids = np.concatenate(self.parts)
        codes = ids.astype(np.int64) << 32 | np.arange(len(ids))
        codes = np.sort(codes[ids >= 0])
        n = np.bincount(codes >> 32, minlength=len(self.words))
        totals = np.bincount(self.lang_of, n, len(self.langs)).astype(np.int64)
        langs, words = list(self.langs), [w.decode() for w in self.words]
        lang = np.array(self.lang_of, np.int64)
        return stored(block, langs, totals, lang, words, None, n, codes & 0xFFFFFFFF)


def shrunk(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes: those of small numbers are mostly zeros."""
    return pa.compress(np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def grown(packed: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(packed, 8 * n, "zstd"), np.uint8).reshape(8, n).T).view("<i8").ravel()


def pack(positions: np.ndarray, n: np.ndarray) -> bytes:
    """Lists of rising positions, one after the other, as compressed differences; ``n`` are their lengths."""
    steps = np.diff(positions, prepend=0)
    starts = (np.cumsum(n) - n)[n > 0]
    steps[starts] = positions[starts]
    return shrunk(steps)


def unpack(packed: bytes, n: np.ndarray) -> np.ndarray:
    steps = grown(packed, int(n.sum()))
    ends = np.cumsum(steps)
    full = n > 0
    starts = (np.cumsum(n) - n)[full]
    return ends - np.repeat(ends[starts] - steps[starts], n[full])


def joined(words: list[str]) -> bytes:
    """Strings without line ends as compressed bytes behind their length before."""
    raw = "\n".join(words).encode()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def parted(packed: bytes, m: int) -> list[str]:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True).decode().split("\n") if m else []


def stored(block: int, langs: list[str], totals: np.ndarray | None, lang: np.ndarray, words: list[str], key: np.ndarray | None, n: np.ndarray, positions: np.ndarray) -> pa.RecordBatch:
    row = (block, langs, totals, len(words), shrunk(lang), joined(words), None if key is None else shrunk(key), shrunk(n), pack(positions, n))
    return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, TYPES.types, strict=True)], schema=TYPES)


class Lists:
    """One stored row."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self._of = lambda c: batch.column(c)[row].as_py()
        self.block, self.m = self._of("block"), self._of("m")

    def numbers(self, column: str) -> np.ndarray:
        return grown(self._of(column), self.m)

    def langs(self) -> list[str]:
        return self._of("langs")

    def phrases(self) -> list[str]:
        return parted(self._of("phrase"), self.m)

    def keys(self) -> np.ndarray:
        """The hash of each list's phrase; those of words are not stored."""
        return word_keys(self.langs(), self.numbers("lang"), self.phrases()) if self._of("key") is None else self.numbers("key")

    def positions(self) -> np.ndarray:
        return unpack(self._of("positions"), self.numbers("n"))

    def chosen(self) -> np.ndarray:
        return np.array(self._of("chosen"), np.int64)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[Lists]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield Lists(batch, row)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two, in this order."""
    with np.errstate(over="ignore"):
        x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b.view(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))).view(np.int64)


def longer(n: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lists of phrases a word longer: (first part, second part, length) of each, and their positions.

    The parts are numbers of lists: a phrase without its last and without its first word.
    """
    at = np.full(int(positions.max(initial=0)) + 2, -1, np.int64)
    at[positions] = np.repeat(np.arange(len(n)), n)
    first = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
    code = at[first] * len(n) + at[first + 1]
    if len(n) ** 2 * len(at) < 1 << 62:
        both = np.sort(code * len(at) + first)
        code, first = both // len(at), both % len(at)
    else:
        order = np.argsort(code, kind="stable")
        code, first = code[order], first[order]
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    found = code[starts]
    return found // max(len(n), 1), found % max(len(n), 1), np.diff(starts, append=len(code)), first


def word_lists(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """The lists of all words, a row a block."""
    source = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    most, wide = BLOCK, SLICE

    def run(batches: Iterator[pa.RecordBatch]):
        number, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            for name, t in zip(batch.column("lang").to_pylist(), texts_of(batch), strict=True):
                t = t.translate(LOWER)
                start = 0
                while start < len(t):
                    end = len(t) if len(t) - start <= wide else t.find(END, start + wide)
                    end = len(t) if end < 0 else end
                    block.add(name, t[start:end])
                    start = end + 1
                    if block.n >= most:
                        yield block.row(number)
                        number, block = number + 1, _Block()
        if block.words:
            yield block.row(number)

    return source.mapInArrow(run, LISTS)


def word_keys(langs: list[str], lang: np.ndarray, words: list[str]) -> np.ndarray:
    """Hashes of words with their language."""
    heads = [f"{x}\0".encode() for x in langs]
    return np.fromiter((xxhash.xxh64_intdigest(heads[k] + w.encode()) for k, w in zip(lang.tolist(), words, strict=True)), np.uint64, len(words)).view(np.int64)


def _short(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(64 - bits)).view(np.int64)


def _slices(place: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, stop) of each run of equal numbers."""
    if not len(place):
        return
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    yield from zip(place[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(place)], strict=True)


def _sent(rows: list[tuple], types: tuple[str, ...], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def counts(lists: DataFrame, grow: bool, ranges: int) -> DataFrame:
    """(range, block, m, keys, sizes): the hashes and lengths of each block's lists, or with ``grow`` of those a word longer."""
    bits = BITS
    shift = bits - (ranges.bit_length() - 1)

    def run(batches):
        for block in _each(batches):
            keys, n = block.keys(), block.numbers("n")
            if grow:
                left, right, n, _ = longer(n, block.positions())
                keys = mix(keys[left], keys[right])
            keys = _short(keys, bits)
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            rows = [(k, block.block, b - a, shrunk(np.diff(keys[a:b], prepend=0)), shrunk(n[a:b])) for k, a, b in _slices(keys >> shift)]
            if rows:
                yield _sent(rows, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), ["range", "block", "m", "keys", "sizes"])

    return lists.select("block", "m", "key", "n", *(["positions"] if grow else ["langs", "lang", "phrase"])).mapInArrow(run, "range long, block long, m int, keys binary, sizes binary")


def frequent(rows: DataFrame, least: int) -> DataFrame:
    """Of each block, the hashes of its lists that are frequent over all blocks: (block, chosen)."""

    def run(group: pa.Table) -> pa.Table:
        m = group.column("m").to_numpy()
        read = lambda c: [grown(x, k) for x, k in zip(group.column(c).to_pylist(), m.tolist(), strict=True)]
        keys, sizes = np.concatenate([np.cumsum(k) for k in read("keys")]), np.concatenate(read("sizes"))
        distinct, place = np.unique(keys, return_inverse=True)
        stay = (np.bincount(place, sizes, len(distinct)) >= least)[place]
        cuts = np.concatenate([[0], np.cumsum(stay)])[np.concatenate([[0], np.cumsum(m)])]
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(keys[stay], pa.int64()))
        return pa.table({"block": group.column("block").combine_chunks(), "chosen": lists}).filter(pa.array(np.diff(cuts) > 0))

    found = rows.groupBy("range").applyInArrow(run, "block long, chosen array<long>")
    return found.groupBy("block").agg(F.flatten(F.collect_list("chosen")).alias("chosen"))


def kept(lists: DataFrame, chosen: DataFrame, grow: bool) -> DataFrame:
    """Of each block the lists that are chosen: those of ``lists``, or with ``grow`` of the phrases a word longer."""
    bits = BITS

    def run(batches):
        for block in _each(batches):
            lang, words, keys, n, positions = block.numbers("lang"), block.phrases(), block.keys(), block.numbers("n"), block.positions()
            if grow:
                left, right, n, positions = longer(n, positions)
                keys = mix(keys[left], keys[right])
            stay = np.isin(_short(keys, bits), block.chosen())
            places = np.flatnonzero(stay)
            if grow:
                ends = [w[w.rfind(" ") + 1 :] for w in words]
                words = [f"{words[a]} {ends[b]}" for a, b in zip(left[places].tolist(), right[places].tolist(), strict=True)]
                lang = lang[left[places]]
            else:
                words, lang = [words[k] for k in places.tolist()], lang[places]
            yield stored(block.block, block.langs(), None, lang, words, keys[places], n[places], positions[np.repeat(stay, n)])

    return lists.drop("totals").join(chosen, "block").mapInArrow(run, LISTS)


def counted(lists: DataFrame, least: int, ranges: int) -> DataFrame:
    """(lang, phrase, f) of the lists' phrases, by their words, as far as they occur ``least`` times."""
    shift = np.uint64(64 - (ranges.bit_length() - 1))

    def send(batches):
        for block in _each(batches):
            keys, lang, n, words, langs = block.numbers("key"), block.numbers("lang"), block.numbers("n"), block.phrases(), block.langs()
            place = (keys.view(np.uint64) >> shift).astype(np.int64)
            order = np.argsort(place, kind="stable")
            lang, n = lang[order], n[order]
            words = [words[k] for k in order.tolist()]
            rows = [(k, b - a, langs, shrunk(lang[a:b]), joined(words[a:b]), shrunk(n[a:b])) for k, a, b in _slices(place[order])]
            if rows:
                yield _sent(rows, (pa.int64(), pa.int32(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()), ["range", "m", "langs", "lang", "phrase", "n"])

    def run(group: pa.Table) -> pa.Table:
        totals: Counter = Counter()
        for row in group.to_pylist():
            m, langs = row["m"], row["langs"]
            for k, phrase, n in zip(grown(row["lang"], m).tolist(), parted(row["phrase"], m), grown(row["n"], m).tolist(), strict=True):
                totals[langs[k], phrase] += n
        found = [(lang, phrase, n) for (lang, phrase), n in totals.items() if n >= least]
        return pa.table([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "phrase", "f"])

    rows = lists.select("block", "langs", "m", "lang", "phrase", "key", "n").mapInArrow(send, "range long, m int, langs array<string>, lang binary, phrase binary, n binary")
    return rows.groupBy("range").applyInArrow(run, "lang string, phrase string, f long")


def frequencies(docs: DataFrame, least: int, longest: int, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``longest`` words that occur ``least`` times (lang, phrase, f), and each language's words (lang, n)."""
    lists = table(word_lists(docs, lang, text))
    blocks = lists.count()
    ranges = 64
    while ranges < min(2 * blocks, RANGES):
        ranges *= 2
    totals = table(lists.select(F.explode(F.arrays_zip("langs", "totals")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.totals").alias("n")).filter("n > 0"))
    found = []
    for k in range(longest):
        longer_lists = table(kept(lists, frequent(counts(lists, k > 0, ranges), least), k > 0))
        deleted(lists)
        lists = longer_lists
        found.append(table(counted(lists, least, ranges)))
    deleted(lists)
    return reduce(DataFrame.unionByName, found), totals


def score(a, n, left, right):
    """floor(1000 * a * n / (left * right)), exact: counts up to fifteen digits, n up to eighteen."""
    exact = lambda c, digits: c.cast(f"decimal({digits},0)")
    return F.call_function("div", exact(a, 15) * exact(n, 18) * F.lit(1000).cast("decimal(4,0)"), exact(left, 15) * exact(right, 15))


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """Each language's ``top`` phrases by the score of their weakest cut, without those that a longer one covers wholly.

    Columns: lang, rank, phrase, a (its count), l and r (the counts of its parts), n (the language's words), score.
    """
    f, totals = frequencies(docs, least, longest, lang, text)
    words = F.split("phrase", " ")
    cuts = f.filter(F.size(words) > 1).select("lang", "phrase", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", F.size("w").alias("size"), part(1, F.col("k")).alias("left"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(f.select("lang", F.col("phrase").alias(side), F.col("f").alias(count)), ["lang", side])
    cuts = table(cuts)
    long_ = F.col("size") > 2
    covered = cuts.filter(long_ & (F.col("k") == F.col("size") - 1) & (F.col("l") == F.col("a"))).select("lang", F.col("left").alias("phrase"))
    covered = covered.unionByName(cuts.filter(long_ & (F.col("k") == 1) & (F.col("r") == F.col("a"))).select("lang", F.col("right").alias("phrase")))
    totals = F.broadcast(totals) if totals.count() <= LANGS else totals
    scored = cuts.join(totals, "lang").withColumn("score", score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("best"))
    best = best.join(covered.distinct(), ["lang", "phrase"], "left_anti").select("lang", "phrase", "best.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for by in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(SALT))], ["lang"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


def sql(least: int = 100, longest: int = 5, top: int = 2000) -> str:
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
lines AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lines GROUP BY lang),
f AS (
  SELECT lang, k, phrase, count(*) AS f
  FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i : array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM lines, range(1, {longest + 1}) AS r(k))
  GROUP BY ALL HAVING count(*) >= {least}),
cuts AS (
  SELECT c.lang, c.phrase, c.k AS size, c.f AS a, j, array_to_string(string_split(c.phrase, ' ')[1 : j], ' ') AS lp, array_to_string(string_split(c.phrase, ' ')[j + 1 : c.k], ' ') AS rp
  FROM f AS c, range(1, {longest}) AS r(j) WHERE j < c.k),
parts AS (SELECT cuts.*, x.f AS l, y.f AS r FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.phrase = lp JOIN f AS y ON y.lang = cuts.lang AND y.phrase = rp),
covered AS (SELECT lang, lp AS phrase FROM parts WHERE size > 2 AND j = size - 1 AND l = a UNION SELECT lang, rp FROM parts WHERE size > 2 AND j = 1 AND r = a),
scored AS (
  SELECT p.lang, phrase, a, l, r, n, CAST((1000::HUGEINT * a * n) // (l::HUGEINT * r) AS BIGINT) AS score, j FROM parts AS p JOIN totals USING (lang)),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
  FROM best ANTI JOIN covered USING (lang, phrase))
SELECT * FROM ranked WHERE rank <= {top}
"""


QUERIES = {"op12_phrases": op12_phrases}
ORACLES = {"op12_phrases": sql()}
