"""Exact removal of repeated 100-byte strings, by column-wise construction of suffix collections.

A byte goes if a 100-byte string that covers it also starts earlier (in a smaller document, or before in the same one).

Routing. Of the 69 grams of 32 bytes in each 100-byte window the one with the smallest hash (the first of equals) is the
window's anchor: equal windows have equal anchors at equal places. Consecutive windows with one anchor make a piece
(168 bytes at most). All pieces meet by their grams in one shuffle, as hashes and places without text. A window over a
gram's pieces, sorted, tells which are alone (nothing can repeat there), which are copies of an earlier equal piece
(every window of a copy has an earlier start, however many copies there are), and how many distinct ones there are.

Hot grams, those frequent in a sample of documents and at most ``HOT``, are spread over salts by their pieces, and a task
passes on only those of their pieces that are earlier than all equal ones it has seen: the others are copies. The sample
decides nothing but this layout.

Construction. Distinct pieces that share a gram are compared by suffix sorting. A task takes whole groups in
collections of bounded size and builds each collection's Burrows-Wheeler transform and longest common prefixes column by
column: round j inserts the suffix of length j of every piece. Its place follows from the rank of its symbol in the
transform so far, and its common prefix with its neighbours from the minimum between equal symbols. Every round reads
and writes the transform, prefixes and origins once, in order; since a collection is bounded they are arrays in
memory, where one unbounded collection would need files. Windows whose suffixes have common prefixes of 100 bytes are
equal, and all but the earliest of such a run are repeated.

A gram with more than ``GROUP`` distinct pieces (a passage in very many contexts) would gather in one task: its pieces
are cut into blocks of windows, which meet by the gram and a hash of all their bytes; the windows of the blocks that are
the earliest of their kind then meet in the same way. This leaves out no window and splits evenly.

Defined results: null and empty texts have no bytes. Rows with equal ids are ordered by a hash of their texts; rows equal
in both are one document and get equal results. Null ids come last. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bloom
from .common import chunks, cut, extended, read_table, table, texts_of
from .ctph import INVERSE, PRIME, _power

LENGTH, GRAM = 100, 32
#: Grams that count as hot at most, how often they must occur in the sample of one document in SAMPLE, and salts of each.
HOT, LEAST_HOT, SAMPLE, SALTS = 10_000, 32, 64, 256
WINDOW = LENGTH - GRAM + 1
#: Distinct pieces of a gram that are sorted together; pieces of a collection; windows of a block.
GROUP, COLLECTION, BLOCK = 48, 1500, 8
CHUNK = 1 << 20
ODD = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD
    x = (x ^ (x >> np.uint64(29))) * ODD
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any span of a byte array."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(PRIME, n)[:n], out=self.sums[1:])
        self.back = _power(INVERSE, n)

    def of(self, start, stop) -> np.ndarray:
        return _mixed((self.sums[stop] - self.sums[start]) * self.back[start])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest key of each window, by running minima from block edges on both sides."""
    n = len(keys)
    blocks = -(-n // width)
    grid = np.full(blocks * width, np.iinfo(np.int64).max, np.int64)
    grid[:n] = keys
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def pieces_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """For each piece: the text's number, where its first window starts, how many windows, where its anchor lies in it, hashes of gram and piece."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    if len(raw) < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    hashes = Hashes(raw)
    grams = _mixed((hashes.sums[GRAM:] - hashes.sums[:-GRAM]) * hashes.back[: len(raw) - GRAM + 1])
    keys = (grams >> np.uint64(1)).view(np.int64)
    keys &= ~0xFFFFFFFF
    keys |= np.arange(len(keys))
    anchor = _least(keys, WINDOW) & 0xFFFFFFFF
    end_of = np.repeat(ends, sizes)[: len(anchor)]
    starts = np.flatnonzero(np.arange(len(anchor)) + LENGTH <= end_of)
    if not len(starts):
        return pieces_of([])
    anchor = anchor[starts]
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    first = starts[new]
    many = np.diff(np.append(new, len(starts)))
    at = anchor[new]
    whole = _mixed(hashes.of(first, first + many + LENGTH - 1) + (at - first).astype(np.uint64) * ODD + many.astype(np.uint64))
    doc = np.searchsorted(ends, first, side="right")
    return doc, first - (ends - sizes)[doc], many, at - first, grams[at].view(np.int64), whole.view(np.int64)


def repeated_windows(pieces: list[bytes], document: np.ndarray, start: np.ndarray, lead: np.ndarray | None = None) -> np.ndarray:
    """Rows (piece, window) of all windows that also start earlier. document: an order of documents; start: in it.

    With ``lead``, the place of each piece's anchor, equal windows lie at equal distances from their anchors. A piece then
    enters in the round in which its end is reached, and goes once its common prefix cannot reach the length any more.
    """
    m, sizes = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
    text = np.frombuffer(b"".join(pieces), np.uint8)
    stop = np.cumsum(sizes)
    after_anchor = np.zeros(m, np.int64) if lead is None else sizes - lead
    delay = after_anchor.max() - after_anchor
    # Symbols are raised by one: 0 says that a suffix has no symbol before it, or none yet. UTF-8 has no byte 255.
    symbol = lambda who, n: np.where(n <= sizes[who], text[np.maximum(stop[who] - n, 0)] + np.uint8(1), np.uint8(0))
    stays, left = np.ones(m, bool), m
    bwt, lcp, tag, at = np.zeros(m, np.uint8), np.zeros(m, np.uint8), (np.arange(m, dtype=np.int32) << 8), np.arange(m)
    for j in range(1, int((sizes + delay).max()) + 1):
        length = j - delay
        begins = np.flatnonzero(stays & (length == 1))
        bwt[at[begins]] = symbol(begins, np.ones(len(begins), np.int64))
        live = np.flatnonzero(stays & (length > 0) & (length <= sizes))
        if not len(live):
            continue
        order = np.argsort(bwt, kind="stable")
        n = len(bwt)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        done = int(np.count_nonzero(bwt == 0))
        live = live[np.argsort(at[live])]  # ranges below are then read in order
        p = at[live]
        r = rank[p]
        place = left + r - done
        before, after = order[np.maximum(r - 1, 0)], order[np.minimum(r + 1, n - 1)]
        joined, leads = (r > 0) & (bwt[before] == bwt[p]), (r + 1 < n) & (bwt[after] == bwt[p])
        wide = np.append(lcp, np.uint8(255))
        own = np.zeros(len(p), np.uint8)
        if joined.any():
            own[joined] = np.minimum(np.minimum.reduceat(wide, np.stack([before[joined] + 1, p[joined] + 1], 1).ravel())[::2], LENGTH - 1) + 1
        size = n + len(p)
        old = np.ones(size, bool)
        old[place] = False
        fresh = [np.empty(size, a.dtype) for a in (bwt, lcp, tag)]
        for new, past, value in zip(fresh, (bwt, lcp, tag), (symbol(live, length[live] + 1), own, (live << 8 | length[live]).astype(np.int32)), strict=True):
            new[old] = past
            new[place] = value
        if leads.any():
            next_ = np.minimum(np.minimum.reduceat(wide, np.stack([p[leads] + 1, after[leads] + 1], 1).ravel())[::2], LENGTH - 1) + 1
            fresh[1][place[leads] + 1] = next_
        bwt, lcp, tag = fresh
        # Suffixes of pieces that are not live have moved only if they are ends, which stay in front.
        at[live] = place
        if lead is not None and j % 8 == 0:
            best = np.maximum(lcp[place], np.append(lcp, np.uint8(0))[place + 1]).astype(np.int64)
            now = length[live]
            stays[live[(now < LENGTH) & (best + sizes[live] - now < LENGTH)]] = False
            kept = np.flatnonzero(stays[tag >> 8])
            if not len(kept):
                return np.zeros((0, 2), np.int64)
            if len(kept) < len(tag):
                lcp = np.minimum.reduceat(lcp[: kept[-1] + 1], np.append(0, kept[:-1] + 1))
                at = np.searchsorted(kept, at)
                bwt, tag, left = bwt[kept], tag[kept], int(stays.sum())
    long = (tag & 255) >= LENGTH
    group = np.cumsum(lcp < LENGTH)[long]
    who, window = tag[long] >> 8, sizes[tag[long] >> 8] - (tag[long] & 255)
    key = (document[who].astype(np.int64) << 40) + start[who] + window
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    if not len(edges):
        return np.zeros((0, 2), np.int64)
    least = np.repeat(np.minimum.reduceat(key, edges), np.diff(np.append(edges, len(key))))
    again = key > least
    return np.stack([who[again], window[again]], 1)


def _runs(rows: np.ndarray) -> np.ndarray:
    """(piece, first, last) of runs of neighbouring windows."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    if not len(rows):
        return np.zeros((0, 3), np.int64)
    new = np.concatenate([[True], (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows)) - 1
    return np.stack([rows[first, 0], rows[first, 1], rows[last, 1]], 1)


def _hot(docs: DataFrame) -> np.ndarray:
    """The sorted hashes of grams that are frequent in a sample of documents."""

    def run(batches):
        for batch in chunks(batches, limit=CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(pieces_of(texts_of(batch))[4])], names=["gram"])

    some = docs.filter(F.pmod(F.xxhash64("doc_id", "th"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "gram long")
    most = some.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_HOT).orderBy(F.desc("n"), "gram").limit(HOT).collect()
    return np.sort(np.array([r["gram"] for r in most], np.int64))


def _pieces(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """gram, salt, piece, doc_id, th and at (start, many and lead in one number) for every piece of the documents.

    salt: 0; above 0 for a hot gram; below 0 for a piece that is known to be a copy already (its gram is then any number).
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        hot, least = shared.value, {}
        for batch in chunks(batches, limit=CHUNK):
            doc, start, many, lead, gram, piece = pieces_of(texts_of(batch))
            salt = np.zeros(len(gram), np.int64)
            if len(hot):
                where = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, gram), len(hot) - 1)] == gram)
                salt[where] = 1 + piece[where] % SALTS
                ids, th = batch.column("doc_id").to_pylist() if len(where) else [], batch.column("th").to_pylist()
                for k, d, s, g, p in zip(where.tolist(), doc[where].tolist(), start[where].tolist(), gram[where].tolist(), piece[where].tolist(), strict=True):
                    own, key = (ids[d] is None, 0 if ids[d] is None else ids[d], th[d], s), (g, p)
                    if key in least and least[key] <= own:
                        salt[k] = -1
                    else:
                        least[key] = own
                copies = np.flatnonzero(salt < 0)
                gram[copies] = _mixed(gram[copies].view(np.uint64) + doc[copies].astype(np.uint64) * ODD + start[copies].astype(np.uint64)).view(np.int64)
            doc = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(salt), pa.array(piece), batch.column("doc_id").take(doc), batch.column("th").take(doc), pa.array(start << 16 | many << 8 | lead)], names=["gram", "salt", "piece", "doc_id", "th", "at"])

    return docs.mapInArrow(run, f"gram long, salt long, piece long, doc_id {id_type}, th long, at long")


ORDER = ("no_id", "doc_id", "th", "start")


def _met(pieces: DataFrame) -> DataFrame:
    """The pieces that are copies of an earlier one, and of grams with several distinct pieces the first of each."""
    w = W.partitionBy("gram", "salt")
    before = F.lag("piece").over(w.orderBy("piece", F.col("doc_id").isNull(), "doc_id", "th", "at"))
    rows = pieces.withColumn("copy", (F.col("salt") < 0) | F.coalesce(before == F.col("piece"), F.lit(False)))
    kinds = F.when(F.col("salt") > 0, GROUP + 1).otherwise(F.sum(F.when(F.col("copy"), 0).otherwise(1)).over(w))
    rows = rows.withColumn("kinds", kinds.cast("long")).filter("copy OR kinds > 1")
    start, many, lead = F.shiftright("at", 16), F.shiftright("at", 8).bitwiseAND(F.lit(255)), F.col("at").bitwiseAND(F.lit(255))
    return rows.select("gram", "kinds", "copy", "doc_id", "th", start.alias("start"), many.alias("many"), lead.alias("lead"))


def _sieved(docs: DataFrame, keyed: DataFrame) -> DataFrame:
    """``docs`` with _hit: false where no row of ``keyed`` is the document's."""
    key = F.xxhash64("doc_id", "th")
    return bloom.sieved(docs.withColumn("_own", key), "_own", keyed.select(key.alias("_key")), "_key").drop("_own")


def _with_lists(docs: DataFrame, lists: DataFrame, name: str) -> DataFrame:
    """Join documents with a list per (doc_id, th); ids may be null."""
    right = lists.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), name)
    return docs.join(right, (docs["th"] == right["_th"]) & docs["doc_id"].eqNullSafe(right["_id"]), "left").drop("_id", "_th")


def removed_spans(docs: DataFrame, repeated_ids: bool = True) -> DataFrame:
    """doc_id, th, spans (array of start and end, unmerged) for documents with repeated strings. docs: doc_id, text, th."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = table(_met(_pieces(docs, _hot(docs))))
    spans = found.filter("copy").select("doc_id", "th", "start", (F.col("start") + F.col("many") + LENGTH - 1).alias("end"))
    shared = found.filter("NOT copy")
    wanted = table(shared.groupBy("doc_id", "th").agg(F.collect_list(F.struct("gram", "kinds", "start", "many", "lead")).alias("wanted")))

    def slices(batches):
        for batch in chunks(batches, limit=CHUNK):
            out: dict[str, list] = {k: [] for k in ("gram", "kinds", "row", "start", "lead", "data")}
            for row, (text, items) in enumerate(zip(texts_of(batch), batch.column("wanted").to_pylist(), strict=True)):
                for x in items:
                    for k, v in zip(out, (x["gram"], x["kinds"], row, x["start"], x["lead"], text[x["start"] : x["start"] + x["many"] + LENGTH - 1]), strict=True):
                        out[k].append(v)
            row = pa.array(out["row"], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out["gram"], pa.int64()), pa.array(out["kinds"], pa.int64()), batch.column("doc_id").take(row), batch.column("th").take(row), pa.array(out["start"], pa.int64()), pa.array(out["lead"], pa.int64()), pa.array(out["data"], pa.binary())], names=["gram", "kinds", "doc_id", "th", "start", "lead", "data"])

    # Rows equal in id and text are one document: its pieces are taken once.
    holders = _with_lists(_sieved(docs, wanted).filter("_hit").drop("_hit"), wanted, "wanted").filter("wanted IS NOT NULL").select("doc_id", "th", "text", "wanted")
    taken = holders.mapInArrow(slices, f"gram long, kinds long, doc_id {id_type}, th long, start long, lead long, data binary")
    if repeated_ids:
        taken = taken.dropDuplicates(["gram", "doc_id", "th", "start"])
    taken = table(taken)

    span_schema = f"doc_id {id_type}, th long, start long, end long"

    def sort(batches):
        """Whole groups of a gram, in collections."""
        held: list[dict] = []
        for batch in batches:
            held += batch.to_pylist()
            while len(held) > COLLECTION + GROUP:
                k = COLLECTION
                while k < len(held) and held[k]["gram"] == held[k - 1]["gram"]:
                    k += 1
                if k == len(held):
                    break
                yield told(held[:k], batch.schema.field("doc_id").type)
                held = held[k:]
        if held:
            yield told(held, batch.schema.field("doc_id").type)

    def told(rows, type_):
        key = lambda r: (r["doc_id"] is None, 0 if r["doc_id"] is None else r["doc_id"], r["th"])
        order = {x: k for k, x in enumerate(sorted({key(r) for r in rows}))}
        document = np.array([order[key(r)] for r in rows])
        start = np.array([r["start"] for r in rows])
        runs = _runs(repeated_windows([r["data"] for r in rows], document, start, np.array([r["lead"] for r in rows])))
        who = runs[:, 0].tolist()
        return pa.RecordBatch.from_arrays([pa.array([rows[k]["doc_id"] for k in who], type_), pa.array([rows[k]["th"] for k in who], pa.int64()), pa.array(start[runs[:, 0]] + runs[:, 1]), pa.array(start[runs[:, 0]] + runs[:, 2] + LENGTH)], names=["doc_id", "th", "start", "end"])

    few = taken.filter(F.col("kinds") <= GROUP).select("gram", "doc_id", "th", "start", "lead", "data")
    spans = spans.unionByName(few.repartition("gram").sortWithinPartitions("gram").mapInArrow(sort, span_schema))

    def blocks(batches):
        """Blocks of neighbouring windows at equal distances from the anchor, with a hash of each and of each window."""
        for batch in chunks(batches, "data", CHUNK // 8):
            data = batch.column("data").to_pylist()
            sizes = np.fromiter(map(len, data), np.int64, len(data))
            many, base = sizes - LENGTH + 1, np.cumsum(sizes) - sizes
            hashes = Hashes(np.frombuffer(b"".join(data), np.uint8))
            row = np.repeat(np.arange(len(data)), many)
            window = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            at = base[row] + window
            block = (batch.column("lead").to_numpy()[row] - window) // BLOCK
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (block[1:] != block[:-1])]))
            last = np.append(new[1:], len(row)) - 1
            whole = _mixed(hashes.of(at[new], at[last] + LENGTH) + (last - new).astype(np.uint64))
            each = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)).astype(np.int32)), pa.array(hashes.of(at, at + LENGTH).view(np.int64)))
            take = pa.array(row[new])
            start = batch.column("start").to_numpy()[row[new]] + window[new]
            yield pa.RecordBatch.from_arrays([batch.column("gram").take(take), pa.array(whole.view(np.int64)), batch.column("doc_id").take(take), batch.column("th").take(take), pa.array(start), each], names=["gram", "piece", "doc_id", "th", "start", "windows"])

    def later(rows, width):
        """Spans of the rows whose (gram, piece) also starts earlier."""
        least = rows.groupBy("gram", "piece").agg(F.min(F.struct(*ORDER)).alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("gram").alias("_gram"), F.col("piece").alias("_piece"), "first")
        again = rows.join(least, (F.col("gram") == F.col("_gram")) & (F.col("piece") == F.col("_piece"))).filter(F.struct(*ORDER) > F.col("first"))
        return again.select("doc_id", "th", "start", (F.col("start") + width + LENGTH - 1).alias("end"))

    many = taken.filter(F.col("kinds") > GROUP).select("gram", "doc_id", "th", "start", "lead", "data")
    many = table(many.mapInArrow(blocks, f"gram long, piece long, doc_id {id_type}, th long, start long, windows array<long>")).withColumn("no_id", F.col("doc_id").isNull())
    spans = spans.unionByName(later(many, F.size("windows")))
    # Of equal blocks only the earliest goes on to its windows.
    single = many.groupBy("gram", "piece").agg(F.min(F.struct(*ORDER, "windows")).alias("b")).select("gram", "b.*")
    single = single.select("gram", F.posexplode("windows").alias("k", "piece"), "no_id", "doc_id", "th", (F.col("start")).alias("begin"))
    single = table(single.select("gram", "piece", "no_id", "doc_id", "th", (F.col("begin") + F.col("k")).alias("start")))
    spans = spans.unionByName(later(single, F.lit(1)))
    return spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [tuple(s) for s in out]


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte spans of each row."""
    ids = docs.groupBy(F.col(doc_id).alias("_id")).count()
    repeated_ids = ids.filter("count > 1 OR _id IS NULL").limit(1).count() > 0
    # The hash of the text orders rows of equal ids; where ids are enough it is left at zero and costs nothing to move.
    th = F.xxhash64(F.coalesce(F.col(text), F.lit(""))) if repeated_ids else F.lit(0).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), th.alias("th"))
    spans = cut(removed_spans(rows, repeated_ids))
    sieved = _sieved(rows, spans)
    hits = _with_lists(sieved.filter("_hit").drop("_hit"), spans, "spans").select("doc_id", "text", "spans")
    misses = sieved.filter("NOT _hit").select("doc_id", "text", F.lit(None).cast("array<struct<start:long,end:long>>").alias("spans"))
    schema = extended(docs.select(doc_id).schema, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>")
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in chunks(batches):
            texts, gone = texts_of(batch), [merged(s) for s in batch.column("spans").to_pylist()]
            shas = []
            for b, spans in zip(texts, gone, strict=True):
                sha, at = hashlib.sha256(), 0
                for start, end in spans:
                    sha.update(b[at:start])
                    at = end
                sha.update(b[at:])
                shas.append(sha.hexdigest())
            counts = [pa.array(x, pa.int64()) for x in ([len(b) for b in texts], [sum(e - s for s, e in g) for g in gone], [len(g) for g in gone])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(shas), pa.array([[{"start": s, "end": e} for s, e in g] for g in gone], pair)], names=schema.names)

    return hits.unionByName(misses).mapInArrow(run, schema)


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read_table(spark, sf_dir, "documents")).drop("removed")


QUERIES = {"op8_suffixes": op8_suffixes}
ORACLES: dict[str, str] = {}
