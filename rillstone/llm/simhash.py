"""SimHash near-duplicates by multi-index hashing.

Fingerprints: 64 bits, the bitwise majority of the XXH64 hashes of a text's three-word shingles. Two fingerprints link
when they differ in two bits or fewer. The index cuts a fingerprint in two segments of 32 bits. Of a pair within two
bits either the first segments differ in one bit at most, or the second segments are equal; so each distinct
fingerprint probes the first table with the Hamming ball of radius one (33 values) and the second with its own value,
and every match is verified over all 64 bits.

A bucket with more than ``BUCKET`` distinct fingerprints is not joined: its pairs would grow with the square of the
group. Every fingerprint that probes such a bucket instead emits the ball of radius one of its whole 64 bits. Two
fingerprints within two bits share a member of their balls and a ball holds 65 values, so groups by ball member are
small, miss no link, and linking each to its smallest is exact for components.

Components come from alternating star contraction, with reliable checkpoints between rounds.

Rows that come from an explode meet others by shuffle and merge (``merged``): they are many times what Spark sizes them.

Defined results: null and empty texts have fingerprint zero; rows of equal ids each get a row; a null id takes part and
is never the smallest (a component of null ids alone has a null id); an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import chunks, cut, deleted, extended, merged, read_table, table, texts_of

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Distinct fingerprints that a bucket may hold and still be joined pair by pair.
BUCKET = 64
HALF = 0xFFFFFFFF
#: The pipeline's stage: words of a shingle, the least Jaccard similarity in percent, and the keys by which texts meet.
STAGE_SHINGLE, SIMILAR, BANDS, ROWS = 5, 80, 40, 6
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Rounds in which the texts of a large group that are left over get a heart of their own.
HEARTS = 2
#: Parts in which the rows of a group meet what is kept once a group.
SALTS = 16
#: Bits of a sketch of a set of shingles.
SKETCH = 1024


def shingled(texts: list[bytes], size: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all shingles; which texts have any; and of those, the first hash and how many there are."""
    words = [b.lower().split() for b in texts]  # bytes.lower() changes A-Z alone
    n = np.fromiter(map(len, words), np.int64, len(words))
    some = n > 0
    if not some.any():
        return np.zeros(0, np.uint64), some, np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat = list(chain.from_iterable(words))
    joined = b" ".join(flat)
    stop = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)) + 1) - 1
    start = np.concatenate([[0], stop[:-1] + 1])
    last = np.cumsum(n) - 1
    width = np.minimum(n, size)[some]
    each = (n[some] - width + 1)  # shingles of a text
    offset = np.concatenate([[0], np.cumsum(each)[:-1]])
    first = np.repeat((last - n + 1)[some] - offset, each) + np.arange(each.sum())
    xx = xxhash.xxh64_intdigest
    hashes = np.fromiter((xx(joined[a:b], seed) for a, b in zip(start[first].tolist(), stop[first + np.repeat(width, each) - 1].tolist(), strict=True)), np.uint64, len(first))
    return hashes, some, offset, each


def fingerprints_of(texts: list[bytes], size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The 64-bit fingerprint of each text, as unsigned integers."""
    return majorities(*shingled(texts, size, seed))


def majorities(hashes: np.ndarray, some: np.ndarray, offset: np.ndarray, each: np.ndarray) -> np.ndarray:
    """The fingerprint of each text from what ``shingled`` gives: the bitwise majority of its hashes."""
    out = np.zeros(len(some), np.uint64)
    if not len(hashes):
        return out
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = np.add.reduceat(bits, offset, axis=0, dtype=np.int32) * 2 > each[:, None]
    out[some] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprinted(docs: DataFrame, keep: list[str], text: str = "text", name: str = "fp") -> DataFrame:
    """The columns ``keep`` and the fingerprint (as a signed long) of each row."""
    source = docs.select(*dict.fromkeys([*keep, text]))

    def run(batches):
        for batch in chunks(batches, text):
            fp = fingerprints_of(texts_of(batch, text))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fp.view(np.int64))], names=[*keep, name])

    return source.mapInArrow(run, source.select(*keep).schema.add(name, "long"))


def _ball(column, bits: int):
    """The column's value and each value that differs in one of its lowest ``bits`` bits."""
    return F.array(column, *(column.bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(bits)))


def links(prints: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Pairs (u, v), u > v, of distinct fingerprints ``fp``: they connect exactly what links within two bits connect."""
    if distance != 2:
        raise ValueError("two segments and balls of radius one cover a distance of two")
    fp = F.col("fp")
    high, low = F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(HALF))
    held = prints.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("seg"), high.alias("val")), F.struct(F.lit(1).alias("seg"), low.alias("val")))).alias("k")).select("k.seg", "k.val", F.col("fp").alias("other"))
    sizes = held.groupBy("seg", "val").agg(F.count("*").alias("n"))
    small = merged(held).join(sizes.filter(F.col("n") <= bucket).select("seg", "val"), ["seg", "val"])
    large = sizes.filter(F.col("n") > bucket).select("seg", "val", F.lit(None).cast("long").alias("other"))
    probes = prints.select("fp", F.explode(F.concat(F.transform(_ball(high, 32), lambda x: F.struct(F.lit(0).alias("seg"), x.alias("val"))), F.array(F.struct(F.lit(1).alias("seg"), low.alias("val"))))).alias("k")).select("fp", "k.seg", "k.val")
    near = F.bit_count(fp.bitwiseXOR(F.col("other"))) <= distance
    met = cut(merged(probes).join(small.unionByName(large), ["seg", "val"]).filter(F.col("other").isNull() | ((fp > F.col("other")) & near)).select("fp", "other").distinct())
    direct = met.filter(F.col("other").isNotNull()).select(fp.alias("u"), F.col("other").alias("v"))
    balls = met.filter(F.col("other").isNull()).select("fp", F.explode(_ball(fp, 64)).alias("center"))
    least = balls.groupBy("center").agg(F.min("fp").alias("v"), F.count("*").alias("n")).filter(F.col("n") > 1).select("center", "v")
    stars = merged(balls).join(least, "center").filter(fp > F.col("v")).select(fp.alias("u"), "v")
    return direct.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node of the undirected edges (u, v)."""
    state, edges = None, cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def labelled(rows: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """fp, component_id for each distinct fingerprint of ``rows`` (doc_id, fp)."""
    prints = cut(rows.groupBy("fp").agg(F.min(doc_id).alias("least")))
    roots = cut(components(links(prints.select("fp"))))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    own = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = own.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(ids, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of each row."""
    rows = cut(fingerprinted(docs, [doc_id], text))
    out = rows.join(labelled(rows, doc_id), "fp")
    return out.select(doc_id, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def bands_of(texts: list[bytes]) -> np.ndarray:
    """BANDS keys of each text: a hash of the band's number and of ROWS least values of its five-word shingles."""
    return least_keys(*shingled(texts, STAGE_SHINGLE)[:3])


def least_keys(hashes: np.ndarray, some: np.ndarray, offset: np.ndarray) -> np.ndarray:
    out = np.zeros((len(some), BANDS), np.uint64)
    for k, factors in enumerate(FACTORS):
        key = np.full(len(offset), k, np.uint64)
        for factor in factors if len(offset) else ():
            key = (key ^ np.minimum.reduceat(hashes * factor, offset)) * MIX
            key ^= key >> np.uint64(29)
        out[some, k] = key
        out[~some, k] = k
    return out


def banded(docs: DataFrame) -> DataFrame:
    """node (a hash of the text), least (its smallest doc_id), its fingerprint and its band keys, for each distinct text."""
    source = docs.select("doc_id", "text", _node().alias("node"))

    def run(batches):
        for batch in chunks(batches):
            found = shingled(texts_of(batch), STAGE_SHINGLE)
            fp, keys = majorities(*found), least_keys(*found[:3])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("doc_id"), pa.array(fp.view(np.int64)), lists], names=["node", "doc_id", "fp", "keys"])

    rows = source.mapInArrow(run, extended(source.select("node", "doc_id").schema, "fp long, keys array<long>"))
    return cut(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, the set of its shingles' hashes, their number and their sketch, for the texts of ``nodes``.

    A sketch has a bit for each value of ten bits of a hash: set if an odd number of hashes have it.
    Where ``nodes`` says which doc_id is a text's ``least``, only that row serves, so that a text's copies do not move.
    """
    own, theirs = (F.xxhash64("doc_id", _node()), F.xxhash64("least", "node")) if "least" in nodes.columns else (_node(), F.col("node"))
    serve = table(nodes.select(theirs.alias("_serves")).distinct())
    rows = docs.select("text", _node().alias("node"), own.alias("_row"))
    rows = bloom.sieved(rows, "_row", serve, "_serves").filter("_hit")
    # Rows that repeat are aggregated before the shuffle; each text is then left in one row.
    rows = rows.groupBy("_row").agg(F.first("text").alias("text"), F.first("node").alias("node"))
    source = rows.join(serve, F.col("_row") == F.col("_serves"), "left_semi").select("text", "node")

    def run(batches):
        for batch in chunks(batches):
            hashes, some, offset, each = shingled(texts_of(batch), STAGE_SHINGLE)
            sets, at = [np.zeros(0, np.int64)] * batch.num_rows, np.flatnonzero(some)
            for k, a, n in zip(at.tolist(), offset.tolist(), each.tolist(), strict=True):
                sets[k] = np.unique(hashes[a : a + n]).view(np.int64)
            odd = np.stack([np.bincount(x & (SKETCH - 1), minlength=SKETCH) & 1 for x in sets]).astype(np.uint8)
            words = np.packbits(odd, axis=1).view(np.int64)
            sketches = pa.ListArray.from_arrays(pa.array(np.arange(0, words.size + 1, SKETCH // 64, dtype=np.int32)), pa.array(words.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64())), pa.array([len(x) for x in sets], pa.int64()), sketches], names=["node", "hashes", "size", "sketch"])

    return table(source.mapInArrow(run, "node long, hashes array<long>, size long, sketch array<long>"))


def _node():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) of texts whose shingle sets have a Jaccard similarity of SIMILAR percent at least.

    Sketches go first: their bits differ in no more places than the sets in members, so a pair whose sketches differ in
    more than the similarity allows is none, and only the others' sets are brought together.
    """
    side = lambda x, *columns: sets.select(F.col("node").alias(x), *(F.col(c).alias(f"_{c}_{x}") for c in columns))
    met = lambda df, *columns: df.join(side("v", *columns), "v").join(side("u", *columns), "u")
    apart = sum((F.bit_count(F.col("_sketch_u")[k].bitwiseXOR(F.col("_sketch_v")[k])) for k in range(SKETCH // 64)), F.lit(0))
    may = met(pairs.distinct(), "size", "sketch").filter((100 + SIMILAR) * apart <= (100 - SIMILAR) * (F.col("_size_u") + F.col("_size_v"))).select("u", "v")
    both = F.size(F.array_intersect("_hashes_u", "_hashes_v"))
    size = F.size("_hashes_u") + F.size("_hashes_v")
    return cut(met(may, "hashes").filter(100 * both >= SIMILAR * (size - both)).select("u", "v"))


def _pair(x, y):
    return F.greatest(x, y).alias("u"), F.least(x, y).alias("v")


def _dealt(once: DataFrame) -> DataFrame:
    """Rows that are kept once a group, for each part of the group."""
    return merged(once.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))


def apart(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every member (grp, node, hashes, size) by its difference from its group's heart; and ranks of (grp, e).

    The heart holds the shingles of more than half the members. ``diff`` is what a member and the heart do not share,
    ``dist`` its size, ``f`` the distance beyond what half a pair may have, ``low`` the member with the least ``f``.
    A rank is the number of members whose differences hold e; ranks of one are left out.
    """
    counts = members.select("grp", F.explode("hashes").alias("e")).groupBy("grp", "e").agg(F.count("*").alias("n")).filter("n > 1")
    counts = table(counts.join(members.groupBy("grp").agg(F.count("*").alias("all")), "grp"))
    common = F.col("n") * 2 > F.col("all")
    hearts = counts.filter(common).groupBy("grp").agg(F.collect_list("e").alias("heart"))
    own = members.withColumn("salt", F.pmod("node", F.lit(SALTS))).join(_dealt(hearts), ["grp", "salt"], "left")
    own = own.withColumn("heart", F.coalesce("heart", F.array().cast("array<long>")))
    own = own.withColumn("diff", F.concat(F.array_except("hashes", "heart"), F.array_except("heart", "hashes"))).withColumn("dist", F.size("diff").cast("long"))
    far = table(own.select("grp", "salt", "node", "diff", "dist", ((100 + SIMILAR) * F.col("dist") - (100 - SIMILAR) * F.col("size")).alias("f")))
    lows = far.groupBy("grp").agg(F.min(F.struct("f", "node")).alias("low"))
    ranks = counts.select("grp", "e", F.when(common, F.col("all") - F.col("n")).otherwise(F.col("n")).alias("rank")).filter("rank > 1")
    return far.join(_dealt(lows), ["grp", "salt"]).drop("salt"), ranks


def group_edges(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (u, v) between members (grp, node, hashes, size) that connect exactly what similar pairs of a group connect.

    Two sets differ in no more than their distances from the heart together, so members with f(x) + f(low) <= 0 are
    similar to ``low`` for certain, and any pair with f(x) + f(y) <= 0 consists of such members: a star, no comparison.
    Any other similar pair shares (f(x) + f(y)) / 2 (100 + SIMILAR) elements of the differences at least, so it meets at one
    among the rarest of each side; places in that order rule out most of what meets. Only pairs that remain are compared.
    Members that no star holds get a heart of their own (several texts may have been copied); two of one star are not
    compared.
    """
    share = lambda x, y: F.greatest(F.lit(1), F.ceil((x + y) / (2 * (100 + SIMILAR))))
    f, low = F.col("f"), F.col("low.f")
    first, ranks = apart(members)
    far, rest, stars = first, members, None
    for k in range(HEARTS):
        if k:
            far = apart(rest)[0]
        held = table(far.filter(f + low <= 0).select("grp", "node", F.col("low.node").alias("star")))
        stars = held if stars is None else stars.unionByName(held)
        rest = rest.join(held.select("node"), "node", "left_anti")
    edges = stars.filter("node <> star").select(*_pair("node", "star"))
    sorted_ = first.select("node", "grp", "f", "dist", low.alias("low"), F.explode("diff").alias("e")).join(ranks, ["grp", "e"])
    sorted_ = sorted_.groupBy("node", "grp", "f", "dist", "low").agg(F.sort_array(F.collect_list(F.struct("rank", "e"))).alias("es"))
    sorted_ = sorted_.join(stars.select("node", "star"), "node", "left")
    placed = sorted_.select("*", F.posexplode("es").alias("at", "one")).withColumn("left", F.size("es") - F.col("at"))
    low = F.col("low")
    wide = (f + low > 0) & (F.col("left") >= share(f, low))
    short = F.col("left") >= share(f, F.greatest(f, 1 - low))
    placed = table(placed.select("grp", F.col("one.e").alias("e"), "node", "f", "left", F.coalesce("star", "node").alias("star"), wide.alias("wide"), short.alias("short")).filter("wide OR short"))
    x, y = (placed.filter(role).select("grp", "e", *(F.col(c).alias(f"{c}_{role}") for c in ("node", "f", "left", "star"))) for role in ("wide", "short"))
    above = F.struct("f_wide", "node_wide") > F.struct("f_short", "node_short")
    enough = F.least("left_wide", "left_short") >= share(F.col("f_wide"), F.col("f_short"))
    met = merged(x).join(y, ["grp", "e"]).filter(above & enough & (F.col("star_wide") != F.col("star_short")))
    return edges.unionByName(similar(met.select(*_pair("node_wide", "node_short")), sets))


def print_edges(prints: DataFrame) -> DataFrame:
    """Edges (u, v) of texts (node, fp) that connect what fingerprints within two bits connect: the dealt method, ``links``.

    Each text is tied to the smallest of its fingerprint, and those of linked fingerprints to each other.
    """
    held = table(prints.groupBy("fp").agg(F.min("node").alias("head")))
    side = lambda x: held.select(F.col("fp").alias(x), F.col("head").alias(f"_head_{x}"))
    apart = links(held.select("fp")).join(side("u"), "u").join(side("v"), "v").select(*_pair("_head_u", "_head_v"))
    return prints.select("node", "fp").join(held, "fp").filter("node <> head").select(*_pair("node", "head")).unionByName(apart)


def near_roots(docs: DataFrame, prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """node, root of texts that are linked: components of the texts whose fingerprints link, and of all pairs that share a
    band and are similar on whole texts.

    Of keys with ``bucket`` texts at most all pairs are compared. Texts that larger keys tie together form groups, whose
    pairs ``group_edges`` settles without meeting one by one; those pairs are not compared again.
    """
    keyed = prints.select("node", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("head")).filter("n > 1")
    met = table(merged(keyed).join(sizes, "key"))
    sets = shingle_sets(docs, prints.select("node", "least").join(met.select("node").distinct(), "node", "left_semi"))
    edges, large = None, met.filter(F.col("n") > bucket)
    members = met.filter(F.col("n") <= bucket).select("key", "node")
    if large.limit(1).count():
        groups = components(large.filter("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v")))
        groups = table(groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "grp"))
        edges = group_edges(sets.join(groups, "node").select("grp", "node", "hashes", "size"), sets)
        members = members.join(groups, "node", "left")
    else:
        members = members.withColumn("grp", F.lit(None).cast("long"))
    other = members.select("key", F.col("node").alias("v"), F.col("grp").alias("of_v"))
    pairs = members.join(other, "key").filter("node > v AND NOT coalesce(grp = of_v, false)").select(F.col("node").alias("u"), "v")
    found = print_edges(prints).unionByName(similar(pairs, sets))
    roots = cut(components(found if edges is None else edges.unionByName(found)))
    deleted(met)
    deleted(sets)
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the row with the smallest doc_id stays; of equal ids, one row.

    Texts link when the fingerprints of their five-word shingles (a shorter text is one shingle) differ in two bits or
    fewer, by the multi-index hashing of this module. That is a similarity of about 0.99; at 0.8 about ten bits of 64
    differ, and up to twenty. So texts link as well when the sets of those shingles have a Jaccard similarity of 0.8 or
    more, compared exactly on whole texts (by 64-bit hashes). Their candidates share one of BANDS keys of ROWS least
    values: of pairs at 0.8 one in 190,000 shares none, above that fewer.
    Rows without a doc_id stay only if no row of their component has one, and then one of them.
    """
    prints = banded(docs)
    roots = near_roots(docs, prints)
    own = prints.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), F.struct(F.col("least").isNull().alias("none"), "least", "node").alias("k"))
    stay = own.groupBy("root").agg(F.min("k").alias("k")).select(F.col("k.least").alias("_least"), F.col("k.node").alias("_stay"))
    # Decided on ids and hashes; texts move only where a row goes or has equals.
    rows = docs.withColumn("_node", _node())
    each = rows.groupBy("doc_id", "_node").agg(F.count("*").alias("many"))
    each = each.join(stay.withColumn("_stays", F.lit(True)), (F.col("_node") == F.col("_stay")) & F.col("doc_id").eqNullSafe(F.col("_least")), "left")
    touched = table(each.filter("_stays IS NULL OR many > 1").select(F.xxhash64("doc_id", "_node").alias("_touched"), F.col("_stays").isNotNull().alias("_stays")))
    rows = bloom.sieved(rows.withColumn("_key", F.xxhash64("doc_id", "_node")), "_key", touched, "_touched", "_moved")
    moved = rows.filter("_moved").join(touched, F.col("_key") == F.col("_touched"), "left")
    own = docs.columns
    kept = moved.filter("_touched IS NULL").select(*own).unionByName(moved.filter("_stays").dropDuplicates(["_key"]).select(*own))
    return rows.filter("NOT _moved").select(*own).unionByName(kept)


QUERIES = {"op5_simhash": op5_simhash}
ORACLES: dict[str, str] = {}
