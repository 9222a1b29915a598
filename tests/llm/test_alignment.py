import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rillstone.llm import alignment

public = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))


def unlettered():
    """The bytes that the letters of byte-level tokens stand for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


LETTERS = unlettered()


def groups_of(text, libraries):
    a, b = libraries
    if not text:
        return []
    left = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(LETTERS[c] for c in t)) for i, t in zip(left.ids, left.tokens, strict=True)]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    want = (" " + text).encode()
    if any(b"".join(x for _, x in side) != want for side in (left, right)):
        return []

    def ends(side):
        at, out = 0, []
        for _, x in side:
            at += len(x)
            out.append(at)
        return out

    shared = sorted({*ends(left)} & {*ends(right)})
    out = [([], []) for _ in shared]
    for k, side in enumerate((left, right)):
        for (i, _), e in zip(side, ends(side), strict=True):
            out[next(n for n, s in enumerate(shared) if e <= s)][k].append(i)
    return out


def brute(docs, libraries):
    groups = [groups_of(t, libraries) for _, t in docs]
    count = Counter()
    for g in groups:
        count.update({(a, b) for x, y in g for a in x for b in y})
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for (i, _), g in zip(docs, groups, strict=True):
        links = [(a, b) for x, y in g for a in x for b in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(count[k] == best[k[0]] for k in links), sum(count[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


PARTS = ["a", "the", "naïve", " ", " ", " ", "  ", "\n", " \n", "\t", "'s", "\xa0", "\x1c", "é", "1234", "!?", "<|endoftext|>", "<s>", "中文", "\U0001f600", "xxxxxxxx", "ababab", "unbelievable", "\x00", "̈"]


def drawn(n, seed):
    draw = random.Random(seed)
    docs = [(k, "".join(draw.choices(PARTS, k=draw.randint(0, 14)))) for k in range(n)]
    return docs + [(n, "a▁b"), (n + 1, "▁"), (n + 2, "mostly plain words, and plain words again")] * 2


def result(spark, docs, parts=3):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts).selectExpr("*", "1 AS block", "2 AS kind", "3 AS pieces", "4 AS a")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in alignment.aligned(df, ["doc_id"]).select(*names).collect()), key=str)


def test_equals_brute_force(spark, libraries):
    docs = drawn(400, 1)
    got = result(spark, docs)
    assert got == brute(docs, libraries)
    assert any(r[4] > r[3] > 0 for r in got)


def test_blocks_do_not_matter(spark, libraries, monkeypatch):
    docs = drawn(120, 2)
    monkeypatch.setattr(alignment, "BLOCK_WORDS", 5)
    monkeypatch.setattr("rillstone.llm.alignment.chunks", lambda batches, limit=200, real=alignment.chunks: real(batches, limit=limit))
    assert result(spark, docs, 5) == brute(docs, libraries)


def test_documents_of_the_given_table(spark, sf, libraries):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.substring("text", 1, 700)).collect()]
    assert result(spark, docs) == brute(docs, libraries)


def test_edges(spark, docs_of, edge, libraries):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = sorted((tuple(r) for r in alignment.aligned(docs_of(edge), ["doc_id"]).select(*names).collect()), key=str)
    small = [(i, t) for i, t in edge if t is None or len(t) < 5000]
    assert len(got) == len(edge)
    by = {r[0]: r for r in got}
    for i, t in small:
        g = groups_of(t, libraries)
        assert by[i][3] == len(g) and (by[i][7] == "") == (not g)
    long_ = next(t for _, t in edge if t and len(t) == 30000)
    assert by[7][1] == len(libraries[0].encode(" " + long_, add_special_tokens=False).ids)
    assert alignment.aligned(docs_of([]), ["doc_id"]).count() == 0


def test_a_pair_in_two_groups_counts_once(spark):
    counts = spark.createDataFrame([("1,2|7", 3), ("1|7", 2), ("1,1|7,7", 1)], "pieces string, n long")
    surplus = spark.createDataFrame([(1, 7, 2)], "a int, b int, n long")
    values, pairs = alignment.linked(counts, surplus)
    assert sorted(map(tuple, pairs.collect())) == [(1, 7, 4), (2, 7, 3)]
    assert sorted(map(tuple, values.select("pieces", "count_sum", "n_best").collect())) == [("1,1|7,7", 16, 4), ("1,2|7", 7, 2), ("1|7", 4, 1)]
