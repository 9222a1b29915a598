import hashlib
import random

import numpy as np
import pytest

from rillstone.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")
PIECES = ["'", "'s", "'re", "'ll", "'ve", " ", "  ", "\n", "\t", "a", "s", "t", "re", "l", "é", "1", "22", "!", "#", " ", "　", "中", "\U0001f600", "̈", "Ⅷ", "²", "ſ", "\x00", "\x85"]


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.vocabulary().ranks, special_tokens={})


def test_ids_equal_the_library_and_round_trip(encoding):
    draw = random.Random(1)
    texts = ["".join(draw.choices(PIECES, k=draw.randint(0, 40))) for _ in range(3000)] + ["a" * 5000, "ab" * 3000 + "!" * 400, " " * 700, "x" * 300, "'s't're"]
    got = bpe.vocabulary().encode([t.encode() for t in texts])
    for t, (ids, offsets) in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoding.encode_ordinary(t)
        assert bpe.vocabulary().decode(ids) == t.encode()
        assert (offsets[0] == 0) if t else not len(offsets)


def test_query_shape_and_edges(spark, docs_of, edge, encoding):
    rows = bpe.round_trip(docs_of(edge), ["doc_id"]).collect()
    assert len(rows) == len(edge)
    sha = lambda data: hashlib.sha256(data).hexdigest()
    ids = {t: encoding.encode_ordinary(t or "") for _, t in edge}
    want = sorted((str(i), len(ids[t]), sha(np.array(ids[t], "<u4").tobytes()), sha((t or "").encode())) for i, t in edge)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want
    assert bpe.round_trip(docs_of([]), ["doc_id"]).count() == 0


def test_query_equals_the_library(spark, sf, encoding):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in bpe.op9_byte_bpe(spark, sf).collect():
        ids = encoding.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_columns_of_ids_decode(spark, docs_of, edge):
    back = bpe.decoded(bpe.encoded(docs_of(edge), ["doc_id"]), ["doc_id"])
    assert sorted(bytes(r["bytes"]) for r in back.collect()) == sorted((t or "").encode() for _, t in edge)


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_SLICES", 3)
    vocab = bpe.vocabulary()
    for t in ("one two three four", "five six seven", "one two"):
        assert vocab.decode(vocab.encode([t.encode()])[0][0]) == t.encode()


def test_a_worker_keeps_no_slices_after_a_task(spark, docs_of):
    import pyarrow as pa

    def kept(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(v.cache) for v in bpe._OPEN.values()]}, pa.schema([("n", pa.int64())]))

    assert bpe.round_trip(docs_of([(k, f"some words number{k} here") for k in range(40)]), ["doc_id"]).count() == 40
    assert bpe.round_trip(docs_of([(k, f"some words number{k} here") for k in range(40)]), ["doc_id"]).agg({"n_tokens": "sum"}).first()[0] > 0
    assert not any(r["n"] for r in spark.range(0, 8, 1, 8).mapInArrow(kept, "n long").collect())
