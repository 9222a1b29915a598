import random
import zlib

import numpy as np
import pytest

from rillstone.llm import packing
from rillstone.llm.packing import Limits

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def sequences(rows):
    out = {}
    for r in rows:
        out.setdefault(r["sequence_id"], []).append(r)
    return {k: sorted(v, key=lambda r: r["offset"]) for k, v in out.items()}


def padding(lengths, most):
    return sum(0 if n & (n - 1) == 0 else most - n for n in lengths)


def test_query_holds_every_id_once(spark, sf, library):
    rows = packing.op13_packing(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    ids = {d["doc_id"]: [*library.encode(d["text"] or "", add_special_tokens=False).ids, 1] for d in docs}
    at = dict.fromkeys(ids, 0)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        whole = ids[r["doc_id"]]
        assert (r["start"], r["doc_tokens"]) == (at[r["doc_id"]], len(whole)) and r["length"] > 0
        at[r["doc_id"]] += r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.array(whole[r["start"] : at[r["doc_id"]]], "<u4").tobytes())
    assert at == {k: len(v) for k, v in ids.items()}
    lengths = []
    for group in sequences(rows).values():
        assert [r["offset"] for r in group] == np.cumsum([0, *(r["length"] for r in group)])[:-1].tolist()
        assert len(group) <= Limits().segments
        lengths.append(sum(r["length"] for r in group))
    assert max(lengths) <= 2048 and padding(lengths, 2048) <= 0.001 * sum(lengths)


def test_edges_and_special_strings(spark, docs_of, edge, library):
    texts = [*edge, (20, "a<|endoftext|> b"), (21, "<|endoftext|><|endoftext|>"), (22, "  two  spaces \n\n and   more   "), (23, "x " * 9000)]
    rows = packing.packed_texts(docs_of(texts), ["doc_id"]).collect()
    want = sorted((str(i), len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in texts)
    firsts = sorted((str(r["doc_id"]), r["example_tokens"]) for r in rows if r["start"] == 0)
    assert firsts == want
    assert sum(r["length"] for r in rows) == sum(n for _, n in want)
    assert packing.packed_texts(docs_of([]), ["doc_id"]).count() == 0


def test_encoder_equals_library(library):
    draw = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "'", " ", "\x1c", "▁", "é", "12", "!", "<|endoftext|>", "中", "\U0001f600"]
    encode = packing.ByteLevel(special=packing.SPECIAL)
    for _ in range(4000):
        t = "".join(draw.choices(parts, k=draw.randint(0, 25)))
        assert np.frombuffer(encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("limits", [Limits(64, 5, 64), Limits(64, 5, 20), Limits(100, 3, 1), Limits(32, 1, 32)])
def test_three_limits_hold_together(spark, limits):
    draw = random.Random(4)
    rows = []
    for k in range(400):
        n = draw.choice([0, 1, 2, 7, 31, 64, 65, 200, draw.randint(1, 90)])
        rows.append((k % 50, [draw.randint(0, 50000) for _ in range(n)], [draw.random() < 0.3 for _ in range(n)]))
    df = spark.createDataFrame(rows, "k int, ids array<int>, marks array<boolean>").repartition(3)
    got = packing.packed(df, ["k"], "ids", "marks", limits).collect()
    assert sum(r["length"] for r in got) == sum(len(x) for _, x, _ in rows)
    assert sum(r["n_loss"] for r in got) == sum(sum(m) for _, _, m in rows)
    for group in sequences(got).values():
        assert sum(r["length"] for r in group) <= limits.tokens
        assert len(group) <= limits.segments and sum(r["n_loss"] for r in group) <= limits.loss
    whole = [tuple(np.frombuffer(r["ids"], "<u4").tolist()) for r in got if r["length"] == r["example_tokens"]]
    assert set(whole) <= {tuple(x) for _, x, _ in rows}


def test_examples_stay_whole_without_cutting(spark):
    df = spark.createDataFrame([(k, [1] * (k % 60 + 1)) for k in range(300)], "k int, ids array<int>").coalesce(1)
    got = packing.packed(df, ["k"], limits=Limits(64, 8, 64), cut=False).collect()
    assert all(r["start"] == 0 and r["length"] == r["example_tokens"] for r in got) and len(got) == 300
    lengths = [sum(r["length"] for r in g) for g in sequences(got).values()]
    assert sum(lengths) > 0.97 * 64 * len(lengths)
    with pytest.raises(Exception, match="above a limit"):
        packing.packed(df, ["k"], limits=Limits(32, 8, 32), cut=False).collect()


def test_a_pool_that_overflows_keeps_half(monkeypatch):
    monkeypatch.setattr(packing, "POOL", 16)
    packer, draw, out = packing.Packer(Limits(64, 4, 64)), random.Random(5), []
    total = 0
    for k in range(500):
        n = draw.randint(1, 63)
        total += n
        out += packer.add(packing.Piece((k,), 0, b"\0\0\0\0" * n, None, n))
        assert len(packer.pieces) <= 17
    out += packer.rest()
    assert sum(p.length for s in out for p in s) == total
