import hashlib
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from rillstone.llm import bloom, suffixes


def plain(rows):
    """In the order of ids, by a set of all earlier strings."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s] += 1
                gone[s + 100] -= 1
            seen.add(w)
        mask = np.cumsum(gone[:-1]) > 0
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out.append((i, len(b), int(mask.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest()))
    return sorted(out)


def told(df):
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


@pytest.mark.parametrize(("group", "hot", "capacity"), [(1, False, 1 << 22), (48, False, 1 << 22), (48, True, 0)])
def test_against_brute_force(spark, docs_of, monkeypatch, group, hot, capacity):
    """Both ways of comparing pieces; every frequent gram taken for hot; documents met with and without the Bloom filter."""
    monkeypatch.setattr(suffixes, "GROUP", group)
    monkeypatch.setattr(bloom, "CAPACITY", capacity)
    if hot:
        monkeypatch.setattr(suffixes, "SAMPLE", 1)
        monkeypatch.setattr(suffixes, "LEAST_HOT", 3)
    draw = random.Random(5)
    words = lambda n: " ".join(draw.choice(["der", "die", "été", "und", "qx", "lorem", "ipsum"]) + str(draw.randrange(90)) for _ in range(n))
    passage = words(40)
    rows = [(k, words(20) + " " + passage[draw.randrange(30) :] + " " + words(20)) for k in range(40)]
    copy = words(120)
    rows += [(50 + k, copy) for k in range(5)] + [(60, copy[:200] + "!" + copy[201:]), (61, "a" * 700), (62, "ab" * 300), (63, "x" * 99), (64, None), (65, ""), (66, "a" * 100)]
    draw.shuffle(rows)
    assert told(suffixes.deduplicated(docs_of(rows))) == plain(rows)
    assert bool(len(suffixes._hot(docs_of(rows).selectExpr("doc_id", "text", "0L AS th")))) == hot


def test_ids_of_other_types(spark, docs_of):
    same = "q" + "zy" * 75
    rows = [("b", same), ("a", same + "!"), ("", same), (None, same), ("c", "unlike")]
    got = {r["doc_id"]: r["n_removed"] for r in suffixes.deduplicated(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    first = got[""]  # within it all but the first two starts repeat
    assert got["b"] == got[None] == 151 and got["a"] >= 151 and 0 < first < 151 and got["c"] == 0
    assert {r["n_removed"] for r in suffixes.deduplicated(docs_of([(1, "alone")]).withColumn("doc_id", F.lit("x"))).collect()} == {0}


def test_edges(spark, docs_of, edge):
    got = suffixes.deduplicated(docs_of(edge)).collect()
    assert len(got) == len(edge)
    assert suffixes.deduplicated(docs_of([])).count() == 0
    same = suffixes.deduplicated(docs_of([(1, "q" + "z" * 150), (1, "q" + "z" * 150), (None, "q" + "z" * 150)])).collect()
    assert [r["n_removed"] for r in sorted(same, key=lambda r: r["n_removed"])][-1] == 151


def test_column_wise_construction():
    draw = random.Random(6)
    for aligned in (False, True):
        for _ in range(40):
            gram, left, right = b"0123456789ABCDEF0123456789ABCDEF", bytes(draw.choices(b"ab ", k=68)), bytes(draw.choices(b"ab ", k=68))
            pieces, leads = [], []
            for _ in range(draw.randint(1, 40)):
                a = draw.randint(0, 68)
                b = draw.randint(68 - a, 68)
                x = bytearray(left[68 - a :] + gram + right[:b])
                k = draw.randrange(len(x))
                if not a <= k < a + 32:
                    x[k] = 120
                pieces.append(bytes(x))
                leads.append(a)
            document, start = np.array([draw.randint(0, 5) for _ in pieces]), np.arange(len(pieces)) * 1000
            got = suffixes.repeated_windows(pieces, document, start, np.array(leads) if aligned else None)
            first: dict = {}
            where = [(i, u) for i, p in enumerate(pieces) for u in range(len(p) - 99)]
            for i, u in where:
                key = (document[i], start[i] + u)
                first[pieces[i][u : u + 100]] = min(first.get(pieces[i][u : u + 100], key), key)
            assert sorted(map(tuple, got.tolist())) == sorted((i, u) for i, u in where if (document[i], start[i] + u) > first[pieces[i][u : u + 100]])
