import random
import re
from collections import Counter

import numpy as np
import pytest
from oracle import connect, rows
from pyspark.sql import functions as F

from rillstone.llm import phrases

PIECES, WORDS = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, longest, top):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in PIECES.split((text or "").translate(LOWER)):
            w = WORDS.findall(piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    out = []
    kept = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    for (lang, p), a in kept.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
        if any(g == lang and len(q) > len(p) and b >= a and inside(q) for (g, q), b in kept.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        s, k = min(cuts)
        out.append((lang, -s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    ranked, at = [], Counter()
    for lang, s, a, p, left, right in sorted(out):
        at[lang] += 1
        if at[lang] <= top:
            ranked.append((lang, at[lang], p.decode(), -a, left, right, n[lang], -s))
    return ranked


def drawn(k=300, seed=1):
    draw = random.Random(seed)
    vocabulary = ["A", "b", "c", "Zürich", "中文", "e\x0bf", "é", "x\xa0y", "new", "york", "of", "the", "\U0001f600"]
    fixed = ["new york of the", "b c b c b c", "A b c Zürich é", "the the the the the the"]
    text = lambda: "".join(draw.choice([draw.choice(vocabulary), draw.choice(fixed)]) + draw.choice([" ", "  ", "\t", ". ", "\n", " ", " ", " "]) for _ in range(draw.randint(0, 30)))
    return [(draw.choice(["en", "en", "en", "fr", None, "und", ""]), text()) for _ in range(k)] + [("en", None), (None, ""), ("en", " \t.\n")]


def query(spark, docs, parts=3, **how):
    df = spark.createDataFrame(docs, "lang string, text string").repartition(parts).selectExpr("*", "1 AS phrase", "2 AS n", "3 AS block", "4 AS key")
    return sorted(tuple(r) for r in phrases.collocations(df, **how).collect())


@pytest.mark.parametrize("least, longest, top", [(5, 5, 2000), (20, 5, 7), (3, 2, 50), (1, 3, 10**6)])
def test_equals_brute_force(spark, least, longest, top):
    docs = drawn()
    assert query(spark, docs, least=least, longest=longest, top=top) == sorted(brute(docs, least, longest, top))


def test_blocks_and_slices_do_not_matter(spark, monkeypatch):
    docs = drawn(200, 2) + [("en", "new york of the. " * 3000)]
    want = query(spark, docs, 1, least=4)
    assert want == sorted(brute(docs, 4, 5, 2000)) and want
    monkeypatch.setattr(phrases, "BLOCK", 100)
    monkeypatch.setattr(phrases, "SLICE", 64)
    assert query(spark, docs, 5, least=4) == want


def test_small_blocks():
    block = phrases._Block()
    block.add("en", b"a b a b\xffb a")
    row = phrases.Lists(block.row(0), 0)
    n = row.numbers("n")
    assert row.phrases() == ["a", "b"] and n.tolist() == [3, 3]
    assert row.positions().tolist() == [0, 2, 6, 1, 3, 5]
    left, right, sizes, first = phrases.longer(n, row.positions())
    assert [(a, b, c) for a, b, c in zip(left.tolist(), right.tolist(), sizes.tolist(), strict=True)] == [(0, 1, 2), (1, 0, 2)]
    assert first.tolist() == [0, 2, 1, 5]


def test_numbers_come_back():
    for values in ([0], [5, 1, 2**43, 0], list(range(1000))):
        assert phrases.grown(phrases.shrunk(np.array(values)), len(values)).tolist() == values


def test_colliding_hashes_do_no_harm(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BITS", 8)
    docs = drawn(150, 3)
    assert query(spark, docs, least=6) == sorted(brute(docs, 6, 5, 2000))


def test_scores_are_exact(spark):
    draw = random.Random(7)
    cases = [(draw.randint(1, 10**12), draw.randint(10**12, 10**14), draw.randint(10**11, 10**12), draw.randint(10**11, 10**12)) for _ in range(200)] + [(10**12, 10**15, 10**12, 10**12), (100, 10**6, 100, 100)]
    df = spark.createDataFrame(cases, "a long, n long, l long, r long").withColumn("s", phrases.score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    for x in df.collect():
        assert x["s"] == 1000 * x["a"] * x["n"] // (x["l"] * x["r"])


def test_empty(spark):
    assert query(spark, []) == []
    assert query(spark, [("en", None)]) == []


def test_sql_gives_the_same(spark, sf, monkeypatch):
    got = phrases.collocations(spark.read.parquet(f"{sf}/documents.parquet"), 20).toPandas()
    want = connect(sf).execute(phrases.sql(20)).df()
    assert len(want) and rows(got) == rows(want)
