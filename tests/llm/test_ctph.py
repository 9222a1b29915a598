import hashlib
import random
import time

import pytest

from rillstone.llm import ctph


def text(draw, n):
    return " ".join(draw.choice(["alpha", "beta", "gamma", "été", "delta", "x"]) + str(draw.randrange(99)) for _ in range(n))


def test_against_a_plain_order(spark, docs_of):
    draw = random.Random(7)
    rows = [(k * 3 - 50, text(draw, draw.randint(0, 200))) for k in range(70)] + [(500, ""), (501, None), (10**12, "ab")]
    got = {r["doc_id"]: r for r in ctph.fingerprinted(docs_of(rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        own, after = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(own) // 3
        edited = own[: len(own) - m] + after[:m]
        r, f, g = got[i], ctph.fingerprint(own.encode()), ctph.fingerprint(edited.encode())
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(own), hashlib.sha256(edited.encode()).hexdigest(), f, g)
        assert r["near_edited"] == ctph.likeness(f, g) and r["near_next"] == ctph.likeness(f, ctph.fingerprint(after.encode()))


def test_edges(spark, docs_of, edge):
    assert ctph.fingerprinted(docs_of(edge)).count() == len(edge)
    assert ctph.fingerprinted(docs_of([])).count() == 0
    one = ctph.fingerprinted(docs_of([(1, "abcdef")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()


def test_likeness_follows_the_share_that_stays():
    draw = random.Random(8)
    for _ in range(30):
        a, b = text(draw, 400), text(draw, 400)
        half = a[: len(a) // 2] + b[len(b) // 2 :]
        f = ctph.fingerprint(a.encode())
        assert ctph.likeness(f, ctph.fingerprint(a.encode())) == 1
        assert ctph.likeness(f, ctph.fingerprint(half.encode())) > 0.25
        assert ctph.likeness(f, ctph.fingerprint(b.encode())) < 0.2


def test_common_length_is_that_of_a_table():
    draw = random.Random(9)
    for _ in range(200):
        a, b = ("".join(draw.choices("abcd", k=draw.randint(0, 30))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
            row = new
        assert ctph.common_length(a, b) == row[-1]


def test_every_boundary_of_a_text_with_frequent_triggers_counts():
    """Repeated lines have far more boundaries than 64; an edit of the last third moves about a third of the signature."""
    draw = random.Random(10)
    seen = 0
    for _ in range(30):
        line = text(draw, 6) + "\n"
        a = line * 80 + text(draw, 60)
        b = a[: len(a) - len(a) // 3] + text(draw, 600)[: len(a) // 3]
        f, g = ctph.fingerprint(a.encode()), ctph.fingerprint(b.encode())
        first = f.split(":")[1]
        if len(first) > ctph.PIECES:
            seen += 1
            assert ctph.likeness(f, g) < 0.95
    assert seen > 3


def plain_fingerprint(data):
    """By the definition, a byte at a time."""

    def hashed(k):
        h = sum(data[k - j] * pow(0x01000193, j + 1, 1 << 32) for j in range(min(7, k + 1))) % (1 << 32)
        h ^= h >> 15
        h = h * 0x2C1B3C6D % (1 << 32)
        return h ^ h >> 13

    rolls = [hashed(k) for k in range(len(data))]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

    def letter(piece):
        h = sum((b + 1) * pow(ctph.PRIME, k, 1 << 64) for k, b in enumerate(piece)) % (1 << 64)
        h ^= h >> 29
        return letters[h * 0xBF58476D1CE4E5B9 % (1 << 64) >> 58]

    def signature(block):
        pieces, start = [], 0
        for k, r in enumerate(rolls):
            if r % block == block - 1:
                pieces.append(data[start : k + 1])
                start = k + 1
        if start < len(data):
            pieces.append(data[start:])
        out, last, n = "", None, 0
        for c in [*map(letter, pieces), None]:
            if c != last:
                out += (last or "") * (n if n <= 3 else 3 + (n // 3).bit_length() - 1)
                last, n = c, 0
            n += 1
        return out

    if not data:
        return "4::"
    block = 4
    while block * 64 < len(data):
        block *= 2
    while len(signature(block)) < 32 and block > 4:
        block //= 2
    while len(signature(block)) > 512 and len(signature(2 * block)) >= 32:
        block *= 2
    return f"{block}:{signature(block)}:{signature(2 * block)}"


def test_fingerprint_equals_the_plain_definition():
    draw = random.Random(11)
    texts = ["", "a", "ab" * 200, ";f" * 700, "x" * 900, "abc def " * 150, "Zürich " * 60] + ["".join(draw.choices("abcdefgh \n", k=draw.randint(1, 3000))) for _ in range(12)]
    for t in texts:
        assert ctph.fingerprint(t.encode()) == plain_fingerprint(t.encode())


@pytest.mark.parametrize("unit", [";f", "x", "abc\n", "".join(map(chr, range(40, 100)))])
def test_periodic_texts_take_linear_time(unit):
    text = unit * (10_000_000 // len(unit))
    began = time.perf_counter()
    a = ctph.fingerprint(text.encode())
    b = ctph.fingerprint(ctph.edited(text, "something else " * 300_000).encode())
    near = ctph.likeness(a, b)
    assert time.perf_counter() - began < 60 and 0 <= near <= 1 and ctph.likeness(a, a) == 1
    assert ctph.fingerprint(text.encode()) == a


def test_long_signatures_compare_by_shared_runs():
    draw = random.Random(12)
    a = "".join(draw.choices("abcdef", k=9000))
    b = a[:6000] + "".join(draw.choices("ghij", k=3000))
    assert ctph._score(a, b) == pytest.approx(2 / 3, abs=0.01) and ctph._score(a, a[::-1].upper()) == 0
