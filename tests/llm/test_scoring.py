import math
import zlib
from collections import Counter

import numpy as np
import pytest

from rillstone.llm import scoring


def plain(rows):
    tokens = [(i, (t or "").encode().lower().split() + [b" end"]) for i, t in rows]
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    c = Counter(w for i, ws in tokens if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted((str(i), out(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in tokens)


@pytest.mark.parametrize("head", [4, 65_536])
def test_base_scores_against_brute_force(spark, docs_of, edge, monkeypatch, head):
    monkeypatch.setattr(scoring, "HEAD", head)
    rows = [*edge, *((100 + k, f"the cat {k} sat on the mat{k % 7} The end") for k in range(60))]
    got = scoring.scored(docs_of(rows)).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == plain(rows)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert scoring.scored(docs_of([])).count() == 0


def counts_of(texts):
    c = Counter(w for t in texts for w in t.lower().split())
    top = sorted(c.items(), key=lambda x: (-x[1], x[0]))
    tokens, words = np.zeros(scoring.CLASSES), np.zeros(scoring.CLASSES)
    tokens[scoring.END] = len(texts)
    for k, (w, n) in enumerate(top):
        own = 1 + k if k < scoring.WORDS else scoring.surface(w)
        tokens[own] += n
        words[own] += 1
    return scoring.Counts([w for w, _ in top], np.array([k for _, k in top], np.int64), sum(c.values()) + len(texts), len(texts), len(c) + 1, tokens, words)


def sequence(counts, texts):
    _, n, _, classes = scoring._words({w: k for k, w in enumerate(counts.words)}, np.array(counts.classes(), np.int32), texts)
    return scoring.padded(classes, n)[0]


def chained():
    draw = np.random.default_rng(0)
    pairs = {k: draw.permutation(30)[:3] for k in range(30)}

    def text():
        k, out = int(draw.integers(30)), []
        for _ in range(60):
            out.append(b"w%d" % k)
            k = int(draw.choice(pairs[k]))
        return b" ".join(out)

    return [text() for _ in range(400)], [text() for _ in range(40)]


def objective(model, seq, noise):
    """The noise-contrastive objective, token by token."""
    sigma = lambda x: 1 / (1 + np.exp(-x))
    group_noise = noise.reshape(scoring.GROUPS, scoring.MEMBERS).sum(1)
    out = 0.0
    for t in range(scoring.CONTEXT, len(seq)):
        if seq[t] == scoring.BEGIN:
            continue
        v = sum(model.place[k] * model.context[seq[t - 1 - k]] for k in range(scoring.CONTEXT))
        g, m = divmod(int(seq[t]), scoring.MEMBERS)
        for scores, bias, pn, own in (
            (model.group @ v, model.group_bias, group_noise, g),
            (model.member.reshape(scoring.GROUPS, scoring.MEMBERS, -1)[g] @ v, model.member_bias.reshape(scoring.GROUPS, -1)[g], noise.reshape(scoring.GROUPS, -1)[g] / group_noise[g], m),
        ):
            odds = scores + bias - np.log(scoring.NOISE * pn)
            out += np.log(sigma(odds[own])) + (scoring.NOISE * pn * np.log(sigma(-odds))).sum()
    return out


def test_the_gradient_is_that_of_the_objective():
    draw = np.random.default_rng(4)
    counts = counts_of([b"a b c d e", b"a b", b"f g a", b"", b"a"])
    noise = counts.noise()
    seq = sequence(counts, [b"a b c d e", b"f g a zz", b""])
    model = scoring.Model.start(noise)
    model.member[:], model.group[:] = draw.normal(0, 0.3, model.member.shape), draw.normal(0, 0.3, model.group.shape)
    total = scoring.Model(np.zeros_like(model.matrix))
    assert model.gradient(seq, noise, total) == 12
    for part in ("context", "member", "group", "place", "member_bias", "group_bias"):
        own, got = getattr(model, part), getattr(total, part)
        at = np.unravel_index(np.abs(got).argmax(), got.shape)
        before = own[at]
        own[at] = before + 1e-4
        high = objective(model, seq, noise)
        own[at] = before - 1e-4
        low = objective(model, seq, noise)
        own[at] = before
        assert abs((high - low) / 2e-4 - got[at]) < 1e-3 * max(1, abs(got[at])), part


def test_probabilities_sum_to_one_and_beat_unigrams():
    train, test = chained()
    counts = counts_of(train)
    noise, seq = counts.noise(), sequence(counts, train)
    model = scoring.Model.start(noise)
    steps = scoring.Steps(model)
    for _ in range(60):
        total = scoring.Model(np.zeros_like(model.matrix))
        many = model.single().gradient(seq, noise, total)
        steps.make(total.matrix / many)
    held = sequence(counts, test)
    real = held[held != scoring.BEGIN]
    assert model.log_probability(held).sum() / len(real) > np.log(noise)[real].mean() + 0.5
    # All classes after one context.
    before = held[scoring.CONTEXT : 3 * scoring.CONTEXT]
    one = np.concatenate([np.append(before[-scoring.CONTEXT :], c) for c in range(scoring.CLASSES)])
    at = np.arange(scoring.CONTEXT, len(one), scoring.CONTEXT + 1)
    assert abs(np.exp(model.log_probability(one)[at]).sum() - 1) < 1e-6


def test_scores_against_a_plain_model(spark, docs_of, edge):
    """The score of each text, token by token, from the parameters that the rounds give."""
    rows = [*edge, *((100 + k, f"the cat {k} sat on the mat{k % 7} The end") for k in range(60))]
    docs = docs_of(rows)
    _, counts = scoring.corpus_counts(docs, "doc_id", "text")
    model = scoring.trained(docs, counts, "doc_id", "text")
    c, n_texts = Counter(), 0
    for i, t in rows:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 10:
            c.update((t or "").encode().lower().split())
            n_texts += 1
    top = [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))]
    assert counts.words == top and counts.n_texts == n_texts
    cls = lambda w: 1 + top.index(w) if w in top[: scoring.WORDS] else scoring.surface(w)
    of_class = Counter()
    for w in c:
        of_class[cls(w)] += c[w]

    def score(t):
        seq = [scoring.BEGIN] * scoring.CONTEXT
        out = 0.0
        for w in [*(t or "").encode().lower().split(), None]:
            own = scoring.END if w is None else cls(w)
            v = sum(model.place[k] * model.context[seq[-1 - k]] for k in range(scoring.CONTEXT))
            g = own // scoring.MEMBERS
            a = model.group @ v + model.group_bias
            b = (model.member @ v + model.member_bias)[g * scoring.MEMBERS : (g + 1) * scoring.MEMBERS]
            out += a[g] - np.log(np.exp(a).sum()) + b[own % scoring.MEMBERS] - np.log(np.exp(b).sum())
            if own > scoring.WORDS:
                kinds = sum(cls(x) == own for x in c)
                out += np.log((c[w] + 0.1) / (of_class[own] + 0.1 * (kinds + 1)))
            seq.append(own)
        return out / np.log(10)

    got = sorted((str(r["doc_id"]), round(r["score"], 2)) for r in scoring.scored(docs).collect())
    assert len(got) == len(rows)
    want = sorted((str(i), score(t)) for i, t in rows)
    for (i, a), (j, b) in zip(got, want, strict=True):
        assert i == j and abs(a - b) < 0.02 + 1e-4 * abs(b)


def test_held_out_texts_of_the_table_score_above_the_base_at_any_partitioning(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = []
    for parts in (1, 8, 64):
        r = scoring.scored(docs.repartition(parts)).filter("held_out").agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first()
        assert r["sum(score)"] > r["sum(base_score)"] + 0.1 * r["sum(n_tokens)"]
        sums.append(r["sum(score)"])
    assert max(sums) - min(sums) < 1e-4 * abs(sums[0])
