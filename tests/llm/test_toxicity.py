import numpy as np

from rillstone.llm import toxicity


def test_marked_texts_are_found_and_clean_ones_left(spark, docs_of):
    rows = [(k, f"the day number {k} was fine and quiet again w{k}") for k in range(300)] + [(1000 + k, f"the day number {k} you stupid idiot w{k}") for k in range(60)] + [(2000 + k, f"cheap*** pills*** now*** w{k}") for k in range(60)]
    labels = spark.createDataFrame([(i, int(not 2000 <= i), int(1000 <= i < 2000)) for i, _ in rows if i % 3] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    docs = docs_of(rows)
    got = {r["doc_id"]: r for r in toxicity.scored(docs, *toxicity.chain_of(docs, labels)).collect()}
    assert all(got[i]["toxic"] == (1000 <= i < 2000) for i, _ in rows)
    assert all((got[i]["p_fault"] > 0.5) == (i >= 2000) for i, _ in rows)


def test_edges(spark, docs_of, edge):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = docs_of(edge)
    got = toxicity.scored(docs, *toxicity.chain_of(docs, labels)).collect()
    assert len(got) == len(edge) and not any(r["toxic"] for r in got)
    empty = docs_of([])
    assert toxicity.scored(empty, *toxicity.chain_of(empty, labels)).count() == 0


def test_later_models_see_out_of_fold_probabilities():
    draw = np.random.default_rng(1)
    x = (draw.random((600, 5)) < 0.4).astype(np.float32)
    first = x[:, 0].copy()
    second = (first * (draw.random(600) < 0.9)).astype(np.float32)
    models = toxicity.train_chain(x, [first, second], np.ones(600, np.float32), np.arange(600) % toxicity.FOLDS)
    assert len(models[1]) == len(models[0]) + 1
    p1 = toxicity.predicted(x, models[0])
    p2 = toxicity.predicted(np.column_stack([x, p1]), models[1])
    assert ((p2 > 0.5) == (first > 0)).mean() > 0.99


def test_bounded_sample(spark, docs_of):
    docs = docs_of([(k, f"text {k}") for k in range(100)])
    labels = spark.createDataFrame([(k, 1, 0) for k in range(100)], "doc_id long, quality int, toxic int")
    assert toxicity.labelled_words(docs, labels, 10).count() <= 10


def plain_words(text):
    words = {w for w in "".join(" " if c in ".,;:!?\"'()[]{}" else c for c in text.lower()).split()}
    return words | {w[:n] + "*" for w in words for n in (4, 5, 6) if len(w) > n} | {"*" + w[-3:] for w in words if len(w) > 3}


def newton(x, y, weight):
    """A ridge logistic model by Newton steps; the bias is free."""
    a = np.column_stack([x, np.ones(len(x))]).astype(float)
    total, positive = weight.sum(), float(weight @ y)
    w = np.zeros(a.shape[1])
    w[-1] = np.log((positive + 0.5) / (total - positive + 0.5))
    if not positive or positive == total:
        return w
    ridge = np.append(np.full(x.shape[1], toxicity.RIDGE), 0)
    cost = lambda w: weight @ (np.logaddexp(0, a @ w) - y * (a @ w)) + ridge @ (w * w) / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        slope = a.T @ (weight * (p - y)) + ridge * w
        step, size = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-9), slope), 1.0
        while size > 1e-6 and cost(w - size * step) > cost(w):
            size /= 2
        w = w - size * step
    return w


def test_chain_equals_a_plain_one(spark, docs_of):
    draw = np.random.default_rng(5)
    tone = lambda k: {0: "you stupid idiot", 1: "cheap*** pills now", 2: "", 3: "you idiot with cheap*** pills"}[k]
    kinds = draw.choice(4, 500, p=[0.2, 0.2, 0.5, 0.1])
    rows = [(k, f"the day number {k % 90} {tone(kinds[k])} was {'quiet' if draw.random() < 0.5 else 'busy'} w{k}") for k in range(500)]
    rows += [(900 + k, rows[k][1]) for k in range(40)]  # copies share a weight
    said = lambda k, on: int((kinds[k % 900] in on) != (draw.random() < 0.05))
    labelled = [(i, 1 - said(i, (1, 3)), said(i, (0, 3))) for i, _ in rows if i % 4 or i >= 900]
    docs, labels = docs_of(rows), spark.createDataFrame(labelled, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.scored(docs, *toxicity.chain_of(docs, labels)).collect()}

    text = dict(rows)
    sketches = [toxicity.sketch(text[i].encode()) for i, _, _ in labelled]
    folds = {r["s"]: abs(r["f"]) for r in spark.createDataFrame([(s,) for s in set(sketches)], "s long").selectExpr("s", f"hash(s) % {toxicity.FOLDS} AS f").collect()}
    weight = np.array([1 / sketches.count(s) for s in sketches])
    fold = np.array([folds[s] for s in sketches])
    ys = [np.array([q == 0 for _, q, _ in labelled], float), np.array([t == 1 for _, _, t in labelled], float)]
    ys.append(ys[0] * ys[1])
    bags = [plain_words(text[i]) for i, _, _ in labelled]
    words = []
    for y in ys[:2]:
        share, gains = (weight @ y) / weight.sum(), []
        for word in set().union(*bags):
            held = np.array([word in b for b in bags])
            n = weight[held].sum()
            rate = (weight[held] @ y[held] + share) / (n + 1)
            gain = n * (rate * np.log(rate / share) + (1 - rate) * np.log((1 - rate) / (1 - share)))
            if n >= toxicity.LEAST_TEXTS and gain >= toxicity.LEAST_GAIN:
                gains.append((-gain, word))
        words += [w for _, w in sorted(gains)[: toxicity.FEATURES // 2] if w not in words]
    x = np.array([[w in b for w in words] for b in bags], float)
    every = np.array([[w in plain_words(t) for w in words] for _, t in rows], float)
    for c, y in zip(toxicity.CATEGORIES, ys, strict=True):
        add = lambda z, w: 1 / (1 + np.exp(-(z @ w[:-1] + w[-1])))
        p = add(every, newton(x, y, weight))
        assert np.abs(p - np.array([got[i][f"p_{c}"] for i, _ in rows])).max() < 0.03
        out = np.zeros(len(y))
        for k in range(toxicity.FOLDS):
            out[fold == k] = add(x[fold == k], newton(x[fold != k], y[fold != k], weight[fold != k]))
        x, every = np.column_stack([x, out]), np.column_stack([every, p])
    assert sum(r["toxic"] for r in got.values()) > 100
