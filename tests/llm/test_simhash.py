import random
from itertools import combinations

import pytest
import xxhash

from rillstone.llm import simhash


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(prints, 2):
        if (a ^ b).bit_count() <= 2:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


def test_documents_against_brute_force(spark, docs_of, edge):
    draw = random.Random(2)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [" ".join(draw.choices(vocabulary, k=300)) for _ in range(5)]
    rows = [*edge]
    for k in range(60):
        words = draw.choice(base).split()
        words[draw.randrange(300)] = draw.choice(vocabulary)
        rows.append((100 + k, " ".join(words)))
    got = simhash.near_duplicates(docs_of(rows)).collect()
    prints = {plain(t) for _, t in rows}
    roots = components(prints)
    least = {}
    for i, t in rows:
        if i is not None:
            r = roots[plain(t)]
            least[r] = min(i, least.get(r, i))
    want = sorted((str(i), f"{plain(t):016x}", str(least.get(roots[plain(t)]))) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want


@pytest.mark.parametrize("bucket", [2, 64])
def test_links_connect_what_brute_force_connects(spark, bucket):
    """Small buckets take the way of whole-fingerprint balls, large ones the way of pairs."""
    draw = random.Random(3)
    prints = {0, 1, 3, 7, 1 << 63, (1 << 64) - 1}
    for _ in range(12):
        x = draw.getrandbits(64)
        for _ in range(draw.randint(1, 25)):
            prints.add(x)
            for _ in range(draw.randint(1, 3)):
                x ^= 1 << draw.randrange(64)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    edges = simhash.links(frame, bucket=bucket)
    found = {(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in edges.collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in found)
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    want = components(prints)
    same = lambda f, x, y: f(x) == f(y)
    of = lambda p: got.get(signed(p), signed(p))
    for a, b in combinations(prints, 2):
        assert same(of, a, b) == same(want.get, a, b)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 500), (900, 901)], "u long, v long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert {got[k] for k in range(1, 201)} == {0} and got[901] == 900 and 500 not in got


def test_one_of_each_component_stays(spark, docs_of):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (2, "q r s t u v w"), (2, "q r s t u v w"), (None, "a b c d e f"), (None, "lonely text without an id"), (9, None), (8, "")]
    kept = simhash.keep_one(spark, docs_of(rows), "")
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["1", "2", "8", "None"]
    assert kept.columns == docs_of(rows).columns
    assert simhash.keep_one(spark, docs_of([]), "").count() == 0


def jaccard(a, b):
    a, b = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("bucket", [2, 64])
def test_near_copies_of_the_stage_against_all_pairs(spark, docs_of, bucket, monkeypatch):
    """Chains of edited copies from J = 1 to well below 0.8, most of them farther apart than two bits."""
    monkeypatch.setattr(simhash, "near_roots", lambda docs, prints, f=simhash.near_roots: f(docs, prints, bucket))
    draw = random.Random(5)
    vocabulary = [f"w{k}" for k in range(900)]
    rows = []
    for _ in range(4):
        base = draw.choices(vocabulary, k=200)
        for _ in range(15):
            words = list(base)
            for _ in range(draw.choice([1, 2, 3, 4, 6, 12])):
                words[draw.randrange(200)] = draw.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    near = [(a, b) for a, b in combinations(range(len(rows)), 2) if jaccard(rows[a][1], rows[b][1]) >= 0.8]
    assert any((plain(rows[a][1]) ^ plain(rows[b][1])).bit_count() > 2 for a, b in near)
    root = list(range(len(rows)))
    for _ in rows:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    kept = simhash.keep_one(spark, docs_of(rows), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))


@pytest.mark.parametrize("seed", range(3))
def test_groups_by_their_hearts_against_all_pairs(spark, docs_of, seed):
    """Copies of one or two bases, copies of copies, from one word changed to most; and texts without words."""
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(40 + 400 * seed)}"
    bases = [[word() for _ in range(180)]]
    bases.append([w if k < 148 else word() for k, w in enumerate(bases[0])])
    texts = ["", " "] + [" ".join(b) for b in bases[seed % 2 :]]
    for _ in range(110):
        words = draw.choice([*bases[seed % 2 :], draw.choice(texts).split() or bases[1]])[: draw.choice([180, 180, 140])]
        for _ in range(draw.choice([1, 1, 2, 3, 5, 30])):
            words = [*words]
            words[draw.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts = sorted(set(texts))
    nodes = docs_of(list(enumerate(texts))).select("text", simhash._node().alias("node"))
    sets = simhash.shingle_sets(nodes, nodes.select("node"))
    name = {r["node"]: r["text"] for r in nodes.collect()}
    edges = [(name[r["u"]], name[r["v"]]) for r in simhash.group_edges(sets.selectExpr("7L AS grp", "node", "hashes", "size"), sets).collect()]
    near = [(a, b) for a, b in combinations(texts, 2) if jaccard(a, b) >= 0.8]
    assert len(near) > 100 and set(map(frozenset, edges)) <= set(map(frozenset, near))

    def parts(links):
        root = {t: t for t in texts}
        find = lambda t: t if root[t] == t else find(root[t])
        for a, b in links:
            root[find(a)] = find(b)
        return {frozenset(t for t in texts if find(t) == r) for r in texts} - {frozenset()}

    assert parts(edges) == parts(near)


def test_rows_of_one_id_with_other_texts_are_kept_apart(spark, docs_of):
    rows = [(1, "a b c d e f g"), (1, "q r s t u v w"), (1, "q r s t u v w"), (2, "a b c d e f g")]
    got = simhash.keep_one(spark, docs_of(rows), "").select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == [(1, "a b c d e f g"), (1, "q r s t u v w")]


def test_sketches_rule_out_no_similar_pair(spark, docs_of):
    """Every pair of texts from far below to above the similarity, the border included, against plain sets."""
    draw = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base[: 60 - k] + [f"x{draw.randrange(10**6)}" for _ in range(k)]) for k in range(24)] + [""]
    docs = docs_of(list(enumerate(texts)))
    nodes = docs.select("text", simhash._node().alias("node"))
    node = {r["text"]: r["node"] for r in nodes.collect()}
    pairs = [(node[a], node[b]) for a, b in combinations(texts, 2)]
    got = simhash.similar(spark.createDataFrame(pairs, "u long, v long"), simhash.shingle_sets(docs, nodes.select("node").distinct())).collect()
    assert {(r["u"], r["v"]) for r in got} == {(node[a], node[b]) for a, b in combinations(texts, 2) if jaccard(a, b) >= 0.8}


def test_the_stage_links_by_fingerprints(spark, docs_of):
    """A text that is mostly one repeated line: its fingerprint is that of the line, the sets of shingles are not similar."""
    line = "one two three four five six seven eight nine ten eleven "
    rows = [(1, line * 400), (2, line * 400 + " ".join(f"w{k}" for k in range(60))), (3, "another text with words of its own that nothing else has here"), (4, None), (5, " \n")]
    fp = simhash.fingerprints_of([r[1].encode() if r[1] else b"" for r in rows], simhash.STAGE_SHINGLE)
    assert int(fp[0] ^ fp[1]).bit_count() <= 2 and fp[3] == fp[4] == 0
    edges = simhash.print_edges(simhash.banded(docs_of(rows))).collect()
    assert len(edges) == 2 and len({x for e in edges for x in e}) == 4
    assert sorted(r["doc_id"] for r in simhash.keep_one(spark, docs_of(rows), "").collect()) == [1, 3, 4]


def test_short_batches_end_with_their_block(spark):
    import pyarrow as pa

    from rillstone.llm import common

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with common.short_batches(spark):
        sizes = spark.range(0, 2500, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"id": [b.num_rows]}) for b in batches), "id long").collect()
        assert max(r["id"] for r in sizes) == common.BATCH
    assert spark.conf.get(name) == before


def _broadcast_explodes(plan):
    """The lines of an executed plan that explode rows for a broadcast, without an exchange in between."""
    found, inside = [], []
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        while inside and inside[-1][0] >= depth:
            inside.pop()
        if "Exchange" in line and "ReusedExchange" not in line:
            inside.append((depth, "BroadcastExchange" in line))
        elif "Generate explode" in line and inside and inside[-1][1]:
            found.append(line.strip())
    return found


def test_exploded_rows_are_not_broadcast(spark, docs_of, monkeypatch):
    """Spark sizes them by their input: at 0.6 GB the balls of all fingerprints, 1,275 MB, went through the driver."""
    plans = []

    def seen(write):
        def run(df, *rest):
            out = write(df, *rest)
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return out

        return run

    for name in ("cut", "table"):
        monkeypatch.setattr(simhash, name, seen(getattr(simhash, name)))
    draw = random.Random(4)
    words = [f"w{k}" for k in range(900)]
    rows = []
    for _ in range(3):
        base = draw.choices(words, k=120)
        rows += [(len(rows) + k, " ".join([*base[:k], f"x{k}", *base[k + 1 :]])) for k in range(30)]
    docs = docs_of(rows)
    prints = simhash.banded(docs)
    simhash.near_roots(docs, prints, 4)
    star_links = simhash.links(simhash.cut(prints.select("fp").distinct()), bucket=1)
    plans.append(star_links._jdf.queryExecution().executedPlan().toString())
    assert star_links.count() > 0 and any("BroadcastExchange" in p for p in plans) and any("Generate explode" in p for p in plans)
    assert [x for p in plans for x in _broadcast_explodes(p)] == []
