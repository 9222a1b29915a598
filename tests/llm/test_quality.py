import random
from collections import Counter

from rillstone.llm import quality, registry


def plain(text):
    t = text or ""
    words = t.encode().split()
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if seen[w] > 1 for j in range(5)}
    lines = [x for x in t.encode().split(b"\n") if x.split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_measures_against_brute_force(spark, docs_of, edge):
    draw = random.Random(4)
    rows = [*edge, *((100 + k, " ".join(draw.choices("a b c é|# d\n e\n".split(" "), k=draw.randint(0, 60)))) for k in range(80))]
    got = quality.quality_rules(docs_of(rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in got) == sorted((str(i), *plain(t)) for i, t in rows)
    assert quality.quality_rules(docs_of([])).count() == 0


GOOD = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def test_a_bad_host_goes_and_a_small_one_is_shrunk(spark, docs_of):
    """Rates of bad, null and small: 50/51, 0/500, 1/2."""
    rows = [(k, "short") for k in range(50)] + [(50, GOOD)] + [(100 + k, GOOD + f" {k}") for k in range(500)] + [(700, "short"), (701, GOOD)]
    host = lambda i: "bad" if i <= 50 else None if i < 700 else "small"
    got = {r["doc_id"]: r for r in quality.quality_rules(docs_of(rows, host)).collect()}
    assert not got[50]["base_failed"] and not got[50]["kept"] and got[50]["host_rejected"]
    assert got[701]["kept"] and 0.1 < got[701]["host_rate"] < 0.5 and got[150]["kept"]
    kept = {r["doc_id"] for r in quality.keep_good(spark, docs_of(rows, host), "").collect()}
    assert kept == {i for i, r in got.items() if r["kept"]}


def test_a_host_at_a_third_of_failures_goes_and_those_near_the_corpus_stay(spark, docs_of):
    """Twenty hosts fail at 4 to 9 percent; one, planted, at 35."""
    host = lambda i: f"h{i // 1000}"
    rows = [(1000 * h + k, "short" if k < (70 if h == 20 else 8 + h // 2) else GOOD + f" {h} {k}") for h in range(21) for k in range(200)]
    got = quality.quality_rules(docs_of(rows, host)).collect()
    assert {r["doc_id"] // 1000 for r in got if r["host_rejected"]} == {20}
    assert all(r["kept"] == (not r["base_failed"] and r["doc_id"] < 20000) for r in got)


def test_query_equals_its_sql(spark, sf):
    from oracle import connect, rows

    name = "op3_quality_rules"
    assert rows(registry.queries()[name](spark, sf).toPandas()) == rows(connect(sf).execute(registry.oracle_sql()[name]).df())
