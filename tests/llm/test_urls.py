from rillstone.llm import bloom, registry, urls

PAGES = [
    (1, "https://WWW.Sub.Example.org/en/12?x#y"), (2, "http://a.org"), (3, "http://a.com/de/x"), (4, "http://a.com/fr/x"), (5, None), (6, "no scheme"), (7, ""), (8, "ftp://bad.net/p.html#t"),
    (9, "https://www.bad.net/p/?utm_source=q"), (9, "https://www.bad.net/p/?utm_source=q"), (10, "http://good.net/p"), (11, "http://notexample.org/es/1"), (12, "http://x.example.org/es/1"), (13, "http://u://v/w"),
]


def test_rules_and_list(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string").selectExpr("*", "'z' AS host", "'z' AS canonical", "'z' AS listed", "1 AS _hit")
    listed = spark.createDataFrame([("bad.net/p",), (None,), ("bad.net/p",)], "url string")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judged(pages, listed).collect()}
    assert urls.judged(pages, listed).count() == len(PAGES)
    assert got[1] == ("www.sub.example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("a.org", "", None, "allow")
    assert got[3][2:] == ("com/de/", "block") and got[4][2:] == ("com/fr/", "allow")
    assert got[5] == got[6] == got[7] == ("", "", None, "allow")
    assert got[8] == ("bad.net", "/p.html", None, "block") and got[9] == ("www.bad.net", "/p/", None, "block") and got[10][3] == "allow"
    assert got[11][2:] == ("org/", "allow") and got[12][2:] == ("example.org/es/", "block") and got[13][0] == "u:"
    assert {r["verdict"] for r in urls.judged(pages, listed.limit(0)).filter("rule IS NULL").collect()} == {"allow"}
    assert urls.judged(pages.limit(0), listed).count() == 0


def test_the_filter_never_misses_and_its_errors_go(spark):
    keys = spark.range(3000).selectExpr("concat('k', id) AS k")
    probes = spark.range(20000).selectExpr("concat('k', id) AS k")
    small = bloom.built(keys, "k", 3000, max_blocks=16)
    hits = {r["k"] for r in bloom.tested(probes, "k", *small).filter("_hit").collect()}
    assert {f"k{i}" for i in range(3000)} <= hits and len(hits) > 3000
    exact = urls.in_list(probes, "k", keys)
    assert exact.count() == 20000 and exact.filter("listed").count() == 3000


def test_query_equals_its_sql(spark, sf):
    from oracle import connect, rows

    name = "op6_url_filter"
    assert rows(registry.queries()[name](spark, sf).toPandas()) == rows(connect(sf).execute(registry.oracle_sql()[name]).df())
