from ledgerlark.llm import exact_dedup as E
from ledgerlark.llm import url_filter as U


def test_dedup_rows(spark, odd):
    got = E.exact_dedup(odd)
    assert got.count() == odd.count()
    by = {}
    for r in got.collect():
        by.setdefault(r["text_sha256"], []).append(r)
    assert sum(r["kept"] for rows in by.values() for r in rows) == len(by)
    empty = [r for rows in by.values() for r in rows if r["keep_id"] == 1]
    assert len(empty) == 2 and {r["doc_id"] for r in empty} == {None, 1}
    assert {r["doc_id"] for rows in by.values() for r in rows if r["group_size"] == 1} == {2**60 + 1, None, 7, 8}
    assert E.exact_dedup(odd.limit(0)).count() == 0


def test_blanks(spark):
    rows = [(3, "a b"), (2, "a \t\n b"), (1, "a\x0bb"), (4, " a b"), (5, "ab"), (6, "a\u00a0b")]
    got = {r["doc_id"]: r["keep_id"] for r in E.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}


def test_many_rows_with_one_id_and_text(spark, monkeypatch):
    monkeypatch.setattr(E, "LOT", 3)
    rows = [(None, "a")] * 10 + [(4, "a")] * 3 + [(5, "a")] * 4 + [(6, "b")] * 7 + [(7, "c")]
    got = E.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    seen = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got.collect()), key=repr)
    want = [(None, 4, 17, False)] * 10 + [(4, 4, 17, i == 0) for i in range(3)] + [(5, 4, 17, False)] * 4 + [(6, 6, 7, i == 0) for i in range(7)] + [(7, 7, 1, True)]
    assert seen == sorted(want, key=repr)


def test_urls(spark):
    rows = [
        (1, "HTTP://WWW.Example.ORG/en/148?x#y"), (2, "https://example.org/es/"), (3, "https://notexample.org/es/x"), (4, "https://a.com/fr/"), (5, "https://a.com/FR/"), (6, "https://a.com"), (7, None),
        (8, "no scheme"), (9, "x://y://z.org/a"), (10, "http://spam-farm.net/a"), (11, "http://cheap-pills.org/a"), (12, "http://org"), (13, "http://org/"), (14, "http://a.com/de/x\ny"), (15, ""), (1, "http://a.com:80/de/"),
    ]
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in U.url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect() if r["page_id"] is not None)
    want = [
        (1, "a.com:80", "/de/", None, "allow"), (1, "www.example.org", "/en/148", "example.org/en/1", "allow"), (2, "example.org", "/es/", "example.org/es/", "block"), (3, "notexample.org", "/es/x", "org/", "allow"),
        (4, "a.com", "/fr/", "com/fr/", "allow"), (5, "a.com", "/FR/", None, "allow"), (6, "a.com", "", None, "allow"), (7, "", "", None, "allow"), (8, "", "", None, "allow"), (9, "y:", "//z.org/a", None, "allow"),
        (10, "spam-farm.net", "/a", None, "block"), (11, "cheap-pills.org", "/a", "org/", "allow"), (12, "org", "", None, "allow"), (13, "org", "/", "org/", "allow"), (14, "a.com", "/de/x\ny", "com/de/", "block"), (15, "", "", None, "allow"),
    ]
    assert [tuple(x if x is not None else "" for x in g) for g in got] == sorted(tuple(x if x is not None else "" for x in w) for w in want)


def test_no_pages_and_many_rules(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a.com/de/")], "page_id long, url string")
    assert U.url_filter(pages.limit(0)).count() == 0
    monkeypatch.setattr(U, "BROADCAST_RULES", 0)
    assert U.url_filter(pages).collect()[0]["rule"] == "com/de/"


def test_ties_long_urls_and_clashing_columns(spark):
    """Of two rules of one rank the one with the least name decides; other columns, whatever their names, play no part."""
    rows = [(1, "http://casino.porn.net/", "x", 1), (2, "http://porn.casino.net/", None, None), (3, "http://a.com/" + "torrent/a" * 40_000 + "/torrent/x", "y", 2), (4, "http://" + "a." * 50_000 + "com/de/", "z", 3)]
    got = {r["page_id"]: r for r in U.url_filter(spark.createDataFrame(rows, "page_id long, url string, token string, row int")).collect()}
    assert [got[i]["pattern"] for i in range(1, 5)] == ["host:casino", "host:casino", "path:torrent", "com/de/"] and got[4]["rule"] == "com/de/"
    odd = spark.createDataFrame([(1, "http://a.com/de/", "h", "p", "r", "v", "n", 1)], "page_id long, url string, host string, path string, rule string, verdict string, name string, row int")
    assert [tuple(r) for r in U.url_filter(odd).collect()] == [(1, "a.com", "/de/", "com/de/", "block", "com/de/")]
