import json

from pyspark.sql import functions as F

from ledgerlark.operators import queues as Q
from ledgerlark.operators import views as V
from ledgerlark.sources import readers, sinks
from ledgerlark.sources.domain import view
from ledgerlark.streaming import feed

SMALL = "/root/testdata/sf0.001"


def ids(df, c="id"):
    return sorted(r[c] for r in df.select(c).collect())


def tables(spark):
    raw = spark.createDataFrame([(i, f"u{i}", "new" if i == 5 else "scraped", None if i == 2 else f"2024-01-0{i}") for i in range(1, 7)], "id long, url string, status string, published_date string")
    art = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False), (6, True)], "item_id long, scrape_success boolean")
    ext = spark.createDataFrame([(1, True), (2, None), (3, False)], "item_id long, summary_complete boolean")
    mas = spark.createDataFrame([(3,)], "item_id long")
    rej = spark.createDataFrame([(3,), (6,)], "item_id long")
    return raw, art, ext, mas, rej


def test_queues(spark):
    raw, art, ext, mas, rej = tables(spark)
    assert ids(Q.triage(raw, art, mas, rej)) == [1, 2]
    assert ids(Q.pending_digest(raw, art, ext, mas, rej)) == [1]
    assert ids(Q.unscraped(raw, art)) == [5]
    assert ids(Q.needs_extraction(raw, art, ext)) == [2, 3, 6]
    assert [r["id"] for r in Q.newest(raw, 6).collect()] == [6, 5, 4, 3, 1, 2]
    r = Q.queue_status(raw, art, ext, mas, rej).collect()[0]
    assert r["scraped"] == 4 and r["pending_triage"] == 1


def test_queue_and_list_are_disjoint(spark):
    raw, art, mas, rej = (view(spark, SMALL, n) for n in ("raw_items", "article_content", "master_list", "rejected_items"))
    assert Q.triage(raw, art, mas, rej).join(mas, F.col("id") == F.col("item_id")).count() == 0


def test_insert_twice_is_insert_once(spark):
    batch = spark.createDataFrame([(1, "a", "first"), (2, "a", "second"), (3, "b", "x"), (4, "c", "y"), (5, "", "z"), (6, None, "n")], "i int, url string, title string")
    stored = spark.createDataFrame([("c",)], "url string")
    once = Q.new_rows(batch, stored, "url", "i")
    assert {(r["url"], r["title"]) for r in once.collect()} == {("", "z"), (None, "n"), ("a", "first"), ("b", "x")}
    again = Q.new_rows(batch.filter("url IS NOT NULL"), stored.unionByName(once.select("url")), "url", "i")
    assert again.count() == 0


def test_upsert_keeps_what_is_kept(spark):
    old = spark.createDataFrame([(1, "a", "old"), (2, "b", "old")], "k int, v string, at string")
    new = spark.createDataFrame([(2, None, "new"), (3, "c", "new")], "k int, v string, at string")
    got = sorted(tuple(r) for r in Q.latest_wins(old, new, "k", kept=("at",)).collect())
    assert got == [(1, "a", "old"), (2, None, "old"), (3, "c", "new")]


def test_evolution_is_idempotent(spark):
    df = spark.createDataFrame([(1,)], "a int")
    once = Q.evolved(df, {"b": "string", "a": "int"})
    assert once.columns == Q.evolved(once, {"b": "string", "a": "int"}).columns == ["a", "b"]


def test_pages(spark):
    for n in (0, 1, 10, 11, 20, 21):
        rows = spark.range(n)
        assert Q.page(rows, 2, 10, "id").count() == max(0, min(10, n - 10))
    assert Q.page(spark.range(21), 1, 10, "id").collect()[0]["pages"] == 3


def test_decisions(spark):
    d = spark.createDataFrame([(1, "accept", "", "f", "x", "t", "s", ["a", "b"], []), (2, "reject", "c", "f", "x", "t", "s", [], []), (3, "accept", "c", "f", "x", "t", "s", [], ["z"])], "item_id long, action string, company string, investors string, investment_amount string, transaction_type string, summary string, capital_sources array<string>, sectors array<string>")
    got = sorted(tuple(r) for r in Q.accepted_from_form(d, spark.createDataFrame([(3,)], "item_id long")).select("item_id", "company", "capital_sources", "sectors").collect())
    assert got == [(1, None, "a,b", None)]
    ext = spark.createDataFrame([(1, "C", "I", "$1", "T", "a", "b", "why")], "item_id long, company string, investors string, deal_amount string, transaction_type string, capital_sources string, sectors string, strategic_significance string")
    items = spark.createDataFrame([(1,), (9,)], "item_id long")
    got = {r["item_id"]: (r["investment_amount"], r["summary"]) for r in Q.accepted_from_link(items, ext, spark.createDataFrame([], "item_id long")).collect()}
    assert got == {1: ("$1", "why"), 9: (None, None)}


def test_search_takes_nothing_as_a_wildcard(spark):
    rows = spark.createDataFrame([("A_b", "x"), ("acb", "y")], "a string, b string")
    assert V.search(rows, "a_B", "a", "b").count() == 1 and V.search(rows, "", "a", "b").count() == 2


def test_tables_gain_columns(spark, tmp_path):
    spark.createDataFrame([(1,)], "item_id long").write.parquet(str(tmp_path / "rejected_items"))
    assert readers.curation_table(spark, str(tmp_path), "rejected_items").collect()[0]["rejection_reason"] is None
    sinks.write_csv(spark.createDataFrame([("a",)], "Date string"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()[0]["Date"] == "a"
    assert {r["name"]: r["present"] for r in readers.present_files(spark, str(tmp_path / "csv"), ["_SUCCESS", "no"]).collect()}["no"] is False


def test_stream_takes_a_url_once(spark, tmp_path):
    source, table, at = (str(tmp_path / x) for x in ("in", "table", "at"))
    (tmp_path / "in").mkdir()

    def land(name, rows):
        (tmp_path / "in" / name).write_text("".join(json.dumps({"url": u, "title": t, "landed": w}) + "\n" for u, t, w in rows))

    land("a.json", [("u1", "first", "2024-01-01T00:00:00Z"), ("u2", "x", "2024-01-01T00:00:01Z")])
    feed.run(spark, source, table, at)
    land("b.json", [("u1", "second", "2024-01-02T00:00:00Z"), ("u3", "y", "2024-01-02T00:00:00Z")])
    feed.run(spark, source, table, at)
    got = {r["url"]: r["title"] for r in spark.read.parquet(table).collect()}
    assert got == {"u1": "first", "u2": "x", "u3": "y"}
