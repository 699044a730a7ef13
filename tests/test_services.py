"""Workbooks, decisions, functions of SQL, and the order in which queries give their rows."""

import io
import zipfile

import pytest
from oracle import SMALL, expected
from pyspark.sql import functions as F

from ledgerlark.functions import registered, rules, urls
from ledgerlark.operators import decisions
from ledgerlark.operators import series as S
from ledgerlark.plans.registry import QUERIES, SQL
from ledgerlark.sources import store, workbooks


def test_workbooks(spark, tmp_path):
    rows = [("Title", "URL", "Date Created", "Summary", "More"), ("A & <b>", "http://a", "2024-01-02", None, 1), (None, "http://b"), ("C", None), (" é ", "http://d", None, "s")]
    (tmp_path / "a.xlsx").write_bytes(workbooks.content("Raw_GA", rows))
    (tmp_path / "other.xlsx").write_bytes(workbooks.content("Sheet & 1", rows))
    (tmp_path / "broken.xlsx").write_bytes(b"PK not a zip")
    found = workbooks.cells(workbooks.files(spark, f"{tmp_path}/*.xlsx"), "Raw_GA")
    errors = {r["file"].rpartition("/")[2]: r["error"].partition(":")[0] for r in found.filter("error IS NOT NULL").collect()}
    assert errors == {"other.xlsx": "KeyError", "broken.xlsx": "BadZipFile"}
    got = workbooks.articles(found).orderBy("row").collect()
    assert [(r["row"], r["title"], r["url"], r["created"], r["summary"]) for r in got] == [(1, "A & <b>", "http://a", "2024-01-02", None), (4, " é ", "http://d", None, "s")]
    assert workbooks.articles(found.limit(0)).count() == 0


def test_fixed_ranges_and_shared_strings(spark):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="X" r:id="a"/><sheet name="Y" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/one.xml"/><Relationship Id="b" Target="/xl/worksheets/two.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>plain</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>')
        z.writestr("xl/worksheets/one.xml", f'<worksheet xmlns="{main}"/>')
        z.writestr("xl/worksheets/two.xml", f'<worksheet xmlns="{main}"><sheetData><row r="3"><c r="B3" t="s"><v>1</v></c><c r="AA3"><v>2.5</v></c></row><row r="17"><c r="C17"><v>2020</v></c><c r="D17"><v>-10.9</v></c></row><row><c r="C18"><v>2021</v></c><c r="D18"><f>1+1</f><v>7.2</v></c></row><row r="20"><c r="C20"><v>2022</v></c></row></sheetData></worksheet>')
    assert list(workbooks.sheet_cells(out.getvalue(), "Y"))[:2] == [(2, 1, "rich"), (2, 26, "2.5")] and not list(workbooks.sheet_cells(out.getvalue(), "X"))
    found = workbooks.cells(spark.createDataFrame([("f", out.getvalue())], "file string, content binary"), "Y")
    got = workbooks.fixed_range(found, (16, 18), 2, {"v": 3}).orderBy("year").collect()
    assert [tuple(r) for r in got] == [("f", 2020, -10.0), ("f", 2021, 7.0)]


def test_decisions(spark, tmp_path):
    home = str(tmp_path)
    form = "item_id long, action string, company string, investors string, investment_amount string, transaction_type string, summary string, capital_sources array<string>, sectors array<string>, reason string"
    rows = [(1, "accept", "A", "", None, "IPO", "s", ["x", "y"], [], ""), (2, "reject", *[None] * 7, ""), (3, "reject", *[None] * 7, "dull"), (1, "accept", "B", *[None] * 7), (4, "wait", *[None] * 8)]
    forms = spark.createDataFrame(rows, form)
    master, rejected = decisions.tables(home, 4)
    for _ in range(2):
        decisions.post(spark, home, forms, "f1", 4)
    (one,) = store.stored(spark, master).collect()
    assert (one["item_id"], one["investors"], one["transaction_type"], one["capital_sources"], one["published"]) == (1, None, "IPO", "x,y", False)
    why = lambda: {r["item_id"]: r["rejection_reason"] for r in store.stored(spark, rejected).collect()}
    assert why() == {2: None, 3: "dull"}
    links = spark.createDataFrame([(True, 5, "approve"), (True, 3, "reject"), (False, 6, "approve"), (True, 7, "reject"), (False, None, None)], "valid boolean, item_id long, action string")
    ext = spark.createDataFrame([(5, "E", "i", "$1M", "M&A", "c", "s", "why")], "item_id long, company string, investors string, deal_amount string, transaction_type string, capital_sources string, sectors string, strategic_significance string")
    for _ in range(2):
        decisions.follow(spark, home, links, ext, "l1", 4)
    assert why() == {2: None, 3: "dull", 7: "Rejected via email"}
    assert {r["item_id"]: (r["company"], r["summary"], r["human_notes"]) for r in store.stored(spark, master).filter("item_id <> 1").collect()} == {5: ("E", "why", "Approved via email")}
    decisions.undo(spark, home, links.select("item_id"), 4)
    assert why() == {2: None}


def test_functions_of_sql(spark):
    assert {"extract_domain", "percent_change"} <= set(registered.register(spark))
    said = ["http://www.a.co/x", "https://www.google.com/url?a=b&url=http%3A%2F%2Fwww.b.co%2Fy%2Bz", "https://www.google.com/url?url=", "ftp://c:80", "no url", "", None, "https://google.com/url?url=http%3A%2F%2Fd.co%3Fq%3D%252B1", "https://www.google.com/search?url=http%3A%2F%2Fe.co", "https://www.google.com/url?url=%zz"]
    df = spark.createDataFrame([(u,) for u in said], "u string")
    got = df.select(urls.source_domain("u").alias("a"), F.expr("extract_domain(u)").alias("b"), urls.unwrapped("u").alias("c"), F.expr("extract_real_url(u)").alias("d"), F.expr("size(extract_urls(u))").alias("n"))
    assert all(r["a"] == r["b"] and r["c"] == r["d"] for r in got.collect())
    numbers = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (None, 1.0), (3.0, -1.5), (2.0, 2.0)], "a double, b double").select(F.expr("percent_change(a, b)").alias("p"))
    assert [r["p"] for r in numbers.collect()] == [-50.0, None, None, -300.0, 0.0]
    same = numbers.select(F.expr("change_class(p)").alias("a"), rules.sign_class("p").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in same)


def test_the_observation_before(spark):
    rows = [("a", d, float(v)) for d, v in ((3, 1), (1, 2), (2, 3), (2, 2))] + [("b", 1, None), ("b", 2, 5.0), ("c", 9, 9.0)]
    got = S.with_previous(spark.createDataFrame(rows, "series string, date long, value double").repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted([("a", 1, 2.0, None), ("a", 2, 2.0, 2.0), ("a", 2, 3.0, 2.0), ("a", 3, 1.0, 3.0), ("b", 1, None, None), ("b", 2, 5.0, None), ("c", 9, 9.0, None)], key=repr)


#: Queries whose rows come in an order, with it, and with columns that tell the rows apart.
ORDERED = {
    "triage_queue": ("published_date DESC NULLS LAST, id", ["id"]),
    "recent_items": ("date_found DESC, id", ["id", "n"]),
    "master_view": ("curated_at DESC NULLS LAST, item_id", ["item_id"]),
    "rejected_view": ("rejected_at DESC NULLS LAST, item_id", ["item_id"]),
    "csv_export": ('"Date" DESC, "Source URL"', ["Source URL"]),
    "deal_cards": ("published_date DESC NULLS LAST, item_id", ["item_id"]),
    "sort_mixed": ("number NULLS LAST, cell, p_partkey", ["p_partkey"]),
}


@pytest.mark.parametrize("name", sorted(ORDERED))
def test_rows_come_in_order(spark, name):
    order, columns = ORDERED[name]
    want = expected(f"SELECT * FROM ({SQL[name]}) q ORDER BY {order}")
    got = QUERIES[name](spark, SMALL).select(*[f"`{c}`" for c in columns]).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want[columns].itertuples(index=False, name=None)] and len(got) > 1


def test_digest_comes_in_order(spark):
    sql = SQL["pending_digest"]
    assert [r["item_id"] for r in QUERIES["pending_digest"](spark, SMALL).collect()] == list(expected(sql)["item_id"])
