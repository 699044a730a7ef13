"""Queries over workbooks, tables that are created and filled, posted decisions, commands, and functions of SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from .. import commands
from ..functions import registered, tokens
from ..operators import decisions
from ..operators import queues as Q
from ..operators import series as S
from ..sources import landing, readers, schemas, sinks, store, workbooks
from ..sources.domain import base, view, with_views
from .base import query


def _workbooks(rows, key: str, header: tuple, sheet: str):
    """file, content: a workbook for each value of key, with a header and key's rows, by their first column. rows: key, cells (array of strings, numbers as such)."""

    def made(group: pd.DataFrame) -> pd.DataFrame:
        cells = [[None if c is None else int(c) if c.isdigit() else float(c) if c.replace(".", "", 1).replace("-", "", 1).isdigit() else c for c in r] for r in sorted(map(list, group["cells"]), key=lambda r: r[0])]
        return pd.DataFrame({"file": [str(group[key].iloc[0])], "content": [workbooks.content(sheet, [header, *cells])]})

    return rows.groupBy(key).applyInPandas(made, "file string, content binary")


_YEARLY = "SELECT o_orderstatus, year(o_orderdate) AS y, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS total, count(*) AS n FROM orders GROUP BY 1, 2"


@query(f"""
WITH y AS ({_YEARLY}), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY y) AS place FROM y)
SELECT o_orderstatus AS file, series, CAST(make_date(y, 12, 31) AS VARCHAR) AS date, CASE series WHEN 'total' THEN trunc(CAST(total AS DOUBLE)) ELSE CAST(n AS DOUBLE) END AS value
FROM r, (VALUES ('total'), ('n')) s(series) WHERE place BETWEEN 2 AND 5""")
def workbook_figures(spark, sf_dir):
    """A fixed range of a sheet of each of several workbooks, as points on the years' last days; figures lose their fractions."""
    orders = base(spark, sf_dir, "orders").groupBy("o_orderstatus", F.year("o_orderdate").alias("y")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"), F.count(F.lit(1)).alias("n"))
    rows = orders.select("o_orderstatus", F.array(F.col("y").cast("string"), F.lit(None).cast("string"), F.col("total").cast("string"), F.col("n").cast("string")).alias("cells"))
    found = workbooks.cells(_workbooks(rows, "o_orderstatus", ("years", None, "a", "b"), "Sheet3"), "Sheet3")
    wide = workbooks.fixed_range(found, (2, 5), 0, {"total": 2, "n": 3})
    points = wide.unpivot(["file", "year"], ["total", "n"], "series", "value")
    return points.select("file", "series", F.make_date("year", F.lit(12), F.lit(31)).cast("string").alias("date"), "value")


#: Numbers of pages whose articles go to the same four workbooks.
_SHEET = 10_000


def _book(page: str):
    """The workbook of a page: a sheet ends at 1,048,576 rows, so more pages fill more books, not longer ones."""
    return F.concat_ws("-", F.col(page) % 4, F.floor(F.col(page) / _SHEET))


_LISTED = "SELECT page_id, page_id % 4 AS book, url FROM pages WHERE url <> '' AND page_id % 5 <> 0"


@query(f"""
WITH p AS ({_LISTED}), s AS (SELECT DISTINCT url FROM pages WHERE page_id % 9 = 0), n AS (SELECT DISTINCT url FROM p WHERE page_id % 7 <> 0 AND url NOT IN (SELECT url FROM s WHERE url IS NOT NULL))
SELECT (SELECT count(*) FROM n) AS imported, (SELECT count(*) FROM p WHERE page_id % 7 <> 0) - (SELECT count(*) FROM n) AS skipped""")
def import_articles(spark, sf_dir):
    """Articles of several workbooks by their headers, of which those without a title are left out, counted against the stored ones."""
    pages = base(spark, sf_dir, "pages")
    title = F.when(F.col("page_id") % 7 != 0, F.concat(F.lit("Page "), F.col("page_id").cast("string")))
    rows = pages.filter("url <> '' AND page_id % 5 <> 0").select(_book("page_id").alias("book"), F.array(F.col("url"), title, F.lit("2024-01-02")).alias("cells"))
    found = workbooks.articles(workbooks.cells(_workbooks(rows, "book", ("URL", "Title", "Date Created"), "Raw_GA"), "Raw_GA"))
    split = Q.split_batch(found.select("file", "row", "url"), pages.filter("page_id % 9 = 0").select("url"), "url", "file", "row")
    return split.agg(F.count_if("is_new").alias("imported"), F.count_if(~F.col("is_new")).alias("skipped"))


@query(with_views("SELECT id, url, status, relevance_score, NULL AS relevance_flags, false AS made_again FROM raw_items", "raw_items"))
def created_tables(spark, sf_dir):
    """Tables are created where they are missing, filled, and not created again; a column that the files lack is NULL."""
    at = landing.folder(spark)
    for name, schema in schemas.TABLES.items():
        sinks.created(spark, at, name, schema)
    wanted = ("url string", "title string", "rss_summary string", "status string", "relevance_score double")
    rows = view(spark, sf_dir, "raw_items").select(F.col("id").cast("long").alias("id"), *[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in wanted])
    sinks.write_table(rows, f"{at}/raw_items")
    again = sinks.created(spark, at, "raw_items", schemas.RAW_ITEMS)
    return readers.curation_table(spark, at, "raw_items").select("id", "url", "status", "relevance_score", "relevance_flags", F.lit(again).alias("made_again"))


_POSTED = """p AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'reject' ELSE 'accept' END AS action, company FROM ai_extractions WHERE item_id % 2 = 0),
l AS (SELECT item_id, CASE WHEN item_id % 4 = 1 THEN 'approve' ELSE 'reject' END AS action, company FROM ai_extractions WHERE item_id % 2 = 1 AND item_id % 5 <> 0)"""


@query(with_views(f"""
WITH {_POSTED}
SELECT item_id, 'master' AS name, nullif(company, '') AS said FROM p WHERE action = 'accept'
UNION ALL SELECT item_id, 'master', company FROM l WHERE action = 'approve'
UNION ALL SELECT item_id, 'rejected', 'off topic' FROM p WHERE action = 'reject' AND item_id % 12 <> 0
UNION ALL SELECT item_id, 'rejected', 'Rejected via email' FROM l WHERE action = 'reject'""", "ai_extractions"))
def posted_decisions(spark, sf_dir):
    """Forms and signed links decide on items, the forms come twice, some links have expired, some rejections are taken back; then both tables."""
    home, ext = landing.folder(spark), view(spark, sf_dir, "ai_extractions")
    none = F.array().cast("array<string>")
    forms = ext.filter("item_id % 2 = 0").select("item_id", F.when(F.col("item_id") % 3 == 0, "reject").otherwise("accept").alias("action"), "company", "investors", F.col("deal_amount").alias("investment_amount"), "transaction_type", F.lit("").alias("summary"), none.alias("capital_sources"), none.alias("sectors"), F.lit("off topic").alias("reason"))
    for _ in range(2):
        decisions.post(spark, home, forms, "forms-1", 8)
    now, secret = 1_700_100_000, "test-secret"
    action = F.when(F.col("item_id") % 4 == 1, "approve").otherwise("reject")
    links = ext.filter("item_id % 2 = 1").select(tokens.signed("item_id", action, F.lit(now) - F.when(F.col("item_id") % 5 == 0, 90_000).otherwise(60), secret).alias("t"))
    decisions.follow(spark, home, links.select(tokens.verdict("t", F.lit(now), secret).alias("v")).select("v.*"), ext, "links-1", 8)
    decisions.undo(spark, home, ext.filter("item_id % 12 = 0").select("item_id"), 8)
    master, rejected = (store.stored(spark, t) for t in decisions.tables(home, 8))
    return master.select("item_id", F.lit("master").alias("name"), F.col("company").alias("said")).unionByName(rejected.select("item_id", F.lit("rejected").alias("name"), F.col("rejection_reason").alias("said")))


@query("""
WITH p AS (SELECT url, page_id FROM pages WHERE url <> ''), a AS (SELECT DISTINCT url FROM p WHERE page_id % 2 = 0), b AS (SELECT DISTINCT url FROM p)
SELECT 'first' AS said, (SELECT count(*) FROM a) AS n UNION ALL SELECT 'first duplicate', (SELECT count(*) FROM p WHERE page_id % 2 = 0) - (SELECT count(*) FROM a)
UNION ALL SELECT 'second', (SELECT count(*) FROM b) - (SELECT count(*) FROM a) UNION ALL SELECT 'second duplicate', (SELECT count(*) FROM p) - (SELECT count(*) FROM b) + (SELECT count(*) FROM a)
UNION ALL SELECT 'landed', (SELECT count(*) FROM b) UNION ALL SELECT 'status', (SELECT count(*) FROM b)""")
def command_runs(spark, sf_dir):
    """The fetcher's command over landed feeds, and again over more of them; then what the commands for numbers and status say."""
    home, feeds = landing.folder(spark), landing.folder(spark)
    escaped = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    entries = base(spark, sf_dir, "pages").filter("url IS NOT NULL").select("page_id", F.concat(F.lit("<entry><title>t</title><link>"), escaped, F.lit("</link></entry>")).alias("value"))
    out = []
    for k, name in enumerate(("first", "second")):
        some = entries.filter(F.col("page_id") % 2 == k).groupBy(F.floor(F.col("page_id") / 50)).agg(F.array_join(F.collect_list("value"), "").alias("x"))  # 25 entries a document
        some.select(F.concat(F.lit("<feed>"), "x", F.lit("</feed>")).alias("value")).write.option("maxRecordsPerFile", 1).text(f"{feeds}/{name}")
        got = commands.run(spark, ["rss_fetcher", home, f"{feeds}/*"]).first()
        out += [(name, got["new"]), (f"{name} duplicate", got["duplicate"])]
    out.append(("landed", commands.run(spark, ["view_data", home, "stats"]).first()["items"]))
    out.append(("status", commands.run(spark, ["queue_status", home]).first()["total"]))
    return spark.createDataFrame(out, "said string, n long")


@query("""
SELECT page_id, CASE WHEN h = '' THEN 'source' ELSE h END AS domain, url AS real, 1 AS links
FROM (SELECT page_id, url, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^www[.]', '') AS h FROM pages WHERE url LIKE 'http%')""")
def sql_functions(spark, sf_dir):
    """The column functions as functions of SQL; each page's URL stands in a search engine's redirect too."""
    registered.register(spark)
    pages = base(spark, sf_dir, "pages").filter("url LIKE 'http%'")
    return spark.sql(
        "SELECT page_id, extract_domain(concat('https://www.google.com/url?q=1&url=', url_encode(url))) AS domain, extract_real_url(concat('https://www.google.com/url?url=', url_encode(url_encode(url)))) AS real, size(extract_urls(concat('see ', url, ' now'))) AS links FROM {pages}",
        pages=pages,
    )


@query(with_views("""
WITH r AS (SELECT series, date, value, lag(value) OVER (PARTITION BY series ORDER BY date, value) AS before FROM daily)
SELECT series, CAST(date AS VARCHAR) AS date, 100 * ((value - before) / nullif(before, 0)) AS change, CASE WHEN value - before > 0 AND before > 0 OR value - before < 0 AND before < 0 THEN 'positive' WHEN value = before AND before <> 0 THEN 'neutral' WHEN before <> 0 THEN 'negative' END AS class FROM r""", "daily"))
def point_changes(spark, sf_dir):
    """Each point's change against the one before, by the functions of SQL."""
    registered.register(spark)
    rows = S.with_previous(view(spark, sf_dir, "daily"))
    return rows.select("series", F.col("date").cast("string").alias("date"), F.expr("percent_change(value, before)").alias("change")).withColumn("class", F.expr("change_class(change)"))
