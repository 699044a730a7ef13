"""Queries over what arrives and what changes: streams, batches, failures of single sources, versions of series, feeds and documents in files."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..operators import queues as Q
from ..operators import series as S
from ..sources import documents, landing, readers, sinks, store
from ..sources.domain import base, view, with_views
from ..streaming import feed
from .base import query
from .landed_queries import _PAYLOADS, _TAKEN


@query("SELECT url, min(page_id % 3) AS slice FROM pages WHERE url <> '' GROUP BY url")
def incremental_intake(spark, sf_dir):
    """Pages land in three slices, the first of them twice; a stream takes in what is there, stops, and goes on where it stopped."""
    at = landing.folder(spark)
    table = store.Table(f"{at}/table", "url string, slice long", "url", 8)
    pages = base(spark, sf_dir, "pages").select("url", (F.col("page_id") % 3).cast("long").alias("slice"))

    def land(part: int, name: str) -> None:
        landed = F.expr(f"timestamp '2024-01-01 00:00:00' + interval {part} hours")
        pages.filter(F.col("slice") == part).withColumn("landed", landed).write.json(f"{at}/landed/{name}")

    for names in (((0, "a"), (1, "b")), ((0, "again"), (2, "c"))):
        for part, name in names:
            land(part, name)
        feed.intake(spark, f"{at}/landed/*", table, f"{at}/checkpoint")
    return store.stored(spark, table)


@query(f"""
WITH t AS ({_TAKEN}), r AS (SELECT chat_id, unnest(links) AS url FROM t WHERE command = 'links')
SELECT url, coalesce(min(chat_id) FILTER (chat_id % 2 = 0), min(chat_id)) AS chat_id FROM r GROUP BY url""")
def streamed_updates(spark, sf_dir):
    """Chat updates land as lines in two lots, and a third time the first; a stream takes in the links of allowed users, once per URL."""
    at = landing.folder(spark)
    table = store.Table(f"{at}/table", "url string, chat_id long", "url", 8)
    lines = base(spark, sf_dir, "pages").select((F.col("page_id") % 2).alias("lot"), F.expr(_PAYLOADS).alias("value"))
    for lots in ((0,), (1, 0)):
        for lot in lots:
            lines.filter(F.col("lot") == lot).select("value").write.text(f"{at}/landed/{len(lots)}-{lot}")
        feed.intake_updates(spark, f"{at}/landed/*", table, f"{at}/checkpoint", "0,1,3,4")
    return store.stored(spark, table)


@query(with_views("""
SELECT s.source, CASE WHEN s.source IN ('O', 'X') THEN 0 ELSE (SELECT count(*) FROM monthly m WHERE m.series = s.source) END AS n,
       CASE s.source WHEN 'O' THEN 'malformed document' WHEN 'X' THEN 'no document' WHEN 'E' THEN 'no data' END AS error
FROM (VALUES ('F'), ('O'), ('P'), ('X'), ('E')) s(source)""", "monthly"))
def failed_sources(spark, sf_dir):
    """A landed document is cut short, one has no data, and one never came; their sources count nothing and say why, the others are whole."""
    at = landing.folder(spark)
    names = spark.createDataFrame([(x, x, x, x) for x in "FOP"], "series string, name string, description string, units string")
    made = sinks.series_documents(view(spark, sf_dir, "monthly"), names, "2024-01-01").select(F.col("series_id").alias("series"), F.to_json(F.struct("*")).alias("value"))
    cut = F.when(F.col("series") == "O", F.substring("value", 1, 300)).otherwise(F.col("value"))
    bare = spark.createDataFrame([("E", '{"series_id": "E"}')], "series string, value string")
    made.withColumn("value", cut).unionByName(bare).write.partitionBy("series").text(at)
    return readers.series_outcomes(readers.named_documents(spark, at), spark.createDataFrame([(x,) for x in "FOPXE"], "source string"))


_QUOTES = "SELECT date_trunc('month', o_orderdate) AS m, min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) AS volume FROM orders GROUP BY 1"


@query(with_views(f"""
SELECT series, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS pos, CAST(date AS VARCHAR) AS date, value, NULL::DOUBLE AS open, NULL::DOUBLE AS high, NULL::DOUBLE AS low, NULL::DOUBLE AS close, NULL::BIGINT AS volume, NULL AS error FROM monthly
UNION ALL SELECT 'ORD', row_number() OVER (ORDER BY m) - 1, CAST(CAST(m AS DATE) AS VARCHAR), NULL, low, high, low, high, volume, NULL FROM ({_QUOTES}) q
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'JSONDecodeError'""", "monthly"))
def source_points(spark, sf_dir):
    """A3, A4, A5: documents of values and of quotes, and one that is cut short, through a data source that reads each in a task of its own."""
    at = landing.folder(spark)
    names = spark.createDataFrame([(x, x, x, x) for x in "FOP"], "series string, name string, description string, units string")
    sinks.write_series(sinks.series_documents(view(spark, sf_dir, "monthly"), names, "2024-01-01"), f"{at}/values")
    quotes = spark.sql(_QUOTES.replace("FROM orders", "FROM {orders}"), orders=base(spark, sf_dir, "orders"))
    points = quotes.select(F.struct(F.date_format("m", "yyyy-MM-dd").alias("date"), F.col("low").alias("open"), "high", "low", F.col("high").alias("close"), "volume").alias("p"))
    ticker = points.agg(F.array_sort(F.collect_list("p")).alias("data")).select(F.to_json(F.struct(F.lit("ORD").alias("ticker"), "data")).alias("value"))  # one document
    whole = ticker.withColumn("series", F.lit("ord"))
    whole.unionByName(whole.select(F.substring("value", 1, 40).alias("value"), F.lit("cut").alias("series"))).write.partitionBy("series").text(f"{at}/quotes")
    documents.register(spark)
    return spark.read.format("series_documents").option("path", at).load().drop("source")


_UPDATES = "SELECT item_id + CASE WHEN item_id % 8 = 0 THEN 1000000 ELSE 0 END AS item_id, 'updated' AS company, '$1M' AS deal_amount FROM ai_extractions WHERE item_id % 4 = 0"


@query(with_views(f"""
WITH u AS ({_UPDATES})
SELECT coalesce(o.item_id, u.item_id) AS item_id, coalesce(u.company, o.company) AS company, CASE WHEN o.item_id IS NOT NULL THEN o.deal_amount ELSE u.deal_amount END AS deal_amount, o.sectors
FROM ai_extractions o FULL JOIN u ON u.item_id = o.item_id WHERE coalesce(o.item_id, u.item_id) % 5 <> 3""", "ai_extractions"))
def committed_batches(spark, sf_dir):
    """Extractions in a bucketed table; a batch of updates is applied, and once more, items are taken out, and the table is read back."""
    table = store.Table(landing.folder(spark), "item_id long, company string, deal_amount string, sectors string", "item_id", 16)
    old = view(spark, sf_dir, "ai_extractions").select("item_id", "company", "deal_amount", "sectors")
    store.insert(spark, table, old, mark="first")
    key = F.col("item_id") + F.when(F.col("item_id") % 8 == 0, 1_000_000).otherwise(0)
    updates = old.filter("item_id % 4 = 0").select(key.alias("item_id"), F.lit("updated").alias("company"), F.lit("$1M").alias("deal_amount"))
    for _ in range(2):
        store.upsert(spark, table, updates, kept=("deal_amount",), mark="second")
    store.remove(spark, table, store.stored(spark, table).filter("item_id % 5 = 3").select("item_id"), mark="third")
    return store.stored(spark, table)


@query(with_views("""
SELECT r.id, CASE WHEN a.item_id IS NULL THEN 'new' WHEN a.scrape_success THEN 'scraped' ELSE 'failed' END AS status FROM raw_items r LEFT JOIN article_content a ON a.item_id = r.id""", "raw_items", "article_content"))
def status_updates(spark, sf_dir):
    """Items enter as new; a scraping batch, applied by two runs that overlap, sets the status of what it scraped."""
    table = store.Table(landing.folder(spark), "id long, status string", "id", 16)
    raw, art = view(spark, sf_dir, "raw_items").select("id", F.lit("new").alias("status")), view(spark, sf_dir, "article_content")
    store.insert(spark, table, raw)
    scraped = art.select(F.col("item_id").alias("id"), F.when(F.col("scrape_success"), "scraped").otherwise("failed").alias("status"))
    store.upsert(spark, table, scraped.filter("id % 3 <> 0"), mark="batch-1")
    store.upsert(spark, table, scraped.filter("id % 3 <> 1"), mark="batch-2")
    return store.stored(spark, table)


@query("""
WITH s AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE doc_id % 2 = 0), b AS (SELECT md5(text) AS h FROM documents WHERE doc_id % 2 = 1)
SELECT count(*) AS seen, count(DISTINCT h) FILTER (h NOT IN (SELECT h FROM s WHERE h IS NOT NULL)) AS new, count(*) - count(DISTINCT h) FILTER (h NOT IN (SELECT h FROM s WHERE h IS NOT NULL)) AS duplicate FROM b""")
def observed_intake(spark, sf_dir):
    """A batch's counters are observed by the write that takes it in; the batch is read once."""
    rows = base(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    seen, taken = Observation(), Observation()
    batch = rows.filter("doc_id % 2 = 1").observe(seen, F.count(F.lit(1)).alias("n"))
    fresh = Q.new_rows(batch.filter("h IS NOT NULL"), rows.filter("doc_id % 2 = 0"), "h", "doc_id").observe(taken, F.count(F.lit(1)).alias("n"))
    fresh.write.parquet(landing.folder(spark))
    return spark.createDataFrame([(seen.get["n"], taken.get["n"], seen.get["n"] - taken.get["n"])], "seen long, new long, duplicate long")


_VINTAGES = """o AS (SELECT * FROM daily UNION ALL SELECT 'gone', date, value FROM daily WHERE month(date) = 1),
n AS (SELECT series, date, CASE WHEN series = 'purchase' AND month(date) = 2 THEN value + 1 ELSE value END AS value FROM daily UNION ALL SELECT series, date, value FROM daily WHERE series = 'click' AND day(date) = 9 UNION ALL SELECT 'come', date, value FROM daily WHERE month(date) = 1)"""


@query(with_views(f"""
WITH {_VINTAGES}, k AS (SELECT series FROM o UNION SELECT series FROM n)
SELECT series, (SELECT count(*) FROM o WHERE o.series = k.series) AS rows_old, (SELECT count(*) FROM n WHERE n.series = k.series) AS rows_new,
       EXISTS (SELECT * FROM ((SELECT * FROM o EXCEPT ALL SELECT * FROM n) UNION ALL (SELECT * FROM n EXCEPT ALL SELECT * FROM o)) d WHERE d.series = k.series) AS changed
FROM k""", "daily"))
def changed_series(spark, sf_dir):
    """Which series of two versions differ, by fingerprints: one with other values, one with rows twice, one that is gone and one that came."""
    daily = view(spark, sf_dir, "daily")
    january = lambda name: daily.filter("month(date) = 1").withColumn("series", F.lit(name))
    old = daily.unionByName(january("gone"))
    value = F.when((F.col("series") == "purchase") & (F.month("date") == 2), F.col("value") + 1).otherwise(F.col("value"))
    new = daily.withColumn("value", value).unionByName(daily.filter("series = 'click' AND day(date) = 9")).unionByName(january("come"))
    return S.changed_series(S.fingerprints(old), new)


#: Pages in a made-up feed document.
_FEED = 20


def _feed_documents(spark, sf_dir, at: str) -> None:
    """Feeds of pages as files, RSS and Atom in turn; every seventh document ends in the midst of its last entry."""
    escaped = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    pages = base(spark, sf_dir, "pages").filter("url IS NOT NULL").withColumn("feed", F.floor(F.col("page_id") / _FEED))
    n = F.col("page_id").cast("string")
    rss = F.concat(F.lit("<item><title><![CDATA[Page "), n, F.lit("]]></title><link>"), escaped(F.col("url")), F.lit("</link><description>of &lt;p&gt; "), n, F.lit("</description><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item>"))
    atom = F.concat(F.lit('<entry><link rel="self" href="http://self/"/><link href="'), escaped(F.col("url")), F.lit('"/><updated>2024-01-02T05:04:05+02:00</updated><summary type="html">of &lt;p&gt; '), n, F.lit("</summary></entry>"))
    entries = pages.select("feed", "page_id", F.when(F.col("feed") % 2 == 0, rss).otherwise(atom).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "x"))), lambda e: e["x"]), "\n")
    whole = F.when(F.col("feed") % 2 == 0, F.concat(F.lit('<rss version="2.0"><channel><title>t</title>\n'), "body", F.lit("</channel></rss>"))).otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title>\n'), "body", F.lit("</feed>")))
    cut = F.when(F.col("feed") % 7 == 3, F.regexp_replace(whole, r"(?s)</(item|entry)>\s*</(channel></rss|feed)>\s*$", "")).otherwise(whole)
    entries.groupBy("feed").agg(body.alias("body")).select(cut.alias("value")).write.option("maxRecordsPerFile", 1).text(at)


_KEPT = f"""SELECT *, page_id // {_FEED} AS feed, row_number() OVER (PARTITION BY page_id // {_FEED} ORDER BY page_id DESC) AS back FROM pages WHERE url IS NOT NULL"""


@query(f"""
WITH p AS ({_KEPT})
SELECT CASE WHEN feed % 2 = 0 THEN concat('Page ', page_id) ELSE 'No title' END AS title, url, concat('of <p> ', page_id) AS summary, '2024-01-02 03:04:05' AS published, 'landed' AS feed_source,
       CASE WHEN feed % 7 = 3 THEN 'not well-formed' END AS warning
FROM p WHERE feed % 7 <> 3 OR back > 1""")
def feeds_in_files(spark, sf_dir):
    """RSS and Atom documents in files; a broken one is a warning, and its whole entries are kept."""
    at = landing.folder(spark)
    _feed_documents(spark, sf_dir, at)
    landed = readers.feed_documents(spark, at)
    items = readers.feed_items(landed, "landed").join(landed.select("file", "warning"), "file")
    return items.select("title", "url", "summary", F.date_format(F.col("published").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("published"), "feed_source", "warning")
