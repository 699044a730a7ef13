"""Queries over files that are landed first, over payloads, forms and workbooks, and over what they write."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import forms, numbers, text
from ..operators import fetching, messages
from ..operators import queues as Q
from ..operators import series as S
from ..operators.intervals import inside
from ..sources import landing, readers, schemas, sinks
from ..sources.dimensions import values_sql
from ..sources.domain import base, view, with_views
from .base import query


def _landed(spark, lines) -> str:
    """A folder with one text file that holds these lines."""
    at = landing.folder(spark)
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(at)
    return at


@query(with_views("SELECT series, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS pos, CAST(date AS VARCHAR) AS date, value FROM monthly", "monthly"))
def series_files(spark, sf_dir):
    """A1, A2, B1: a JSON file for each series is written, and the files are read together."""
    names = spark.createDataFrame([(x, x, x, x) for x in "FOP"], "series string, name string, description string, units string")
    at = landing.folder(spark)
    sinks.write_series(sinks.series_documents(view(spark, sf_dir, "monthly"), names, "2024-01-01"), at)
    points = readers.series_points(readers.series_documents(spark, [f"{at}/series={x}" for x in "fop"]))
    return points.select("series", F.col("pos").cast("long").alias("pos"), F.col("date").cast("string").alias("date"), "value")


@query(with_views("SELECT s.series, 4 AS series_count, count(m.series) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(series) LEFT JOIN monthly m ON m.series = s.series GROUP BY s.series", "monthly"))
def manifest_file(spark, sf_dir):
    """The manifest as it is written and read again; it counts the configured series, also those that nothing came of."""
    at = landing.folder(spark)
    sinks.manifest(view(spark, sf_dir, "monthly"), spark.createDataFrame([(x,) for x in "FOPX"], "series string"), "2024-01-01").write.json(at)
    return spark.read.schema(schemas.MANIFEST).json(at).select("series_count", F.explode("series").alias("series", "n"))


_SLUMPS = (("1993-02-01", "1993-08-31", "one"), ("1996-01-01", "1996-03-01", "two"))


@query(with_views("WITH " + values_sql("v", "a, b, label", _SLUMPS) + " SELECT m.series, CAST(m.date AS VARCHAR) AS date, v.label FROM monthly m JOIN v ON m.date BETWEEN CAST(v.a AS DATE) AND CAST(v.b AS DATE)", "monthly"))
def recession_file(spark, sf_dir):
    """Points inside the intervals of a landed document, both ends included."""
    at = _landed(spark, [json.dumps({"recessions": [{"start": a, "end": b, "label": x} for a, b, x in _SLUMPS]})])
    spans = readers.recessions(spark, at)
    points = view(spark, sf_dir, "monthly")
    return inside(points, spans, how="inner").select("series", F.col("date").cast("string").alias("date"), "label")


_PAYLOADS = """to_json(named_struct('message', named_struct(
  'text', CASE page_id % 4 WHEN 3 THEN '/status' WHEN 2 THEN 'nothing here' ELSE concat('see ', url, ' or a.co/x') END,
  'caption', CASE WHEN page_id % 4 < 2 THEN concat(url, CASE WHEN page_id % 4 = 0 THEN repeat(concat(' https://b.co/', CAST(page_id AS STRING)), 4) ELSE '' END) END,
  'chat', named_struct('id', page_id), 'from', named_struct('id', page_id % 7),
  'entities', CASE WHEN page_id % 4 < 2 THEN array(named_struct('type', 'url', 'offset', 4, 'length', length(url)), named_struct('type', 'url', 'offset', 4 + length(url) + 4, 'length', 6), named_struct('type', 'bold', 'offset', 0, 'length', 3)) END)))"""


def _payloads(spark, sf_dir):
    """Updates in a landed file, one in a line; those of the users 1 and 3 come from the allowed ones."""
    at = landing.folder(spark)
    base(spark, sf_dir, "pages").select(F.expr(_PAYLOADS).alias("value")).write.text(at)
    return messages.intake(spark.read.text(at), "0,1,3,4", column="value")


_TAKEN = """SELECT page_id AS chat_id, CASE page_id % 4 WHEN 3 THEN 'status' WHEN 2 THEN 'none' ELSE 'links' END AS command,
  CASE page_id % 4 WHEN 0 THEN [url, 'a.co/x', url, concat('https://b.co/', page_id), concat('https://b.co/', page_id)] WHEN 1 THEN [url, 'a.co/x', url] ELSE [] END AS links,
  CASE WHEN page_id % 4 = 0 THEN 2 ELSE 0 END AS more FROM pages WHERE page_id % 7 IN (0, 1, 3, 4)"""


@query(f"SELECT chat_id, command, array_to_string(links, ' ') AS links, more FROM ({_TAKEN}) t")
def webhook_links(spark, sf_dir):
    """Links of landed updates, from texts, entities and captions; five of a message are taken."""
    return _payloads(spark, sf_dir).select("chat_id", "command", F.array_join("links", " ").alias("links"), "more")


_QUEUED = f"""WITH t AS ({_TAKEN}), r AS (SELECT DISTINCT chat_id, unnest(links) AS url FROM t WHERE command = 'links'),
q AS (SELECT chat_id, url, chat_id = min(chat_id) OVER (PARTITION BY url) AND url NOT IN (SELECT url FROM pages WHERE page_id % 5 = 0) AS is_new FROM r)"""


def _queued(spark, sf_dir):
    taken = _payloads(spark, sf_dir)
    return taken, messages.queued(taken, base(spark, sf_dir, "pages").filter("page_id % 5 = 0"))


@query(f"{_QUEUED} SELECT chat_id, url, is_new FROM q")
def webhook_queue(spark, sf_dir):
    """The links of updates as rows for the queue; a URL enters once, and not if it is stored."""
    return _queued(spark, sf_dir)[1]


@query(f"""{_QUEUED} SELECT t.chat_id, CASE t.command WHEN 'links' THEN concat('Added ', count(*) FILTER (q.is_new), ', known ', count(*) FILTER (NOT q.is_new)) WHEN 'none' THEN 'No links found' ELSE concat('/', t.command) END AS reply
FROM t LEFT JOIN q ON q.chat_id = t.chat_id GROUP BY t.chat_id, t.command""")
def webhook_replies(spark, sf_dir):
    """What each update is answered with."""
    return messages.replies(*_queued(spark, sf_dir))


_FORM = "concat('action=', CASE item_id % 3 WHEN 0 THEN 'reject' ELSE 'accept' END, '&company=', company, '+%26+Co&sectors=AI%2FML&sectors=Other&note=&reason=off%20topic')"
_FORM_ROWS = "SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'reject' ELSE 'accept' END AS action, concat(company, ' & Co') AS company FROM ai_extractions WHERE company IS NOT NULL"


def _forms(spark, sf_dir):
    posted = view(spark, sf_dir, "ai_extractions").filter("company IS NOT NULL").select("item_id", F.expr(_FORM.replace("company,", "replace(company, ' ', '+'),")).alias("f"))
    one = {c: forms.scalar("f", c) for c in ("action", "company", "note", "missing", "reason")}
    return posted.select("item_id", *[x.alias(c) for c, x in one.items()], forms.repeated("f", "sectors").alias("sectors"), forms.repeated("f", "capital_sources").alias("capital_sources"))


@query(with_views(f"SELECT item_id, action, company, '' AS note, '' AS missing, 'off topic' AS reason, 'AI/ML|Other' AS sectors, 0 AS sources FROM ({_FORM_ROWS}) x", "ai_extractions"))
def form_fields(spark, sf_dir):
    """Fields of posted forms, single ones and lists of a repeated key."""
    return _forms(spark, sf_dir).select("item_id", "action", "company", "note", "missing", "reason", F.array_join("sectors", "|").alias("sectors"), F.size("capital_sources").alias("sources"))


@query(with_views(f"SELECT item_id, 'off topic' AS rejection_reason FROM ({_FORM_ROWS}) x WHERE action = 'reject' AND item_id NOT IN (SELECT item_id FROM rejected_items)", "ai_extractions", "rejected_items"))
def reject_by_form(spark, sf_dir):
    """Reject decisions as rows to add; an item is rejected once."""
    rows = _forms(spark, sf_dir).filter("action = 'reject'").select("item_id", F.nullif("reason", F.lit("")).alias("rejection_reason"))
    return Q.new_rows(rows, view(spark, sf_dir, "rejected_items"), "item_id", "rejection_reason")


@query(with_views("SELECT item_id, company, deal_amount AS investment_amount, sectors, strategic_significance AS summary, 'Approved via email' AS human_notes FROM ai_extractions WHERE item_id % 2 = 0 AND item_id NOT IN (SELECT item_id FROM master_list)", "ai_extractions", "master_list"))
def accept_by_link(spark, sf_dir):
    """Items accepted by a link, with their extractions' fields; those in the list already stay as they are."""
    ext, mas = view(spark, sf_dir, "ai_extractions"), view(spark, sf_dir, "master_list")
    rows = Q.accepted_from_link(ext.filter("item_id % 2 = 0").select("item_id"), ext, mas)
    return rows.select("item_id", "company", "investment_amount", "sectors", "summary", "human_notes")


@query(with_views("SELECT series, CAST(date AS VARCHAR) AS date, CASE WHEN month(date) % 5 = 0 OR month(date) % 7 = 0 THEN value / 2 ELSE value END AS loose, CASE WHEN month(date) % 5 = 0 THEN 0 WHEN month(date) % 7 = 0 THEN value / 2 ELSE value END AS strict FROM monthly", "monthly"))
def falsy_values(spark, sf_dir):
    """C4, Q1: the value, or the close where it is missing or, as loosely typed readers have it, zero."""
    points = view(spark, sf_dir, "monthly").withColumn("close", F.col("value") / 2)
    points = points.withColumn("value", F.when(F.month("date") % 5 == 0, 0.0).when(F.month("date") % 7 == 0, F.lit(None)).otherwise(F.col("value")))
    return points.select("series", F.col("date").cast("string").alias("date"), S.observed("value", "close", falsy_zero=True).alias("loose"), S.observed("value", "close").alias("strict"))


def _cut_sql(n: int) -> str:
    return f"CASE WHEN length(text) <= {n + 5} THEN text ELSE concat(regexp_replace(substring(text, 1, {n - 3}), ' [^ ]*$', '', 's'), '...') END AS cut_{n}"


_CUTS = (50, 80, 500, 1500, 8000)


@query(f"SELECT doc_id, {_cut_sql(300)}, {_cut_sql(1000)}, {', '.join(f'length(substring(text, 1, {n})) AS first_{n}' for n in _CUTS)} FROM documents")
def text_cuts(spark, sf_dir):
    """Texts cut at a word, and prefixes."""
    cuts = [text.truncated("text", n).alias(f"cut_{n}") for n in (300, 1000)]
    return base(spark, sf_dir, "documents").select("doc_id", *cuts, *[F.length(F.substring("text", 1, n)).cast("long").alias(f"first_{n}") for n in _CUTS])


@query("SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS grouped, concat('$', format('{:,}', CAST(floor(o_totalprice) AS BIGINT))) AS dollars, concat('-$', format('{:,}', CAST(floor(o_totalprice) AS BIGINT))) AS owed FROM orders")
def number_formats(spark, sf_dir):
    """L2, L3: thousands and whole dollars."""
    whole = F.floor("o_totalprice")
    return base(spark, sf_dir, "orders").select("o_orderkey", numbers.grouped("o_totalprice").alias("grouped"), numbers.dollars(whole).alias("dollars"), numbers.dollars(-whole).alias("owed"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def struct_times(spark, sf_dir):
    """Six numbers of a time to a timestamp."""
    ts = F.col("ts")
    six = F.array(*[f(ts) for f in (F.year, F.month, F.dayofmonth, F.hour, F.minute)], F.second(ts))
    made = F.make_timestamp(*[F.col("t")[i] for i in range(6)])
    return base(spark, sf_dir, "events").select("event_id", six.alias("t")).select("event_id", F.date_format(made, "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT event_id, concat('axis=y|color=', event_type, '|title=', CASE WHEN event_id % 2 = 0 THEN 'own' ELSE 'default' END) AS options FROM events")
def merged_options(spark, sf_dir):
    """M7: options over defaults; the later ones hold."""
    first = F.create_map(F.lit("title"), F.lit("default"), F.lit("axis"), F.lit("y"))
    own = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("title"), F.lit("own"), F.lit("color"), F.col("event_type"))).otherwise(F.create_map(F.lit("color"), F.col("event_type")))
    both = base(spark, sf_dir, "events").select("event_id", forms.merged(first, own).alias("o"))
    return both.select("event_id", F.array_join(F.array_sort(F.transform(F.map_entries("o"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|").alias("options"))


@query(with_views("SELECT count(*) AS total_items FROM (SELECT id FROM raw_items WHERE id IN (SELECT item_id FROM article_content WHERE scrape_success) AND id NOT IN (SELECT item_id FROM master_list) AND id NOT IN (SELECT item_id FROM rejected_items) LIMIT 50) x", "raw_items", "article_content", "master_list", "rejected_items"))
def page_total(spark, sf_dir):
    """A page's total counts what the page holds, after its limit."""
    raw, art, mas, rej = (view(spark, sf_dir, n) for n in ("raw_items", "article_content", "master_list", "rejected_items"))
    return Q.newest(Q.triage(raw, art, mas, rej), 50).agg(F.count(F.lit(1)).alias("total_items"))


def _service(name: str) -> str:
    """A stand-in for a service: one series fails, one has no points."""
    if name == "3":
        raise TimeoutError("no answer")
    return json.dumps({"series_id": name, "data": [{"date": f"2024-01-{d:02d}", "value": d} for d in range(1, 1 + (0 if name == "4" else int(name) % 10))]})


@query("SELECT CAST(s_suppkey AS VARCHAR) AS series, CASE WHEN s_suppkey IN (3, 4) THEN 0 ELSE s_suppkey % 10 END AS n, CASE WHEN s_suppkey = 3 THEN 'TimeoutError: no answer' END AS error FROM supplier")
def fetched_series(spark, sf_dir):
    """Documents of a service, one for each name; a failure is counted as no points and stays with its name."""
    got = fetching.fetched(base(spark, sf_dir, "supplier"), "s_suppkey", _service)
    counts = fetching.counted(got, "s_suppkey", schemas.SERIES)
    return counts.join(got.select("s_suppkey", "error"), "s_suppkey").select(F.col("s_suppkey").alias("series"), F.col("n").cast("long").alias("n"), "error")


def _web(url: str) -> str:
    """A stand-in for pages: those under /a/ only forward."""
    if "/a/" in url:
        return f'<html><head><meta http-equiv="refresh" content="0;url={url.replace("/a/", "/b/")}"></head></html>'
    if url.endswith("7"):
        raise ConnectionError("HTTP 404")
    return f"<p>page {url}</p>"


@query("""
SELECT url, final, CASE WHEN final LIKE '%7' THEN NULL ELSE concat('page ', final) END AS clean_text, CASE WHEN final LIKE '%7' THEN 'ConnectionError: HTTP 404' END AS error
FROM (SELECT concat('http://x/', CASE WHEN s_suppkey % 2 = 0 THEN 'a' ELSE 'c' END, '/', s_suppkey) AS url, concat('http://x/', CASE WHEN s_suppkey % 2 = 0 THEN 'b' ELSE 'c' END, '/', s_suppkey) AS final FROM supplier) x""")
def followed_pages(spark, sf_dir):
    """Pages fetched, one forwarding hop followed, cleaned; failures stay with their URL."""
    from ..functions.html import clean_html

    key = F.col("s_suppkey")
    names = base(spark, sf_dir, "supplier").select(F.concat(F.when(key % 2 == 0, "http://x/a/").otherwise("http://x/c/"), key.cast("string")).alias("url"))
    got = fetching.followed(names.withColumnRenamed("url", "asked"), "asked", _web)
    return got.select(F.col("asked").alias("url"), F.col("url").alias("final"), clean_html("document").alias("clean_text"), "error")
