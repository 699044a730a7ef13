"""Queries over the items' way: queues, counts, curated views, changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import queues as Q
from ..operators import views as V
from ..sources.domain import base, view, with_views
from .base import query

_TABLES = ("raw_items", "article_content", "ai_extractions", "master_list", "rejected_items")


def _t(spark, sf_dir, *names):
    return [view(spark, sf_dir, n) for n in names or _TABLES]


def case_sql(text: str, table, otherwise: str) -> str:
    """A rule table as a CASE."""
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(upper({text}), '{w}')''' for w in words)} THEN '{name}'" for name, words in table) + f" ELSE {otherwise} END"


def label_sql(curated: str, legacy: str, extracted: str) -> str:
    parts = [f"WHEN coalesce({x}, '') <> '' THEN {case_sql(x, t, f'upper({x})')}" for x, t in ((curated, rules.CURATED_LABELS), (legacy, rules.LEGACY_LABELS), (extracted, rules.LEGACY_LABELS))]
    return "CASE " + " ".join(parts) + " ELSE 'UNKNOWN' END"


def badge_sql(curated: str, legacy: str, extracted: str) -> str:
    badges = lambda t: [(rules.BADGES.get(name, "badge-secondary"), words) for name, words in t]
    parts = [f"WHEN coalesce({x}, '') <> '' THEN {case_sql(x, badges(t), chr(39) + 'badge-secondary' + chr(39))}" for x, t in ((curated, rules.CURATED_LABELS), (legacy, rules.LEGACY_LABELS), (extracted, rules.LEGACY_LABELS))]
    return "CASE " + " ".join(parts) + " ELSE 'badge-secondary' END"


_OPEN = "id IN (SELECT item_id FROM article_content WHERE scrape_success) AND id NOT IN (SELECT item_id FROM master_list) AND id NOT IN (SELECT item_id FROM rejected_items)"


@query(with_views(f"SELECT id, url, published_date, feed_source FROM raw_items WHERE {_OPEN} ORDER BY published_date DESC NULLS LAST, id LIMIT 50", *_TABLES))
def triage_queue(spark, sf_dir):
    """The first 50 of the queue (the page's size)."""
    raw, art, _, mas, rej = _t(spark, sf_dir)
    return Q.newest(Q.triage(raw, art, mas, rej).select("id", "url", "published_date", "feed_source"), 50)


@query(with_views(f"""
SELECT r.id, r.title, length(a.clean_text) AS text_length, e.company AS ai_company, e.item_id IS NOT NULL AS has_extraction, coalesce(e.summary_complete, false) AS complete
FROM raw_items r LEFT JOIN article_content a ON a.item_id = r.id LEFT JOIN ai_extractions e ON e.item_id = r.id
WHERE {_OPEN.replace('id IN (', 'r.id IN (').replace('id NOT', 'r.id NOT')}""", *_TABLES))
def triage_queue_decorated(spark, sf_dir):
    """The whole queue with what is known of each item."""
    raw, art, ext, mas, rej = _t(spark, sf_dir)
    rows = Q.with_content(Q.triage(raw, art, mas, rej), art, ext)
    return rows.select("id", "title", F.length("clean_text").cast("long").alias("text_length"), "ai_company", "has_extraction", F.coalesce("summary_complete", F.lit(False)).alias("complete"))


_DIGEST = f"""
SELECT r.id AS item_id, r.title, e.company, e.deal_amount, coalesce(nullif(e.transaction_type, ''), nullif(e.deal_type, '')) AS deal_type, e.sectors,
       coalesce(nullif(e.strategic_significance, ''), nullif(e.ai_summary, '')) AS summary, r.url, r.relevance_score
FROM raw_items r JOIN ai_extractions e ON e.item_id = r.id AND e.summary_complete
WHERE {_OPEN.replace('id IN (', 'r.id IN (').replace('id NOT', 'r.id NOT')} ORDER BY r.published_date DESC NULLS LAST, r.id LIMIT 20"""


@query(with_views(_DIGEST, *_TABLES))
def pending_digest(spark, sf_dir):
    """The digest's 20 items (its default size)."""
    raw, art, ext, mas, rej = _t(spark, sf_dir)
    return V.digest(Q.newest(Q.pending_digest(raw, art, ext, mas, rej), 20))


@query(with_views(f"""
WITH d AS ({_DIGEST.replace('LIMIT 20', '')})
SELECT item_id, coalesce(nullif(company, ''), 'Unknown Company') AS company, CASE WHEN length(title) > 100 THEN substr(title, 1, 100) || '...' ELSE title END AS title,
       CASE WHEN summary <> '' THEN substr(summary, 1, 200) || '...' END AS summary,
       coalesce(array_to_string(list_transform(string_split(nullif(sectors, ''), ',')[1:3], lambda x: trim(x)), '|'), '') AS sectors,
       CASE WHEN relevance_score IS NULL OR relevance_score = 0 THEN NULL WHEN relevance_score >= 0.5 THEN '#4caf50' WHEN relevance_score >= 0.3 THEN '#ff9800' ELSE '#f44336' END AS colour
FROM d""", *_TABLES))
def digest_projection(spark, sf_dir):
    """The texts of all pending items."""
    raw, art, ext, mas, rej = _t(spark, sf_dir)
    return V.digest_lines(V.digest(Q.pending_digest(raw, art, ext, mas, rej)))


@query(with_views("SELECT id, url FROM raw_items WHERE status = 'new' AND id NOT IN (SELECT item_id FROM article_content)", "raw_items", "article_content"))
def unscraped_queue(spark, sf_dir):
    """D9, C6, G6."""
    return Q.unscraped(*_t(spark, sf_dir, "raw_items", "article_content")).select("id", "url")


@query(with_views("SELECT r.id, r.url FROM raw_items r JOIN article_content a ON a.item_id = r.id AND a.scrape_success LEFT JOIN ai_extractions e ON e.item_id = r.id WHERE e.item_id IS NULL OR e.summary_complete = false OR e.summary_complete IS NULL", *_TABLES[:3]))
def needs_extraction(spark, sf_dir):
    """D5, C7, G6."""
    return Q.needs_extraction(*_t(spark, sf_dir, *_TABLES[:3])).select("id", "url")


@query(with_views("""
SELECT m.item_id, r.title, m.curated_at, coalesce(a.scrape_success, false) AS scraped, coalesce(e.summary_complete, false) AS ai_processed, coalesce(m.summary, '') <> '' AS curated
FROM master_list m JOIN raw_items r ON r.id = m.item_id LEFT JOIN article_content a ON a.item_id = m.item_id LEFT JOIN ai_extractions e ON e.item_id = m.item_id""", *_TABLES))
def master_view(spark, sf_dir):
    """D2, D10, G4, C19."""
    raw, art, ext, mas, _ = _t(spark, sf_dir)
    return Q.newest(V.master_rows(mas, raw, art, ext), by="curated_at", key="item_id")


@query(with_views("""
SELECT j.item_id, r.title, j.rejected_at, coalesce(nullif(j.rejection_reason, ''), 'No reason') AS reason, length(a.clean_text) AS text_length
FROM rejected_items j JOIN raw_items r ON r.id = j.item_id LEFT JOIN article_content a ON a.item_id = j.item_id""", *_TABLES))
def rejected_view(spark, sf_dir):
    """D3, D10, G4, E11."""
    raw, art, _, _, rej = _t(spark, sf_dir)
    return Q.newest(V.rejected_rows(rej, raw, art), by="rejected_at", key="item_id")


@query(with_views("""
SELECT r.id, r.title, r.url, r.status, length(a.clean_text) AS text_length, substr(a.clean_text, 1, 2000) AS preview, e.company AS ai_company
FROM raw_items r LEFT JOIN article_content a ON a.item_id = r.id LEFT JOIN ai_extractions e ON e.item_id = r.id WHERE r.id = 7""", *_TABLES))
def item_detail(spark, sf_dir):
    """The item with id 7."""
    return V.item(*_t(spark, sf_dir, *_TABLES[:3]), 7)


@query(with_views("SELECT id, substr(title, 1, 60) AS title, feed_source, date_found, row_number() OVER (ORDER BY date_found DESC, id) AS n FROM raw_items ORDER BY date_found DESC, id LIMIT 10", "raw_items"))
def recent_items(spark, sf_dir):
    """The ten newest (the list's default), numbered."""
    ten = Q.newest(view(spark, sf_dir, "raw_items"), 10, by="date_found")
    return Q.page(ten, 1, 10, F.desc_nulls_last("date_found"), "id").select("id", F.substring("title", 1, 60).alias("title"), "feed_source", "date_found", F.col("row").alias("n"))


@query(with_views("""
SELECT coalesce(r.published_date, 'N/A') AS "Date", coalesce(nullif(m.company, ''), 'N/A') AS "Company", coalesce(nullif(m.investment_amount, ''), 'Not disclosed') AS "Investment Amount",
       coalesce(nullif(m.capital_type, ''), 'N/A') AS "Capital Type", coalesce(nullif(m.sector, ''), 'N/A') AS "Sector", coalesce(nullif(m.location, ''), 'N/A') AS "Location",
       coalesce(nullif(m.project_type, ''), 'N/A') AS "Project Type", coalesce(nullif(m.summary, ''), 'N/A') AS "Summary", r.url AS "Source URL"
FROM master_list m JOIN raw_items r ON r.id = m.item_id""", "raw_items", "master_list"))
def csv_export(spark, sf_dir):
    """D2, B3, C15, J1, G3."""
    raw, mas = _t(spark, sf_dir, "raw_items", "master_list")
    return V.csv_rows(mas, raw).orderBy(F.desc("Date"), "Source URL")


_CARDS = f"""
SELECT m.item_id, {label_sql('m.transaction_type', 'm.deal_type', 'e.deal_type')} AS label, {badge_sql('m.transaction_type', 'm.deal_type', 'e.deal_type')} AS badge,
       coalesce(strftime(CAST(r.published_date AS DATE), '%b %d, %Y'), 'Date unknown') AS shown_date, r.published_date, coalesce(nullif(m.company, ''), nullif(e.company, '')) AS company,
       coalesce(nullif(m.investment_amount, ''), nullif(e.deal_amount, '')) AS amount, coalesce(nullif(m.investors, ''), nullif(e.investors, '')) AS investors,
       coalesce(nullif(m.capital_sources, ''), nullif(m.capital_type, '')) AS capital, coalesce(nullif(m.sectors, ''), nullif(m.sector, '')) AS sectors,
       coalesce(nullif(m.summary, ''), 'No summary provided.') AS summary, regexp_replace(regexp_extract(r.url, '://([^/?#]*)', 1), '^www[.]', '') AS source, r.url,
       coalesce(e.summary_complete, false) AS has_extraction
FROM master_list m JOIN raw_items r ON r.id = m.item_id LEFT JOIN ai_extractions e ON e.item_id = m.item_id"""


def _cards(spark, sf_dir):
    raw, ext, mas = _t(spark, sf_dir, "raw_items", "ai_extractions", "master_list")
    return V.cards(mas, raw, ext)


@query(with_views(_CARDS, "raw_items", "ai_extractions", "master_list"))
def deal_cards(spark, sf_dir):
    """D4, C14, C18, N1-N4, I11, J1, G3, B5."""
    return Q.newest(_cards(spark, sf_dir), key="item_id")


@query(with_views(f"SELECT count(*) FILTER (has_extraction) AS complete, count(*) AS cards FROM ({_CARDS}) c", "raw_items", "ai_extractions", "master_list"))
def deals_with_extraction(spark, sf_dir):
    """E5."""
    return _cards(spark, sf_dir).agg(F.count_if("has_extraction").alias("complete"), F.count(F.lit(1)).alias("cards"))


@query(with_views(f"SELECT item_id, label FROM ({_CARDS}) c WHERE contains(lower(label), 'acq')", "raw_items", "ai_extractions", "master_list"))
def label_filter(spark, sf_dir):
    """Cards whose label holds a text."""
    return V.of_label(_cards(spark, sf_dir), "acq").select("item_id", "label")


@query(with_views(f"SELECT item_id, label, row_number() OVER (ORDER BY published_date DESC NULLS LAST, item_id) AS row, CAST(ceil(count(*) OVER () / 10.0) AS BIGINT) AS pages FROM ({_CARDS}) c QUALIFY row BETWEEN 11 AND 20", "raw_items", "ai_extractions", "master_list"))
def paginate(spark, sf_dir):
    """The second page of ten."""
    return Q.page(_cards(spark, sf_dir), 2, 10, F.desc_nulls_last("published_date"), "item_id").select("item_id", "label", "row", "pages")


@query(with_views("SELECT feed_source, count(id) AS items FROM raw_items GROUP BY feed_source", "raw_items"))
def stats_by_source(spark, sf_dir):
    """Items without a source are one group."""
    return Q.by_source(view(spark, sf_dir, "raw_items"))


@query(with_views("""
SELECT 'raw_items' AS name, count(*) AS rows FROM raw_items UNION ALL SELECT 'article_content', count(*) FROM article_content UNION ALL SELECT 'scraped', count(*) FILTER (scrape_success) FROM article_content
UNION ALL SELECT 'ai_extractions', count(*) FROM ai_extractions UNION ALL SELECT 'master_list', count(*) FROM master_list UNION ALL SELECT 'rejected_items', count(*) FROM rejected_items""", *_TABLES))
def table_counts(spark, sf_dir):
    """E1, E2."""
    counted = lambda name, df: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
    frames = dict(zip(_TABLES, _t(spark, sf_dir), strict=True))
    out = counted("scraped", frames["article_content"].filter("scrape_success"))
    for name, df in frames.items():
        out = out.unionByName(counted(name, df))
    return out


@query(with_views("""
SELECT total, new, scraped, with_ai_summary, approved, rejected, scraped - approved - rejected AS pending_triage FROM
  (SELECT count(*) AS total, count(*) FILTER (status = 'new') AS new FROM raw_items), (SELECT count(*) FILTER (scrape_success) AS scraped FROM article_content),
  (SELECT count(*) FILTER (summary_complete) AS with_ai_summary FROM ai_extractions), (SELECT count(*) AS approved FROM master_list), (SELECT count(*) AS rejected FROM rejected_items)""", *_TABLES))
def queue_status(spark, sf_dir):
    """E4, E2."""
    return Q.queue_status(*_t(spark, sf_dir))


@query(with_views("SELECT r.id, CASE WHEN a.item_id IS NULL THEN 'new' WHEN a.scrape_success THEN 'scraped' ELSE 'failed' END AS status FROM raw_items r LEFT JOIN article_content a ON a.item_id = r.id", "raw_items", "article_content"))
def derived_status(spark, sf_dir):
    """B10."""
    return Q.derived_status(*_t(spark, sf_dir, "raw_items", "article_content"))


@query("SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY text")
def dedup_first_wins(spark, sf_dir):
    """Documents by text, the first by id."""
    rows = base(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_md5"))
    return Q.first_wins(rows, "text_md5", "doc_id").select("doc_id", "text_md5")


@query("""
WITH s AS (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0), b AS (SELECT * FROM documents WHERE doc_id % 2 = 1),
c AS (SELECT b.doc_id, s.text IS NULL AND row_number() OVER (PARTITION BY b.text ORDER BY b.doc_id) = 1 AS is_new FROM b LEFT JOIN s ON s.text = b.text)
SELECT count(*) FILTER (is_new) AS new, count(*) FILTER (NOT is_new) AS duplicate FROM c""")
def ingest_split(spark, sf_dir):
    """The even documents are stored, the odd ones arrive."""
    rows = base(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_md5"))
    split = Q.split_batch(rows.filter("doc_id % 2 = 1"), rows.filter("doc_id % 2 = 0"), "text_md5", "doc_id")
    return split.agg(F.count_if("is_new").alias("new"), F.count_if(~F.col("is_new")).alias("duplicate"))


_DECIDED = "CASE item_id % 3 WHEN 0 THEN 'reject' ELSE 'accept' END"


@query(with_views(f"""
WITH d AS (SELECT *, {_DECIDED} AS action FROM ai_extractions)
SELECT item_id, nullif(company, '') AS company, nullif(deal_amount, '') AS investment_amount, nullif(transaction_type, '') AS transaction_type, nullif(capital_sources, '') AS capital_sources, nullif(sectors, '') AS sectors
FROM d WHERE action = 'accept' AND item_id NOT IN (SELECT item_id FROM master_list)""", "ai_extractions", "master_list"))
def apply_decisions(spark, sf_dir):
    """Accept decisions made from the extractions' fields, as rows to add."""
    ext, mas = _t(spark, sf_dir, "ai_extractions", "master_list")
    listed = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "")
    made = ext.select("item_id", F.expr(_DECIDED).alias("action"), "company", "investors", F.col("deal_amount").alias("investment_amount"), "transaction_type", F.col("strategic_significance").alias("summary"), listed("capital_sources").alias("capital_sources"), listed("sectors").alias("sectors"))
    return Q.accepted_from_form(made, mas).select("item_id", "company", "investment_amount", "transaction_type", "capital_sources", "sectors")


@query(with_views("""
WITH u AS (SELECT item_id + CASE WHEN item_id % 8 = 0 THEN 1000000 ELSE 0 END AS item_id, 'updated' AS company, '$1M' AS deal_amount FROM ai_extractions WHERE item_id % 4 = 0)
SELECT coalesce(o.item_id, u.item_id) AS item_id, coalesce(u.company, o.company) AS company, CASE WHEN o.item_id IS NOT NULL THEN o.deal_amount ELSE u.deal_amount END AS deal_amount, o.sectors
FROM ai_extractions o FULL JOIN u ON u.item_id = o.item_id""", "ai_extractions"))
def upsert_extraction(spark, sf_dir):
    """Updates replace what they bring, keep what stays as stored, and add new items."""
    old = view(spark, sf_dir, "ai_extractions").select("item_id", "company", "deal_amount", "sectors")
    key = F.col("item_id") + F.when(F.col("item_id") % 8 == 0, 1_000_000).otherwise(0)
    updates = old.filter("item_id % 4 = 0").select(key.alias("item_id"), F.lit("updated").alias("company"), F.lit("$1M").alias("deal_amount"))
    return Q.latest_wins(old, updates, "item_id", kept=("deal_amount",))


@query(with_views("SELECT item_id, rejected_at FROM rejected_items WHERE item_id % 2 = 1", "rejected_items"))
def undo_rejection(spark, sf_dir):
    """The even items' rejections are taken back."""
    rej = view(spark, sf_dir, "rejected_items").select("item_id", "rejected_at")
    return Q.without(rej, rej.filter("item_id % 2 = 0"), "item_id")


@query(with_views("SELECT item_id, location, CAST(NULL AS VARCHAR) AS ai_summary, CAST(NULL AS DOUBLE) AS score FROM master_list UNION ALL SELECT item_id, NULL, ai_summary, NULL FROM ai_extractions", "master_list", "ai_extractions"))
def schema_evolve(spark, sf_dir):
    """Wanted columns are added once, and frames of different columns are united."""
    mas, ext = _t(spark, sf_dir, "master_list", "ai_extractions")
    old = Q.evolved(Q.evolved(mas.select("item_id", "location"), {"score": "double"}), {"score": "double", "location": "string"})
    return old.unionByName(ext.select("item_id", "ai_summary"), allowMissingColumns=True)


@query("SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', source, lang, text)), 'mit license')")
def search_filter(spark, sf_dir):
    """C11, I1."""
    return V.search(base(spark, sf_dir, "documents"), "MIT License", "source", "lang", "text").select("doc_id")
