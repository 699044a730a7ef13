"""The domain's tables, made from the tables at hand.

The curation tables and series are views over documents, labels, orders and events. The views are plain SQL that Spark and
DuckDB read alike, so that a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .workers import importable

#: By view: its SQL over the base tables.
VIEWS = {
    "raw_items": """
SELECT doc_id AS id, concat('http://', source, '.example.com/', CAST(doc_id AS STRING)) AS url, substr(text, 1, 90) AS title, substr(text, 1, 40) AS rss_summary,
       CASE WHEN doc_id % 17 <> 0 THEN CAST(make_date(2024, 1, 1) + CAST(doc_id % 365 AS INT) AS STRING) END AS published_date,
       CASE WHEN doc_id % 23 <> 0 THEN source END AS feed_source,
       CAST(make_date(2024, 2, 1) + CAST(doc_id % 30 AS INT) AS STRING) AS date_found,
       CASE WHEN doc_id % 10 = 9 THEN 'new' WHEN n_chars >= 200 THEN 'scraped' ELSE 'failed' END AS status,
       CASE WHEN doc_id % 4 <> 0 THEN CAST(doc_id % 10 AS DOUBLE) / 10 END AS relevance_score
FROM documents""",
    "article_content": """
SELECT doc_id AS item_id, text AS clean_text, n_chars >= 200 AS scrape_success, CASE WHEN n_chars < 200 THEN 'HTTP 404' END AS error_message
FROM documents WHERE doc_id % 10 <> 9""",
    "ai_extractions": """
SELECT l.doc_id AS item_id, CASE l.doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('Company ', CAST(l.doc_id % 50 AS STRING)) END AS company,
       CASE l.doc_id % 5 WHEN 0 THEN NULL ELSE concat('$', CAST(l.doc_id % 90 + 10 AS STRING), 'M') END AS deal_amount,
       CASE l.doc_id % 7 WHEN 0 THEN 'VC Round' WHEN 1 THEN 'M&A' WHEN 2 THEN 'Strategic Joint Venture' WHEN 3 THEN 'Contract Award' WHEN 4 THEN '' WHEN 5 THEN 'ipo' END AS deal_type,
       CASE l.doc_id % 8 WHEN 0 THEN 'Equity Funding Round' WHEN 1 THEN 'Acquisition' WHEN 2 THEN 'Joint Venture' WHEN 3 THEN '' WHEN 4 THEN 'IPO' WHEN 5 THEN 'Debt' END AS transaction_type,
       CASE l.doc_id % 4 WHEN 0 THEN 'Venture Capital,Private Equity' WHEN 1 THEN 'Family Office' WHEN 2 THEN 'Angel,Venture Capital' END AS capital_sources,
       CASE l.doc_id % 5 WHEN 0 THEN 'AI/ML, Aerospace' WHEN 1 THEN 'Space/Satellites,Aerospace,AI/ML,Other' WHEN 2 THEN '' WHEN 3 THEN 'Biotech' END AS sectors,
       CASE l.doc_id % 3 WHEN 0 THEN 'VC and Corporate' WHEN 1 THEN 'Government Grant' END AS capital_type,
       CASE l.doc_id % 4 WHEN 0 THEN 'AI Chips' WHEN 1 THEN 'Aircraft Production' WHEN 2 THEN 'CREDIT' END AS sector,
       CASE l.doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE substr(d.text, 1, 260) END AS strategic_significance,
       CASE l.doc_id % 4 WHEN 0 THEN NULL ELSE substr(d.text, 20, 80) END AS market_implications,
       CASE l.doc_id % 2 WHEN 0 THEN concat('Investor ', CAST(l.doc_id % 9 AS STRING)) END AS investors,
       substr(d.text, 1, 60) AS ai_summary,
       CASE WHEN l.quality = 1 THEN true WHEN l.doc_id % 2 = 0 THEN false END AS summary_complete
FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    "master_list": """
SELECT doc_id AS item_id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('Curated ', CAST(doc_id % 40 AS STRING)) END AS company,
       CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Fund ' || CAST(doc_id % 11 AS STRING) END AS investors,
       CASE doc_id % 3 WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN '$5M' END END AS investment_amount,
       CASE doc_id % 6 WHEN 0 THEN 'Merger' WHEN 3 THEN '' END AS transaction_type,
       CASE doc_id % 4 WHEN 0 THEN 'joint venture' WHEN 1 THEN 'Acquired' WHEN 2 THEN '' END AS deal_type,
       CASE doc_id % 5 WHEN 0 THEN 'Venture Capital' WHEN 1 THEN '' END AS capital_sources, CASE doc_id % 2 WHEN 0 THEN 'VC' END AS capital_type,
       CASE doc_id % 7 WHEN 0 THEN 'AI/ML,Aerospace' END AS sectors, CASE doc_id % 3 WHEN 0 THEN CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'Space' END END AS sector,
       CASE doc_id % 2 WHEN 0 THEN 'Paris' WHEN 1 THEN '' END AS location, CASE doc_id % 4 WHEN 0 THEN 'Plant' END AS project_type,
       CASE doc_id % 5 WHEN 2 THEN NULL ELSE concat('Summary ', CAST(doc_id AS STRING)) END AS summary,
       CAST(make_date(2024, 3, 1) + CAST(doc_id % 20 AS INT) AS STRING) AS curated_at, false AS published
FROM labels WHERE quality = 1 AND toxic = 0 AND doc_id % 3 = 0""",
    "rejected_items": """
SELECT doc_id AS item_id, CAST(make_date(2024, 3, 5) + CAST(doc_id % 20 AS INT) AS STRING) AS rejected_at, CASE doc_id % 2 WHEN 0 THEN 'off topic' END AS rejection_reason
FROM labels WHERE toxic = 1""",
    "monthly": """
SELECT o_orderstatus AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS value
FROM orders GROUP BY o_orderstatus, CAST(date_trunc('month', o_orderdate) AS DATE)""",
    "daily": """
SELECT event_type AS series, CAST(ts AS DATE) AS date, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS value FROM events GROUP BY event_type, CAST(ts AS DATE)""",
}
_BASE = {"raw_items": ["documents"], "article_content": ["documents"], "ai_extractions": ["labels", "documents"], "master_list": ["labels"], "rejected_items": ["labels"], "monthly": ["orders"], "daily": ["events"]}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table as a DataFrame. The base tables stand in the SQL as parameters, so no session-wide view is made."""
    sql = VIEWS[name]
    for t in _BASE[name]:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(sql, **{t: base(spark, sf_dir, t) for t in _BASE[name]})


def with_views(sql: str, *names: str) -> str:
    """SQL with the named views in front, for an oracle."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n" + sql if not sql.lstrip().upper().startswith("WITH ") else "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + ",\n" + sql.lstrip()[5:]
