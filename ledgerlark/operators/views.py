"""What readers see: curated lists, cards, digests, exports, pages of an item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules, urls
from ..functions.columns import clipped, filled, first_filled, parts


def shown_date(column: str, pattern: str, missing: str):
    return F.coalesce(F.date_format(F.col(column).cast("timestamp"), pattern), F.lit(missing))


def curated(master: DataFrame, raw: DataFrame) -> DataFrame:
    """Accepted items with their source: inner join on the item."""
    r = raw.select(F.col("id").alias("item_id"), "url", "title", "published_date", "feed_source")
    return master.join(r, "item_id")


def cards(master: DataFrame, raw: DataFrame, extractions: DataFrame) -> DataFrame:
    """One card for each accepted item. Curated fields come first, then older ones, then extracted ones; a field without any is NULL."""
    m = curated(master, raw).alias("m")
    e = extractions.select("item_id", "company", "deal_amount", "investors", "deal_type", "summary_complete").alias("e")
    j = m.join(e, "item_id", "left")
    kind = ("m.transaction_type", "m.deal_type", "e.deal_type")
    return j.select(
        "item_id",
        rules.deal_label(*kind).alias("label"),
        rules.badge(*kind).alias("badge"),
        shown_date("m.published_date", "MMM dd, yyyy", "Date unknown").alias("shown_date"),
        F.col("m.published_date").alias("published_date"),
        first_filled("m.company", "e.company").alias("company"),
        first_filled("m.investment_amount", "e.deal_amount").alias("amount"),
        first_filled("m.investors", "e.investors").alias("investors"),
        first_filled("m.capital_sources", "m.capital_type").alias("capital"),
        first_filled("m.sectors", "m.sector").alias("sectors"),
        first_filled("m.summary", default="No summary provided.").alias("summary"),
        urls.source_domain("m.url").alias("source"),
        F.col("m.url").alias("url"),
        F.coalesce("e.summary_complete", F.lit(False)).alias("has_extraction"),
    )


def csv_rows(master: DataFrame, raw: DataFrame) -> DataFrame:
    """The nine columns of the export, from the older fields only; missing texts are spelled out."""
    j = curated(master, raw)
    text = lambda c, name, missing="N/A": first_filled(c, default=missing).alias(name)
    return j.select(
        shown_date("published_date", "yyyy-MM-dd", "N/A").alias("Date"), text("company", "Company"), text("investment_amount", "Investment Amount", "Not disclosed"), text("capital_type", "Capital Type"),
        text("sector", "Sector"), text("location", "Location"), text("project_type", "Project Type"), text("summary", "Summary"), F.col("url").alias("Source URL"),
    )


def digest(pending: DataFrame) -> DataFrame:
    """item_id, title, company, deal_amount, deal_type, sectors, summary, url, relevance_score of pending items."""
    return pending.select(
        F.col("id").alias("item_id"), "title", "company", "deal_amount", first_filled("transaction_type", "deal_type").alias("deal_type"), "sectors",
        first_filled("strategic_significance", "ai_summary").alias("summary"), "url", "relevance_score",
    )


def digest_lines(items: DataFrame) -> DataFrame:
    """A digest's texts: at most 100 characters of a title, 200 of a summary, three sectors, and the relevance colour."""
    return items.select(
        "item_id",
        first_filled("company", default="Unknown Company").alias("company"),
        clipped("title", 100).alias("title"),
        F.when(filled("summary").isNotNull(), F.concat(F.substring("summary", 1, 200), F.lit("..."))).alias("summary"),
        F.array_join(F.slice(parts("sectors"), 1, 3), "|").alias("sectors"),
        rules.relevance_colour("relevance_score").alias("colour"),
    )


def master_rows(master: DataFrame, raw: DataFrame, articles: DataFrame, extractions: DataFrame) -> DataFrame:
    """Accepted items with what has been done to them."""
    a = articles.select("item_id", F.coalesce("scrape_success", F.lit(False)).alias("_scraped"))
    e = extractions.select("item_id", F.coalesce("summary_complete", F.lit(False)).alias("_complete"))
    j = curated(master, raw).join(a, "item_id", "left").join(e, "item_id", "left")
    return j.select("item_id", "title", "curated_at", F.coalesce("_scraped", F.lit(False)).alias("scraped"), F.coalesce("_complete", F.lit(False)).alias("ai_processed"), filled("summary").isNotNull().alias("curated"))


def rejected_rows(rejected: DataFrame, raw: DataFrame, articles: DataFrame) -> DataFrame:
    r = raw.select(F.col("id").alias("item_id"), "title", "url")
    a = articles.select("item_id", F.length("clean_text").cast("long").alias("text_length"))
    return rejected.join(r, "item_id").join(a, "item_id", "left").select("item_id", "title", "rejected_at", first_filled("rejection_reason", default="No reason").alias("reason"), "text_length")


def item(raw: DataFrame, articles: DataFrame, extractions: DataFrame, key: int) -> DataFrame:
    """One item with what there is of it, or no row."""
    r = raw.filter(F.col("id") == key)
    a = articles.select(F.col("item_id").alias("id"), F.length("clean_text").cast("long").alias("text_length"), F.substring("clean_text", 1, 2000).alias("preview"))
    e = extractions.select(F.col("item_id").alias("id"), F.col("company").alias("ai_company"))
    return r.join(a, "id", "left").join(e, "id", "left").select("id", "title", "url", "status", "text_length", "preview", "ai_company")


def search(rows: DataFrame, term: str, *columns: str) -> DataFrame:
    """Rows whose columns, joined by blanks, hold the term, whatever its case. An empty term finds all; nothing in it is a wildcard."""
    text = F.lower(F.concat_ws(" ", *columns))
    return rows.filter(F.contains(text, F.lit(term.lower())))


def of_label(rows: DataFrame, wanted: str) -> DataFrame:
    return rows if wanted.lower() == "all" else rows.filter(F.contains(F.lower("label"), F.lit(wanted.lower())))
