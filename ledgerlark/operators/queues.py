"""The item's way: work queues, counts, and the changes that move items. Tables are immutable; a change returns the new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered, page  # noqa: F401


def newest(rows: DataFrame, limit: int | None = None, by: str = "published_date", key: str = "id") -> DataFrame:
    """Rows by a date, newest first, unknown dates last, ties by key."""
    out = rows.orderBy(F.desc_nulls_last(by), key)
    return out if limit is None else out.limit(limit)


def undecided(items: DataFrame, master: DataFrame, rejected: DataFrame) -> DataFrame:
    """Items that are neither accepted nor rejected."""
    out = items.join(master.select(F.col("item_id").alias("id")), "id", "left_anti")
    return out.join(rejected.select(F.col("item_id").alias("id")), "id", "left_anti")


def triage(raw: DataFrame, articles: DataFrame, master: DataFrame, rejected: DataFrame) -> DataFrame:
    """Items that were scraped and wait for a decision."""
    good = articles.filter("scrape_success").select(F.col("item_id").alias("id"))
    return undecided(raw.join(good, "id", "left_semi"), master, rejected)


def pending_digest(raw: DataFrame, articles: DataFrame, extractions: DataFrame, master: DataFrame, rejected: DataFrame) -> DataFrame:
    """Items of the triage queue whose extraction is complete, with the extraction's columns."""
    done = extractions.filter("summary_complete").withColumnRenamed("item_id", "id")
    return triage(raw, articles, master, rejected).join(done, "id")


def unscraped(raw: DataFrame, articles: DataFrame) -> DataFrame:
    return raw.filter("status = 'new'").join(articles.select(F.col("item_id").alias("id")), "id", "left_anti")


def needs_extraction(raw: DataFrame, articles: DataFrame, extractions: DataFrame) -> DataFrame:
    """Scraped items without a complete extraction: none, one that failed, or one that doesn't say."""
    good = articles.filter("scrape_success").select(F.col("item_id").alias("id"))
    done = extractions.filter(F.coalesce("summary_complete", F.lit(False))).select(F.col("item_id").alias("id"))
    return raw.join(good, "id", "left_semi").join(done, "id", "left_anti")


def derived_status(raw: DataFrame, articles: DataFrame) -> DataFrame:
    """id, status as the article table tells it."""
    a = articles.select(F.col("item_id").alias("id"), "scrape_success")
    status = F.when(F.col("scrape_success").isNull(), "new").when(F.col("scrape_success"), "scraped").otherwise("failed")
    return raw.join(a, "id", "left").select("id", status.alias("status"))


def queue_status(raw: DataFrame, articles: DataFrame, extractions: DataFrame, master: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row of counts. pending_triage is arithmetic, not the queue's length, and may be negative."""
    one = F.lit(1)
    frames = [
        raw.agg(F.count(one).alias("total"), F.count_if(F.col("status") == "new").alias("new")),
        articles.agg(F.count_if("scrape_success").alias("scraped")),
        extractions.agg(F.count_if(F.coalesce("summary_complete", F.lit(False))).alias("with_ai_summary")),
        master.agg(F.count(one).alias("approved")),
        rejected.agg(F.count(one).alias("rejected")),
    ]
    out = frames[0]
    for f in frames[1:]:  # single rows
        out = out.join(f, F.lit(True))
    return out.withColumn("pending_triage", F.col("scraped") - F.col("approved") - F.col("rejected"))


def by_source(raw: DataFrame) -> DataFrame:
    """feed_source, items. Items without a source are one group."""
    return raw.groupBy("feed_source").agg(F.count("id").alias("items"))


def first_wins(batch: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """Of rows with one key, the first by order. A minimum per key, so that partial aggregation shrinks hot keys before the shuffle."""
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    rest = F.struct(*[F.struct(*by).alias("_by"), F.struct(*[c for c in batch.columns if c != key]).alias("_row")])
    return batch.groupBy(key).agg(F.min(rest).alias("_x")).select(key, "_x._row.*").select(*batch.columns)


def new_rows(batch: DataFrame, stored: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """Rows of a batch to insert: the first of each key that isn't stored yet."""
    return first_wins(batch, key, *order).join(stored.select(key).distinct(), key, "left_anti")


def split_batch(batch: DataFrame, stored: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """batch with is_new: whether a row would be inserted, in arrival order, against the stored rows and earlier rows of the batch.

    Rows are numbered in ranges, a key's first number is a minimum, and numbers are joined, so a key that half of the batch
    shares makes no hot task.
    """
    rows = numbered(batch, *order, name="_row")
    first = rows.groupBy(key).agg(F.min("_row").alias("_row"))
    fresh = first.join(stored.select(key).distinct(), key, "left_anti").select("_row", F.lit(True).alias("_fresh"))
    return rows.join(fresh, "_row", "left").select(*batch.columns, F.coalesce("_fresh", F.lit(False)).alias("is_new"))


def latest_wins(old: DataFrame, updates: DataFrame, key: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """Upsert by key: a row's columns come from its update, except the kept ones, which stay as stored; new keys are added."""
    new = updates.select(F.col(key), F.struct(*updates.columns).alias("_new"))
    both = old.select(F.col(key), F.struct(*old.columns).alias("_old")).join(new, key, "full_outer")
    pick = lambda c: (
        F.col(f"_old.{c}") if c not in updates.columns
        else F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}")) if c in kept
        else F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
    )
    return both.select(*[F.col(key) if c == key else pick(c).alias(c) for c in old.columns])


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def accepted_from_form(decisions: DataFrame, master: DataFrame) -> DataFrame:
    """Rows to add for accept decisions. Empty fields become NULL, lists are joined; items that are in the list already stay as they are."""
    from ..functions.columns import filled, joined

    texts = ("company", "investors", "investment_amount", "transaction_type", "summary")
    rows = decisions.filter("action = 'accept'").select("item_id", *[filled(c).alias(c) for c in texts], joined("capital_sources").alias("capital_sources"), joined("sectors").alias("sectors"), F.lit(False).alias("published"))
    return new_rows(rows, master, "item_id", *texts)


def accepted_from_link(items: DataFrame, extractions: DataFrame, master: DataFrame) -> DataFrame:
    """Rows to add for items accepted by a link: an extraction's fields under the list's names."""
    e = items.join(extractions, "item_id", "left")
    rows = e.select("item_id", "company", "investors", F.col("deal_amount").alias("investment_amount"), "transaction_type", "capital_sources", "sectors", F.col("strategic_significance").alias("summary"), F.lit("Approved via email").alias("human_notes"))
    return new_rows(rows, master, "item_id", "company")


def evolved(old: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """old with the wanted columns that it lacks, as NULLs; the same again changes nothing."""
    have = set(old.schema.fieldNames())
    return old.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in wanted.items() if name not in have])


def with_content(rows: DataFrame, articles: DataFrame, extractions: DataFrame) -> DataFrame:
    """rows (by id) with clean_text, scrape_success, has_extraction and the extraction's company, type and completeness, where there are any."""
    a = articles.select(F.col("item_id").alias("id"), "clean_text", "scrape_success")
    e = extractions.select(F.col("item_id").alias("id"), F.col("company").alias("ai_company"), F.col("transaction_type").alias("ai_type"), "summary_complete", F.lit(True).alias("_there"))
    return rows.join(a, "id", "left").join(e, "id", "left").withColumn("has_extraction", F.coalesce("_there", F.lit(False))).drop("_there")
