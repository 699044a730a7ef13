"""Decisions on items, applied to bucketed tables: what the pages' forms and the digest's links post, each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store
from . import queues as Q

MASTER = "item_id long, company string, investors string, investment_amount string, transaction_type string, capital_sources string, sectors string, summary string, human_notes string, published boolean"
REJECTED = "item_id long, rejection_reason string"


def tables(home: str, buckets: int = 64) -> tuple[store.Table, store.Table]:
    """The master list and the rejected items below a folder."""
    return store.Table(f"{home}/master_list", MASTER, "item_id", buckets), store.Table(f"{home}/rejected_items", REJECTED, "item_id", buckets)


def post(spark: SparkSession, home: str, decisions: DataFrame, batch: str, buckets: int = 64) -> None:
    """Applies a batch of forms: item_id, action and the form's fields. What is accepted enters the list once, what is rejected the other table; a batch that comes again is void."""
    master, rejected = tables(home, buckets)
    store.insert(spark, master, Q.accepted_from_form(decisions, store.stored(spark, master)), mark=batch)
    reasons = decisions.filter("action = 'reject'").select("item_id", F.nullif("reason", F.lit("")).alias("rejection_reason"))
    store.insert(spark, rejected, reasons, mark=batch)


def follow(spark: SparkSession, home: str, verdicts: DataFrame, extractions: DataFrame, batch: str, buckets: int = 64) -> None:
    """Applies links of the digest: item_id, action, valid, as a token's verdict has them. A link that isn't valid changes nothing; an approved item brings its extraction's fields."""
    master, rejected = tables(home, buckets)
    good = verdicts.filter("valid")
    known = store.stored(spark, master)
    store.insert(spark, master, Q.accepted_from_link(good.filter("action = 'approve'").select("item_id"), extractions, known), mark=batch)
    store.insert(spark, rejected, good.filter("action = 'reject'").select("item_id", F.lit("Rejected via email").alias("rejection_reason")), mark=batch)


def undo(spark: SparkSession, home: str, items: DataFrame, buckets: int = 64) -> None:
    """Takes rejections back; items that aren't rejected change nothing."""
    store.remove(spark, tables(home, buckets)[1], items)
