"""Extraction by a pluggable function from title and text to a reply; the engine owns the batching and the parsing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import joined
from ..functions.text import parsed_reply

#: Characters of an article that an extractor sees.
READ = 8000


def extract(items: DataFrame, extractor: Callable[[str, str], str]) -> DataFrame:
    """item_id, company, transaction_type, capital_sources, sectors, deal_amount, summary_complete of items (item_id, title, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies = [extractor(title or "", (text or "")[:READ]) for title, text in zip(batch["title"], batch["text"], strict=True)]
            yield pd.DataFrame({"item_id": batch["item_id"], "reply": replies})

    replies = items.select(F.col("item_id").cast("string").alias("item_id"), "title", F.substring("text", 1, READ).alias("text")).mapInPandas(run, "item_id string, reply string")
    got = replies.select(F.col("item_id").cast("long").alias("item_id"), parsed_reply("reply").alias("r"))
    return got.select("item_id", F.col("r.company_name").alias("company"), "r.transaction_type", joined("r.capital_sources").alias("capital_sources"), joined("r.sectors").alias("sectors"), "r.deal_amount", "r.summary_complete")
