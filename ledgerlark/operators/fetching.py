"""Fetching by a pluggable function, with failures kept to the row they belong to. What comes back is landed as it is."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fetched(names: DataFrame, column: str, fetch: Callable[[str], str], at_once: int = 1, pause_s: float = 0.0) -> DataFrame:
    """column, document, error: what fetch gives for each name. at_once tasks run, and each pauses after a name; one by default, as a client that asks one source after another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name in batch["name"]:
                try:
                    rows.append((name, fetch(name), None))
                except Exception as e:  # one source's failure is that row's result
                    rows.append((name, None, f"{type(e).__name__}: {e}"))
                if pause_s:
                    time.sleep(pause_s)
            yield pd.DataFrame(rows, columns=["name", "document", "error"], dtype=object)

    got = names.select(F.col(column).cast("string").alias("name")).repartition(at_once).mapInPandas(run, "name string, document string, error string")
    return got.withColumnRenamed("name", column)


def followed(names: DataFrame, column: str, fetch: Callable[[str], str]) -> DataFrame:
    """column, url (where the document comes from), document, error: a page that only forwards is left for its target, once."""
    from ..functions.html import refresh_content
    from ..functions.text import refresh_target

    first = fetched(names, column, fetch).withColumn("target", F.nullif(F.trim(refresh_target(refresh_content("document"))), F.lit("")))
    second = fetched(first.filter("target IS NOT NULL").select("target").distinct(), "target", fetch).select("target", F.col("document").alias("_document"), F.col("error").alias("_error"))
    hop = F.col("target").isNotNull()
    both = first.join(second, "target", "left")
    return both.select(column, F.coalesce("target", column).alias("url"), F.when(hop, F.col("_document")).otherwise(F.col("document")).alias("document"), F.when(hop, F.col("_error")).otherwise(F.col("error")).alias("error"))


def counted(documents: DataFrame, column: str, schema: str, data: str = "data") -> DataFrame:
    """column, n: the points of each fetched document, 0 where the fetch failed."""
    return documents.select(column, F.coalesce(F.when(F.col("document").isNotNull(), F.size(F.from_json("document", schema)[data])), F.lit(0)).alias("n"))
