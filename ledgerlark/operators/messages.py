"""Chat updates: from a payload to the links that enter the queue, and the reply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text
from ..sources import readers

#: Links of one message that are taken in.
AT_ONCE = 5


def intake(payloads: DataFrame, users: str, column: str = "payload") -> DataFrame:
    """chat_id, command, links (at most AT_ONCE), more (links left out) of updates from allowed users."""
    got = readers.updates(payloads, column).filter(rules.allowed("user_id", users))
    found = got.withColumn("all", text.links("text", "entities", "caption"))
    command = F.when(F.size("all") > 0, F.when(rules.command("text").isin("start", "status", "help"), rules.command("text")).otherwise("links")).otherwise(rules.command("text"))
    return found.select("chat_id", command.alias("command"), F.slice("all", 1, AT_ONCE).alias("links"), F.greatest(F.size("all") - AT_ONCE, F.lit(0)).alias("more"))


def queued(taken: DataFrame, stored: DataFrame) -> DataFrame:
    """chat_id, url, is_new: each link once for a chat; a URL enters the queue with the least chat that sends it, if it isn't stored."""
    rows = taken.filter("command = 'links'").select("chat_id", F.explode("links").alias("url")).distinct()
    first = rows.groupBy("url").agg(F.min("chat_id").alias("first"))
    known = stored.select("url").distinct().withColumn("known", F.lit(True))
    return rows.join(first, "url").join(known, "url", "left").select("chat_id", "url", ((F.col("chat_id") == F.col("first")) & F.col("known").isNull()).alias("is_new"))


def replies(taken: DataFrame, rows: DataFrame) -> DataFrame:
    """chat_id, reply: what a message of links, a command, or anything else is answered with."""
    counts = rows.groupBy("chat_id").agg(F.count_if("is_new").alias("new"), F.count_if(~F.col("is_new")).alias("old"))
    said = F.concat(F.lit("Added "), F.col("new").cast("string"), F.lit(", known "), F.col("old").cast("string"))
    return taken.join(counts, "chat_id", "left").select("chat_id", F.when(F.col("command") == "links", said).when(F.col("command") == "none", "No links found").otherwise(F.concat(F.lit("/"), F.col("command"))).alias("reply"))
