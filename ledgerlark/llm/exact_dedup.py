"""Exact deduplication: 128-bit content hashes, then a comparison of bytes inside groups. DataFrame functions only.

Rows are equal when their texts are identical after each run of blanks (space, tab to carriage return) became one
space; null counts as empty. Of equal rows the one with the smallest id stays; a row without id stays only if no equal
row has one. Of rows with the same id and the same text one stays. An empty table gives an empty result. Other columns,
whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slot_of, spool, table

#: Slots of the prefilter. The broadcast of occupied slots holds at most so many ints, whatever the input's size.
SLOTS = 1 << 18
#: Rows with one id and one text that a task gives back at once.
LOT = 1 << 16


def normalized(text):
    """Each run of blanks as one space. Single spaces need no replacement, so the pattern leaves them out."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each input row: the id, keep_id, group_size, kept, text_sha256.

    First pass: only hashes are shuffled, and equal rows are pre-aggregated. Second pass: only texts whose hash slot
    holds a repeated hash are grouped, by hash and by their bytes; copies meet already in the map tasks, so a group
    that holds a third of all rows sends one row per task. The hash of a text never decides alone: classes come from
    the grouping by bytes, and two classes under one hash keep apart by their SHA-256.
    """
    bare = docs.select(F.col(key).alias("id"), normalized(F.col(text)).alias("norm"))
    hashed = bare.select("id", "norm", F.unhex(F.md5("norm")).alias("h"))
    marks = spool(hashed.select("id", "h", F.sha2("norm", 256).alias("sha")).groupBy("h", "sha", "id").agg(F.count(F.lit(1)).alias("copies")))
    repeated = marks.groupBy("h").agg(F.sum("copies").alias("n")).filter("n > 1")
    slots = repeated.select(slot_of(F.col("h"), SLOTS).alias("slot")).distinct()
    classes = spool(
        hashed.withColumn("slot", slot_of(F.col("h"), SLOTS))
        .join(F.broadcast(slots), "slot", "left_semi")
        .groupBy("h", "norm")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        .select("h", F.sha2("norm", 256).alias("sha"), "keep_id", "n")
        .groupBy("h", "sha")
        .agg(F.min("keep_id").alias("keep_id"), F.max("n").alias("group_size"), F.count(F.lit(1)).alias("classes"))
        .filter((F.col("classes") == 1) | F.assert_true(F.col("classes") == 1, "two texts share MD5 and SHA-256").isNotNull())
        .drop("classes")
    )
    # Rows that agree in id and text come back in lots; more than one lot of them is dealt out over tasks.
    lot = F.col("copies") <= LOT
    few = marks.filter(lot).withColumn("first", F.lit(0).cast("long")).join(classes, ["h", "sha"], "left")
    many = marks.filter(~lot).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(LOT).cast("long")))).join(classes, ["h", "sha"], "left")
    dealt = few.unionByName(many.repartition("h", "sha", "id", "first"))
    rows = dealt.withColumn("copy", F.explode(F.sequence(F.col("first") + 1, F.least(F.col("first") + LOT, F.col("copies")))))
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("id")).otherwise(F.col("keep_id"))
    return rows.select(
        F.col("id").alias(key),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("id").eqNullSafe(keep) & (F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = {
    "op4_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM n"""
}
QUERIES = {"op4_exact_dedup": op4_exact_dedup}
