"""Polling as a stream: landed feed entries are taken in once per URL, whatever is landed again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store

ENTRY = "url string, title string, summary string, published timestamp, feed_source string, landed timestamp"


def landed(spark: SparkSession, directory: str) -> DataFrame:
    """A stream over landed JSON entries."""
    return spark.readStream.schema(ENTRY).json(directory)


def first_of_url(entries: DataFrame, delay: str = "7 days") -> DataFrame:
    """The first entry of each URL. The watermark bounds the state; what comes later than that is checked against the table when it is appended."""
    return entries.withWatermark("landed", delay).dropDuplicatesWithinWatermark(["url"])


def append_new(table: str):
    """A foreachBatch function that appends the entries whose URL the table at this path doesn't have. A batch that runs again adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy("url").agg(F.min(F.struct("landed", "title", "summary", "published", "feed_source")).alias("x")).select("url", "x.*")
        try:
            stored = spark.read.parquet(table).select("url")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            stored = first.select("url").limit(0)
        first.join(stored, "url", "left_anti").write.mode("append").parquet(table)

    return write


SLICED = "url string, slice long, landed timestamp"


def earliest(entries: DataFrame, delay: str = "7 days", of: str = "slice") -> DataFrame:
    """url and the least `of` of its entries, as a stream of updates. The watermark lets go of the state of windows that are over; the table knows their URLs."""
    return entries.withWatermark("landed", delay).groupBy(F.window("landed", delay), "url").agg(F.min(of).alias(of)).select("url", of)


def _mark(batch: DataFrame, checkpoint: str, number: int) -> str:
    """What names a batch: the checkpoint's id, which is kept in it, and the batch's number."""
    return f"{batch.sparkSession.read.schema('id string').json(f'{checkpoint}/metadata').first()['id']}-{number}"


def intake(spark: SparkSession, source: str, table: store.Table, checkpoint: str):
    """Takes in all entries (of SLICED) that are landed now and returns the finished query. A URL enters the table once, with the slice that brought it first.

    The state is kept under the checkpoint; a batch leaves its mark in the table, under the checkpoint's id, so that a batch
    that runs again is void, and a start from the checkpoint without new files adds nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        if not store.insert(batch.sparkSession, table, batch.filter("url <> ''"), order=("slice",), mark=_mark(batch, checkpoint, number)):
            batch.write.format("noop").mode("overwrite").save()  # the state of a void batch is committed all the same

    entries = spark.readStream.schema(SLICED).json(source)
    query = earliest(entries).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run(spark: SparkSession, source: str, table: str, checkpoint: str):
    """Takes in all that is landed now, and returns the finished query."""
    query = first_of_url(landed(spark, source)).writeStream.foreachBatch(append_new(table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_updates(spark: SparkSession, source: str, table: str, checkpoint: str, users: str):
    """Takes in the links of all chat updates that are landed now as lines of JSON, once per URL, and returns the finished query."""
    from ..operators import messages

    append = append_new(table)

    def write(batch: DataFrame, number: int) -> None:
        taken = messages.intake(batch, users, column="value").filter("command = 'links'").select(F.explode("links").alias("url"))
        none = F.lit(None)
        append(taken.select("url", none.cast("string").alias("title"), none.cast("string").alias("summary"), none.cast("timestamp").alias("published"), F.lit("chat").alias("feed_source"), none.cast("timestamp").alias("landed")), number)

    query = spark.readStream.text(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def intake_updates(spark: SparkSession, source: str, table: store.Table, checkpoint: str, users: str):
    """Takes in the links of all chat updates that are landed now, as lines of JSON, and returns the finished query. A URL enters the table (url, chat_id) once, with the least chat of the batch that brought it first."""
    from ..operators import messages

    def write(batch: DataFrame, number: int) -> None:
        taken = messages.intake(batch, users, column="value").filter("command = 'links'")
        store.insert(batch.sparkSession, table, taken.select(F.explode("links").alias("url"), "chat_id"), order=("chat_id",), mark=_mark(batch, checkpoint, number))

    query = spark.readStream.text(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
