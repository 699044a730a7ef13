"""Tables that are changed in place, a batch at a time: Parquet in buckets by a hash of the key.

A batch rewrites only the buckets that it touches, by Spark's dynamic partition overwrite: all of its files are written
before the first old one goes, so a batch that fails leaves the table as it was. A batch may carry a mark, which is left
behind it; a batch whose mark is there does nothing. If a driver is lost between the two, the batch runs again, which
changes nothing either: updates bring the same values, and what is stored isn't inserted twice. Removed rows stay in their
bucket as gone. One writer a table at a time.

A row without key is left out of a batch; of a batch's rows with one key the least by `order` counts. A table that isn't
there is empty.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import landing


class Table(NamedTuple):
    at: str
    schema: str
    key: str
    #: For the table's whole life. A bucket is rewritten as a whole: take as many as keep one at some 100 MB.
    buckets: int = 64


def _files(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _there(spark: SparkSession, at: str) -> bool:
    path, fs = _files(spark, at)
    return fs.exists(path)


def _bucket(table: Table) -> Column:
    return F.pmod(F.xxhash64(table.key), F.lit(table.buckets)).cast("int")


def _whole(spark: SparkSession, table: Table) -> DataFrame:
    """All rows, with gone and bucket."""
    schema = f"{table.schema}, gone boolean, bucket int"
    return spark.read.schema(schema).parquet(table.at) if _there(spark, table.at) else spark.createDataFrame([], schema)


def stored(spark: SparkSession, table: Table) -> DataFrame:
    """The rows of a table."""
    return _whole(spark, table).filter("NOT gone").drop("gone", "bucket")


def marked(spark: SparkSession, table: Table, mark: str) -> bool:
    return _there(spark, f"{table.at}/_marks/{mark}")


def _changed(spark: SparkSession, table: Table, batch: DataFrame, order, mark: str | None, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
    """Whether the batch was applied. merged gets the old rows of the touched buckets, with gone, and the batch."""
    from ..operators.queues import first_wins

    if mark is not None and marked(spark, table, mark):
        return False
    held = landing.folder(spark)  # evaluated once: buckets and rows must be of one batch
    once = first_wins(batch.filter(F.col(table.key).isNotNull()), table.key, *(order or [c for c in batch.columns if c != table.key] or [F.lit(0)]))
    once.withColumn("_bucket", _bucket(table)).write.parquet(held)
    landed = spark.read.parquet(held)
    touched = [r[0] for r in landed.select("_bucket").distinct().collect()]  # at most table.buckets
    if touched:
        old = _whole(spark, table).filter(F.col("bucket").isin(touched)).drop("bucket")
        new = merged(old, landed.drop("_bucket")).withColumn("bucket", _bucket(table))
        new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table.at)
    if mark is not None:
        path, fs = _files(spark, f"{table.at}/_marks/{mark}")
        fs.mkdirs(path.getParent())
        fs.createNewFile(path)
    return True


def upsert(spark: SparkSession, table: Table, updates: DataFrame, kept: tuple[str, ...] = (), order=(), mark: str | None = None) -> bool:
    """Updates replace the columns that they bring, but for the kept ones of a stored row; new keys, and gone ones, are added."""
    from ..operators.queues import latest_wins

    def merged(old: DataFrame, new: DataFrame) -> DataFrame:
        live = old.filter("NOT gone")
        out = latest_wins(live.drop("gone"), new, table.key, kept).withColumn("gone", F.lit(False))
        gone = old.filter("gone").join(new.select(table.key), table.key, "left_anti")
        return out.unionByName(gone)

    return _changed(spark, table, updates, order, mark, merged)


def insert(spark: SparkSession, table: Table, rows: DataFrame, order=(), mark: str | None = None) -> bool:
    """Adds the rows whose key isn't stored; what is stored stays as it is. Missing columns are NULL."""

    def merged(old: DataFrame, new: DataFrame) -> DataFrame:
        fresh = new.join(old.filter("NOT gone").select(table.key), table.key, "left_anti").withColumn("gone", F.lit(False))
        stay = old.filter("NOT gone").unionByName(old.filter("gone").join(fresh.select(table.key), table.key, "left_anti"))
        return stay.unionByName(fresh, allowMissingColumns=True).select(old.columns)

    return _changed(spark, table, rows, order, mark, merged)


def remove(spark: SparkSession, table: Table, keys: DataFrame, mark: str | None = None) -> bool:
    """Takes out the rows of these keys; a key that isn't stored changes nothing."""

    def merged(old: DataFrame, new: DataFrame) -> DataFrame:
        named = new.select(table.key).withColumn("_named", F.lit(True))
        return old.join(named, table.key, "left").withColumn("gone", F.col("gone") | F.coalesce("_named", F.lit(False))).select(old.columns)

    return _changed(spark, table, keys.select(table.key), (), mark, merged)
