"""Writers. Each replaces a folder as a whole; a folder is never read and written at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def series_documents(points: DataFrame, names: DataFrame, updated: str) -> DataFrame:
    """One document per series, with its points by date and the number of them: a document is one row, however long the series. names: series, name, description, units."""
    data = points.groupBy("series").agg(F.array_sort(F.collect_list(F.struct(F.col("date").cast("string").alias("date"), "value"))).alias("data"))
    named = data.join(names, "series", "left")
    return named.select(F.col("series").alias("series_id"), "name", "description", "units", F.lit(updated).alias("last_updated"), F.size("data").cast("long").alias("data_points"), "data")


def write_series(documents: DataFrame, directory: str) -> None:
    """One JSON folder per series."""
    documents.withColumn("series", F.lower("series_id")).write.mode("overwrite").partitionBy("series").json(directory)


def manifest(points: DataFrame, names: DataFrame, updated: str) -> DataFrame:
    """One row: last_updated, series_count (of the configured ones), series (points of each; 0 where nothing came)."""
    counts = names.join(points.groupBy("series").agg(F.count(F.lit(1)).alias("n")), "series", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counts.agg(F.count(F.lit(1)).alias("series_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("series", "n")))).alias("series")).withColumn("last_updated", F.lit(updated))


def created(spark: SparkSession, directory: str, name: str, schema: str) -> bool:
    """Whether a table had to be created; one that is there, with whatever columns, stays as it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{directory}/{name}")
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return False
    spark.createDataFrame([], schema).write.parquet(f"{directory}/{name}")
    return True


def write_csv(rows: DataFrame, directory: str) -> None:
    """One file with a header, as the download is: one task writes it. Exports of any size belong in write_table."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(directory)


def write_table(rows: DataFrame, directory: str) -> None:
    """A table's new version. The folder must not be one that rows reads."""
    rows.write.mode("overwrite").parquet(directory)


def rewrite_changed(points: DataFrame, directory: str) -> list[str]:
    """The names of the series that differ from the stored ones. Only their folders are rewritten; a series that is gone loses its folder.

    The stored fingerprints, not the stored points, are compared; a folder that isn't there holds nothing. A driver that is
    lost before the fingerprints are written rewrites the same series again. points must not read from the folder.
    """
    from ..operators.series import changed_series, fingerprints

    spark = points.sparkSession
    jvm, now, marks = spark._jvm, fingerprints(points), f"{directory}/fingerprints"
    at = jvm.org.apache.hadoop.fs.Path(marks)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = spark.read.schema(now.schema).parquet(marks) if fs.exists(at) else now.limit(0)
    differ = changed_series(before, now).filter("changed").orderBy("series").collect()  # names of series: the dimension's size
    if differ:
        some = points.join(F.broadcast(spark.createDataFrame([(r["series"],) for r in differ], "series string")), "series")
        some.repartition("series").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("series").parquet(f"{directory}/points")
        for r in differ:
            if not r["rows_new"]:
                name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(r["series"])
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{directory}/points/series={name}"), True)
        now.write.mode("overwrite").parquet(marks)
    return [r["series"] for r in differ]
