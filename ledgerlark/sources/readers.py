"""Readers of landed files. Whatever comes from a network is landed first; fetching is not the engine's work."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def series_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per series file. Files that aren't JSON give a row of nulls; see series_outcomes."""
    return spark.read.schema(schemas.SERIES).option("multiLine", True).option("mode", "PERMISSIVE").json(paths)


def series_points(documents: DataFrame) -> DataFrame:
    """series, pos (file order), date, value, close and the other columns of a point."""
    named = documents.withColumn("series", F.coalesce("series_id", "ticker"))
    return named.select("series", F.posexplode("data").alias("pos", "p")).select("series", "pos", F.to_date("p.date").alias("date"), "p.value", "p.open", "p.high", "p.low", "p.close", "p.volume")


#: The source that a landed file belongs to: its folder `series=…`, or else its name without the ending.
SOURCE = r"(?:/series=([^/]+)/[^/]*|/([^/]+?)(?:\.[^/.]*)?)$"


def named_documents(spark: SparkSession, directory: str) -> DataFrame:
    """series documents of a folder with source (by SOURCE, lower case) and _corrupt_record, the text of a file that isn't one whole document."""
    one = spark.read.schema(f"{schemas.SERIES}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(directory)
    path = F.col("_metadata.file_path")
    return one.select("*", F.lower(F.coalesce(F.nullif(F.regexp_extract(path, SOURCE, 1), F.lit("")), F.regexp_extract(path, SOURCE, 2))).alias("source"))


def series_outcomes(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """source, n (points), error: one row for each configured source. A source that failed has no points and its reason; the others are whole.

    documents: of named_documents. sources: source. Reasons: no document, malformed document, no data.
    """
    broken = F.col("_corrupt_record").isNotNull()
    error = F.when(broken, "malformed document").when(F.col("data").isNull(), "no data")
    seen = documents.select("source", F.coalesce(F.size("data"), F.lit(0)).cast("long").alias("n"), error.alias("error"))
    found = seen.groupBy("source").agg(F.sum(F.when(F.col("error").isNull(), F.col("n")).otherwise(0)).alias("n"), F.max("error").alias("error"), F.lit(True).alias("there"))
    both = sources.select(F.col("source"), F.lower("source").alias("_key")).join(found.withColumnRenamed("source", "_key"), "_key", "left")
    return both.select("source", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.when(F.col("there").isNull(), "no document").otherwise(F.col("error")).alias("error"))


def recessions(spark: SparkSession, path: str) -> DataFrame:
    """start, end (dates, both included), label."""
    one = spark.read.schema(schemas.RECESSIONS).option("multiLine", True).json(path)
    return one.select(F.explode("recessions").alias("r")).select(F.to_date("r.start").alias("start"), F.to_date("r.end").alias("end"), "r.label")


def config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CONFIG).option("multiLine", True).json(path)


def enabled_feeds(configs: DataFrame) -> DataFrame:
    """name, url of the feeds that aren't switched off."""
    return configs.select(F.explode("rss_feeds").alias("f")).filter(F.coalesce("f.enabled", F.lit(True))).select("f.name", "f.url")


def _entries(raw: DataFrame, source: str) -> DataFrame:
    """Entries with their defaults; a date that can't be read is NULL."""
    return raw.select(
        F.coalesce("title", F.lit("No title")).alias("title"),
        F.coalesce("link", F.lit("")).alias("url"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        F.try_to_timestamp("published").cast("timestamp_ntz").alias("published"),
        F.lit(source).alias("feed_source"),
    )


def feed_entries(spark: SparkSession, path: str, source: str, tag: str = "entry") -> DataFrame:
    """title, url, summary, published, feed_source of landed feeds, one document a file."""
    return _entries(spark.read.format("xml").schema(schemas.FEED_ENTRY).option("rowTag", tag).load(path), source)


#: An element of a feed, RSS or Atom.
_ELEMENT = r"(?s)<(item|entry)(?:\s[^>]*)?>.*?</\1\s*>"


def feed_documents(spark: SparkSession, directory: str) -> DataFrame:
    """file, document, warning of all landed feeds below a folder; warning says that a document isn't well-formed."""
    texts = spark.read.option("recursiveFileLookup", True).text(directory, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("document"))
    parsed = F.from_xml("document", "_corrupt_record string, channel string, entry array<string>", {"columnNameOfCorruptRecord": "_corrupt_record"})
    broken = F.coalesce(parsed["_corrupt_record"].isNotNull(), F.lit(True))
    return texts.withColumn("warning", F.when(broken, "not well-formed"))


def feed_items(documents: DataFrame, source: str) -> DataFrame:
    """file and the columns of feed_entries, for each RSS item and Atom entry of documents; of a broken document, those that are whole.

    An Atom link is the href of its first link that is an alternate, or doesn't say what it is.
    """
    rows = documents.select("file", F.explode(F.regexp_extract_all("document", F.lit(_ELEMENT), 0)).alias("x")).select("file", F.from_xml("x", schemas.FEED_ITEM).alias("e"))
    own = F.filter(F.col("e.link"), lambda k: k["_href"].isNull() | F.coalesce(k["_rel"] == "alternate", F.lit(True)))
    first = F.try_element_at(own, F.lit(1))
    said = F.coalesce("e.pubDate", "e.published", "e.updated")
    rfc = F.regexp_replace(F.regexp_replace(said, r"^[A-Za-z]{3},\s*", ""), r"(?:GMT|UT|UTC|Z)$", "+0000")
    when = F.coalesce(F.try_to_timestamp(said), F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")))
    text = lambda c, missing: F.coalesce(F.trim(c), F.lit(missing))
    return rows.select(
        "file",
        text("e.title", "No title").alias("title"),
        text(F.coalesce(first["_href"], first["_VALUE"]), "").alias("url"),
        text(F.coalesce("e.description", "e.summary"), "").alias("summary"),
        when.cast("timestamp_ntz").alias("published"),
        F.lit(source).alias("feed_source"),
    )


def parsed_entries(rows: DataFrame, column: str, source: str) -> DataFrame:
    """The same of a column of single entries, as a queue delivers them."""
    return _entries(rows.select(F.from_xml(column, schemas.FEED_ENTRY).alias("e")).select("e.*"), source)


def updates(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """text, caption, chat_id, user_id, username, entities of chat updates as JSON; what is missing is empty or NULL."""
    got = payloads.withColumn("u", F.from_json(column, schemas.UPDATE))
    return got.select(
        F.coalesce("u.message.text", F.lit("")).alias("text"),
        F.coalesce("u.message.caption", F.lit("")).alias("caption"),
        F.col("u.message.chat.id").alias("chat_id"),
        F.col("u.message.from.id").alias("user_id"),
        F.coalesce("u.message.from.username", F.lit("unknown")).alias("username"),
        F.coalesce("u.message.entities", F.array().cast("array<struct<type:string,offset:int,length:int>>")).alias("entities"),
    )


def curation_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table as Parquet, under its schema; columns that its files don't have yet are NULL."""
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{path}/{name}")


def jdbc_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """The same table in a database that a JDBC driver reaches."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def _sheet(path: str, **options):
    try:
        import pandas as pd

        return pd.read_excel(path, **options)
    except ImportError as e:
        raise RuntimeError("reading workbooks needs an Excel engine for pandas, such as openpyxl") from e


def workbook_range(spark: SparkSession, path: str, sheet: str, rows: tuple[int, int], year: int, values: dict[str, int], sheet_of=_sheet) -> DataFrame:
    """A fixed range of a sheet without header: year, and one column per value. Figures lose their fractions. sheet_of reads a sheet as a pandas frame."""
    raw = sheet_of(path, sheet_name=sheet, header=None)
    cut = raw.iloc[rows[0] : rows[1] + 1]
    return spark.createDataFrame([(int(r[year]), *(float(int(r[c])) for c in values.values())) for _, r in cut.iterrows()], "year int, " + ", ".join(f"{k} double" for k in values))


def workbook_articles(spark: SparkSession, path: str, sheet: str = "Raw_GA", sheet_of=_sheet) -> DataFrame:
    """title, url, created (text), summary of a sheet with a header. Rows without a title or URL are left out."""
    raw = sheet_of(path, sheet_name=sheet).astype(object)
    raw = raw.where(raw.notna(), None)
    rows = [tuple(None if r[c] is None else str(r[c]) for c in ("Title", "URL", "Date Created", "Summary")) for _, r in raw.iterrows()]
    return spark.createDataFrame(rows, "title string, url string, created string, summary string").filter("title IS NOT NULL AND url IS NOT NULL")


def unpivoted(wide: DataFrame, series: Iterable[str]) -> DataFrame:
    """series, date (the year's last day), value."""
    return wide.unpivot(["year"], list(series), "series", "value").select("series", F.make_date("year", F.lit(12), F.lit(31)).alias("date"), F.col("value").cast("double").alias("value"))


def present_files(spark: SparkSession, directory: str, required: Iterable[str]) -> DataFrame:
    """name, present of the required files of a folder; the listing reads no contents."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory).select(F.element_at(F.split("path", "/"), -1).alias("name")).distinct().withColumn("present", F.lit(True))
    wanted = spark.createDataFrame([(x,) for x in required], "name string")
    return wanted.join(listed, "name", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def present_sources(spark: SparkSession, directory: str, required: DataFrame) -> DataFrame:
    """name, present of the required sources (name, by SOURCE) of a folder, however many; the listing reads no contents."""
    path = F.col("path")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory).select(F.coalesce(F.nullif(F.regexp_extract(path, SOURCE, 1), F.lit("")), F.regexp_extract(path, SOURCE, 2)).alias("name"))
    named = listed.select(F.url_decode("name").alias("name")).distinct().withColumn("present", F.lit(True))
    return required.select("name").join(named, "name", "left").select("name", F.coalesce("present", F.lit(False)).alias("present"))
