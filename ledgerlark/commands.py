"""The commands over a folder of tables: each gives the rows that it shows, and those that change a table write its new version."""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .operators import queues as Q
from .operators import views as V
from .sources import readers, schemas, sinks


def _hadoop(spark: SparkSession, *paths: str):
    jvm = spark._jvm
    made = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return made[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), *made


def _recovered(spark: SparkSession, home: str, name: str) -> None:
    """Puts a table's last version back, if a command was lost between the two renames of _replaced."""
    fs, at, older = _hadoop(spark, f"{home}/{name}", f"{home}/.{name}-old-*")
    if not fs.exists(at):
        for kept in fs.globStatus(older) or ():
            if fs.rename(kept.getPath(), at):
                return


def _tables(spark: SparkSession, home: str) -> dict[str, DataFrame]:
    """The tables of a folder; missing ones are created."""
    for name, schema in schemas.TABLES.items():
        _recovered(spark, home, name)
        sinks.created(spark, home, name, schema)
    return {name: readers.curation_table(spark, home, name) for name in schemas.TABLES}


def _replaced(spark: SparkSession, home: str, name: str, rows: DataFrame) -> None:
    """Writes a table's new version beside the old one, then puts it in its place.

    A rename that fails puts the old version back and raises; a command lost between the renames leaves the old version
    aside, and the next command finds it there. Tables that change by the batch are better kept in sources.store.
    """
    new_name, old_name = f"{home}/.{name}-{uuid.uuid4().hex}", f"{home}/.{name}-old-{uuid.uuid4().hex}"
    fs, at, new, old = _hadoop(spark, f"{home}/{name}", new_name, old_name)
    sinks.write_table(rows, new_name)
    if not fs.rename(at, old):
        fs.delete(new, True)
        raise OSError(f"{name}: the old version can't be put aside; nothing has changed")
    if not fs.rename(new, at):
        back = fs.rename(old, at)
        raise OSError(f"{name}: the new version can't be put in place; {'nothing has changed' if back else f'the old one is in {old_name}'}")
    fs.delete(old, True)


def rss_fetcher(spark: SparkSession, home: str, landed: str, source: str = "landed") -> DataFrame:
    """new, duplicate: landed feeds' entries, taken into raw_items once per URL."""
    t = _tables(spark, home)["raw_items"]
    seen, taken = Observation(), Observation()
    entries = readers.feed_entries(spark, landed, source).filter("url <> ''").observe(seen, F.count(F.lit(1)).alias("n"))
    fresh = Q.new_rows(entries, t, "url", "published", "title").observe(taken, F.count(F.lit(1)).alias("n"))
    rows = fresh.select(F.xxhash64("url").alias("id"), "url", "title", F.col("summary").alias("rss_summary"), F.col("published").alias("published_date"), "feed_source", F.lit("new").alias("status"))
    _replaced(spark, home, "raw_items", t.unionByName(rows, allowMissingColumns=True).select(t.columns))
    added, every = taken.get["n"], seen.get["n"]  # counted by the write itself
    return spark.createDataFrame([(added, every - added)], "new long, duplicate long")


def article_scraper(spark: SparkSession, home: str, n: int = 5) -> DataFrame:
    """The next n items to scrape."""
    t = _tables(spark, home)
    return Q.unscraped(t["raw_items"], t["article_content"]).select("id", "url", "title").orderBy("id").limit(n)


def generate_ai_summaries(spark: SparkSession, home: str, n: int = 5, force: bool = False) -> DataFrame:
    """The next n items to extract from; with force also those that are complete."""
    t = _tables(spark, home)
    done = t["ai_extractions"].limit(0) if force else t["ai_extractions"]
    return Q.needs_extraction(t["raw_items"], t["article_content"], done).select("id", "url", "title").orderBy("id").limit(n)


def export_to_csv(spark: SparkSession, home: str, out: str = "preview") -> DataFrame:
    """The master list as it is exported; written to a folder unless that is `preview`."""
    t = _tables(spark, home)
    rows = V.csv_rows(t["master_list"], t["raw_items"])
    if out != "preview":
        sinks.write_csv(rows, out)
    return rows


def view_data(spark: SparkSession, home: str, what: str = "10") -> DataFrame:
    """The newest items found, a number of them, or the numbers of items by source with `stats`."""
    raw = _tables(spark, home)["raw_items"]
    return Q.by_source(raw) if what == "stats" else Q.newest(raw, int(what), "date_found").select("id", "title", "feed_source", "date_found")


def inspect_article(spark: SparkSession, home: str, item: int) -> DataFrame:
    t = _tables(spark, home)
    return V.item(t["raw_items"], t["article_content"], t["ai_extractions"], item)


def view_rejected(spark: SparkSession, home: str, undo: int | None = None) -> DataFrame:
    """The rejected items; with undo, whether that item's rejection was there to be taken back."""
    t = _tables(spark, home)
    if undo is None:
        return Q.newest(V.rejected_rows(t["rejected_items"], t["raw_items"], t["article_content"]), by="rejected_at", key="item_id")
    gone = spark.createDataFrame([(undo,)], "item_id long")
    found = not t["rejected_items"].join(gone, "item_id", "left_semi").isEmpty()
    if found:
        _replaced(spark, home, "rejected_items", Q.without(t["rejected_items"], gone, "item_id"))
    return spark.createDataFrame([(undo, "removed" if found else "not found")], "item_id long, outcome string")


def send_digest(spark: SparkSession, home: str, limit: int = 20) -> DataFrame:
    """The digest's lines; sending them is not the engine's work."""
    t = _tables(spark, home)
    pending = Q.pending_digest(t["raw_items"], t["article_content"], t["ai_extractions"].drop("id"), t["master_list"], t["rejected_items"])
    return V.digest_lines(V.digest(Q.newest(pending, limit)))


def queue_status(spark: SparkSession, home: str) -> DataFrame:
    """The counts that the chat's status command answers with."""
    return Q.queue_status(*_tables(spark, home).values())


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m ledgerlark", description="Commands over a folder of tables.")
    sub = p.add_subparsers(dest="command", required=True)

    def add(f, *args):
        one = sub.add_parser(f.__name__, help=(f.__doc__ or "").split("\n")[0])
        one.add_argument("home")
        for names, options in args:
            one.add_argument(*names, **options)
        one.set_defaults(run=f)

    number = lambda n: (["n"], {"type": int, "nargs": "?", "default": n})
    add(rss_fetcher, (["landed"], {}), (["source"], {"nargs": "?", "default": "landed"}))
    add(article_scraper, number(5))
    add(generate_ai_summaries, number(5), (["--force"], {"action": "store_true"}))
    add(export_to_csv, (["out"], {"nargs": "?", "default": "preview"}))
    add(view_data, (["what"], {"nargs": "?", "default": "10"}))
    add(inspect_article, (["item"], {"type": int}))
    add(view_rejected, (["--undo"], {"type": int}))
    add(send_digest, (["--limit"], {"type": int, "default": 20}))
    add(queue_status)
    return p


def run(spark: SparkSession, args: list[str]) -> DataFrame:
    given = vars(parser().parse_args(args))
    f = given.pop("run")
    given.pop("command")
    return f(spark, given.pop("home").rstrip("/"), **given)
