"""Streams, batches, versions, feeds and documents in files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerlark import commands
from ledgerlark.operators import series as S
from ledgerlark.sources import documents, readers, sinks, store
from ledgerlark.streaming import feed


def files(at):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(at) for f in fs if f.endswith(".parquet")}


def held(spark, table):
    return sorted(map(tuple, store.stored(spark, table).collect()), key=repr)


def test_intake_goes_on_where_it_stopped(spark, tmp_path):
    table = store.Table(str(tmp_path / "table"), "url string, slice long", "url", 4)
    (tmp_path / "landed").mkdir()

    def land(name, rows):
        (tmp_path / "landed" / name).write_text("\n".join(json.dumps({"url": u, "slice": s, "landed": f"2024-01-01T0{s}:00:00Z"}) for u, s in rows))

    def run():
        feed.intake(spark, str(tmp_path / "landed"), table, str(tmp_path / "state"))
        return held(spark, table)

    land("1.json", [("a", 2), ("a", 1), ("b", 1), ("", 1), (None, 1)])
    assert run() == [("a", 1), ("b", 1)]
    before = files(table.at)
    assert run() == [("a", 1), ("b", 1)] and files(table.at) == before  # nothing new: nothing written
    land("2.json", [("b", 0), ("c", 3), ("a", 3)])
    assert run() == [("a", 1), ("b", 1), ("c", 3)]  # what is in the table stays
    before = files(table.at)
    for name in ("1", ".1.crc"):  # a driver lost before the checkpoint knew of the batch: it runs again, and is void
        os.remove(tmp_path / "state" / "commits" / name)
    assert run() == [("a", 1), ("b", 1), ("c", 3)] and files(table.at) == before
    assert len(os.listdir(tmp_path / "table" / "_marks")) >= 2
    feed.intake(spark, str(tmp_path / "landed"), table, str(tmp_path / "other"))  # from the start
    assert held(spark, table) == [("a", 1), ("b", 1), ("c", 3)]


def test_updates_go_on_where_they_stopped(spark, tmp_path):
    table = store.Table(str(tmp_path / "table"), "url string, chat_id long", "url", 4)
    (tmp_path / "landed").mkdir()
    say = lambda i, text, user=1: json.dumps({"message": {"text": text, "chat": {"id": i}, "from": {"id": user}}})

    def run(name, *lines):
        (tmp_path / "landed" / name).write_text("\n".join(lines))
        feed.intake_updates(spark, str(tmp_path / "landed"), table, str(tmp_path / "state"), "1,2")
        return held(spark, table)

    first = [("http://a.co/x", 2), ("http://a.co/y", 3)]
    assert run("1", say(3, "http://a.co/x http://a.co/y"), say(2, "see http://a.co/x"), say(1, "http://a.co/z", user=9), "{}", "not json", say(4, "/status")) == first
    before = files(table.at)
    for name in ("0", ".0.crc"):  # the batch runs again, and is void
        os.remove(tmp_path / "state" / "commits" / name)
    assert run("2", "") == first and {f: t for f, t in files(table.at).items() if f in before} == before
    assert run("3", say(1, "http://a.co/y http://a.co/w")) == [("http://a.co/w", 1), *first]


@pytest.fixture
def table(tmp_path):
    return store.Table(str(tmp_path / "t"), "id long, a string, b string", "id", 8)


def test_batches(spark, table):
    rows = lambda *r: spark.createDataFrame(list(r), "id long, a string, b string")
    assert held(spark, table) == []
    assert store.insert(spark, table, rows(*[(i, "x", "y") for i in range(40)], (None, "n", "n"), (0, "w", "w")), order=("a",))
    assert len(held(spark, table)) == 40 and (0, "w", "w") in held(spark, table)
    before = files(table.at)
    assert store.upsert(spark, table, rows((3, "u", "v")).select("id", "a"), mark="m1")
    after = files(table.at)
    gone, come = before.keys() - after.keys(), after.keys() - before.keys()
    assert len({os.path.dirname(f) for f in gone | come}) == 1 and all(before[f] == after[f] for f in before.keys() & after.keys())  # one bucket
    assert (3, "u", "y") in held(spark, table)
    assert not store.upsert(spark, table, rows((3, "again", "")), mark="m1") and files(table.at) == after  # a replay is void
    store.upsert(spark, table, rows((4, "p", "q"), (100, "p", "q")), kept=("b",))
    assert {(4, "p", "y"), (100, "p", "q")} <= set(held(spark, table))
    store.remove(spark, table, rows((4, "", ""), (5, "", ""), (777, "", "")))
    assert len(held(spark, table)) == 39 and not {4, 5} & {r[0] for r in held(spark, table)}
    store.insert(spark, table, rows((4, "new", None), (6, "not", "taken")))
    assert (4, "new", None) in held(spark, table) and (6, "x", "y") in held(spark, table)
    store.upsert(spark, table, rows((5, "back", "z")))
    assert (5, "back", "z") in held(spark, table)
    assert store.insert(spark, table, rows().limit(0)) and len(held(spark, table)) == 41


def test_a_batch_that_fails_changes_nothing(spark, table):
    rows = spark.range(20).select("id", F.lit("x").alias("a"), F.lit("y").alias("b"))
    store.insert(spark, table, rows)
    before, seen = files(table.at), held(spark, table)
    spoiled = rows.withColumn("a", F.when(F.col("id") == 7, F.raise_error(F.lit("spoiled"))).otherwise("z"))
    with pytest.raises(Exception, match="spoiled"):
        store.upsert(spark, table, spoiled, mark="m")
    assert files(table.at) == before and held(spark, table) == seen and not store.marked(spark, table, "m")
    # the rows were written, the driver was lost before the mark: the same batch again changes no row
    good = rows.withColumn("a", F.lit("z"))
    store.upsert(spark, table, good)
    seen = held(spark, table)
    assert store.upsert(spark, table, good, mark="m") and held(spark, table) == seen


def test_a_table_is_put_back(spark, tmp_path, monkeypatch):
    home = str(tmp_path)
    t = commands._tables(spark, home)["rejected_items"]
    row = spark.createDataFrame([(1, 7, None, "off")], t.schema)
    commands._replaced(spark, home, "rejected_items", row)
    kept = lambda: [r["item_id"] for r in commands._tables(spark, home)["rejected_items"].collect()]
    assert kept() == [7] and not [x for x in os.listdir(home) if x.startswith(".rejected")]

    class Fails:
        """A file system whose n-th rename fails."""

        def __init__(self, fs, n):
            self.fs, self.n = fs, n

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def rename(self, a, b):
            self.n -= 1
            return self.n != 0 and self.fs.rename(a, b)

    real = commands._hadoop
    for n, said in ((1, "put aside"), (2, "put in place")):
        monkeypatch.setattr(commands, "_hadoop", lambda s, *p, n=n: (lambda fs, *rest: (Fails(fs, n), *rest))(*real(s, *p)))
        with pytest.raises(OSError, match=said):
            commands._replaced(spark, home, "rejected_items", row.limit(0))
        monkeypatch.setattr(commands, "_hadoop", real)
        assert kept() == [7]
    os.rename(tmp_path / "rejected_items", tmp_path / ".rejected_items-old-x")  # lost between the renames
    assert kept() == [7]


def test_outcomes_of_sources(spark, tmp_path):
    whole = json.dumps({"series_id": "A", "data": [{"date": "2024-01-01", "value": 1}, {"date": "2024-01-02", "value": None}]}, indent=1)
    for name, text in (("a.json", whole), ("series=b/part-0.json", whole[:-9]), ("c.json", '{"ticker": "C"}'), ("d.json", ""), ("e.json", '{"data": []}'), ("f.json", "[1, 2"), ("g.json", whole)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    # files and folders are read apart, as a reader of partitions wouldn't mix them
    named = readers.named_documents(spark, f"{tmp_path}/*.json").unionByName(readers.named_documents(spark, f"{tmp_path}/series=b/*.json"))
    got = {r["source"]: (r["n"], r["error"]) for r in readers.series_outcomes(named, spark.createDataFrame([(x,) for x in "ABCDEFX"], "source string")).collect()}
    assert got == {"A": (2, None), "B": (0, "malformed document"), "C": (0, "no data"), "D": (0, "no document"), "E": (0, None), "F": (0, "malformed document"), "X": (0, "no document")}


def test_documents_as_a_source(spark, tmp_path):
    (tmp_path / "series=q").mkdir()
    (tmp_path / "v.json").write_text(json.dumps({"series_id": "V", "data": [{"date": "2024-01-01", "value": 1}, {"date": "2024-01-02", "value": None}]}))
    (tmp_path / "series=q" / "x.json").write_text(json.dumps({"data": [{"date": "2024-01-01", "open": 1, "high": 3.5, "low": 0.5, "close": 2, "volume": 9}]}))
    (tmp_path / "bad.json").write_text('{"data": [')
    (tmp_path / "none.json").write_text("{}")
    (tmp_path / "_SUCCESS").write_text("")
    documents.register(spark)
    read = spark.read.format("series_documents").option("path", str(tmp_path)).load()
    assert read.rdd.getNumPartitions() == 4  # one a document
    rows = {(r["source"], r["pos"]): r for r in read.collect()}
    assert rows["v", 0]["value"] == 1.0 and rows["v", 1]["value"] is None and rows["v", 0]["series"] == "V"
    assert rows["q", 0]["series"] == "q" and (rows["q", 0]["open"], rows["q", 0]["high"], rows["q", 0]["low"], rows["q", 0]["close"], rows["q", 0]["volume"]) == (1.0, 3.5, 0.5, 2.0, 9)
    assert rows["bad", None]["error"] == "JSONDecodeError" and rows["none", None]["error"] == "KeyError" and len(rows) == 5
    (tmp_path / "empty").mkdir()
    assert spark.read.format("series_documents").option("path", str(tmp_path / "empty")).load().count() == 0


def test_feeds(spark, tmp_path):
    texts = {
        "rss.xml": '<?xml version="1.0"?><rss><channel><title>c</title><item><title>A &amp; B</title><link> http://a/1 </link><description><![CDATA[<b>x</b>]]></description><pubDate>Wed, 03 Apr 2024 05:06:07 +0200</pubDate></item><item><pubDate>soon</pubDate></item></channel></rss>',
        "atom.xml": '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="text">T</title><link rel="enclosure" href="http://no"/><link rel="alternate" href="http://a/2"/><published>2024-04-03T05:06:07Z</published><summary>s</summary></entry></feed>',
        "cut.xml": "<rss><channel><item><title>whole</title><link>http://a/3</link></item><item><title>cu",
        "odd.xml": "not a feed",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    docs = readers.feed_documents(spark, str(tmp_path))
    assert {os.path.basename(r["file"]): r["warning"] for r in docs.collect()} == {"rss.xml": None, "atom.xml": None, "cut.xml": "not well-formed", "odd.xml": "not well-formed"}
    got = sorted((os.path.basename(r["file"]), r["title"], r["url"], r["summary"], str(r["published"])) for r in readers.feed_items(docs, "s").collect())
    assert got == [
        ("atom.xml", "T", "http://a/2", "s", "2024-04-03 05:06:07"),
        ("cut.xml", "whole", "http://a/3", "", "None"),
        ("rss.xml", "A & B", "http://a/1", "<b>x</b>", "2024-04-03 03:06:07"),
        ("rss.xml", "No title", "", "", "None"),
    ]


def test_versions_of_series(spark, tmp_path):
    points = lambda **s: spark.createDataFrame([(k, None if v is None else float(v)) for k, vs in s.items() for v in vs], "series string, value double")
    old, new = points(a=[1, 2, 2], b=[1, None], c=[5], d=[7, 8]), points(a=[2, 1, 1], b=[None, 1], d=[8, 7], e=[0])
    changed = lambda o, n: {r["series"]: (r["rows_old"], r["rows_new"], r["changed"]) for r in S.changed_series(o, n).collect()}
    want = {"a": (3, 3, True), "b": (2, 2, False), "c": (1, 0, True), "d": (2, 2, False), "e": (0, 1, True)}
    assert changed(old, new) == want == changed(S.fingerprints(old), S.fingerprints(new))
    at = str(tmp_path / "x")
    assert sinks.rewrite_changed(old, at) == ["a", "b", "c", "d"]
    before = files(f"{at}/points")
    assert sinks.rewrite_changed(old, at) == [] and files(f"{at}/points") == before
    assert sinks.rewrite_changed(new, at) == ["a", "c", "e"]
    after = files(f"{at}/points")
    assert {f for f in before if "series=b" in f or "series=d" in f} <= after.keys() and not any("series=c" in f for f in after)
    assert sorted((r["series"], r["value"]) for r in spark.read.parquet(f"{at}/points").fillna(-1.0).collect()) == sorted((r["series"], r["value"]) for r in new.fillna(-1.0).collect())
