"""Row numbers, deep pages, intervals, orders and search against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import html, text
from ledgerlark.operators import intervals as I
from ledgerlark.operators import numbering as N
from ledgerlark.operators import queues as Q
from ledgerlark.operators import search
from ledgerlark.operators import series as S
from ledgerlark.sources import readers, schemas


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [0, 1, 777])
def test_numbers(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice([None, 1, 2, 2, 2]), rng.random()) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, k long, row double").repartition(5)
    got = N.numbered(df, F.desc_nulls_last("k"), "id", name="place").collect()
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r["id"], r["place"]) for r in sorted(got, key=lambda r: r["place"])] == [(r[0], i) for i, r in enumerate(want, 1)]


def test_a_hot_value_and_plans(spark):
    df = spark.range(5000).select("id", F.lit(1).alias("k"))
    got = N.numbered(df, "k")
    assert "Window" not in plan(got) and sorted(r["row"] for r in got.collect()) == list(range(1, 5001))
    total = N.running(df.withColumn("v", F.when(F.col("id") % 2 == 0, F.lit(3))), "v", "id", name="sum")
    assert {r["id"]: r["sum"] for r in total.collect()} == {i: 3 * (i // 2 + 1) for i in range(5000)}


@pytest.mark.parametrize("shallow", [0, 10_000])
def test_pages(spark, monkeypatch, shallow):
    monkeypatch.setattr(N, "SHALLOW", shallow)
    df = spark.range(103).select((102 - F.col("id")).alias("id")).repartition(4)
    for number in (1, 2, 6, 11, 12):
        got = N.page(df, number, 10, F.desc("id"))
        assert [(r["id"], r["row"], r["pages"]) for r in got.orderBy("row").collect()] == [(102 - i, i + 1, 11) for i in range(10 * (number - 1), min(103, 10 * number))]
        assert shallow or "Window" not in plan(got)
        assert "NestedLoop" not in plan(got)
    assert N.page(df.limit(0), 1, 10, "id").count() == 0


def test_a_deep_page_reads_its_part(spark, monkeypatch):
    monkeypatch.setattr(N, "SHALLOW", 0)
    assert "GreaterThanOrEqual(_at," in plan(N.page(spark.range(1000), 3, 10, "id"))  # pushed to the scan


def made_spans(seed, points=300, spans=200):
    rng = random.Random(seed)
    ps = [(i, rng.choice([None, *range(100)])) for i in range(points)]
    iv = [(j, a, a + rng.choice([-3, 0, 1, 5, 80])) for j in range(spans) for a in (rng.randrange(100),)]
    return ps, [(j, None if j % 20 == 3 else a, None if j % 20 == 9 else b) for j, a, b in iv]


@pytest.mark.parametrize(("spans", "cell", "few"), [(200, 7, 0), (200, 1000, 0), (40, 5, 64), (0, 5, 0)])
def test_points_in_intervals(spark, spans, cell, few):
    ps, iv = made_spans(spans + cell, spans=spans)
    points = spark.createDataFrame(ps, "p long, date long").repartition(3)
    over = spark.createDataFrame(iv, "label long, start long, end long").repartition(2)
    pairs = [(p, j) for p, d in ps for j, a, b in iv if d is not None and a is not None and b is not None and a <= d <= b]
    inner = I.inside(points, over, how="inner", few=few, cell=cell)
    assert sorted((r["p"], r["label"]) for r in inner.collect()) == sorted(pairs) and inner.columns == ["p", "date", "label", "start", "end"]
    left = I.inside(points, over, few=few, cell=cell)
    alone = [(p, None) for p, _ in ps if p not in {q for q, _ in pairs}]
    assert sorted(((r["p"], r["label"]) for r in left.collect()), key=repr) == sorted(pairs + alone, key=repr)
    assert "NestedLoop" not in plan(inner) and "NestedLoop" not in plan(left)
    count = {p: sum(q == p for q, _ in pairs) for p, _ in ps}
    covered = I.covering(points, over)
    assert {r["p"]: r["covered"] for r in covered.collect()} == count and "NestedLoop" not in plan(covered)


def test_one_url_in_half_the_rows(spark):
    rows = [(i, "hot" if i % 2 else f"u{i % 40}") for i in range(2000)] + [(2000, None), (2001, None)]
    batch = spark.createDataFrame(rows, "id long, url string").repartition(6)
    got = Q.split_batch(batch, spark.createDataFrame([("u4",), ("u4",), (None,)], "url string"), "url", "id")
    new = {}
    for i, u in rows:
        if u != "u4":
            new.setdefault(u, i)
    assert sorted(r["id"] for r in got.filter("is_new").collect()) == sorted(new.values()) and got.count() == len(rows)
    assert "Window" not in plan(got)


def test_related_without_pairs(spark):
    rng = random.Random(1)
    rows = [(f"c{i}", rng.choice("xyz"), rng.random()) for i in range(120)] + [("alone", "w", 0.0)]
    got = S.related(spark.createDataFrame(rows, "chart string, category string, ord double").repartition(7), 3)
    want = {(a, i, b) for a, k, _ in rows for i, b in enumerate([b for b, l, _ in sorted(rows, key=lambda r: r[2]) if l == k and b != a][:3], 1)}
    assert {tuple(r) for r in got.collect()} == want


def test_cells_in_a_readers_order(spark):
    cells = ["$1,000", "$20", "7 apples", "-3", "Zebra", "apple", "Äpfel", "apple pie", "éclair", "Eclair", "", None, "$20"]
    df = spark.createDataFrame(list(enumerate(cells)), "i long, c string").repartition(3)
    place = lambda down: [r["i"] for r in N.numbered(df, *text.cell_order("c", descending=down), "i").orderBy("row").collect()]
    up, down = place(False), place(True)
    assert [cells[i] for i in up] == ["-3", "7 apples", "$20", "$20", "$1,000", "", "Äpfel", "apple", "apple pie", "Eclair", "éclair", "Zebra", None]
    assert up[2:4] == [1, 12] and [i for i in down if i in (1, 12)] == [1, 12]  # equal ones as they came
    said = [cells[i] for i in down if cells[i] is not None]
    assert said[:6] == ["Zebra", "éclair", "Eclair", "apple pie", "apple", "Äpfel"] and said[-5:] == ["$1,000", "$20", "$20", "7 apples", "-3"]


def test_search(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices("abcß é%.", k=rng.randint(0, 60))), rng.choice(["x", None, "Needle in hay"])) for i in range(400)]
    rows += [(None, "needle", "x"), (7, "second row of seven NEEDLE", None), (500, None, None), (501, "z" * 200_000 + "rare one", None)]
    docs = spark.createDataFrame(rows, "id long, text string, src string").repartition(4)
    terms = ["needle", "NEEDLE IN", "abc", "ß", "é%", "rare one", "%", "a.", "no such thing", "cab", "ab", "zzzz"]
    at = str(tmp_path / "index")
    search.write_index(docs, "id", ("src", "text"), at)
    got = sorted((r["term"], r["id"], r["text"]) for r in search.search(docs, "id", ("src", "text"), at, terms).select("term", "id", F.coalesce("text", F.lit("")).alias("text")).collect())
    whole = lambda r: " ".join(x for x in (r[2], r[1]) if x is not None).lower()
    assert got == sorted((t, r[0], r[1] or "") for t in terms for r in rows if r[0] is not None and t.lower() in whole(r))
    met = search.candidates(spark, at, ["needle in", "rare one", "no such thing"]).collect()
    hold = sum(t in whole(r) for t in ("needle in", "rare one") for r in rows if r[0] is not None)
    assert hold <= len(met) <= 1.2 * hold + 2 < len(rows) / 2  # candidates are a small share
    with pytest.raises(ValueError, match="at most"):
        search.candidates(spark, at, [f"term {i}" for i in range(search.MOST_TERMS + 1)])


def test_refresh_headers(spark):
    heads = [
        ("<meta http-equiv='refresh' content='1;url=a'>", "1;url=a"),
        ("<META content=0;url=b http-equiv=Refresh>", "0;url=b"),
        ('<meta data="a>b" http-equiv="refresh" content="it\'s">', "it's"),
        ('<meta name="refresh" content="x">', None),
        ('<meta http-equiv="refresh">', None),
        ("<meta " + "x" * 200_000, None),
        (None, None),
    ]
    got = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(heads)], "i long, h string").select("i", html.refresh_content("h").alias("c")).orderBy("i").collect()
    assert [r["c"] for r in got] == [c for _, c in heads]
    said = (("0; url=https://a.co/x", "https://a.co/x"), ("5;URL=https://a.co/x", None), ("0;url=a url=b", "a "), ("url=", ""), (None, None))
    targets = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(said)], "i long, c string").select("i", text.refresh_target("c").alias("t")).orderBy("i").collect()
    assert [r["t"] for r in targets] == [t for _, t in said]


def test_enabled_feeds(spark):
    document = '{"rss_feeds": [{"name": "one", "url": "u1", "enabled": true}, {"name": "two", "url": "u2", "enabled": false}, {"name": "three", "url": "u3"}]}'
    configs = spark.createDataFrame([(document,), ("{}",), ("broken",)], "c string").select(F.from_json("c", schemas.CONFIG).alias("c")).select("c.*")
    assert sorted(tuple(r) for r in readers.enabled_feeds(configs).collect()) == [("one", "u1"), ("three", "u3")]


def test_lists_come_in_parts(monkeypatch):
    """What a task gives at once doesn't grow with a batch of texts; no list is lost."""
    import pandas as pd

    from ledgerlark.operators import search as index

    batch = pd.DataFrame({"id": range(200), "text": [f"text {i} of many" for i in range(200)]})
    whole = pd.concat(index._listed(iter([batch])), ignore_index=True)
    monkeypatch.setattr(index, "_HELD", 50)
    parts = list(index._listed(iter([batch])))
    assert max(map(len, parts)) < 100 and pd.concat(parts, ignore_index=True).equals(whole)


def test_workbooks_stay_short(spark):
    """More pages make more workbooks, not longer ones."""
    from ledgerlark.plans import service_queries

    sizes = spark.range(100_000).select(service_queries._book("id").alias("book")).groupBy("book").count().collect()
    assert len(sizes) == 40 and {r["count"] for r in sizes} == {2500}
