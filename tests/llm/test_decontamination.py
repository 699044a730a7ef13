import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlark.llm import decontamination as D

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return _WORDS.findall((text or "").translate(_LOWER))


def windows(items, window):
    """Window words and the ids of the items that have them."""
    out = {}
    for k, text in items:
        ws = split(text)
        m = min(window, len(ws))
        for a in range(len(ws) - m + 1) if ws else ():
            out.setdefault(tuple(ws[a : a + m]), set()).update(() if k is None else [str(k)])
    return out


def plain(text, held):
    ws = split(text)
    hit, items = set(), set()
    for m in {len(w) for w in held}:
        for a in range(len(ws) - m + 1):
            if (run := tuple(ws[a : a + m])) in held:
                hit |= set(range(a, a + m))
                items |= held[run]
    return len(ws), len(hit), sorted(items)


def searched(text, items, window, shards=1):
    made = [D.Shard([(None if k is None else str(k), D.item_words(t)) for k, t in items[i::shards] if split(t)], window) for i in range(shards)]
    found = D.search(text, made)
    return found.n_words, sum(b - a for a, b, _, _ in found.spans), found.items


texts = st.lists(st.sampled_from("a b c ab ß é".split()), max_size=14).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, 1, 2, 30]), texts), max_size=5), texts, st.integers(1, 5), st.integers(1, 3))
def test_like_all_windows(items, text, window, shards):
    assert searched(text, items, window, shards) == plain(text, windows(items, window))


def test_words_and_bytes():
    text = "İx É-ß9\x00zZ\n a's " + "y" * 300_000 + " Q " + "\U0001f600"
    data = D._lowered(text)
    start, end, hashes = D.words(data)
    assert [data[a:b].decode() for a, b in zip(start, end, strict=True)] == split(text)
    long = " ".join(random.Random(0).choices(["alpha", "b", "Γδ", "7"], k=200_000))
    data = D._lowered(long)
    start, end, hashes = D.words(data)
    ws = [data[a:b].decode() for a, b in zip(start, end, strict=True)]
    assert ws == split(long) and len({(w, h) for w, h in zip(ws, hashes.tolist(), strict=True)}) == 4


def made(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    say = lambda k: " ".join(rng.choices(vocabulary, k=k))
    items = [(i, say(rng.choice([0, 1, 3, 10, 11, 40]))) for i in range(25)] + [(3, say(12)), (None, say(15)), (9, None)]
    docs = [(i, say(rng.randint(0, 60)) + " " + (rng.choice(items)[1] or "") + "; " + say(5)) for i in range(n)]
    return docs + [(None, None), (1, ""), (2**60 + 1, " ".join(t or "" for _, t in items)), (2**60 + 1, " ".join(t or "" for _, t in items))], items


@pytest.mark.parametrize(("shard_words", "shards"), [(40_000, 4), (60, 2), (40, 1)])
def test_hits(spark, shard_words, shards):
    docs, items = made(1)
    clashing = spark.createDataFrame([(*r, "x", 1, 2, None) for r in docs], "doc_id long, text string, t string, k int, sha int, spans string").repartition(3)
    bench = spark.createDataFrame([(*r, 1, "y") for r in items], "item_id long, text string, k int, ws string")
    got = D.hits(clashing, bench, shard_words=shard_words, shards=shards).collect()
    held = windows(items, 10)
    seen = sorted((str(r["doc_id"]), r["n_words"], sum(s["last"] - s["first"] for s in r["spans"]), list(r["items"])) for r in got)
    assert seen == sorted((str(k), *plain(t, held)) for k, t in docs)


def test_a_long_item_in_parts(spark):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(50)}" for _ in range(1000))
    docs = [(i, "start " + " ".join(long.split()[a : a + 12]) + " end") for i, a in enumerate(range(0, 988, 13))]
    got = D.hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, long)], "item_id long, text string"), shard_words=100, shards=3).collect()
    held = windows([(1, long)], 10)
    assert sorted((r["doc_id"], r["n_words"], sum(s["last"] - s["first"] for s in r["spans"]), list(r["items"])) for r in got) == [(k, *plain(t, held)) for k, t in docs]


def test_empty_tables(spark):
    no_docs, no_items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, None), (2, "-")], "item_id long, text string")
    assert D.hits(no_docs, no_items).count() == 0
    (row,) = D.hits(spark.createDataFrame([(1, "a b")], no_docs.schema), no_items).collect()
    assert (row["n_words"], row["spans"], row["items"]) == (2, [], [])


def test_clean(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = [(1, f"É one two {item.upper()}, three " + "four " * 30, "a"), (2, f"{item} x", "b"), (3, "clean text", "c"), (4, None, "d"), (5, " ".join(f"q{i}" for i in range(11)) + " z" * 30, "e")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in D.clean(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 3, 4, 5}  # 2 is mostly the item
    assert got[1]["text"] == "É one two , three " + "four " * 30 and got[1]["source"] == "a"
    assert got[3]["text"] == "clean text" and got[4]["text"] is None
    assert got[5]["text"] == docs[4][1]  # its run is shorter than the limit


def test_digest_columns(spark):
    import __spark_entry__ as e

    got = e.queries()["op12_decontamination"](spark, "/root/testdata/sf0.001").toPandas()
    none = got[got["n_items"] == 0]
    assert set(none["items_sha256"]) == {hashlib.sha256(b"").hexdigest()} and not none["contaminated"].any() and (none["n_hit"] == 0).all()
    assert got["contaminated"].any()
