import hashlib
import random
import zlib

import numpy as np
import pytest

from ledgerlark.llm import prefix_trie as P
from ledgerlark.llm.scan import running

KIND = "conv_id long, turn long, role string, text string"


def plain(rows, shared=True):
    """The trie by dictionaries."""
    chats = {}
    for c, turn, role, text in rows:
        if c is not None:
            chats.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    chats = {c: [(r, x) for _, _, r, x in sorted(ts)] for c, ts in chats.items()}
    whole = {}
    for c, own in chats.items():
        h = zlib.crc32(str(c).encode()) % 6 if shared else 0
        whole[c] = tuple(chats.get(c - c % 100, [])[:h] + own[h:])
    members = {}
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    saved, leaves, children = {}, {}, {}
    for k, cs in members.items():
        childless = not any(len(whole[c]) > len(k) for c in cs)
        for d in range(len(k) + 1):
            saved[k[:d]] = saved.get(k[:d], 0) + (len(cs) - 1) * (len(k[-1][1]) if k else 0)
            leaves[k[:d]] = leaves.get(k[:d], 0) + childless
        if k:
            children[k[:-1]] = children.get(k[:-1], 0) + 1
    out = []
    for k, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(whole[c]) == len(k))
        out.append((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), children.get(k, 0), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df, make=P.shared_starts):
    return sorted(map(tuple, P.trie(*make(P.turns(df))).collect()), key=repr)


def made(seed, n=150, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(420), n):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["", "é", "a", "ab", None])))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_like_dictionaries(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, KIND).repartition(5)
    assert got(df) == plain(rows)
    assert got(df, P.plain) == plain(rows, shared=False)


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "lost"),
        (7, None, None, None),
        (7, None, "a", "x"),
        (7, 2, "user", "z"),
        (7, 2, "user", "y"),  # the turn of a tie that comes first
        (7, 2, "user", "y"),
        (100, 0, "user", "start"),
        (101, 5, "user", "short"),
        (104, -1, "user", "w" * 300_000),
        (2**60 + 1, 1, "user", "😀"),
    ]
    clashing = spark.createDataFrame([(*r, 1, "q", None, 2) for r in rows], KIND + ", c int, a string, n int, d int").repartition(3)
    assert got(clashing) == plain(rows)


def test_empty(spark):
    assert got(spark.createDataFrame([], KIND)) == []
    assert got(spark.createDataFrame([(None, 1, "a", "b")], KIND)) == []


def test_one_hot_conversation_and_one_hot_path(spark):
    rng = random.Random(3)
    rows = [(5, t, "user", rng.choice("ab")) for t in range(1500)]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1700) for t in range(4)]
    rows += made(9, 40)
    assert got(spark.createDataFrame(rows, KIND).repartition(6)) == plain(rows)


def test_ends_in_many_strings(spark, monkeypatch):
    monkeypatch.setattr(P, "_IDS", 3)
    rows = [(c, 0, "user", "hello") for c in range(9_950, 10_050)] + [(c, 0, "user", "x") for c in (3, 4)]
    assert got(spark.createDataFrame(rows, KIND).repartition(4), P.plain) == plain(rows, shared=False)


def test_running_over_partitions(spark):
    rng = np.random.default_rng(0)
    keys = np.sort(np.concatenate([np.full(3000, 7), rng.integers(0, 40, 2000)]))
    x, y = rng.integers(-9, 9, 5000), rng.integers(-(2**62), 2**62, 5000)
    df = spark.createDataFrame([(int(k), i, int(a), int(b)) for i, (k, a, b) in enumerate(zip(keys, x, y, strict=True))], "k long, i long, x long, y long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 77)
    try:
        out = running(df.repartition(9), "k", ["i"], keep=("i",), xors=("y",), sums=("x",)).toPandas().sort_values("i")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in np.unique(keys):
        on = keys == k
        part = out[on]
        assert (part["k"] == k).all() and list(part["n"]) == list(range(1, on.sum() + 1))
        assert list(part["x"]) == list(np.cumsum(x[on])) and list(part["y"]) == list(np.bitwise_xor.accumulate(y[on]))
