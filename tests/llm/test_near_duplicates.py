import collections
import random
import re

import pytest

from ledgerlark.llm import ngram_join as N
from ledgerlark.llm.common import sorted_groups
from ledgerlark.llm.graph import components
from ledgerlark.llm.shingles import shingle_set, word_hashes


def plain(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return set() if not words else {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)}


def roots(links, n):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def arrayed(sets):
    import numpy as np

    return [np.array(sorted(s), dtype=np.uint64) for s in sets]


def linked(sets, num, den):
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]


def test_shingles_against_plain_sets():
    rng = random.Random(5)
    for _ in range(3000):
        text, n = "".join(rng.choices("abAB é\n\t  \x0bÀ", k=rng.randint(0, 40))), rng.choice([1, 3, 5])
        assert len(shingle_set(text, n)) == len(plain(text, n))
    words = rng.choices(["ab", "c", "déf"], k=150_000)
    by = {}
    assert all(by.setdefault(w, h) == h for w, h in zip(words, word_hashes(" ".join(words)), strict=True)) and len(by) == 3
    assert len(word_hashes("a" * 400_000 + " b c " + "d" * 300_000)) == 4


@pytest.mark.parametrize("arrays", [0, 1000])
def test_search_finds_what_brute_force_finds(monkeypatch, arrays):
    """By lists and a heap, and by arrays."""
    monkeypatch.setattr(N, "ARRAYS", arrays)
    rng = random.Random(6)
    for _ in range(300):
        base = [rng.sample(range(200), rng.randint(1, 40)) for _ in range(3)]
        sets = []
        for _ in range(rng.randint(2, 25)):
            s = set(rng.choice(base))
            for _ in range(rng.randint(0, 4)):
                s.discard(rng.choice(list(s))) if rng.random() < 0.5 and len(s) > 1 else s.add(rng.randint(0, 300))
            sets.append(s)
        num, den = rng.choice([(90, 100), (8, 10), (5, 10)])
        names = list(range(len(sets)))
        assert roots(N.search(arrayed(sets), names, names, num, den), len(sets)) == roots(linked(sets, num, den), len(sets))
        known = [x for x in linked(sets, num, den) if rng.random() < 0.5]
        got = N.search(arrayed(sets), names, roots(known, len(sets)), num, den)
        guests = rng.randint(0, len(sets) - 1)
        hosts = len(sets) - guests
        met = [x for x in linked(sets, num, den) if min(x) < hosts]
        assert roots(N.search(arrayed(sets), names, names, num, den, guests), len(sets)) == roots(met, len(sets))
        assert roots(known + got, len(sets)) == roots(linked(sets, num, den), len(sets))


def near(rng, a):
    """A set that may link with a: some of its members are gone, some others came."""
    import numpy as np

    gone = rng.permutation(a)[int(len(a) * rng.uniform(0, 0.15)) :]
    return np.unique(np.concatenate([gone, rng.integers(0, 2**63, rng.integers(0, len(a) // 8 + 2)).astype(np.uint64)]))


def test_sets_that_link_share_a_class():
    import numpy as np

    rng = np.random.default_rng(1)
    links = 0
    for num, den in ((90, 100), (8, 10), (5, 10)):
        for _ in range(1500):
            a = np.unique(rng.integers(0, 2**63, rng.integers(1, 60) if rng.random() < 0.5 else rng.integers(1, 600)).astype(np.uint64))
            b = near(rng, a)
            both = len(np.intersect1d(a, b))
            if len(a) and len(b) and not np.array_equal(a, b) and den * both >= num * (len(a) + len(b) - both):
                links += 1
                assert set(N.classes(a, num, den)) & set(N.classes(b, num, den))
    assert links > 1000


@pytest.mark.parametrize("arrays", [0, 1000])
def test_followers_against_all_pairs(monkeypatch, arrays):
    import numpy as np

    monkeypatch.setattr(N, "ARRAYS", arrays)
    rng = np.random.default_rng(2)
    for _ in range(200):
        num, den = [(90, 100), (8, 10), (5, 10)][rng.integers(3)]
        lead = np.unique(rng.integers(0, 2**63, rng.integers(1, 200)).astype(np.uint64))
        sets = [near(rng, lead) if rng.random() < 0.7 else np.unique(rng.integers(0, 2**63, 50).astype(np.uint64)) for _ in range(rng.integers(1, 30))]
        both = [len(np.intersect1d(lead, x)) for x in sets]
        assert sorted(N.followers(lead, sets, num, den)) == [i for i, x in enumerate(sets) if den * both[i] >= num * (len(lead) + len(x) - both[i])]


def test_sorted_rows_fall_into_whole_groups():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    for _ in range(50):
        rows = pd.DataFrame({"k": np.sort(rng.integers(0, 12, 60)), "j": 0, "v": range(60)})
        cuts = [0, *sorted(rng.integers(0, 61, 7)), 60]
        out = list(sorted_groups((rows.iloc[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), ["k", "j"]))
        assert pd.concat(out)["v"].tolist() == list(range(60))
        assert len(out) == rows["k"].nunique() and all(g["k"].nunique() == 1 for g in out)


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = roots(links, 200)
    assert got == {x: want[x] for pair in links if pair[0] != pair[1] for x in pair}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("words, num, den, limits", [(3, 90, 100, None), (5, 8, 10, None), (2, 5, 10, (2, 150))])
def test_against_brute_force(spark, monkeypatch, words, num, den, limits):
    """Groups of copies, of near copies around a text that isn't the first, and chains; with limits, lists fall into blocks."""
    if limits:
        monkeypatch.setattr(N, "FOLLOWERS", limits[0])
        monkeypatch.setattr(N, "SEARCHED", limits[1])
        monkeypatch.setattr(N, "MEMBERS", 4)
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=12)
    texts = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([4, 20, 60, 120]))
        for _ in range(rng.choice([1, 2, 12])):
            t = list(base)
            for _ in range(rng.choice([0, 1, 2, 6])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(" ".join(t + (passage if rng.random() < 0.4 else [])))
    texts += ["", None, "w1", "W1", " w1\t", "w1 w2", texts[0], texts[0].upper()]
    rng.shuffle(texts)
    ids = rng.sample(range(1000), len(texts))
    got = N.near_duplicates(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string"), words, num, den)
    sets = [plain(t, words) for t in texts]
    root, least = roots(linked(sets, num, den), len(texts)), collections.defaultdict(lambda: 10**9)
    for i, r in enumerate(root):
        least[r] = min(least[r], ids[i])
    assert {r["id"]: (r["n"], r["component_id"]) for r in got.collect()} == {ids[i]: (len(sets[i]), least[root[i]]) for i in range(len(ids))}


def test_every_link_comes_through_divide_skip(spark, monkeypatch):
    """Without the search only equal sets share a component."""
    docs = spark.createDataFrame([(i, " ".join([f"w{k}" for k in range(60)] + [f"own{i}"] * (i % 3))) for i in range(9)], "doc_id long, text string")
    assert {r["component_id"] for r in N.near_duplicates(docs).collect()} == {0}
    sets = [shingle_set(r["text"], 5) for r in docs.limit(3).collect()]
    assert N.followers(sets[0], sets[1:], 8, 10) == [0, 1]
    monkeypatch.setattr(N, "divide_skip", lambda lists, need, accept: None)
    assert N.followers(sets[0], sets[1:], 8, 10) == [] and N.search(sets, [0, 1, 2], [0, 1, 2], 8, 10) == []


def test_odd_rows(spark, odd):
    assert N.near_duplicates(odd).count() == odd.count() and N.near_duplicates(odd.limit(0)).count() == 0
    kept = N.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [None, 1, 2, 2**60 + 1, None, 7, 8]))


def test_long_near_copies_of_one_leader_are_dealt_by_their_shingles(spark, monkeypatch):
    """Followers whose sets together are beyond a block's shingles are asked in parts; no link is lost."""
    monkeypatch.setattr(N, "SEARCHED", 5_000)
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(2_000)]
    docs = []
    for i in range(40):
        words = list(base)
        for _ in range(i % 5):
            words[rng.randrange(len(words))] = f"x{i}"
        docs.append((i, " ".join(words)))
    docs += [(100 + i, " ".join(f"y{i}_{k}" for k in range(50))) for i in range(5)]
    got = {r["id"]: r["component_id"] for r in N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: 0 for i in range(40)} | {100 + i: 100 + i for i in range(5)}
