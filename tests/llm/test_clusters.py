import hashlib
import math
import random

import pytest

from ledgerlark.llm import lloyd

KIND = "vec_id long, embedding array<double>"


def plain(rows, clusters, rounds, width, salt=2):
    """Lloyd on Python's integers."""
    kept = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for k, vs in groups.items():
            centroids[k] = tuple(sum(x) // len(vs) for x in zip(*vs, strict=True))
    assigned = [(i, *near(v)[::-1]) for i, v in kept]
    total = sum(d for _, _, d in assigned)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, sum(e for _, j, e in assigned if j == k), total, sha[k]) for i, k, d in assigned), key=repr)


def got(df, **settings):
    out = lloyd.lloyd(df, **settings).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("rounds", [0, 1, 5])
def test_like_plain_integers(spark, rounds):
    rng = random.Random(rounds)
    rows = [(i, [rng.gauss(c, 0.3) for c in (i % 3, -i % 2, 1)]) for i in range(300)]
    rows += [(2**60 + 1, [0.001, -0.001, 0.0]), (2**60, [0.001, -0.001, 0.0])]
    df = spark.createDataFrame(rows, KIND).repartition(7)
    assert got(df, clusters=9, rounds=rounds, width=3) == plain(rows, 9, rounds, 3)


def test_rows_without_part_ties_and_copies(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [9.0, 0.25]), (None, [4.0, 4.0]), (3, None), (4, []), (5, [1.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [1.0, -inf]), (9, [1.0, 2.0, 3.0])]
    clashing = spark.createDataFrame([(*r, "a", 1, [1]) for r in rows], KIND + ", id string, cluster int, v array<int>")
    want = plain(rows, 3, 5, 2)
    assert len(want) == 5 and got(clashing, clusters=3, width=2) == want
    assert got(clashing, clusters=40, width=2) == plain(rows, 40, 5, 2)  # fewer vectors than centroids


def test_a_hot_vector(spark):
    rows = [(i, [1.0, 2.0]) for i in range(900)] + [(900 + i, [i / 7, -i / 3]) for i in range(100)]
    assert got(spark.createDataFrame(rows, KIND).repartition(5), clusters=4, width=2) == plain(rows, 4, 5, 2)


def test_nothing_and_too_large(spark):
    assert got(spark.createDataFrame([], KIND), width=2) == []
    assert got(spark.createDataFrame([(1, None), (None, [1.0, 2.0])], KIND), width=2) == []  # no first centroid
    with pytest.raises(Exception, match="too large"):
        got(spark.createDataFrame([(1, [1e300, 1.0])], KIND), width=2)
