import numpy as np
import pytest

from ledgerlark.llm import ann


def made(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def test_hilbert_steps_to_neighbours():
    grid = np.stack(np.meshgrid(range(8), range(8), range(8), indexing="ij"), -1).reshape(-1, 3)
    key = ann.hilbert(grid, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("scale", [False, True])
def test_recall(spark, scale):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if scale:
        x *= rng.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    got = ann.nearest(made(spark, x.tolist()), "vec_id % 20 = 0").toPandas()
    y, found = x.astype(float), 0
    for q, rows in got.groupby("query_id"):
        s = y @ y[q]
        s[q] = -np.inf
        rows = rows.sort_values("rank")
        assert list(rows["rank"]) == list(range(1, 21)) and q not in set(rows["vec_id"])
        assert np.allclose(rows["score"], s[rows["vec_id"]], atol=1e-12) and (np.diff(rows["score"]) <= 1e-12).all()
        found += (rows["score"] >= np.sort(s)[-20] - 1e-12).sum()
    assert found >= 0.9 * 20 * 150


def test_few_rows_ties_and_rows_without_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (5, [0.5, 0.0]), (6, None), (7, [0.0, 0.0]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [1.0]), (None, [1.0, 1.0]), (20, []), (40, [None, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 20 = 0").orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 5, 0.5)]


def test_a_hot_vector(spark):
    x = [[1.0, 2.0, 3.0]] * 2500 + np.random.default_rng(0).standard_normal((500, 3)).tolist()
    got = ann.nearest(made(spark, x), "vec_id % 500 = 0").toPandas()
    assert len(got) == 6 * 20


def test_nothing(spark):
    assert ann.nearest(made(spark, []), "vec_id % 20 = 0").count() == 0


def test_the_index_proper(spark, monkeypatch):
    """Many cells: vectors of few inner dimensions, every fiftieth against all, and few rows compared."""
    rng = np.random.default_rng(5)
    n = 40_000
    x = rng.standard_normal((n, 4)) @ rng.standard_normal((4, 32)) + 0.05 * rng.standard_normal((n, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    reaches = []
    whole = ann._reach
    monkeypatch.setattr(ann, "_reach", lambda *a: reaches.append(whole(*a)) or reaches[-1])
    got = ann.nearest(made(spark, x.tolist()), "vec_id % 50 = 0").toPandas()
    y, found = x.astype(float), 0
    for q, rows in got.groupby("query_id"):
        s = y @ y[q]
        s[q] = -np.inf
        assert np.allclose(rows["score"], s[rows["vec_id"]], atol=1e-12) and rows["vec_id"].is_unique and len(rows) == 20
        found += (rows["score"] >= np.sort(s)[-20] - 1e-12).sum()
    assert found >= 0.9 * 20 * (n // 50)
    assert ann.CURVES * (2 * reaches[0] + 1) * ann.CELL < n / 4


def test_repeated_ids_and_products_that_overflow(spark):
    x = np.random.default_rng(2).standard_normal((50, 3)) * 1e200
    got = ann.nearest(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>"), "vec_id % 20 = 0").toPandas()
    assert len(got) == 60 and not got["score"].isna().any() and (got.sort_values(["query_id", "rank"]).groupby("query_id")["score"].diff().fillna(0).replace(np.nan, 0) <= 0).all()
    rows = [(i % 30, v) for i, v in enumerate(np.random.default_rng(3).standard_normal((600, 3)).tolist())]
    clashing = spark.createDataFrame([(*r, 1, "x", None) for r in rows], "vec_id long, embedding array<double>, id int, curve string, cell int")
    got = ann.nearest(clashing, "vec_id % 20 = 0").toPandas()
    assert set(got["query_id"]) == {0, 20} and all(len(g) == 20 and g["vec_id"].is_unique and q not in set(g["vec_id"]) for q, g in got.groupby("query_id"))


def test_wide_vectors(spark):
    x = np.random.default_rng(7).standard_normal((300, 2000)).astype(np.float32)
    got = ann.nearest(made(spark, x.tolist()), "vec_id % 50 = 0").toPandas()
    y = x.astype(float)
    for q, rows in got.groupby("query_id"):
        s = y @ y[q]
        s[q] = -np.inf
        rows = rows.sort_values("rank")
        assert len(rows) == 20 and (rows["score"].to_numpy() <= np.sort(s)[::-1][:20] + 1e-9).all() and np.allclose(rows["score"], s[rows["vec_id"]])
    assert set(got["query_id"]) == {0, 50, 100, 150, 200, 250}
