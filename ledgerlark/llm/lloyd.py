"""Centroid clustering: plain Lloyd on integers, so that sums and results are the same on any number of partitions.

A vector takes part if it has exactly `width` components and none is null or non-finite; each component x becomes the
integer floor(256 * x). Centroids start as the `clusters` vectors whose salted id hashes least. A round broadcasts the
centroids (clusters x width integers), each task adds up its vectors by nearest centroid, and a group-by merges the sums
of the tasks; the driver gets one row for each centroid. Distances are exact: squared differences of 64-bit integers.

Ties go to the smaller centroid; a centroid without vectors stays. Rows without id take part but can't be a first
centroid; of rows with one id and different vectors the least vector comes first. Repeated rows each count. With fewer
vectors than centroids there are as many centroids as vectors; without vectors, or on an empty table, there are no
rows. Integers beyond 2**27 in size raise an error, since the squared distance need not fit a long. Other columns,
whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spool, table

#: Fixed values of the query: centroids, rounds, the number of components and the salt of the first choice.
CLUSTERS, ROUNDS, WIDTH, SALT = 40, 5, 64, 2
#: Components in whole numbers at most, so that `width` squared differences fit a long.
LARGEST = 1 << 27
#: Vectors compared at once.
_BLOCK = 4096


def integers(df: DataFrame, vector: str, key: str, width: int) -> DataFrame:
    """id and v (array of integers) of the vectors that take part."""
    x = F.col(vector)
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * 256))
    fits = F.forall("v", lambda e: (e <= LARGEST) & (e >= -LARGEST))
    kept = df.filter(x.isNotNull() & (F.size(x) == width)).filter(sound).select(F.col(key).alias("id"), whole.alias("v"))
    return kept.select("id", F.when(fits, F.col("v")).otherwise(F.raise_error(F.lit("a component is too large for exact distances"))).cast("array<int>").alias("v"))


def _packed(width: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "v": [np.asarray(v, dtype="<i4").tobytes() for v in b["v"]]})

    return pack


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<i4").reshape(-1, width).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector its nearest centroid (ties: the smaller number) and the squared distance."""
    to, far = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    for a in range(0, len(x), _BLOCK):
        part = x[a : a + _BLOCK]
        d = np.empty((len(centroids), len(part)), dtype=np.int64)
        for k, c in enumerate(centroids):
            diff = part - c
            d[k] = np.einsum("ij,ij->i", diff, diff)
        to[a : a + _BLOCK] = best = d.argmin(0)
        far[a : a + _BLOCK] = d[best, np.arange(len(part))]
    return to, far


def _sums(spark: SparkSession, vectors: DataFrame, centroids: np.ndarray) -> list:
    """cluster, n and the sum of each component, for every cluster that has vectors."""
    shared, width = spark.sparkContext.broadcast(centroids), centroids.shape[1]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        n, total = np.zeros(len(c), dtype=np.int64), np.zeros(c.shape, dtype=np.int64)
        for b in batches:
            if len(b):
                x = _matrix(b["v"], width)
                to = nearest(x, c)[0]
                n += np.bincount(to, minlength=len(c))
                for k in np.unique(to):
                    total[k] += x[to == k].sum(0)
        found = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": found, "n": n[found], "sums": list(total[found])})

    by_task = vectors.select("v").mapInPandas(add, "cluster long, n long, sums array<long>")
    merged = by_task.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums"))
    rows = merged.collect()  # one row a centroid
    shared.unpersist()
    return rows


def lloyd(df: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, salt: int = SALT, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row for each vector that takes part: key, cluster, distance, cluster_inertia, inertia, centroid_sha256, cluster_size."""
    spark = df.sparkSession
    whole = integers(df, vector, key, width)
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    first = whole.filter("id IS NOT NULL").select(name.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    centroids = np.array([r["v"] for r in first], dtype=np.int64).reshape(-1, width)
    out = "cluster long, distance long"
    kind = dict(df.dtypes)[key]
    if not len(centroids):
        return spark.createDataFrame([], f"{key} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, cluster_size long")
    vectors = spool(whole.withColumn("id", F.col("id").cast("string")).mapInPandas(_packed(width), "id string, v binary"))
    for _ in range(rounds):
        before = centroids.copy()
        for r in _sums(spark, vectors, centroids):
            centroids[r["cluster"]] = [s // r["n"] for s in r["sums"]]
        if (before == centroids).all():
            break  # further rounds would change nothing
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                to, far = nearest(_matrix(b["v"], width), shared.value)
                yield pd.DataFrame({"id": b["id"], "cluster": to, "distance": far})

    assigned = spool(vectors.mapInPandas(assign, f"id string, {out}"))
    totals = assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia"), F.count(F.lit(1)).alias("n")).collect()  # one row a centroid
    inertia = sum(r["inertia"] for r in totals)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    by_cluster = spark.createDataFrame([(r["cluster"], r["inertia"], inertia, hashes[r["cluster"]], r["n"]) for r in totals], "cluster long, cluster_inertia long, inertia long, centroid_sha256 string, cluster_size long")
    return assigned.join(F.broadcast(by_cluster), "cluster").select(F.col("id").cast(kind).alias(key), F.col("cluster").cast("int").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256", "cluster_size")


def op11_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Rounds as chained tables; lists of decimals (hugeint) hold the components."""
    steps = [
        f"""WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e::DOUBLE))) = {WIDTH}),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('{SALT}:' || vec_id) AS h, v FROM v WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {CLUSTERS}))"""
    ]
    for i in range(ROUNDS + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, k := k)) AS best FROM (
  SELECT r, k, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{i}) GROUP BY r)"""
        )
        if i < ROUNDS:
            steps.append(
                f"""s{i} AS (SELECT k, list(m ORDER BY p) AS c FROM (
  SELECT a{i}.best.k AS k, p, CASE WHEN sum(x) % count(*) < 0 THEN sum(x) // count(*) - 1 ELSE sum(x) // count(*) END::BIGINT AS m
  FROM (SELECT r, unnest(v) AS x, unnest(range({WIDTH})) AS p FROM v) JOIN a{i} USING (r) GROUP BY ALL) GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(s{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN s{i} ON s{i}.k = c{i}.k)"""
            )
    n = ROUNDS
    return (
        ",\n".join(steps)
        + f"""
SELECT vec_id, best.k::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.k)::BIGINT AS cluster_inertia,
       sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256, count(*) OVER (PARTITION BY best.k) AS cluster_size
FROM a{n} JOIN v USING (r) JOIN c{n} ON c{n}.k = best.k"""
    )


SQL = {"op11_lloyd": _sql()}
QUERIES = {"op11_lloyd": op11_lloyd}
