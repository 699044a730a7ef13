"""Approximate nearest neighbours by largest inner product on shifted Hilbert curves.

CURVES times, vectors are projected on a few random directions, shifted by a random offset and put on a Hilbert curve.
Each curve is cut into cells of about CELL rows at quantiles of a bounded sample's keys, between which keys are interpolated; a hash
of the id follows the curve position in a key, so that equal vectors spread over cells instead of filling one. A query is
compared with the rows of its own cell on each curve and of those up to `reach` cells away. Spark range-partitions rows and
queries by curve and run, a run being RUN neighbouring cells; a run's queries are dealt into parts of bounded numbers. In
a part, queries go along the curve in blocks, each over its own window of rows, and the k nearest of a query leave it once.
Then the windows of all curves merge, ranked by exact scores.

The reach is measured, not guessed: a bounded number of queries is compared with all rows, and the reach is the smallest
one that covers TARGET of their true neighbours. Vectors of different norms are lifted onto a sphere by one more
coordinate, for which largest inner product means least angle.

Vectors that are null, empty, zero, or hold null or non-finite components, ids that are null, and vectors of another length
than most take no part. Products that overflow count as infinite; sums of opposite infinities are the least score. Rows that
share an id count as one candidate, the nearest of them, and a query never finds its own id; rows that share a query's id ask as
one. Ties go to the smaller id. An empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, sorted_groups, spool, table

CURVES, DIRECTIONS, BITS, CELL = 24, 8, 5, 128
#: Cells of a run; queries of a part, and of a block.
RUN, PART, BLOCK = 32, 8192, 64
#: Rows that the cuts are fitted on at most, queries that the reach is measured with at most, and the share of their neighbours to cover.
SAMPLE, TRIALS, TARGET = 32_768, 64, 0.94
_TIE_BITS = 63 - DIRECTIONS * BITS


def hilbert(grid: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of points with `bits` bits per axis."""
    x = grid.astype(np.int64).T.copy()
    axes = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(axes):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            out = out << 1 | (x[i] >> b & 1)
    return out


class Curves:
    """Projections, shifts and cuts of all curves, fitted on a sample."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, top: float, cells: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.top, self.cells = top, cells
        width = sample.shape[1] + 1
        kept = min(DIRECTIONS, width)
        self.axes = [np.linalg.qr(rng.standard_normal((width, kept)))[0] for _ in range(CURVES)]
        lifted = self.lift(sample)
        self.low, self.step, self.cuts = [], [], []
        for axes in self.axes:
            y = lifted @ axes
            a, b = np.quantile(y, 0.005, axis=0), np.quantile(y, 0.995, axis=0)
            span = np.maximum(b - a, 1e-12) * 1.25
            self.low.append(a - rng.uniform(0, 0.2, kept) * span)
            self.step.append(span / 2**BITS)
        for c in range(CURVES):
            key = np.sort(self.keys(c, lifted, ids))
            at = np.arange(1, cells) * len(key) / cells
            low = np.minimum(at.astype(np.int64), len(key) - 1)
            step = key[np.minimum(low + 1, len(key) - 1)] - key[low]
            self.cuts.append(key[low] + ((at - low) * step).astype(np.int64))

    def lift(self, x: np.ndarray) -> np.ndarray:
        y = x / self.top
        return np.concatenate([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1, keepdims=True)))], axis=1)

    @staticmethod
    def aim(q: np.ndarray) -> np.ndarray:
        q = q / np.abs(q).max(axis=1, keepdims=True)
        return np.concatenate([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))], axis=1)

    def keys(self, c: int, points: np.ndarray, ids: np.ndarray) -> np.ndarray:
        grid = np.clip((points @ self.axes[c] - self.low[c]) / self.step[c], 0, 2**BITS - 1).astype(np.int64)
        mixed = (ids.astype(np.uint64) + np.uint64(c)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        return hilbert(grid, BITS) << _TIE_BITS | (mixed >> np.uint64(64 - _TIE_BITS)).astype(np.int64)

    def cell_of(self, points: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Cells by row and curve."""
        return np.stack([np.searchsorted(self.cuts[c], self.keys(c, points, ids), side="right") for c in range(CURVES)], axis=1)


def _matrix(blobs, kind: str) -> np.ndarray:
    data = b"".join(blobs)
    return np.frombuffer(data, dtype=kind).reshape(len(blobs), -1).astype(np.float64) if len(data) else np.zeros((0, 1))


def _norms(x: np.ndarray) -> np.ndarray:
    """Lengths of vectors; those beyond the largest number count as that."""
    most = np.abs(x).max(axis=1)
    with np.errstate(over="ignore"):
        return np.minimum(most * np.linalg.norm(x / most[:, None], axis=1), np.finfo(np.float64).max)


def _nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, low=None, high=None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query its k nearest rows, among those from low to high where given: places, ids and exact scores, an id once."""
    out = []
    with np.errstate(over="ignore", invalid="ignore"):
        rough = np.nan_to_num(queries @ rows.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        for i, (q, own) in enumerate(zip(queries, query_ids, strict=True)):
            a, b = (0, len(ids)) if low is None else (low[i], high[i])
            near = rough[i, a:b]
            at = np.arange(a, b)
            wide = k + 1  # its own id may be among them
            while wide < len(near):
                least = np.partition(near, len(near) - wide)[len(near) - wide]
                least -= 1e-9 * abs(least) + 1e-12 if np.isfinite(least) else 0
                at = a + np.flatnonzero(near >= least)
                if len(np.unique(ids[at][ids[at] != own])) >= k:
                    break
                wide, at = wide * 4, np.arange(a, b)
            at = at[ids[at] != own]
            score = np.nan_to_num((rows[at] * q).sum(1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            at, score = at[order := np.lexsort((ids[at], -score))], score[order]
            first = np.sort(np.unique(ids[at], return_index=True)[1])[:k]
            out.append((at[first], ids[at[first]], score[first]))
    return out


def nearest(vectors: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), the key, score: of each row that is_query (SQL on the key's column) holds for, the k nearest found."""
    spark = prepare(vectors.sparkSession)
    kind = "<f4" if "float" in vectors.schema[vector].dataType.simpleString() else "<f8"

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            arrays = [None if v is None else np.asarray(v, dtype=np.float64) for v in batch["v"]]
            good = np.array([v is not None and len(v) > 0 and bool(np.isfinite(v).all() and v.any()) for v in arrays], dtype=bool)
            held = [v for v, g in zip(arrays, good, strict=True) if g]
            norms = [float(_norms(v[None])[0]) for v in held]
            yield pd.DataFrame({"id": batch["id"][good].astype("int64"), "q": batch["q"][good].astype(bool), "v": [v.astype(kind).tobytes() for v in held], "d": [len(v) for v in held], "norm": norms}).astype({"d": "int32", "norm": "float64"})

    bare = vectors.select(F.col(key).cast("long").alias("id"), F.expr(is_query).alias("q"), F.col(vector).alias("v")).filter("id IS NOT NULL").withColumn("q", F.coalesce("q", F.lit(False)))
    good = spool(bare.mapInPandas(whole, "id long, q boolean, v binary, d int, norm double"))
    lengths = good.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = f"query_id long, rank int, `{key}` long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    d, n, top = lengths[0]["d"], lengths[0]["n"], lengths[0]["top"]
    good = good.filter(F.col("d") == d)
    cells = max(1, -(-n // CELL))
    sample = good.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).select("id", "v").toPandas()
    curves = spark.sparkContext.broadcast(Curves(_matrix(sample["v"].tolist(), kind), sample["id"].to_numpy(), top, cells))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x, ids = _matrix(batch["v"].tolist(), kind), batch["id"].to_numpy()
            at, seen = curves.value.cell_of(curves.value.lift(x), ids), batch["q"].to_numpy(bool)
            from_ = np.full_like(at, -1)
            if seen.any():
                from_[seen] = curves.value.cell_of(curves.value.aim(x[seen]), ids[seen])
            yield pd.DataFrame({"id": ids, "q": seen, "v": batch["v"], "cells": list(at.astype(np.int32)), "asks": list(from_.astype(np.int32))})

    placed = spool(good.select("id", "v", "q").mapInPandas(place, "id long, q boolean, v binary, cells array<int>, asks array<int>"))
    reach = _reach(placed, cells, k, kind)
    return _merged(_met(placed, reach, cells, k, kind), k, key)


def _met(placed: DataFrame, reach: int, cells: int, k: int, kind: str) -> DataFrame:
    """query_id, ids, scores: the nearest rows of a query in a run's part."""
    asked = placed.filter("q").select("id", "v", F.posexplode("asks").alias("curve", "cell"))
    first, last = (F.floor(F.least(F.greatest(F.col("cell") + x, F.lit(0)), F.lit(cells - 1)) / F.lit(RUN)).cast("int") for x in (-reach, reach))
    asked = spool(asked.withColumn("run", F.explode(F.sequence(first, last))))
    parts = spool(asked.groupBy("curve", "run").agg(F.ceil(F.count(F.lit(1)) / F.lit(PART)).cast("int").alias("parts")))
    asked = asked.join(parts, ["curve", "run"]).select("curve", "run", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("asks"), "cell", "id", "v")
    rows = placed.select("id", "v", F.posexplode("cells").alias("curve", "cell")).withColumn("run", F.floor(F.col("cell") / F.lit(RUN)).cast("int")).join(parts, ["curve", "run"])
    rows = rows.select("curve", "run", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"), "cell", "id", "v")
    keys = ["curve", "run", "part"]

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in sorted_groups(batches, keys):
            asks = g["asks"].to_numpy(bool)
            q, r = g[asks], g[~asks]
            if not len(q) or not len(r):
                continue
            x, ids, cell = _matrix(r["v"].tolist(), kind), r["id"].to_numpy(), r["cell"].to_numpy()
            y, names, own = _matrix(q["v"].tolist(), kind), q["id"].to_numpy(), q["cell"].to_numpy()
            low, high = np.searchsorted(cell, own - reach, side="left"), np.searchsorted(cell, own + reach, side="right")
            for at in range(0, len(q), BLOCK):
                a, b, part = low[at], high[min(at + BLOCK, len(q)) - 1], slice(at, at + BLOCK)  # queries and rows go along the curve
                found = _nearest(y[part], names[part], x[a:b], ids[a:b], k, low[part] - a, high[part] - a)
                yield pd.DataFrame({"query_id": names[part], "ids": [i for _, i, _ in found], "scores": [s for _, _, s in found]})

    met = rows.unionByName(asked).repartitionByRange(*keys).sortWithinPartitions(*keys, "asks", "cell", "id")
    return met.mapInPandas(meet, "query_id long, ids array<long>, scores array<double>")


def _merged(met: DataFrame, k: int, key: str) -> DataFrame:
    """The windows of all curves, merged by query and ranked."""

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in sorted_groups(batches, ["query_id"]):
            ids, scores = np.concatenate(g["ids"].tolist()).astype(np.int64), np.concatenate(g["scores"].tolist())
            order = np.lexsort((ids, -scores))
            first = np.sort(np.unique(ids[order], return_index=True)[1])[:k]
            best = order[first]
            yield pd.DataFrame({"query_id": g["query_id"].iloc[0], "rank": np.arange(1, len(best) + 1, dtype=np.int32), key: ids[best], "score": scores[best]})

    return met.repartition("query_id").sortWithinPartitions("query_id").mapInPandas(rank, f"query_id long, rank int, `{key}` long, score double")


def _reach(placed: DataFrame, cells: int, k: int, kind: str) -> int:
    """The smallest reach that covers TARGET of the true neighbours of a bounded number of queries."""
    trial = placed.filter("q").orderBy(F.xxhash64("id"), "id", "v").limit(TRIALS).select("id", "v", "asks").toPandas().drop_duplicates("id")
    if not len(trial) or cells == 1:
        return 0
    held = placed.sparkSession.sparkContext.broadcast((_matrix(trial["v"].tolist(), kind), trial["id"].to_numpy()))

    def truth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, own = held.value
        best = None
        for batch in batches:
            if len(batch):
                ids, rows, cells_ = batch["id"].to_numpy(), _matrix(batch["v"].tolist(), kind), batch["cells"].to_numpy()
                parts = [pd.DataFrame({"query_id": name, "id": i, "score": s, "cells": list(cells_[at])}) for name, (at, i, s) in zip(own, _nearest(q, own, rows, ids, k), strict=True)]
                best = pd.concat([*parts, *([best] if best is not None else [])]).sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id").head(k)
        if best is not None:
            yield best

    found = placed.select("id", "v", "cells").mapInPandas(truth, "query_id long, id long, score double, cells array<int>")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    asks = dict(zip(trial["id"], trial["asks"], strict=True))
    away = sorted(int(np.abs(np.array(r["cells"]) - np.array(asks[r["query_id"]])).min()) for r in best.select("query_id", "cells").collect())  # TRIALS * k rows
    return min(away[min(len(away) - 1, int(np.ceil(TARGET * len(away))))] if away else 0, cells - 1)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


QUERIES = {"op3_ann": op3_ann}
