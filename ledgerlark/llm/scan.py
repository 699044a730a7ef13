"""Running sums within keys that may span any number of partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spool


def running(df: DataFrame, key: str, order: list[str], keep: tuple[str, ...] = (), xors: tuple[str, ...] = (), sums: tuple[str, ...] = ()) -> DataFrame:
    """key, keep, n (place from 1 within key, by order) and, under their own names, running xors and sums.

    key, xors and sums are long, and they and numbers to keep are without nulls.

    Rows are sorted in range partitions. Each task adds up what it holds; a key that goes on from earlier partitions gets
    their total by a join with one row a partition at most.
    """
    spark = df.sparkSession
    totals = ["n", *xors, *sums]
    cut = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).select(key, *keep, *xors, *sums, F.spark_partition_id().alias("_pid"))
    types = dict(cut.dtypes) | {"n": "bigint"}
    kinds = ", ".join(f"`{c}` {types[c]}" for c in (key, *keep, *totals))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, held = None, None
        for b in batches:
            if not len(b):
                continue
            keys = b[key].to_numpy(np.int64)
            fresh = np.ones(len(b), dtype=bool)
            fresh[1:] = keys[1:] != keys[:-1]
            fresh[0] = name is None or keys[0] != name
            starts = np.flatnonzero(fresh)
            group = np.cumsum(fresh) - 1  # -1: what goes on from the last batch
            out = {"n": np.ones(len(b), dtype=np.int64)} | {c: b[c].to_numpy(np.int64) for c in totals[1:]}
            for i, c in enumerate(out):
                step = np.bitwise_xor if c in xors else np.add
                run = step.accumulate(out[c])
                before = np.concatenate([[0], run])[starts]  # all that came before each group of this batch
                base = before[group] if len(starts) else np.zeros(len(b), dtype=np.int64)
                base = np.where(group >= 0, base, 0)
                run = run ^ base if c in xors else run - base
                if held is not None:
                    on = group < 0
                    run[on] = run[on] ^ held[i] if c in xors else run[on] + held[i]
                out[c] = run
            name, held = keys[-1], [v[-1] for v in out.values()]
            yield b.assign(**out)

    local = spool(cut.mapInPandas(add, f"{kinds}, _pid int"))
    ends = local.groupBy("_pid").agg(F.min(key).alias("first"), F.max(F.struct(key, "n")).alias("last"), F.max_by(F.struct(*totals), F.struct(key, "n")).alias("held"))
    offsets, name, held = [], None, None
    for r in ends.orderBy("_pid").collect():  # one row a partition
        going = name is not None and r["first"] == name
        if going:
            offsets.append((r["_pid"], name, *held))
        own = list(r["held"])
        if going and r["last"][key] == name:
            own = [a ^ b if c in xors else a + b for c, a, b in zip(totals, held, own, strict=True)]
        name, held = r["last"][key], own
    schema = "_pid int, _key long, " + ", ".join(f"_{c} long" for c in totals)
    carried = F.broadcast(spark.createDataFrame(offsets, schema))
    joined = local.join(carried, (local["_pid"] == carried["_pid"]) & (local[key] == carried["_key"]), "left")
    whole = {c: (F.col(c).bitwiseXOR(F.coalesce(f"_{c}", F.lit(0).cast("long"))) if c in xors else F.col(c) + F.coalesce(f"_{c}", F.lit(0).cast("long"))) for c in totals}
    return joined.select(key, *keep, *(whole[c].alias(c) for c in totals))
