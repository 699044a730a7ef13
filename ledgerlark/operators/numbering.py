"""Row numbers, running totals and deep pages: ranges are sorted apart, and only one number a range meets on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import landing

#: A page that ends within so many rows is cut from the first rows alone.
SHALLOW = 10_000
_LOCAL = (1 << 33) - 1


def _columns(order) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _sorted(rows: DataFrame, order) -> tuple[DataFrame, dict[int, int]]:
    """rows, written in order, with _at (range and place in it); and the number of rows before each range. Equal rows keep apart, so a hot value is no hot range."""
    by, at = _columns(order), landing.folder(rows.sparkSession)
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    cut = tied.repartitionByRange(*by, "_tie").sortWithinPartitions(*by, "_tie").drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    cut.write.parquet(at)
    written = rows.sparkSession.read.schema(cut.schema).parquet(at)
    counts = written.groupBy(F.shiftright("_at", 33).alias("range")).agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect()  # one row a range
    before, total = {}, 0
    for r in counts:
        before[r["range"]] = total
        total += r["n"]
    return written, before | {-1: total}


def _placed(written: DataFrame, before: dict[int, int], name: str) -> DataFrame:
    offsets = written.sparkSession.createDataFrame([(k, n) for k, n in before.items() if k >= 0], "_range long, _before long")
    joined = written.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(offsets), "_range")
    return joined.withColumn(name, F.col("_at").bitwiseAND(F.lit(_LOCAL)) + F.col("_before") + 1).drop("_before")


def numbered(rows: DataFrame, *order: str | Column, name: str = "row") -> DataFrame:
    """rows with their place by order, from 1. Ties come as they arrive. No rows: none."""
    return _placed(*_sorted(rows, order), name).select(*rows.columns, name)


def running(rows: DataFrame, value: str, *order: str | Column, name: str = "total") -> DataFrame:
    """rows with the sum of value up to each of them, by order. NULL counts as zero."""
    written, _ = _sorted(rows, order)
    whole = written.withColumn("_range", F.shiftright("_at", 33))
    sums = whole.groupBy("_range").agg(F.coalesce(F.sum(value), F.lit(0)).alias("n")).orderBy("_range").collect()  # one row a range
    offsets, total = [], 0
    for r in sums:
        offsets.append((r["_range"], total))
        total += r["n"]
    kind = "double" if isinstance(total, float) else "long"
    before = rows.sparkSession.createDataFrame(offsets, f"_range long, _before {kind}")
    local = F.sum(F.coalesce(value, F.lit(0))).over(Window.partitionBy("_range").orderBy("_at"))
    return whole.withColumn("_local", local).join(F.broadcast(before), "_range").select(*rows.columns, (F.col("_local") + F.col("_before")).alias(name))


def page(rows: DataFrame, number: int, size: int, *order: str | Column) -> DataFrame:
    """A page of rows with row (from 1) and pages, the number of pages; a page beyond the last is empty.

    The first pages come from the first rows alone. A deeper page sorts ranges, and reads only where it lies: its place in
    the written rows is a filter on _at, which Parquet's statistics answer.
    """
    if number * size <= SHALLOW:
        place = F.row_number().over(Window.orderBy(*order))  # over SHALLOW rows at most
        top = rows.orderBy(*order).limit(number * size).withColumn("row", place.cast("long"))
        pages = rows.agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("long").alias("pages")).scalar()
        return top.filter(F.col("row") > (number - 1) * size).withColumn("pages", pages)
    written, before = _sorted(rows, order)
    total, first, last = before[-1], (number - 1) * size, number * size
    starts = sorted((n, k) for k, n in before.items() if k >= 0)
    wanted = F.lit(False)
    for i, (start, k) in enumerate(starts):
        stop = starts[i + 1][0] if i + 1 < len(starts) else total
        a, b = max(first, start), min(last, stop)
        if a < b:
            wanted |= F.col("_at").between((k << 33) + a - start, (k << 33) + b - start - 1)
    return _placed(written.filter(wanted), before, "row").select(*rows.columns, "row", F.lit(-(-total // size)).cast("long").alias("pages"))
