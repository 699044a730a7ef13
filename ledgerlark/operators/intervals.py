"""Points inside intervals, with many of both: all ends are sorted together and cut into cells of as many rows.

An interval lies in the cells from its start to its end, a point in one, so the join is by cell. Open intervals are carried
from cell to cell, not from day to day: cells are narrow where there is much, and wide where there is little.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import numbered, running

#: Ends and points in a cell.
CELL = 1000
#: So many intervals become a literal of the plan, which needs no join at all.
FEW = 64


def _sound(intervals: DataFrame, start: str, end: str) -> DataFrame:
    return intervals.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))


def _ends(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """t, kind (0 start, 2 end), id, i: two rows of each interval, made from one, so that they share its id."""
    once = intervals.withColumn("_id", F.monotonically_increasing_id())
    ends = F.array(F.struct(F.col(start).alias("t"), F.lit(0).alias("kind")), F.struct(F.col(end).alias("t"), F.lit(2).alias("kind")))
    return once.select(F.explode(ends).alias("e"), F.col("_id").alias("id"), F.struct(*intervals.columns).alias("i")).select("e.t", "e.kind", "id", "i")


def inside(points: DataFrame, intervals: DataFrame, at: str = "date", start: str = "start", end: str = "end", how: str = "left", few: int = FEW, cell: int = CELL) -> DataFrame:
    """A row for each point and interval that holds it, both ends included. how: left keeps points without any, inner doesn't.

    An interval without a start or end, or that ends before it starts, holds nothing; a NULL point is in none. Columns of
    both must have different names.
    """
    sound = _sound(intervals, start, end)
    least = sound.limit(few + 1).collect()  # few + 1 rows at most
    if len(least) <= few:
        if not least:
            return points.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in sound.schema]).filter(F.lit(how == "left"))
        listed = F.array(*[F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in sound.schema]) for r in least])
        held = F.filter(listed, lambda i: F.col(at).between(i[start], i[end]))
        return points.select("*", (F.explode_outer if how == "left" else F.explode)(held).alias("_i")).select(*points.columns, "_i.*")
    none = lambda f, df: F.lit(None).cast(df.select(f).schema[0].dataType)
    ends = _ends(sound, start, end)
    p = F.struct(*points.columns).alias("p")
    marks = points.select(F.col(at).alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("id"), none("i", ends).alias("i"), p)
    marks = marks.unionByName(ends.withColumn("p", none("p", marks.select("p"))))
    placed = numbered(marks, "t", "kind").withColumn("cell", F.floor((F.col("row") - 1) / cell)).drop("row")
    first = placed.filter("kind = 0").select("id", "i", F.col("cell").alias("a"))
    last = placed.filter("kind = 2").select("id", F.col("cell").alias("b"))
    cells = first.join(last, "id").select("i", F.explode(F.sequence("a", "b")).alias("cell"))
    among = placed.filter("kind = 1").select("cell", "t", "p")
    holds = (among["cell"] == cells["cell"]) & among["t"].between(F.col(f"i.{start}"), F.col(f"i.{end}"))
    return among.join(cells, holds, how).select("p.*", "i.*")


def covering(points: DataFrame, intervals: DataFrame, at: str = "date", start: str = "start", end: str = "end", name: str = "covered") -> DataFrame:
    """points with the number of intervals that hold each, both ends included: a running total over sorted ends, without a row for each pair. NULL points are in none."""
    ends = _ends(_sound(intervals, start, end), start, end).select("t", "kind", (F.lit(1) - F.col("kind")).cast("long").alias("step"))
    p = F.struct(*points.columns).alias("p")
    marks = points.select(F.col(at).alias("t"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("step"), p)
    marks = marks.unionByName(ends.withColumn("p", F.lit(None).cast(marks.schema["p"].dataType)))
    swept = running(marks, "step", "t", "kind", name="_open").filter("kind = 1")
    return swept.select("p.*", F.when(F.col("t").isNull(), 0).otherwise(F.col("_open")).alias(name))
