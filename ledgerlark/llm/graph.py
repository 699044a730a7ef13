"""Connected components by alternating stars; every step is a join and a minimum, so no vertex's neighbours are gathered.

Minima are written before the joins that use them, so that Spark can split the edges of a vertex that very many share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spool


def _stars(e: DataFrame) -> bool:
    """Whether every vertex has one parent at most and no parent has one."""
    ends = e.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up > 0 AND down > 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node that can be reached) for every node of the links (u, v). No links: no rows."""
    e = spool(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = spool(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = spool(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = spool(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = spool(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
