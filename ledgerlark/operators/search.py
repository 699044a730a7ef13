"""Search for parts of texts by an index of trigrams.

The index lists, for each trigram, the rows that hold it. A term is looked up by its rarest trigrams: their lists are
intersected, and what is in all of them is checked in the text itself. Terms under three characters are in no list, and
are looked for in all texts. Case doesn't count; nothing in a term is a wildcard.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import landing
from ..sources.workers import small_batches

#: Trigrams by which a term is looked up.
RAREST = 4
#: Terms searched for at once; they and their trigrams are literals of the plan.
MOST_TERMS = 1000
#: Folders of an index, by the trigram's hash, and parts that a trigram's rows are dealt to by their keys, so that one that all texts hold is no hot task.
_PARTS, _LOTS = 64, 16
#: Trigrams that a task gives at once.
_HELD = 1 << 17


def _part(gram: str):
    return F.pmod(F.xxhash64(gram), F.lit(_PARTS)).cast("int")


def grams(text: str) -> np.ndarray:
    """The distinct trigrams of a text, as numbers: three code points of 21 bits."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]) if len(c) > 2 else c[:0]


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found, ids, size = [], [], 0
        for i, t in zip(b["id"].tolist(), b["text"], strict=True):
            found.append(grams(t))
            ids.append(i)
            size += len(found[-1])
            if size >= _HELD:
                yield _frame(found, ids)
                found, ids, size = [], [], 0
        if found:
            yield _frame(found, ids)


def _frame(found: list[np.ndarray], ids: list[int]) -> pd.DataFrame:
    return pd.DataFrame({"gram": np.concatenate(found), "id": np.repeat(np.array(ids, dtype=np.int64), [len(x) for x in found])})


def searched(rows: DataFrame, *columns: str):
    return F.lower(F.concat_ws(" ", *columns))


def write_index(rows: DataFrame, key: str, columns: Sequence[str], directory: str) -> None:
    """Writes the lists of rows' trigrams, sorted by trigram, so that a look-up reads a part of a few files. key: a whole number; rows without one aren't found."""
    texts = rows.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), searched(rows, *columns).alias("text"))
    lists = texts.mapInPandas(_listed, "gram long, id long").withColumns({"part": _part("gram"), "lot": F.pmod(F.xxhash64("id"), F.lit(_LOTS))})
    with small_batches(rows.sparkSession):
        lists.repartition("part", "lot").sortWithinPartitions("part", "gram", "id").drop("lot").write.partitionBy("part").parquet(directory)


def candidates(spark: SparkSession, directory: str, terms: Sequence[str]) -> DataFrame:
    """term, id: rows that hold the rarest trigrams of a term of three characters or more."""
    if len(terms) > MOST_TERMS:
        raise ValueError(f"at most {MOST_TERMS} terms at once")
    lowered = spark.createDataFrame([(t,) for t in terms], "term string").select("term", F.lower("term").alias("low")).collect()  # as the texts are lowered
    wanted = {r["term"]: grams(r["low"]).tolist() for r in lowered}
    pairs = spark.createDataFrame([(t, g) for t, gs in wanted.items() for g in gs], "term string, gram long")
    parts = [r[0] for r in pairs.select(_part("gram")).distinct().collect()]
    lists = spark.read.schema("gram long, id long, part int").parquet(directory).filter(F.col("part").isin(parts))
    held = lists.join(F.broadcast(pairs.select("gram").distinct()), "gram", "left_semi")  # bounded by MOST_TERMS
    counts = {r["gram"]: r["n"] for r in held.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}
    rarest = [(t, g, min(RAREST, len(gs))) for t, gs in wanted.items() if gs and all(g in counts for g in gs) for g in sorted(gs, key=lambda g: (counts[g], g))[:RAREST]]
    chosen = spark.createDataFrame(rarest, "term string, gram long, needed int")
    met = held.join(F.broadcast(chosen), "gram").groupBy("term", "id", "needed").agg(F.size(F.collect_set("gram")).alias("n"))  # a key may have several rows
    return met.filter("n = needed").select("term", "id")


def search(rows: DataFrame, key: str, columns: Sequence[str], directory: str, terms: Sequence[str]) -> DataFrame:
    """term and the columns of rows: each row that holds a term. directory: of write_index, over the same rows and columns."""
    spark, terms = rows.sparkSession, list(dict.fromkeys(terms))
    size = {r["term"]: r["n"] for r in spark.createDataFrame([(t,) for t in terms], "term string").select("term", F.length(F.lower("term")).alias("n")).collect()}
    long, short = [t for t in terms if size[t] >= 3], [t for t in terms if size[t] < 3]
    keyed = rows.filter(F.col(key).isNotNull())
    text = searched(rows, *columns)
    found = keyed.join(candidates(spark, directory, long).withColumnRenamed("id", "_id"), F.col(key).cast("long") == F.col("_id")).filter(F.contains(text, F.lower("term"))).select("term", *rows.columns)
    if not short:
        return found
    hold = F.filter(F.array(*[F.lit(t) for t in short]), lambda t: F.contains(F.col("_text"), F.lower(t)))
    scanned = keyed.withColumn("_text", text).withColumn("term", F.explode(hold)).select("term", *rows.columns)
    return found.unionByName(scanned)


def new_index(spark: SparkSession) -> str:
    """A folder for an index that lives as long as a job."""
    return landing.folder(spark)
