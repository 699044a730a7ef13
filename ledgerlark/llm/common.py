"""Reading tables, cutting lineage on shared storage, and small helpers that the operators share."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pandas as pd

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_SPOOLS: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package; where it is installed on the executors this changes nothing."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (_ROOT, env.get("PYTHONPATH", "")) if p)
    return spark


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20):
    """Within this, rows go to Python in smaller batches, of so many rows and bytes: for jobs that run inside it and whose rows grow in Python."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary folder serves only local masters."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="ledgerlark-")
    spark.conf.set("spark.checkpoint.dir", at)
    _SPOOLS.add(at)
    return at


#: Removes a query's shuffle files at its end; what is spooled needs them no more.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def spool(df: DataFrame) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: its lineage ends there, so a lost executor costs no rerun."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/spool/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        with small_batches(spark):  # reused Python workers keep what their largest batch took
            df.write.parquet(at)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _SPOOLS.add(at)
    return spark.read.schema(df.schema).parquet(at)


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or not _SPOOLS:
        return
    try:
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for at in _SPOOLS:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(conf).delete(path, True)
    except Exception:  # the JVM may be gone by now; then the folder's owner cleans it
        return


def sorted_groups(batches: Iterator["pd.DataFrame"], keys: list[str]) -> Iterator["pd.DataFrame"]:
    """A frame for each group of rows that come sorted by keys."""
    import pandas as pd

    held: list["pd.DataFrame"] = []
    name = None
    for batch in batches:
        if not len(batch):
            continue
        named = list(zip(*(batch[k].tolist() for k in keys), strict=True))
        cuts = [0, *(i for i in range(1, len(named)) if named[i] != named[i - 1]), len(named)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and named[a] != name:
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held = []
            name = named[a]
            held.append(batch.iloc[a:b])
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def named(rows: DataFrame, key: str, value: str) -> DataFrame:
    """k, the key as a string, and t, the value, for Python: pandas has no long column with nulls."""
    return rows.select(F.col(key).cast("string").alias("k"), F.col(value).alias("t"))


def lower_ascii(column):
    """A-Z to lower case; all other characters stay, whatever the locale."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slot_of(column, slots: int):
    """A slot number from 0 to slots - 1."""
    return F.pmod(F.xxhash64(column), F.lit(slots)).cast("int")


#: Bits of a slot bitmap: 2 MB, whatever the input's size.
SLOT_BITS = 24


def slot_bitmap(keys: DataFrame, column: str):
    """A bitmap of the slots (lowest SLOT_BITS bits) of a long column of hashes, as a numpy array of 64-bit words.

    It tells which keys may be in the column: a superset at any size, of bounded size. What it lets through is checked exactly
    by the join that follows; where the column holds many more keys than there are slots, it only stops to save work.
    """
    import numpy as np

    slot = F.col(column).bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
    words = keys.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, int({column} & 63))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << (SLOT_BITS - 6), dtype=np.int64)
    found = words.toPandas()
    if len(found):
        out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def in_bitmap(bitmap, keys):
    """Which of an array of 64-bit keys have a filled slot."""
    import numpy as np

    keys = keys.view(np.uint64) & np.uint64((1 << SLOT_BITS) - 1)
    return (bitmap[(keys >> np.uint64(6)).astype(np.int64)] >> (keys & np.uint64(63)) & np.uint64(1)).astype(bool)
