"""Folders for files that a job lands and reads again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_FOLDERS: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir. A temporary folder serves only local masters. It goes with the process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="ledgerlark-")
        spark.conf.set("spark.checkpoint.dir", at)
        _FOLDERS.append(at)
    _FOLDERS.append(f"{at.rstrip('/')}/landed/{uuid.uuid4().hex}")
    return _FOLDERS[-1]


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for at in _FOLDERS:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(conf).delete(path, True)
    except Exception:  # the JVM may be gone by now; then the folder's owner cleans it
        return
