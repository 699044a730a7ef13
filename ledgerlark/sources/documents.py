"""Landed series documents as a data source: spark.read.format("series_documents").option("path", …).load().

Each document is a partition, read by a task of its own; a document that can't be read is a row with its error, and the
others are whole. Documents of values and of quotes (open, high, low, close, volume) share one schema. Folders are listed
by pyarrow's file systems (local, HDFS, S3, GCS), which give the tasks the same access; where only Spark's readers reach a
store, sources.readers reads the same documents.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .workers import importable

SCHEMA = "source string, series string, pos int, date string, value double, open double, high double, low double, close double, volume long, error string"
_FIGURES = ("value", "open", "high", "low", "close")


class _Document(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _number(x):
    return None if x is None or isinstance(x, bool) else float(x)


def parsed(source: str, text: str):
    """Rows of a document; its series is what it says it is, or else its source."""
    document = json.loads(text)
    name = document.get("series_id") or document.get("ticker") or source
    for pos, p in enumerate(document["data"]):
        yield (source, name, pos, p.get("date"), *(_number(p.get(c)) for c in _FIGURES), None if p.get("volume") is None else int(p["volume"]), None)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def partitions(self):
        from pyarrow import fs

        system, at = self._files()
        listed = system.get_file_info(fs.FileSelector(at, recursive=True))
        hidden = lambda path: any(x[:1] in "._" for x in path[len(at) :].split("/") if x)
        return [_Document(f.path) for f in sorted(listed, key=lambda f: f.path) if f.is_file and not hidden(f.path)]

    def read(self, partition):
        if partition is None:  # a folder without documents
            return
        system, _ = self._files()
        folder, _, name = partition.path.rpartition("/")
        parent = folder.rpartition("/")[2]
        source = parent.removeprefix("series=") if parent.startswith("series=") else name.rpartition(".")[0] or name
        try:
            with system.open_input_stream(partition.path) as f:
                rows = list(parsed(source, f.read().decode("utf-8")))
        except Exception as e:  # one document's failure is its own row
            rows = [(source, *[None] * 9, type(e).__name__)]
        yield from rows


class SeriesDocuments(DataSource):
    @classmethod
    def name(cls):
        return "series_documents"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    importable(spark).dataSource.register(SeriesDocuments)
