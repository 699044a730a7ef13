"""Workbooks (xlsx) as tables of cells. Files come through Spark's readers, so they may lie in any store; a task opens one file at a time."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CELLS = "file string, row int, col int, value string, error string"


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def sheet_cells(content: bytes, sheet: str) -> Iterator[tuple[int, int, str]]:
    """row, column (both from 0) and value, as text, of a sheet's cells that hold something."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): targets[s.get(_LINK)] for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")}
        if sheet not in sheets:
            raise KeyError(f"no sheet {sheet}")
        target = sheets[sheet]
        shared = [_text(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        whole = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    at = -1
    for row in whole.iter(f"{_MAIN}row"):
        at = int(row.get("r", at + 2)) - 1
        col = -1
        for c in row:
            col = _column(c.get("r")) if c.get("r") else col + 1
            kind, v = c.get("t"), c.find(f"{_MAIN}v")
            said = _text(c) if kind == "inlineStr" else None if v is None else shared[int(v.text)] if kind == "s" else v.text
            if said is not None:
                yield at, col, said


def cells(files: DataFrame, sheet: str) -> DataFrame:
    """CELLS of files (file, content). A file that is no workbook, or has no such sheet, is one row with its error."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["file"], b["content"], strict=True):
                try:
                    rows = [(name, *c, None) for c in sheet_cells(bytes(content), sheet)]
                except Exception as e:  # one file's failure is its own row
                    rows = [(name, None, None, None, f"{type(e).__name__}: {e}"[:200])]
                yield pd.DataFrame(rows, columns=["file", "row", "col", "value", "error"]).astype({"row": "Int32", "col": "Int32"})

    return files.select("file", "content").mapInPandas(read, CELLS)


def files(spark: SparkSession, path: str) -> DataFrame:
    """file, content of the workbooks at a path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def fixed_range(found: DataFrame, rows: tuple[int, int], year: int, values: dict[str, int]) -> DataFrame:
    """file, year and one column per value, of the rows from rows[0] to rows[1] (both included, from 0) of each file. Figures lose their fractions."""
    inside = found.filter(F.col("row").between(*rows))
    at = lambda c: F.max(F.when(F.col("col") == c, F.col("value"))).try_cast("double")
    wide = inside.groupBy("file", "row").agg(at(year).cast("int").alias("year"), *[F.when(at(c) >= 0, F.floor(at(c))).otherwise(F.ceil(at(c))).cast("double").alias(k) for k, c in values.items()])
    return wide.filter("year IS NOT NULL").drop("row")


def headed(found: DataFrame, names: Sequence[str]) -> DataFrame:
    """file, row and a column per name, by the first row's headers; rows without any of them are left out. A file without a header of that name has NULLs."""
    heads = found.filter("row = 0").select("file", "col", F.trim("value").alias("name")).filter(F.col("name").isin(*names))
    body = found.filter("row > 0").join(heads, ["file", "col"])
    return body.groupBy("file", "row").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])


def articles(found: DataFrame) -> DataFrame:
    """file, row, title, url, created (text), summary of sheets with a header. Rows without a title or URL are left out."""
    rows = headed(found, ("Title", "URL", "Date Created", "Summary"))
    return rows.select("file", "row", F.col("Title").alias("title"), F.col("URL").alias("url"), F.col("Date Created").alias("created"), F.col("Summary").alias("summary")).filter("title IS NOT NULL AND url IS NOT NULL")


def content(sheet: str, rows: Sequence[Sequence]) -> bytes:
    """A workbook with one sheet of texts and numbers; None is an empty cell."""
    escape = lambda s: re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", s).replace("&", "&amp;").replace("<", "&lt;")
    cell = lambda v: "<c/>" if v is None else f"<c><v>{v}</v></c>" if isinstance(v, int | float) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
    main = _MAIN.strip("{}")
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{_LINK[1:-3]}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()
