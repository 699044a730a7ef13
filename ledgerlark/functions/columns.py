"""Small column builders that everything else uses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def filled(x: Column | str) -> Column:
    """The value, or NULL where it is empty: reads treat both alike."""
    return F.nullif(col(x), F.lit(""))


def first_filled(*xs: Column | str, default: str | None = None) -> Column:
    """The first value that is neither NULL nor empty, or the default."""
    return F.coalesce(*map(filled, xs), *([] if default is None else [F.lit(default)]))


def holds(x: Column | str, *words: str) -> Column:
    """Whether any of the words occurs in the text; case counts."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(col(x), F.lit(w))
    return out


def first_match(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """An ordered CASE: the first condition that holds decides."""
    out = None
    for when, then in cases:
        out = F.when(when, then) if out is None else out.when(when, then)
    return out.otherwise(otherwise)


def joined(array: Column | str) -> Column:
    """An array as a comma-joined text; NULL where it is missing or empty."""
    return F.when(F.size(col(array)) > 0, F.array_join(col(array), ","))


def parts(text: Column | str) -> Column:
    """A comma-joined text as a trimmed array; empty where it is missing."""
    return F.coalesce(F.transform(F.split(filled(text), ","), lambda x: F.trim(x)), F.array().cast("array<string>"))


def clipped(text: Column | str, n: int, mark: str = "...") -> Column:
    """The first n characters, and the mark where there are more."""
    return F.when(F.length(col(text)) > n, F.concat(F.substring(col(text), 1, n), F.lit(mark))).otherwise(col(text))
