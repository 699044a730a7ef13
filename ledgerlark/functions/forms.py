"""Form payloads: key=value pairs parted by &, escaped; a key may repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col


def repeated(payload: Column | str, key: str) -> Column:
    """All values of a key, in order; none gives an empty list."""
    pairs = F.filter(F.split(F.coalesce(col(payload), F.lit("")), "&"), lambda x: F.substring_index(x, "=", 1) == key)
    value = lambda x: F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).otherwise(F.lit(""))
    return F.transform(pairs, lambda x: F.coalesce(F.try_url_decode(value(x)), value(x)))


def scalar(payload: Column | str, key: str) -> Column:
    """The first value of a key; empty without one."""
    return F.coalesce(F.get(repeated(payload, key), 0), F.lit(""))


def merged(first: Column | str, second: Column | str) -> Column:
    """Options of two maps; where both have a key, the second's value holds."""
    a, b = col(first), col(second)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
