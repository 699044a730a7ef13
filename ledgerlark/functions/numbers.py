"""Numbers as readers see them. Compare numbers, not these texts: half cents round by the double's exact value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col


def grouped(x: Column | str, decimals: int = 2) -> Column:
    """With thousands separators."""
    return F.format_number(col(x), decimals)


def dollars(x: Column | str) -> Column:
    """Whole dollars; the sign stands before the currency."""
    return F.concat(F.when(col(x) < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(col(x)), 0))


def percent_text(old: Column | str, new: Column | str) -> Column:
    """The signed change in percent; NULL where the old value is 0 or missing."""
    change = 100 * F.try_divide(col(new) - col(old), col(old))
    return F.when(change.isNotNull(), F.concat(F.when(change >= 0, "+").otherwise(""), F.format_string("%.2f%%", change)))
