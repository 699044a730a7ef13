"""Dimensions: small literal tables. Where order matters they carry it as ord."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Charts in their order, with the category and the axis format (prefix, suffix, divisor).
CHARTS = (
    ("dgorder", "defense-investment", "$", "B", 1000), ("vc_defense", "defense-investment", "$", "B", 1), ("ma_defense", "defense-investment", "$", "B", 1),
    ("public_defense_companies", "defense-investment", "$", "B", 1), ("adefno", "defense-industrial", "$", "B", 1000), ("adapno", "defense-industrial", "$", "B", 1000),
    ("ipb52300s", "defense-industrial", "", "", 1), ("fdefx", "defense-industrial", "$", "B", 1), ("prmfgcons", "defense-industrial", "$", "B", 1000), ("ita", "defense-industrial", "$", "", 1),
    ("indpro", "us-industrial", "", "", 1), ("pnfi", "us-industrial", "$", "T", 1000), ("gpdi", "us-industrial", "$", "T", 1000), ("drtscilm", "us-industrial", "", "%", 1),
    ("xli", "us-industrial", "$", "", 1), ("pld", "us-industrial", "$", "", 1), ("dgs10", "us-industrial", "", "%", 1),
)
# Charts of a category in the order its page shows them.
CATEGORIES = (
    ("defense-investment", ("dgorder", "public_defense_companies", "vc_defense", "ma_defense")),
    ("defense-industrial", ("adefno", "adapno", "ipb52300s", "fdefx", "prmfgcons", "ita")),
    ("us-industrial", ("indpro", "pnfi", "gpdi", "drtscilm", "xli", "pld", "dgs10")),
)
# Series of own research and tickers; series that show all years; charts whose axis begins at zero; the first day shown.
CUSTOM = ("vc_defense", "ma_defense", "public_defense_companies")
TICKERS = ("ita", "xli", "pld")
EXEMPT = ("public_defense_companies", "vc_defense", "ma_defense")
FROM_ZERO = ("public_defense_companies", "vc_defense", "ma_defense", "dgorder", "fdefx", "pnfi", "gpdi", "prmfgcons", "adefno", "adapno")
FIRST_DAY = "2019-01-01"
# Recessions, both days included.
RECESSIONS = (
    ("1980-01-01", "1980-07-31", "1980 Recession"), ("1981-07-01", "1982-11-30", "Early 1980s Recession"), ("1990-07-01", "1991-03-31", "Early 1990s Recession"),
    ("2001-03-01", "2001-11-30", "Dot-com Recession"), ("2007-12-01", "2009-06-30", "Great Recession"), ("2020-02-01", "2020-04-30", "COVID-19 Recession"),
)


def charts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(CHARTS)], "ord int, chart string, category string, prefix string, suffix string, divisor int")


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, c, list(x)) for i, (c, x) in enumerate(CATEGORIES)], "ord int, category string, charts array<string>")


def recessions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RECESSIONS), "start string, end string, label string").selectExpr("to_date(start) AS start", "to_date(end) AS end", "label")


def values_sql(name: str, columns: str, rows) -> str:
    """A literal table as a CTE."""
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"
