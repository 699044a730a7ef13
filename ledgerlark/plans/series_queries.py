"""Queries over series and their dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import series as S
from ..sources import dimensions as D
from ..sources import sinks
from ..sources.domain import base, view, with_views
from .base import query

#: The base tables' series, under charts' names.
NAMES = (("F", "dgorder"), ("O", "adefno"), ("P", "vc_defense"))
CUT = "1999-01-01"
_NAMED_SQL = with_views("SELECT CASE series WHEN 'F' THEN 'dgorder' WHEN 'O' THEN 'adefno' WHEN 'P' THEN 'vc_defense' END AS series, date, value FROM monthly", "monthly")


def _text(df: DataFrame, *dates: str) -> DataFrame:
    return df.withColumns({d: F.col(d).cast("string") for d in dates})


def _named(spark, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "monthly").replace(dict(NAMES), subset=["series"])


def _summary_sql(points: str) -> str:
    return with_views(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC, value DESC) AS rn, count(*) OVER (PARTITION BY series) AS n FROM {points}),
s AS (
  SELECT series, max(n) AS n, max(CASE WHEN rn = 1 THEN date END) AS latest_date, max(CASE WHEN rn = 1 THEN value END) AS latest,
         nullif(max(CASE WHEN rn = 2 THEN value END), 0) AS previous, max(CASE WHEN rn = least(n, 13) THEN value END) AS year_base
  FROM r GROUP BY series)
SELECT series, n, CAST(latest_date AS VARCHAR) AS latest_date, latest, previous, year_base, latest - previous AS period_change, 100 * ((latest - previous) / previous) AS period_change_pct,
       latest - year_base AS year_change, 100 * ((latest - year_base) / nullif(year_base, 0)) AS year_change_pct,
       CASE WHEN 100 * ((latest - previous) / previous) > 1 THEN 'up' WHEN 100 * ((latest - previous) / previous) < -1 THEN 'down' ELSE 'flat' END AS trend
FROM s""", points)


@query(_summary_sql("monthly"))
def series_summary(spark, sf_dir):
    """E8, F1-F4, C4, G7, L1."""
    return _text(S.summary(view(spark, sf_dir, "monthly")), "latest_date")


@query(_summary_sql("daily"))
def series_summary_daily(spark, sf_dir):
    """E8, F1-F4 on another grain."""
    return _text(S.summary(view(spark, sf_dir, "daily")), "latest_date")


@query(with_views("SELECT s.series, count(m.series) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(series) LEFT JOIN monthly m ON m.series = s.series GROUP BY s.series", "monthly"))
def series_manifest(spark, sf_dir):
    """Points per configured series, 0 where nothing came."""
    names = spark.createDataFrame([(x,) for x in "FOPX"], "series string")
    return S.counts(view(spark, sf_dir, "monthly"), names)


@query(with_views("SELECT series, CAST(max(date) AS VARCHAR) AS date, arg_max(value, date) AS value FROM daily GROUP BY series", "daily"))
def series_last_observation(spark, sf_dir):
    """E7."""
    return _text(S.last_observation(view(spark, sf_dir, "daily")), "date")


@query(with_views("SELECT series, CAST(date AS VARCHAR) AS date, value, count(*) OVER (PARTITION BY series) AS data_points FROM monthly", "monthly"))
def series_json_roundtrip(spark, sf_dir):
    """M1, M2, M9: points to documents, to JSON, and back."""
    names = spark.createDataFrame([(x, x, x, x) for x in "FOP"], "series string, name string, description string, units string")
    documents = sinks.series_documents(view(spark, sf_dir, "monthly"), names, "2024-01-01")
    back = documents.select(F.from_json(F.to_json(F.struct("*")), documents.schema).alias("d")).select("d.*")
    return back.select(F.col("series_id").alias("series"), "data_points", F.explode("data").alias("p")).select("series", "p.date", "p.value", "data_points")


@query(with_views("SELECT series, CAST(date AS VARCHAR) AS \"Date\", value AS \"Value\" FROM monthly", "monthly"))
def series_csv(spark, sf_dir):
    """The download's rows."""
    points = view(spark, sf_dir, "monthly").withColumn("close", F.lit(None).cast("double"))
    return points.select("series", F.col("date").cast("string").alias("Date"), S.observed("value", "close").alias("Value"))


@query(with_views(f"""
WITH p AS (SELECT * FROM monthly UNION ALL SELECT 'old', date, value FROM monthly WHERE series = 'F' AND date < DATE '1998-01-01'),
m AS (SELECT *, bool_or(date >= DATE '{CUT}') OVER (PARTITION BY series) AS has FROM p)
SELECT series, CAST(date AS VARCHAR) AS date, CAST(year(date) AS VARCHAR) AS label, value FROM m WHERE date >= DATE '{CUT}' OR series = 'P' OR NOT has""", "monthly"))
def chart_points(spark, sf_dir):
    """From a day on, with an exempt series and one that lies wholly before."""
    points = view(spark, sf_dir, "monthly")
    old = points.filter((F.col("series") == "F") & (F.col("date") < "1998-01-01")).withColumn("series", F.lit("old"))
    shown = S.labelled(S.since(points.unionByName(old), CUT, exempt=["P"]))
    return _text(shown.select("series", "date", "label", "value"), "date")


@query(f"""
WITH n AS ({_NAMED_SQL}), {D.values_sql('c', 'category, pos, chart', [(c, i, x) for c, xs in D.CATEGORIES for i, x in enumerate(xs)])}
SELECT c.category, c.pos, n.series AS chart, CAST(n.date AS VARCHAR) AS date, n.value FROM n JOIN c ON c.chart = n.series
WHERE n.date >= DATE '{CUT}' OR n.series IN ('public_defense_companies', 'vc_defense', 'ma_defense')""")
def category_points(spark, sf_dir):
    """The previews of a category's charts; nothing replaces an empty range."""
    points = S.since(_named(spark, sf_dir), CUT, exempt=D.EXEMPT, keep_all_if_none=False).withColumnRenamed("series", "chart")
    lists = S.listed(D.categories(spark), D.charts(spark))
    return _text(lists.join(points, "chart").select("category", "pos", "chart", "date", "value"), "date")


@query(f"""
WITH n AS ({_NAMED_SQL}), u AS (SELECT * FROM n UNION ALL SELECT 'unlisted', date, value FROM n WHERE series = 'dgorder'),
{D.values_sql('f', 'ord, chart, category, prefix, suffix, divisor', [(i, *c) for i, c in enumerate(D.CHARTS)])}
SELECT u.series, CAST(u.date AS VARCHAR) AS date, u.value, coalesce(f.prefix, '') AS prefix, coalesce(f.suffix, '') AS suffix, u.value / coalesce(f.divisor, 1) AS scaled FROM u LEFT JOIN f ON f.chart = u.series""")
def axis_scaled(spark, sf_dir):
    """Values as the axis shows them; a series without a format stays as it is."""
    points = _named(spark, sf_dir)
    points = points.unionByName(points.filter("series = 'dgorder'").withColumn("series", F.lit("unlisted")))
    formats = D.charts(spark).select(F.col("chart").alias("series"), "prefix", "suffix", "divisor")
    return _text(S.scaled(points, formats), "date")


@query(f"SELECT series, CASE WHEN period_change_pct > 0 THEN 'positive' WHEN period_change_pct < 0 THEN 'negative' WHEN period_change_pct = 0 THEN 'neutral' END AS period_class, CASE WHEN year_change_pct > 0 THEN 'positive' WHEN year_change_pct < 0 THEN 'negative' WHEN year_change_pct = 0 THEN 'neutral' END AS year_class FROM ({_summary_sql('daily')}) x")
def change_sign_class(spark, sf_dir):
    """L6, F3."""
    s = S.summary(view(spark, sf_dir, "daily"))
    return s.select("series", rules.sign_class("period_change_pct").alias("period_class"), rules.sign_class("year_change_pct").alias("year_class"))


@query(f"""
WITH {D.values_sql('r', 'a, b, label', D.RECESSIONS)}
SELECT coalesce(r.label, 'none') AS label, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total
FROM orders o LEFT JOIN r ON CAST(o.o_orderdate AS DATE) BETWEEN CAST(r.a AS DATE) AND CAST(r.b AS DATE) GROUP BY 1""")
def recession_overlay(spark, sf_dir):
    """Orders by the interval that their day lies in."""
    points = base(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("value"))
    marked = S.overlay(points, D.recessions(spark))
    return marked.groupBy(F.coalesce("label", F.lit("none")).alias("label")).agg(F.count(F.lit(1)).alias("orders"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


@query(with_views("SELECT CAST(date AS VARCHAR) AS date, max(CASE WHEN series = 'F' THEN value END) AS \"F\", max(CASE WHEN series = 'O' THEN value END) AS \"O\", max(CASE WHEN series = 'P' THEN value END) AS \"P\" FROM monthly GROUP BY date", "monthly"))
def series_align(spark, sf_dir):
    """One row per date, one column per series."""
    return _text(S.aligned(view(spark, sf_dir, "monthly"), ["F", "O", "P"]), "date")


@query("""
WITH w AS (SELECT year(o_orderdate) AS y, o_orderstatus AS series, CAST(trunc(CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE)) AS DOUBLE) AS value FROM orders GROUP BY 1, 2)
SELECT series, CAST(make_date(y, 12, 31) AS VARCHAR) AS date, value FROM w""")
def annual_unpivot(spark, sf_dir):
    """A wide table of years to points on the years' last days; figures lose their fractions."""
    from ..sources.readers import unpivoted

    orders = base(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    wide = orders.groupBy("year").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum("v").cast("double").cast("long").cast("double"))
    return _text(unpivoted(wide, ["F", "O", "P"]).filter("value IS NOT NULL"), "date")


@query(with_views("SELECT series, CAST(date AS VARCHAR) AS date, value FROM monthly WHERE month(date) % 5 <> 0 AND month(date) % 7 <> 0", "monthly"))
def drop_missing_points(spark, sf_dir):
    """Missing observations, as NULL and as NaN, are dropped."""
    holed = F.when(F.month("date") % 5 == 0, None).when(F.month("date") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return _text(S.without_missing(view(spark, sf_dir, "monthly").withColumn("value", holed)), "date")


@query(with_views("WITH o AS (SELECT * FROM monthly), n AS (SELECT series, date, CASE WHEN month(date) = 3 THEN value + 1 ELSE value END AS value FROM monthly) SELECT count(*) FILTER (gone) AS gone, count(*) FILTER (NOT gone) AS come, count(*) > 0 AS changed FROM (SELECT true AS gone, x.* FROM ((SELECT * FROM o) EXCEPT (SELECT * FROM n)) x UNION ALL SELECT false, y.* FROM ((SELECT * FROM n) EXCEPT (SELECT * FROM o)) y) z", "monthly"))
def change_detect(spark, sf_dir):
    """Two vintages that differ in the Marches."""
    old = view(spark, sf_dir, "monthly")
    return S.changed(old, old.withColumn("value", F.when(F.month("date") == 3, F.col("value") + 1).otherwise(F.col("value"))))
