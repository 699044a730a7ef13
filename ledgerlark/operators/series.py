"""Series: summaries, selections, overlays, alignment. A series frame has the columns series, date, value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import inside
from .numbering import numbered

#: Observations back that count as a year, whatever the series' frequency.
YEAR = 12


def observed(value: Column | str, close: Column | str, falsy_zero: bool = False) -> Column:
    """The value, or the close where there is none. falsy_zero takes a zero or NaN for none, as loosely typed readers do."""
    v = F.col(value) if isinstance(value, str) else value
    c = F.col(close) if isinstance(close, str) else close
    if not falsy_zero:
        return F.coalesce(v, c)
    return F.coalesce(F.when((v != 0) & ~F.isnan(v), v), F.when((c != 0) & ~F.isnan(c), c))


def without_missing(points: DataFrame) -> DataFrame:
    return points.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def summary(points: DataFrame) -> DataFrame:
    """One row per series: latest, period and year change, trend.

    A period is the observation before, a year the twelfth before or, in a shorter series, the first. Changes against
    nothing or zero are NULL. Only the newest 13 rows of a series and its first are looked at, which partial
    aggregation finds without sorting a series in one task.
    """
    item = F.struct("date", "value")
    newest = Window.partitionBy("series").orderBy(F.desc("date"), F.desc("value"))
    counted = points.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.min(item).alias("first"))
    top = points.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= YEAR + 1)
    at = lambda k: F.max(F.when(F.col("rn") == k, item))
    s = top.groupBy("series").agg(at(1).alias("last"), at(2).alias("prev"), at(YEAR + 1).alias("back")).join(counted, "series")
    latest, previous = F.col("last.value"), F.when(F.col("prev.value") != 0, F.col("prev.value"))
    base = F.when(F.col("n") > YEAR, F.col("back.value")).otherwise(F.col("first.value"))
    percent = 100 * F.try_divide(latest - previous, previous)
    return s.select(
        "series", "n", F.col("last.date").alias("latest_date"), latest.alias("latest"), previous.alias("previous"), base.alias("year_base"),
        (latest - previous).alias("period_change"), percent.alias("period_change_pct"),
        (latest - base).alias("year_change"), (100 * F.try_divide(latest - base, base)).alias("year_change_pct"),
        F.when(percent > 1, "up").when(percent < -1, "down").otherwise("flat").alias("trend"),
    )


def with_previous(points: DataFrame) -> DataFrame:
    """points with before, the value of the observation before in its series, by date, then value; NULL for the first.

    Rows are numbered in ranges and joined with the number before, so no series is sorted in one task.
    """
    placed = numbered(points, "series", "date", "value", name="_n")
    before = placed.select((F.col("_n") + 1).alias("_n"), F.col("series").alias("_series"), F.col("value").alias("before"))
    return placed.join(before, (placed["_n"] == before["_n"]) & (F.col("series") == F.col("_series")), "left").select(*points.columns, "before")


def last_observation(points: DataFrame) -> DataFrame:
    """series, date, value of the last point; a series without points has no row."""
    return points.groupBy("series").agg(F.max(F.struct("date", "value")).alias("x")).select("series", F.col("x.date").alias("date"), F.col("x.value").alias("value"))


def since(points: DataFrame, first_day: str, exempt: Sequence[str] = (), keep_all_if_none: bool = True) -> DataFrame:
    """Points from a day on. Exempt series keep all; so does, unless asked otherwise, a series that has nothing since."""
    inside = F.col("date") >= F.lit(first_day).cast("date")
    if not keep_all_if_none:
        return points.filter(inside | F.col("series").isin(*exempt))
    any_inside = points.filter(inside).select("series").distinct().withColumn("_any", F.lit(True))
    marked = points.join(any_inside, "series", "left")
    return marked.filter(inside | F.col("series").isin(*exempt) | F.col("_any").isNull()).drop("_any")


def labelled(points: DataFrame) -> DataFrame:
    return points.withColumn("label", F.year("date").cast("string"))


def scaled(points: DataFrame, formats: DataFrame) -> DataFrame:
    """points with prefix, suffix and the value divided for the axis. formats: series, prefix, suffix, divisor; unknown series stay as they are."""
    out = points.join(formats, "series", "left")
    return out.select(*points.columns, F.coalesce("prefix", F.lit("")).alias("prefix"), F.coalesce("suffix", F.lit("")).alias("suffix"), (F.col("value") / F.coalesce("divisor", F.lit(1))).alias("scaled"))


def overlay(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """points, each with the label of the interval it lies in, both days included, or NULL."""
    return inside(points, intervals).drop("start", "end")


def linked(charts: DataFrame, custom: Sequence[str], tickers: Sequence[str]) -> DataFrame:
    """charts with source_name, source_url and footer: own research has no link, tickers and economic series have their sites'. The footer credits own research to the economic series' source too."""
    c, own, ticker = F.col("chart"), F.col("chart").isin(*custom), F.col("chart").isin(*tickers)
    fred, yahoo = F.lit("Federal Reserve Economic Data (FRED)"), F.lit("Yahoo Finance")
    link = F.when(own, None).when(ticker, F.concat(F.lit("https://finance.yahoo.com/quote/"), F.upper(c))).otherwise(F.concat(F.lit("https://fred.stlouisfed.org/series/"), F.upper(c)))
    name = F.when(own, "Custom Research").when(ticker, yahoo).otherwise(fred)
    return charts.select("*", name.alias("source_name"), link.alias("source_url"), F.when(ticker, yahoo).otherwise(fred).alias("footer"))


def chart_pages(points: DataFrame, charts: DataFrame, first_day: str, exempt: Sequence[str] = (), from_zero: Sequence[str] = ()) -> DataFrame:
    """A row for each chart with points: the dimension's columns, from_zero, the summary's, and points (date, label, value, scaled) by date.

    A chart's points are one row, as its page holds them; series longer than a page is for belong in frames of points.
    """
    shown = labelled(since(without_missing(points), first_day, exempt))
    named = shown.withColumnRenamed("series", "chart").join(charts, "chart")
    one = F.struct("date", "label", "value", (F.col("value") / F.coalesce("divisor", F.lit(1))).alias("scaled"))
    rows = named.groupBy(*charts.columns).agg(F.array_sort(F.collect_list(one)).alias("points"))
    return rows.join(summary(points).withColumnRenamed("series", "chart"), "chart").withColumn("from_zero", F.col("chart").isin(*from_zero))


def aligned(points: DataFrame, series: Sequence[str]) -> DataFrame:
    """One row per date, one column per series."""
    return points.groupBy("date").pivot("series", list(series)).agg(F.first("value"))


def related(charts: DataFrame, k: int = 3) -> DataFrame:
    """chart, pos, related: up to k other charts of the category, in the dimension's order.

    They are among the category's first k + 1, which partial aggregation finds; so a category's charts aren't paired with each other.
    """
    listed = F.collect_list(F.struct(F.col("ord").alias("o"), F.col("chart").alias("c")))
    rank = F.row_number().over(Window.partitionBy("category", "_part").orderBy("ord"))  # first k + 1 of each part, then of all
    dealt = charts.select("chart", "category", "ord", F.pmod(F.xxhash64("chart"), F.lit(64)).alias("_part"))
    first = dealt.withColumn("_n", rank).filter(F.col("_n") <= k + 1).groupBy("category").agg(F.slice(F.array_sort(listed), 1, k + 1).alias("_first"))
    others = F.slice(F.filter("_first", lambda x: x["c"] != F.col("chart")), 1, k)
    return charts.join(first, "category").select("chart", F.posexplode(others).alias("pos", "x")).select("chart", (F.col("pos") + 1).cast("int").alias("pos"), F.col("x.c").alias("related"))


def fingerprints(points: DataFrame, key: str = "series") -> DataFrame:
    """key, rows, and two sums of row hashes: the same for the same rows in any order, each as often as it is there."""
    whole = [c for c in points.columns if c != key]
    h = lambda salt: F.sum(F.xxhash64(F.lit(salt), *whole).cast("decimal(38,0)"))
    return points.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), h(1).alias("h1"), h(2).alias("h2"))


def changed_series(old: DataFrame, new: DataFrame, key: str = "series") -> DataFrame:
    """key, rows_old, rows_new, changed: which series of two versions differ, rows counted as often as they are there.

    old and new are frames of points or of fingerprints, so that the old version needs no second reading.
    """
    kept = lambda df: df if {"h1", "h2", "rows"} <= set(df.columns) else fingerprints(df, key)
    side = lambda df, name: kept(df).select(F.col(key), F.struct("rows", "h1", "h2").alias(name))
    both = side(old, "o").join(side(new, "n"), key, "full_outer")
    rows = lambda name: F.coalesce(F.col(f"{name}.rows"), F.lit(0).cast("long"))
    return both.select(key, rows("o").alias("rows_old"), rows("n").alias("rows_new"), (~F.col("o").eqNullSafe(F.col("n"))).alias("changed"))


def listed(categories: DataFrame, charts: DataFrame) -> DataFrame:
    """category, pos, chart: the charts that a category lists, in its order; unknown ones are left out."""
    return categories.select("category", F.posexplode("charts").alias("pos", "chart")).join(charts.select("chart"), "chart").select("category", "pos", "chart")


def counts(points: DataFrame, names: DataFrame) -> DataFrame:
    """series, n for each configured series; 0 where nothing came."""
    return names.join(points.groupBy("series").agg(F.count(F.lit(1)).alias("n")), "series", "left").select("series", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: whether two versions of a frame differ, and in how many rows each way."""
    gone, come = old.exceptAll(new).agg(F.count(F.lit(1)).alias("gone")), new.exceptAll(old).agg(F.count(F.lit(1)).alias("come"))
    return gone.join(come, F.lit(True)).withColumn("changed", (F.col("gone") > 0) | (F.col("come") > 0))
