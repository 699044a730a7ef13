"""Queries about places: row numbers, deep pages, orders as a reader sees them, intervals, search, and dimensions over given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html, text
from ..operators import intervals, numbering, search
from ..operators import series as S
from ..sources import dimensions as D
from ..sources import landing, readers, schemas
from ..sources.domain import base, view, with_views
from .base import query

_PAGE = 500


@query(f"""
WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row, count(*) OVER () AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice, row, CAST(ceil(n / {_PAGE}.0) AS BIGINT) AS pages FROM r WHERE row > n // {2 * _PAGE} * {_PAGE} AND row <= (n // {2 * _PAGE} + 1) * {_PAGE}""")
def deep_page(spark, sf_dir):
    """The page in the middle of all lines by price."""
    lines = base(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    middle = lines.count() // (2 * _PAGE) + 1
    rows = numbering.page(lines, middle, _PAGE, F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice", "row", "pages")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS n FROM orders")
def numbered_orders(spark, sf_dir):
    """Every order's number in the list, newest first."""
    return numbering.numbered(base(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.desc_nulls_last("o_orderdate"), "o_orderkey", name="n").select("o_orderkey", "n")


def _spans_sql(n: int) -> str:
    return f"SELECT event_id, CAST(ts AS DATE) + CAST(event_id % 7 * 400 AS INTEGER) - 11000 AS a, CAST(ts AS DATE) + CAST(event_id % 7 * 400 AS INTEGER) - 11000 + CAST(event_id % {n} AS INTEGER) - 2 AS b FROM events"


def _spans(spark, sf_dir, n: int):
    day = F.date_add(F.col("ts").cast("date"), (F.col("event_id") % 7 * 400).cast("int") - 11000)
    return base(spark, sf_dir, "events").select("event_id", day.alias("start"), F.date_add(day, (F.col("event_id") % n).cast("int") - 2).alias("end"))


@query(f"""
WITH i AS ({_spans_sql(90)}), d AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n, sum(o_orderkey) AS keys FROM orders GROUP BY 1)
SELECT event_id, CAST(sum(n) AS BIGINT) AS orders, CAST(sum(keys) AS BIGINT) AS keys FROM i JOIN d ON d BETWEEN a AND b GROUP BY event_id""")
def orders_in_spans(spark, sf_dir):
    """Orders inside many overlapping intervals, days counted first; those of events that begin some years before, of no to 88 days."""
    days = base(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))
    return intervals.inside(days, _spans(spark, sf_dir, 90), how="inner").groupBy("event_id").agg(F.sum("n").alias("orders"), F.sum("keys").alias("keys"))


@query(f"""
WITH i AS ({_spans_sql(90)}), m AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders),
c AS (SELECT d, count(event_id) AS covered FROM m LEFT JOIN i ON d BETWEEN a AND b GROUP BY d)
SELECT o_orderkey, covered FROM orders JOIN c ON c.d = CAST(o_orderdate AS DATE)""")
def spans_over_orders(spark, sf_dir):
    """By how many of the intervals each order is held, as a running total over sorted ends."""
    orders = base(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    return intervals.covering(orders, _spans(spark, sf_dir, 90)).select("o_orderkey", "covered")


_CELL = "CASE p_partkey % 5 WHEN 0 THEN concat('$', CAST(p_size AS STRING), ',000.5') WHEN 1 THEN p_name WHEN 2 THEN concat(upper(substr(p_brand, 1, 1)), substr(p_type, 2)) WHEN 3 THEN lower(p_type) ELSE concat('é', p_type) END"


@query(f"""
WITH c AS (SELECT p_partkey, cell, TRY_CAST(nullif(regexp_extract(replace(replace(trim(cell), '$', ''), ',', ''), '^[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?'), '') AS DOUBLE) AS number FROM (SELECT p_partkey, {_CELL} AS cell FROM part) x)
SELECT p_partkey, row_number() OVER (ORDER BY number NULLS LAST, cell COLLATE en_us, p_partkey) AS up, row_number() OVER (ORDER BY number IS NOT NULL, CASE WHEN number IS NULL THEN cell END COLLATE en_us DESC NULLS LAST, number DESC, p_partkey) AS down FROM c""")
def locale_order(spark, sf_dir):
    """The place of each cell when a table's column is sorted, and sorted again: numbers by value, texts as a dictionary has them, equal ones as they came."""
    cells = base(spark, sf_dir, "part").select("p_partkey", F.expr(_CELL).alias("cell"))
    up = numbering.numbered(cells, *text.cell_order("cell"), "p_partkey", name="up").select("p_partkey", "up")
    down = numbering.numbered(cells, *text.cell_order("cell", descending=True), "p_partkey", name="down").select("p_partkey", "down")
    return up.join(down, "p_partkey")


#: What readers look for, in lengths from one character on.
TERMS = ("mit license", "License", "http://", ".example", "@", "ß", "é", "the ", "tion", "ing.", "que ", "der.", "ción", "copyright", "all rights", "password", "api_key", "no such term", "%", "Th")
_TERMS = "(VALUES " + ", ".join(f"('{t}')" for t in TERMS) + ") v(term)"


@query(f"SELECT term, doc_id FROM documents JOIN {_TERMS} ON contains(lower(concat_ws(' ', source, lang, text)), lower(term))")
def indexed_search(spark, sf_dir):
    """Twenty terms against all documents, by trigrams; short ones by a scan."""
    docs, at = base(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), landing.folder(spark)
    search.write_index(docs, "doc_id", ("source", "lang", "text"), at)
    return search.search(docs, "doc_id", ("source", "lang", "text"), at, TERMS).select("term", "doc_id")


_CHARTS = D.values_sql("c", "ord, chart, category", [(i, *c[:2]) for i, c in enumerate(D.CHARTS)])
_OWN, _QUOTED = ("'" + "', '".join(x) + "'" for x in (D.CUSTOM, D.TICKERS))


def _given(spark, sf_dir):
    """s_suppkey, chart: the chart that each supplier is given."""
    names = F.array(*[F.lit(c[0]) for c in D.CHARTS])
    return base(spark, sf_dir, "supplier").select("s_suppkey", F.get(names, (F.col("s_suppkey") % len(D.CHARTS)).cast("int")).alias("chart"))


_GIVEN = f"WITH {_CHARTS}, s AS (SELECT s_suppkey, chart FROM supplier JOIN c ON c.ord = s_suppkey % {len(D.CHARTS)})"


@query(f"""{_GIVEN}
SELECT s_suppkey, chart, CASE WHEN chart IN ({_OWN}) THEN 'Custom Research' WHEN chart IN ({_QUOTED}) THEN 'Yahoo Finance' ELSE 'Federal Reserve Economic Data (FRED)' END AS source_name,
       CASE WHEN chart IN ({_OWN}) THEN NULL WHEN chart IN ({_QUOTED}) THEN concat('https://finance.yahoo.com/quote/', upper(chart)) ELSE concat('https://fred.stlouisfed.org/series/', upper(chart)) END AS source_url,
       CASE WHEN chart IN ({_QUOTED}) THEN 'Yahoo Finance' ELSE 'Federal Reserve Economic Data (FRED)' END AS footer
FROM s""")
def source_links(spark, sf_dir):
    """Where a chart's data come from, for the chart that each supplier is given."""
    return S.linked(_given(spark, sf_dir), D.CUSTOM, D.TICKERS).select("s_suppkey", "chart", "source_name", "source_url", "footer")


@query(f"""{_GIVEN}
SELECT s_suppkey, chart, chart IN ({"'" + "', '".join(D.FROM_ZERO) + "'"}) AS from_zero FROM s""")
def begin_at_zero_flags(spark, sf_dir):
    """Whether the axis begins at zero, for the chart that each supplier is given."""
    return _given(spark, sf_dir).select("s_suppkey", "chart", F.col("chart").isin(*D.FROM_ZERO).alias("from_zero"))


@query("""
WITH c AS (SELECT s_suppkey AS chart, s_nationkey AS category, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS ord FROM supplier),
x AS (SELECT a.chart, b.chart AS related, row_number() OVER (PARTITION BY a.chart ORDER BY b.ord) AS pos FROM c a JOIN c b ON a.category = b.category AND a.chart <> b.chart)
SELECT chart, CAST(pos AS INTEGER) AS pos, related FROM x WHERE pos <= 3""")
def related_charts(spark, sf_dir):
    """Of each supplier, the first three others of its nation by balance."""
    rows = base(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("chart"), F.col("s_nationkey").alias("category"), F.struct((-F.col("s_acctbal")).alias("b"), "s_suppkey").alias("ord"))
    return S.related(rows)


@query("SELECT n_name AS name, concat('http://', lower(n_name), '/feed') AS url FROM nation WHERE n_nationkey % 3 <> 1")
def config_file(spark, sf_dir):
    """Landed configurations, one for each region; feeds that aren't switched off, of which some don't say."""
    nation, at = base(spark, sf_dir, "nation"), landing.folder(spark)
    on = F.when(F.col("n_nationkey") % 3 == 1, False).when(F.col("n_nationkey") % 3 == 2, True)
    one = F.struct(F.col("n_name").alias("name"), F.concat(F.lit("http://"), F.lower("n_name"), F.lit("/feed")).alias("url"), on.alias("enabled"))
    nation.groupBy("n_regionkey").agg(F.collect_list(one).alias("rss_feeds")).select(F.to_json(F.struct("rss_feeds")).alias("value")).write.option("maxRecordsPerFile", 1).text(at)
    return readers.enabled_feeds(readers.config(spark, at))


@query("SELECT s_name AS name, concat('http://x/', s_suppkey) AS url FROM supplier WHERE s_suppkey % 4 <> 1")
def enabled_feeds(spark, sf_dir):
    """Configurations in a column, one for each supplier's nation; a feed that doesn't say is on."""
    suppliers = base(spark, sf_dir, "supplier")
    on = F.when(F.col("s_suppkey") % 4 == 1, False).when(F.col("s_suppkey") % 4 == 2, True)
    one = F.struct(F.col("s_name").alias("name"), F.concat(F.lit("http://x/"), F.col("s_suppkey").cast("string")).alias("url"), on.alias("enabled"))
    documents = suppliers.groupBy("s_nationkey").agg(F.collect_list(one).alias("rss_feeds")).select(F.to_json(F.struct("rss_feeds")).alias("c"))
    return readers.enabled_feeds(documents.select(F.from_json("c", schemas.CONFIG).alias("c")).select("c.*"))


@query("SELECT n_name AS name, n_nationkey % 5 <> 0 AS present FROM nation")
def required_files(spark, sf_dir):
    """Which of the required files, one for each nation, a folder holds."""
    nation, at = base(spark, sf_dir, "nation").select("n_name", "n_nationkey"), landing.folder(spark)
    nation.filter("n_nationkey % 5 <> 0").select(F.lit("{}").alias("value"), F.col("n_name").alias("series")).write.partitionBy("series").text(at)
    return readers.present_sources(spark, at, nation.select(F.col("n_name").alias("name")))


_SAID = "CASE o_orderkey % 4 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN 1 THEN concat(CAST(CAST(o_orderdate AS DATE) AS STRING), ' 07:08:09') WHEN 2 THEN 'soon' END"


@query(f"SELECT o_orderkey, strftime(coalesce(TRY_CAST({_SAID} AS TIMESTAMP), TIMESTAMP '2024-01-01 00:00:00'), '%Y-%m-%d %H:%M:%S') AS shown, strftime(make_date(year(o_orderdate), 12, 31), '%Y-%m-%d') AS year_end FROM orders")
def lenient_dates(spark, sf_dir):
    """Dates of orders as texts, of which some can't be read and count as the clock's time, which is passed in."""
    rows = base(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.expr(_SAID).alias("said"))
    at = F.coalesce(F.try_to_timestamp("said"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return rows.select("o_orderkey", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("shown"), F.date_format(F.make_date("y", F.lit(12), F.lit(31)), "yyyy-MM-dd").alias("year_end"))


@query("SELECT page_id, CASE page_id % 6 WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE url END AS target FROM pages WHERE url NOT LIKE '%\"%' AND url NOT LIKE '%''%' AND url NOT LIKE '% %' AND url NOT LIKE '%>%'")
def meta_refresh_target(spark, sf_dir):
    """The targets of pages that forward, their header in quotes of either kind or in none, in either order, and of pages that don't."""
    heads = [
        ('<meta http-equiv="refresh" content="0; url=', '">'),
        ("<META content='5;url=", "' HTTP-EQUIV='Refresh'>"),
        ("<meta http-equiv=refresh content=0;url=", ">"),
        ("<meta name=a content=\"x > y\"><meta data-x='>' http-equiv = \"REFRESH\"\n content = '0;url=", "' />"),
        ('<meta name="refresh" content="0; url=', '">'),
        ("<!-- no header ", "-->"),
    ]
    pages = base(spark, sf_dir, "pages").filter("url NOT LIKE '%\"%' AND url NOT LIKE '%\\'%' AND url NOT LIKE '% %' AND url NOT LIKE '%>%'")
    k = (F.col("page_id") % len(heads)).cast("int")
    before, after = (F.get(F.array(*[F.lit(h[i]) for h in heads]), k) for i in (0, 1))
    return pages.select("page_id", text.refresh_target(html.refresh_content(F.concat(F.lit("<html><head>"), before, "url", after, "html"))).alias("target"))


@query(with_views(f"""
WITH n AS (SELECT CASE series WHEN 'F' THEN 'dgorder' WHEN 'O' THEN 'adefno' WHEN 'P' THEN 'vc_defense' END AS chart, date, value FROM monthly),
{D.values_sql('f', 'ord, chart, category, prefix, suffix, divisor', [(i, *c) for i, c in enumerate(D.CHARTS)])},
m AS (SELECT *, bool_or(date >= DATE '1999-01-01') OVER (PARTITION BY chart) AS has FROM n),
k AS (SELECT * FROM m WHERE date >= DATE '1999-01-01' OR chart IN ({_OWN}) OR NOT has)
SELECT f.category, k.chart, f.prefix, f.suffix, f.chart IN ({"'" + "', '".join(D.FROM_ZERO) + "'"}) AS from_zero, count(*) AS points, string_agg(CAST(year(date) AS VARCHAR), ',' ORDER BY date) AS labels,
       sum(CAST(value AS DECIMAL(30, 2)))::DOUBLE AS total, CAST(max(date) AS VARCHAR) AS latest
FROM k JOIN f ON f.chart = k.chart GROUP BY ALL""", "monthly"))
def chart_pages(spark, sf_dir):
    """What a chart's page is made of, as one row a chart: its format, its points from the first day shown on, their labels, and the latest."""
    points = view(spark, sf_dir, "monthly").replace({"F": "dgorder", "O": "adefno", "P": "vc_defense"}, subset=["series"])
    pages = S.chart_pages(points, D.charts(spark), "1999-01-01", D.EXEMPT, D.FROM_ZERO)
    total = F.aggregate("points", F.lit(0).cast("decimal(38,2)"), lambda t, p: (t + p["value"].cast("decimal(30,2)")).cast("decimal(38,2)"))
    return pages.select("category", "chart", "prefix", "suffix", "from_zero", F.size("points").cast("long").alias("points"), F.array_join(F.transform("points", lambda p: p["label"]), ",").alias("labels"), total.cast("double").alias("total"), F.col("latest_date").cast("string").alias("latest"))
