"""Queries over texts, URLs, replies and rules."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import html, rules, text, tokens, urls
from ..functions.columns import parts
from ..operators import extraction
from ..sources import readers
from ..sources.domain import base, view, with_views
from .base import query
from .queue_queries import label_sql


#: Blanks as a trim of listed characters, and line ends as replacements, in SQL.
_BLANKS = " || ".join(f"chr({i})" for i in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def _clean_sql(x: str) -> str:
    lines = f"replace({x}, chr(13) || chr(10), chr(10))"
    for i in (11, 12, 13, 28, 29, 30, 0x85, 0x2028, 0x2029):
        lines = f"replace({lines}, chr({i}), chr(10))"
    return f"array_to_string(list_filter(flatten(list_transform(string_split({lines}, chr(10)), lambda l: list_transform(string_split(trim(l, {_BLANKS}), '  '), lambda p: trim(p, {_BLANKS})))), lambda x: x <> ''), ' ')"


_SPACED = "concat(text, ' \u00a0\u2003 x  \u00a0y\u2028 z\u001c', lang, '\u0085 \u3000', source, '\u00a0')"


@query(f"SELECT doc_id, {_clean_sql(_SPACED)} AS clean FROM documents")
def clean_whitespace(spark, sf_dir):
    """Texts, and blanks and line ends of all kinds behind them."""
    return base(spark, sf_dir, "documents").select("doc_id", text.clean_whitespace(F.expr(_SPACED)).alias("clean"))


_PAGE = "html"
for _tag in html.DROPPED:
    _PAGE = f"regexp_replace({_PAGE}, '<{_tag}[^>]*>.*?</{_tag}>', '', 'gis')"
_PAGE = f"regexp_replace(regexp_replace({_PAGE}, '<!--.*?-->', '', 'gs'), '<[^>]*>', '', 'gs')"
for _name, _char in (("copy", 169), ("middot", 183), ("quot", 34), ("lt", 60), ("gt", 62), ("nbsp", 160), ("amp", 38)):
    _PAGE = f"replace({_PAGE}, '&{_name};', chr({_char}))"


@query(f"SELECT page_id, clean_text, length(clean_text) AS text_length FROM (SELECT page_id, {_clean_sql(_PAGE)} AS clean_text FROM pages) x")
def clean_html(spark, sf_dir):
    """By a parser; pages as plain as these can be cleaned by patterns too."""
    return base(spark, sf_dir, "pages").select("page_id", html.clean_html("html").alias("clean_text")).withColumn("text_length", F.length("clean_text").cast("long"))


@query(r"""
SELECT page_id, array_to_string(regexp_extract_all(concat(url, ' ', html), '(?i)https?://(?:[-\w.]|(?:%[\da-f]{2}))+[^\s]*'), ' ') AS links FROM pages""")
def extract_urls(spark, sf_dir):
    """I8: links of pages."""
    return base(spark, sf_dir, "pages").select("page_id", F.array_join(text.links(F.concat("url", F.lit(" "), "html")), " ").alias("links"))


def _wrapped(url):
    return F.concat(F.lit("https://www.google.com/url?rct=j&url="), F.url_encode(url), F.lit("&ct=ga"))


@query("SELECT page_id, url_decode(replace(url, '+', '%2B')) || '?q=a b+c%d' AS unwrapped, url AS plain FROM pages")
def unwrap_redirect(spark, sf_dir):
    """All pages' URLs, wrapped with escapes that are decoded twice, and as they are."""
    pages = base(spark, sf_dir, "pages")
    return pages.select("page_id", urls.unwrapped(_wrapped(F.concat("url", F.lit("?q=a%20b+c%25d")))).alias("unwrapped"), urls.unwrapped("url").alias("plain"))


@query(r"""
SELECT page_id, coalesce(nullif(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^www\.', ''), ''), 'source') AS domain,
       coalesce(nullif(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^www\.', ''), ''), 'source') AS wrapped_domain FROM pages""")
def source_domain(spark, sf_dir):
    """Of URLs as they are, and behind a redirect."""
    return base(spark, sf_dir, "pages").select("page_id", urls.source_domain("url").alias("domain"), urls.source_domain(_wrapped(F.col("url"))).alias("wrapped_domain"))


_REPLY = """concat(CASE event_id % 4 WHEN 0 THEN concat('Here: ```json', chr(10)) WHEN 1 THEN '```' ELSE '' END, CASE WHEN event_id % 4 = 3 THEN 'sorry, no' ELSE
  concat('{"company_name": "C', CAST(event_id AS STRING), '", "sectors": ["AI/ML", "Other"], "capital_sources": [], "deal_amount": null}') END, CASE WHEN event_id % 4 < 2 THEN CASE WHEN event_id % 8 < 4 THEN '```' ELSE chr(10) END ELSE '' END)"""


@query("""
SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN concat('C', CAST(event_id AS VARCHAR)) END AS company, CASE WHEN event_id % 4 <> 3 THEN 'AI/ML,Other' END AS sectors, CAST(NULL AS VARCHAR) AS capital_sources, event_id % 4 <> 3 AS complete
FROM events""")
def parse_reply(spark, sf_dir):
    """Replies in both kinds of fence, closed and not, bare, and not JSON at all."""
    from ..functions.columns import joined

    r = base(spark, sf_dir, "events").select("event_id", text.parsed_reply(F.expr(_REPLY)).alias("r"))
    return r.select("event_id", F.col("r.company_name").alias("company"), joined("r.sectors").alias("sectors"), joined("r.capital_sources").alias("capital_sources"), F.col("r.summary_complete").alias("complete"))


@query(with_views("SELECT item_id, generate_subscripts(x, 1) AS pos, trim(unnest(x)) AS part FROM (SELECT item_id, string_split(nullif(sectors, ''), ',') AS x FROM ai_extractions) WHERE x IS NOT NULL", "ai_extractions"))
def multi_select_split(spark, sf_dir):
    """I3, M5."""
    e = view(spark, sf_dir, "ai_extractions").select("item_id", F.posexplode(parts("sectors")).alias("pos", "part"))
    return e.select("item_id", (F.col("pos") + 1).cast("long").alias("pos"), "part")


_QUOTED = lambda xs: ", ".join(f"'{x}'" for x in xs)


@query(with_views(f"""
SELECT kind, part, count(*) AS n FROM (SELECT 'sector' AS kind, trim(unnest(string_split(sectors, ','))) AS part FROM ai_extractions UNION ALL SELECT 'source', trim(unnest(string_split(capital_sources, ','))) FROM ai_extractions) x
WHERE part <> '' AND NOT (kind = 'sector' AND part IN ({_QUOTED(rules.SECTORS)})) AND NOT (kind = 'source' AND part IN ({_QUOTED(rules.CAPITAL_SOURCES)})) GROUP BY kind, part""", "ai_extractions"))
def vocabulary_violations(spark, sf_dir):
    """Values outside the vocabularies, by an anti join."""
    ext = view(spark, sf_dir, "ai_extractions")
    said = ext.select(F.lit("sector").alias("kind"), F.explode(parts("sectors")).alias("part")).unionByName(ext.select(F.lit("source").alias("kind"), F.explode(parts("capital_sources")).alias("part")))
    known = spark.createDataFrame([("sector", x) for x in rules.SECTORS] + [("source", x) for x in rules.CAPITAL_SOURCES], "kind string, part string")
    return said.filter("part <> ''").join(known, ["kind", "part"], "left_anti").groupBy("kind", "part").agg(F.count(F.lit(1)).alias("n"))


@query(with_views(f"SELECT item_id, {label_sql('transaction_type', 'deal_type', 'capital_type')} AS label FROM ai_extractions UNION ALL SELECT p_partkey, {label_sql('p_type', 'NULL', 'NULL')} FROM part", "ai_extractions"))
def label_from_type(spark, sf_dir):
    """N1-N3."""
    ext = view(spark, sf_dir, "ai_extractions").select("item_id", rules.deal_label("transaction_type", "deal_type", "capital_type").alias("label"))
    none = F.lit(None).cast("string")
    return ext.unionByName(base(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), rules.deal_label("p_type", none, none).alias("label")))


def _last_sql(words: dict, exact: str | None, legacy: str) -> str:
    cases = [f"WHEN {f'''{exact} = '{n}' OR ''' if exact else ''}{' OR '.join(f'''contains({legacy}, '{w}')''' for w in ws)} THEN '{n}'" for n, ws in reversed(words.items())]
    return "CASE " + " ".join(cases) + " END"


def _all_sql(words: dict, listed: str, legacy: str, extra: dict | None = None) -> str:
    one = lambda n, ws: f"CASE WHEN list_contains(string_split(coalesce({listed}, ''), ','), '{n}') OR {' OR '.join(f'''contains(coalesce({legacy}, ''), '{w}')''' for w in ws)}{(extra or {}).get(n, '')} THEN '{n}' END"
    return f"concat_ws('|', {', '.join(one(n, ws) for n, ws in words.items())})"


@query(with_views(f"SELECT item_id, {_last_sql(rules.TRANSACTION_WORDS, 'transaction_type', chr(39).join(['coalesce(deal_type, ', '', ')']))} AS kind, {_last_sql(rules.DETAIL_WORDS, None, 'deal_type')} AS detail FROM ai_extractions", "ai_extractions"))
def preselect_type(spark, sf_dir):
    """N5, N8."""
    return view(spark, sf_dir, "ai_extractions").select("item_id", rules.preselected_type("transaction_type", "deal_type").alias("kind"), rules.preselected_detail("deal_type").alias("detail"))


@query(with_views(f"SELECT item_id, {_all_sql(rules.CAPITAL_WORDS, 'capital_sources', 'capital_type', {'Public Markets': ''' OR capital_type = 'IPO' '''})} AS checked FROM ai_extractions", "ai_extractions"))
def preselect_sources(spark, sf_dir):
    """N6, M5."""
    return view(spark, sf_dir, "ai_extractions").select("item_id", F.array_join(rules.checked_sources("capital_sources", "capital_type"), "|").alias("checked"))


@query(with_views(f"SELECT item_id, {_all_sql(rules.SECTOR_WORDS, 'sectors', 'sector')} AS checked FROM ai_extractions", "ai_extractions"))
def preselect_sectors(spark, sf_dir):
    """N7, M5."""
    return view(spark, sf_dir, "ai_extractions").select("item_id", F.array_join(rules.checked_sectors("sectors", "sector"), "|").alias("checked"))


@query(with_views("""
SELECT item_id, concat(CASE WHEN strategic_significance <> '' THEN concat('**Why It Matters:** ', strategic_significance, chr(10), chr(10)) ELSE '' END, CASE WHEN market_implications <> '' THEN concat('**Market Implications:** ', market_implications) ELSE '' END) AS draft,
       concat(coalesce(strategic_significance, ''), CASE WHEN market_implications <> '' THEN concat(' ', market_implications) ELSE '' END) AS plain FROM ai_extractions""", "ai_extractions"))
def draft_summary(spark, sf_dir):
    """I14, I15."""
    x = ("strategic_significance", "market_implications")
    return view(spark, sf_dir, "ai_extractions").select("item_id", text.draft_summary(*x).alias("draft"), text.plain_summary(*x).alias("plain"))


@query(with_views("""
SELECT outcome, count(*) AS n FROM (SELECT CASE item_id % 6 WHEN 0 THEN 'Timeout' WHEN 1 THEN 'Request error: refused' WHEN 2 THEN 'Parse error: empty' WHEN 3 THEN 'HTTP 404' WHEN 4 THEN 'HTTP 503 (redirected)' END AS outcome FROM article_content) x GROUP BY outcome""", "article_content"))
def scrape_outcome(spark, sf_dir):
    """Fetches of made-up results, counted by outcome; success is NULL."""
    k = F.col("item_id") % 6
    a = view(spark, sf_dir, "article_content").select(
        F.when(k == 3, 404).when(k == 4, 503).otherwise(200).alias("code"), (k == 4).alias("redirected"),
        F.when(k == 0, "timeout").when(k == 1, "request").when(k == 2, "parse").alias("problem"), F.when(k == 1, "refused").when(k == 2, "empty").alias("detail"),
    )
    return a.groupBy(rules.scrape_outcome("code", "redirected", "problem", "detail").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, count(*) AS events FROM events WHERE user_id IN (1, 2, 30) GROUP BY user_id")
def allow_list(spark, sf_dir):
    """C20."""
    return base(spark, sf_dir, "events").filter(rules.allowed("user_id", "1, 2,30")).groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))


_TURN = "concat(CASE conv_id % 5 WHEN 0 THEN '/start ' WHEN 1 THEN '/status' WHEN 2 THEN '/helpme ' WHEN 3 THEN 'see HTTPS://a.co/x ' ELSE '' END, text)"


@query(f"""
SELECT conv_id, turn, CASE WHEN starts_with(t, '/start') THEN 'start' WHEN starts_with(t, '/status') THEN 'status' WHEN starts_with(t, '/help') THEN 'help' WHEN regexp_matches(t, '(?i)https?://[-\\w.%]+') THEN 'links' ELSE 'none' END AS command
FROM (SELECT conv_id, turn, {_TURN} AS t FROM conversations) x""")
def command_routing(spark, sf_dir):
    """Turns with commands and links put in front."""
    return base(spark, sf_dir, "conversations").select("conv_id", "turn", rules.command(F.expr(_TURN)).alias("command"))


_NOW, _SECRET = 1_700_100_000, "test-secret"


def _pad(x: int) -> str:
    return "unhex('" + bytes(b ^ x for b in _SECRET.encode().ljust(64, b"\0")).hex() + "')"


@query(with_views(f"""
WITH m AS (SELECT id, id % 6 AS k, CASE WHEN id % 6 = 4 THEN 'publish' ELSE 'approve' END AS action, {_NOW} - CASE WHEN id % 6 = 1 THEN 90000 ELSE 60 END AS made FROM raw_items),
s AS (SELECT *, concat(id, ':', action, ':', made) AS message FROM m),
h AS (SELECT *, substring(sha256({_pad(0x5C)} || unhex(sha256({_pad(0x36)} || encode(message)))), 1, 16) AS signature FROM s)
SELECT id, concat(message, ':', signature) AS token, k = 0 AS valid, CASE WHEN k < 2 THEN id END AS item_id, CASE WHEN k < 2 THEN action END AS action,
       CASE k WHEN 1 THEN 'Token expired' WHEN 2 THEN 'Invalid signature' WHEN 3 THEN 'Invalid token format' WHEN 4 THEN 'Invalid action' WHEN 5 THEN 'Token parse error' END AS error
FROM h""", "raw_items"))
def token_verdict(spark, sf_dir):
    """Tokens of items, some spoiled, at a fixed clock and under a test secret."""
    now, secret = _NOW, _SECRET
    k = F.col("id") % 6
    made = view(spark, sf_dir, "raw_items").select("id", tokens.signed("id", F.when(k == 4, "publish").otherwise("approve"), F.lit(now) - F.when(k == 1, 90_000).otherwise(60), secret).alias("t"))
    spoiled = F.when(k == 2, F.concat(F.substring_index("t", ":", 3), F.lit(":0123456789abcdef"))).when(k == 3, F.substring_index("t", ":", 3)).when(k == 5, F.concat(F.lit("x"), F.col("t"))).otherwise(F.col("t"))
    return made.select("id", F.col("t").alias("token"), tokens.verdict(spoiled, F.lit(now), secret).alias("v")).select("id", "token", "v.*")


def _stub(title: str, article: str) -> str:
    first = (article.split() or [""])[0]
    return "```json\n" + json.dumps({"company_name": first, "transaction_type": "Other", "sectors": ["Other"], "capital_sources": [], "deal_amount": None}) + "\n```"


@query("SELECT doc_id AS item_id, coalesce(regexp_extract(text, '\\S+'), '') AS company, 'Other' AS transaction_type, CAST(NULL AS VARCHAR) AS capital_sources, 'Other' AS sectors, CAST(NULL AS VARCHAR) AS deal_amount, true AS summary_complete FROM documents")
def extractor_stub(spark, sf_dir):
    """K3: a deterministic extractor in place of a service."""
    docs = base(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.lit("").alias("title"), "text")
    return extraction.extract(docs, _stub)


@query("SELECT CASE WHEN page_id % 5 = 0 THEN 'No title' ELSE concat('Page ', CAST(page_id AS VARCHAR)) END AS title, url, '' AS summary, '2024-01-02 03:04:05' AS published, 'landed' AS feed_source FROM pages")
def feed_entries(spark, sf_dir):
    """Pages as XML entries, some without a title; feeds in files are tested by hand."""
    escape = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    title = F.when(F.col("page_id") % 5 == 0, "").otherwise(F.concat(F.lit("<title>Page "), F.col("page_id").cast("string"), F.lit("</title>")))
    xml = F.concat(F.lit("<entry>"), title, F.lit("<link>"), escape(F.col("url")), F.lit("</link><published>2024-01-02T03:04:05</published></entry>"))
    return readers.parsed_entries(base(spark, sf_dir, "pages").select(xml.alias("xml")), "xml", "landed").withColumn("published", F.date_format(F.col("published").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"))


_CELL = "CASE p_partkey % 5 WHEN 0 THEN concat('$', CAST(p_size AS STRING), ',000.5') WHEN 1 THEN p_name WHEN 2 THEN 'N/A' WHEN 3 THEN concat(CAST(p_size AS STRING), 'abc') ELSE '' END"


@query(f"""
SELECT p_partkey, cell, TRY_CAST(nullif(regexp_extract(replace(replace(trim(cell), '$', ''), ',', ''), '^[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?'), '') AS DOUBLE) AS number FROM (SELECT p_partkey, {_CELL} AS cell FROM part) x""")
def sort_mixed(spark, sf_dir):
    """Cells in a table's order: numbers first, by value, then texts."""
    cells = base(spark, sf_dir, "part").select("p_partkey", F.expr(_CELL).alias("cell"))
    return cells.select("p_partkey", "cell", text.number_cell("cell").alias("number")).orderBy(F.asc_nulls_last("number"), "cell", "p_partkey")
