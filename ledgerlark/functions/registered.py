"""The column functions that a SQL user needs, as functions of a session's SQL: all are expressions, so Catalyst sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .rules import URL

_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*://"


def _parameter(url: str) -> str:
    """The first filled parameter `url` of a URL, decoded."""
    raw = f"nullif(regexp_extract(regexp_extract({url}, r'^[^?#]*\\?([^#]*)', 1), r'(?:^|&)url=([^&]+)', 1), '')"
    return f"coalesce(try_url_decode({raw}), {raw})"


def _body(kind: str) -> str:
    target = _parameter("url")
    host = f"regexp_extract({{0}}, r'{_SCHEME}([^/?#]*)', 1)"
    if kind == "extract_domain":
        real = f"CASE WHEN contains(url, 'google.com/url?') THEN coalesce({target}, url) ELSE url END"
        return f"coalesce(nullif(regexp_replace({host.format(real)}, r'^www\\.', ''), ''), 'source')"
    redirect = f"contains({host.format('url')}, 'google.com') AND contains(regexp_extract(url, r'{_SCHEME}[^/?#]*([^?#]*)', 1), '/url')"
    again = f"coalesce(try_url_decode(regexp_replace({target}, r'\\+', '%2B')), {target})"
    return f"CASE WHEN {redirect} AND {target} IS NOT NULL THEN {again} ELSE url END"


#: Name, parameters, type and body.
FUNCTIONS = (
    ("extract_domain", "url STRING", "STRING", _body("extract_domain")),
    ("extract_real_url", "url STRING", "STRING", _body("extract_real_url")),
    ("extract_urls", "said STRING", "ARRAY<STRING>", f"regexp_extract_all(coalesce(said, ''), r'{URL}', 0)"),
    ("percent_change", "latest DOUBLE, before DOUBLE", "DOUBLE", "100 * try_divide(latest - before, nullif(before, 0D))"),
    ("change_class", "x DOUBLE", "STRING", "CASE WHEN x > 0 THEN 'positive' WHEN x < 0 THEN 'negative' WHEN x = 0 THEN 'neutral' END"),
    ("observed", "value DOUBLE, close DOUBLE", "DOUBLE", "coalesce(value, close)"),
    ("first_filled", "a STRING, b STRING", "STRING", "coalesce(nullif(a, ''), nullif(b, ''))"),
)


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session, and returns their names."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
