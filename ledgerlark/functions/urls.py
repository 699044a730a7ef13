"""URL functions, by regular expressions: blanks and odd characters never make them fail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col

_NETLOC = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"


def _parameter(url: Column, name: str) -> Column:
    """The first filled parameter of that name, decoded; NULL if there is none."""
    raw = F.regexp_extract(F.regexp_extract(url, _QUERY, 1), rf"(?:^|&){name}=([^&]+)", 1)
    return F.when(raw != "", F.coalesce(F.try_url_decode(raw), raw))


def unwrapped(url: Column | str) -> Column:
    """The target of a search engine's redirect, decoded twice, as the scraper does; other URLs as they are."""
    u = col(url)
    target = _parameter(u, "url")
    plain = F.regexp_replace(target, r"\+", "%2B")
    again = F.coalesce(F.try_url_decode(plain), target)
    redirect = F.contains(F.regexp_extract(u, _NETLOC, 1), F.lit("google.com")) & F.contains(F.regexp_extract(u, _PATH, 1), F.lit("/url"))
    return F.when(redirect & target.isNotNull(), again).otherwise(u)


def source_domain(url: Column | str) -> Column:
    """Host and port that a link is attributed to, less a leading www.; a redirect's target counts, decoded once. 'source' without one."""
    u = col(url)
    real = F.when(F.contains(u, F.lit("google.com/url?")), F.coalesce(_parameter(u, "url"), u)).otherwise(u)
    host = F.regexp_replace(F.regexp_extract(real, _NETLOC, 1), r"^www\.", "")
    return F.coalesce(F.nullif(host, F.lit("")), F.lit("source"))
