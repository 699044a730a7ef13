"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann, bpe, decontamination, exact_dedup, line_dedup, lloyd, ngram_join, packing, pii, prefix_trie, quality, token_count, url_filter

_MODULES = (pii, line_dedup, ann, exact_dedup, token_count, url_filter, ngram_join, quality, packing, bpe, lloyd, decontamination, prefix_trie)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in getattr(m, "SQL", {}).items()}
