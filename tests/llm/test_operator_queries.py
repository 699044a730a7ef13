"""Queries with SQL against it, at the smallest size, and the promised columns of all."""

import pytest
from oracle import SMALL, expected, rows

from ledgerlark.llm.registry import QUERIES, SQL

COLUMNS = {
    "op1_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op3_ann": {"query_id", "rank", "vec_id", "score"},
    "op4_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op6_url_filter": {"page_id", "host", "path", "rule", "verdict"},
    "op7_ngram_join": {"doc_id", "n_shingles", "component_id"},
    "op9_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op10_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op11_lloyd": {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"},
    "op12_decontamination": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op13_prefix_trie": {"conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"},
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), expected(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    assert COLUMNS[name] <= set(QUERIES[name](spark, SMALL).columns)


@pytest.mark.parametrize("name", ["op4_exact_dedup", "op6_url_filter"])
def test_native(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
