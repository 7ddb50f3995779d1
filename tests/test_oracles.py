"""Registered queries against their DuckDB oracle on the smallest test tables."""

import os

import pytest

from compare import compare, duck

SF = "/root/testdata/sf0.001"
FAST = ["group_summary", "entity_rollup", "prepare_comments", "abbreviation_report", "word_frequency",
        "collocations", "context_similarity", "stem_groups", "tfidf_weights", "tfidf_sublinear",
        "kmeans_lloyd", "silhouette", "kmeans_fit", "categorize", "group_summary_hybrid", "clean_reason", "tokenize", "ngrams", "summary_keywords"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, name):
    import __spark_entry__ as E
    con = duck(SF)
    r = compare(E.queries()[name](spark, SF), con, E.oracle_sql()[name])
    assert r["cols_ok"] and r["values_ok"], r


def test_every_query_has_an_oracle():
    import __spark_entry__ as E
    from reasonscope.registry import QUERIES
    assert set(QUERIES) <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())
