"""Guards for the physical plan shapes the scale design relies on."""

import os
import re

import pytest

from conftest import comments
from reasonscope.operators import explore as X
from reasonscope.operators import reports as R
from reasonscope.operators.prepare import explore_reasons, prepare_comments
from reasonscope.options import Options

SF = "/root/testdata/sf0.001"


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_top_n_uses_partial_group_limit_and_hash_aggregation(spark):
    import __spark_entry__ as E
    plan = executed(E.queries()["summary_keywords"](spark, SF))
    assert re.search(r"WindowGroupLimit .*Partial", plan) and re.search(r"WindowGroupLimit .*Final", plan)
    assert "SortAggregate" not in plan


def test_word_counts_hash_only(spark):
    rows = [(i, "n", "e", "0", "Y", t) for i, t in enumerate(["alpha beta", "beta gamma gamma"])]
    tok = X.row_tokens(explore_reasons(comments(spark, rows), Options()), Options())
    plan = executed(X.word_counts(tok))
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_cleaning_regexes_appear_once(spark):
    opts = Options()     # default dictionaries: 10 abbreviations, 8 synonym groups
    rows = [(1, "n", "e", "0", "Y", "new loan and TD")]
    plan = executed(prepare_comments(comments(spark, rows), opts))
    phrases = sum(len(p) for _, p in opts.synonyms)
    assert plan.count("regexp_replace(") == 1 + len(opts.abbreviations) + phrases


def exchange_keys(plan: str) -> str:
    return " ".join(re.findall(r"(?:hashpartitioning|rangepartitioning)\(([^)]*)\)", plan))


def test_no_exchange_is_keyed_by_text(spark):
    from reasonscope.plans.categorize import categorize
    rows = [(i, "n", "e", "0", "Y", t) for i, t in enumerate(["NEW alpha beta", "beta gamma gamma OLD", "alpha beta"])]
    opts = Options().with_(cluster_unmatched=False)
    reasons = explore_reasons(comments(spark, rows), opts)
    tok = X.row_tokens(reasons, opts)
    counts = X.word_counts(tok)
    detail, _ = categorize(comments(spark, rows), opts, persist=False)
    for df in (counts, X.collocations(tok, counts, opts), X.abbreviation_report(reasons, opts), R.group_summary(detail, opts)):
        keys = exchange_keys(executed(df))
        assert keys and not re.search(r"reason#|ReasonText#|text#|terms#", keys), keys


def test_word_frequency_total_is_planned_once(spark):
    rows = [(i, "n", "e", "0", "Y", t) for i, t in enumerate(["alpha beta", "beta gamma gamma"])]
    reasons = explore_reasons(comments(spark, rows), Options())
    tok = X.row_tokens(reasons, Options())
    plan = executed(X.word_frequency(X.word_counts(tok), reasons, Options()))
    assert len(set(re.findall(r"Subquery subquery#(\d+)", plan))) <= 1 and plan.count("ReusedSubquery") <= 1


def test_rollup_join_adds_no_exchange(spark):
    rows = [(i, "n", "e" if i else None, "0", "Y", "alpha beta") for i in range(3)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from reasonscope.plans.categorize import categorize
        opts = Options().with_(cluster_unmatched=False)
        detail, _ = categorize(comments(spark, rows), opts, persist=False)
        out = R.entity_rollup(detail, opts, ordered=False)
        assert executed(out).count("Exchange hashpartitioning") == 3
        assert sorted((r["EntityId"] or "", r["OverrideCount"]) for r in out.collect()) == [("", 1), ("e", 2)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
