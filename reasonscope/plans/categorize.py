"""Categorize job: prepare -> rules -> (TF-IDF + K-Means on the rest) -> reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reasonscope.operators.prepare import prepare_comments
from reasonscope.operators.rules import with_rule_category
from reasonscope.options import Options
from reasonscope.session import materialize


def rule_categorized(df: DataFrame, opts: Options) -> DataFrame:
    """Prepared detail rows with the rule category (null when no rule hit)."""
    return with_rule_category(prepare_comments(df, opts), opts)


def categorize(df: DataFrame, opts: Options, persist: bool = True):
    """Detail rows with a Category for every row.

    Rule groups first; the unmatched rows are clustered (TF-IDF + K-Means)
    when ``opts.cluster_unmatched``, else they get ``opts.unmatched_label``.
    Returns (detail, model) where model is None without clustering.
    """
    ruled = rule_categorized(df, opts)
    if not opts.cluster_unmatched:
        detail = ruled.withColumn("Category", F.coalesce("Category", F.lit(opts.unmatched_label)))
        # every report reads the cleaned rows: clean once
        return (materialize(detail, opts.materialize) if persist else detail), None
    if persist:
        # the cleaned rows feed the rule split, the vectoriser and the reports
        ruled = materialize(ruled, opts.materialize)
    from reasonscope.plans.hybrid import cluster_unmatched
    return cluster_unmatched(ruled, opts)


def run_categorize(df: DataFrame, opts: Options) -> dict[str, DataFrame]:
    """The four report tables of a categorize run (detail sorted by
    Category, EntityId; summary by Count desc, AvgNotchDiff asc; rollup by
    Category, OverrideCount desc)."""
    from reasonscope.operators import reports as R
    from reasonscope.sources.sinks import run_info
    detail, _ = categorize(df, opts)
    return {
        "detailed_results": R.detail_report(detail),
        "group_summary": R.group_summary(detail, opts),
        "entity_rollup": R.entity_rollup(detail, opts),
        "run_info": run_info(df.sparkSession, opts),
    }
