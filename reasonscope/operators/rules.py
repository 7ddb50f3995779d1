"""Rule-based priority groups: first matching group wins."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reasonscope.functions.regex import any_phrase_pattern
from reasonscope.operators.phrases import first_rule
from reasonscope.options import Options


def priority_category(col, priority_groups, prefix: bool = False) -> Column:
    """Name of the first group with a phrase found as a whole word
    (case-insensitive), else null. Any phrase of a group yields the same name,
    so one alternation per group is exact; groups keep their order."""
    c = F.col(col) if isinstance(col, str) else col
    branches = [F.when(c.rlike(any_phrase_pattern(phrases, prefix=prefix)), F.lit(name))
                for name, phrases in priority_groups if phrases]
    if not branches:
        return F.lit(None).cast("string")
    return F.coalesce(*branches) if len(branches) > 1 else branches[0]


def with_rule_category(detail: DataFrame, opts: Options, text_col: str = "ReasonText",
                       out_col: str = "Category") -> DataFrame:
    rules = [(n, name, p) for n, (name, phrases) in enumerate(opts.priority_groups) for p in phrases if p]
    if len(rules) > opts.chain_limit and not detail.isStreaming and not opts.prefix_match:
        table = detail.sparkSession.createDataFrame(pa.table(dict(zip(("rule_no", "name", "phrase"), map(list, zip(*rules))))))
        return first_rule(detail, table, text_col, out_col, max_rules=len(rules))
    return detail.withColumn(out_col, priority_category(text_col, opts.priority_groups, opts.prefix_match))


def priority_counts(ruled: DataFrame, category_col: str = "Category") -> DataFrame:
    """Comments per matched priority group."""
    return (ruled.where(F.col(category_col).isNotNull())
            .groupBy(category_col).agg(F.count(F.lit(1)).alias("Count")))
