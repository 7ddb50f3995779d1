"""Stateless categorisation of a stream with a model fitted in batch.

Cleaning, rules, vectorisation and nearest-center assignment are all
per-row transforms, so they apply to a ``readStream``
DataFrame unchanged; no state store is involved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reasonscope.operators.features import tfidf_features, with_terms
from reasonscope.operators.prepare import prepare_comments
from reasonscope.operators.rules import priority_category
from reasonscope.options import Options
from reasonscope.plans.hybrid import CategorizeModel, _name_map


def classify_stream(stream: DataFrame, opts: Options, model: CategorizeModel | None) -> DataFrame:
    """Detail rows of a stream with a Category: the rule group, else the
    nearest automatic group of ``model`` (else ``opts.unmatched_label``)."""
    detail = prepare_comments(stream, opts)
    rule = priority_category("ReasonText", opts.priority_groups, opts.prefix_match)
    if model is None or model.kmeans is None:
        fallback = F.lit(model.names.get(0) if model and model.names else opts.unmatched_label)
        return detail.withColumn("Category", F.coalesce(rule, fallback))
    x = model.kmeans.transform(tfidf_features(with_terms(detail, opts), model.vocabulary, opts))
    auto = F.element_at(_name_map(model.names), F.col("_cluster"))
    return x.withColumn("Category", F.coalesce(rule, auto)).drop("terms", "features", "_cluster")
