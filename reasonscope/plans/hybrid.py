"""Hybrid categorisation: rule groups first, K-Means on the remainder."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reasonscope import defaults as D
from reasonscope.operators.cluster import choose_k, fit_kmeans, label_for_center
from reasonscope.operators.features import Vocabulary, build_vocabulary, tfidf_features, with_terms
from reasonscope.options import Options
from reasonscope.session import materialize


@dataclass
class CategorizeModel:
    """What a fit learned: vocabulary (with idf), K-Means model, group names
    per cluster index and the number of rows per group."""
    vocabulary: Vocabulary
    kmeans: object | None
    names: dict[int, str] = field(default_factory=dict)
    sizes: dict[int, int] = field(default_factory=dict)
    k: int = 0


def _name_map(names: dict[int, str]):
    return F.create_map(*[F.lit(x) for kv in sorted(names.items()) for x in kv])


def cluster_unmatched(ruled: DataFrame, opts: Options):
    """Assign every rule-less row to an automatic group.

    The unmatched rows keep all their columns through vectorisation, so the
    clustered rows are re-attached with a union, not a join.
    """
    cols = ruled.columns
    matched = ruled.where(F.col("Category").isNotNull())
    unmatched = ruled.where(F.col("Category").isNull())
    termed = with_terms(unmatched, opts)
    n = termed.count()
    if n == 0:
        return ruled, None
    vocab = build_vocabulary(termed, opts, n_docs=n)
    if not vocab.terms:
        # every remaining row is a zero vector: a single group
        name = D.AUTO_GROUP_FORMAT.format(n=1, label=D.MISC_LABEL)
        out = matched.unionByName(unmatched.withColumn("Category", F.lit(name)))
        return out, CategorizeModel(vocab, None, {0: name}, {0: n}, 1)
    # a vector depends on the row's vocabulary terms alone: only those are shuffled to
    # find the distinct points, with their rows as weights (a hot one is combined map-side)
    inside = termed.select(F.filter("terms", lambda t: t.isin(vocab.terms)).alias("terms"))
    if opts.dedupe_texts:
        distinct = inside.groupBy(F.array_sort("terms").alias("terms")).agg(F.count(F.lit(1)).cast("double").alias("_weight"))
    else:
        distinct = inside.select("terms", F.lit(1.0).alias("_weight"))
    points = tfidf_features(distinct, vocab, opts).select("features", "_weight").persist(StorageLevel.MEMORY_AND_DISK)
    k = min(opts.n_clusters, n)
    fit_kw = dict(n_init=opts.kmeans_n_init, seed=opts.kmeans_seed, max_iter=opts.kmeans_max_iter,
                  tol=opts.kmeans_tol, weight_col="_weight")
    if opts.auto_select_k and n >= 2 * opts.min_k:
        _, model = choose_k(points, n, "features", opts.min_k, opts.n_clusters, **fit_kw)
    else:
        model = fit_kmeans(points, k, "features", **fit_kw)
    centers = [list(map(float, c)) for c in model.clusterCenters()]
    labels = {i: label_for_center(c, vocab.terms, opts.top_keywords_per_cluster) for i, c in enumerate(centers)}
    # every row is assigned row-locally (no join back to the distinct texts);
    # the union of matched and clustered rows is kept once for all reports,
    # and the group sizes that name the clusters are read from it
    pred = model.transform(tfidf_features(termed, vocab, opts)).select(*cols, "_cluster")
    both = matched.withColumn("_cluster", F.lit(None).cast("int")).unionByName(pred)
    both = materialize(both, opts.materialize)
    sizes = {int(r["_cluster"]): int(r["count"])
             for r in both.where(F.col("_cluster").isNotNull()).groupBy("_cluster").count().collect()}
    points.unpersist()
    if opts.materialize != "none":
        ruled.unpersist()
    # group numbers: larger groups first, then label text (seed order is arbitrary)
    order = sorted(labels, key=lambda i: (-sizes.get(i, 0), labels[i]))
    names = {i: D.AUTO_GROUP_FORMAT.format(n=r + 1, label=labels[i]) for r, i in enumerate(order)}
    out = both.withColumn("Category", F.coalesce(F.col("Category"),
                                                 F.element_at(_name_map(names), F.col("_cluster")))).drop("_cluster")
    return out, CategorizeModel(vocab, model, names, sizes, len(centers))
