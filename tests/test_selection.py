"""Distributed median, pruned vocabulary and sparse assignment against plain versions."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from reasonscope.operators import cluster as C
from reasonscope.operators import features as FT
from reasonscope.operators import reports as R
from reasonscope.options import Options


def notches(spark, groups):
    rows = [(c, v) for c, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "Category string, NotchDifference double").repartition(5)


def test_medians_are_exact(spark):
    r = random.Random(3)
    groups = {f"n{n}": [r.choice([r.randint(-3, 3), r.gauss(0, 1e6), 1e300, -1e300]) * 1.0 for _ in range(n)] for n in (1, 2, 3, 4, 5, 10, 99, 1000)}
    groups |= {"equal": [2.0] * 50, "two": [1.0] * 30 + [5.0] * 30, "skewed": [0.0] * 499 + [float(i) for i in range(500)],
               "nulls": [None, None, 4.0], "inf": [float("inf"), -float("inf"), 1.0]}
    got = {r_["Category"]: r_["_median"] for r_ in R.medians(notches(spark, {**groups, "none": [None]}), 100).collect()}
    assert got == {c: statistics.median([v for v in values if v is not None]) for c, values in groups.items()}


def test_a_million_values_leave_few_rows_for_one_task(spark):
    n = 1_000_001
    rows = spark.range(n, numPartitions=8).select(F.lit("a").alias("Category"), ((F.col("id") * 7919) % n / 7).alias("NotchDifference"))
    rows = rows.unionAll(spark.range(10).select(F.lit("b"), F.col("id").cast("double"))).cache()
    assert R.median_counts(rows, 2).groupBy("Category").count().agg(F.max("count")).first()[0] < 3000
    assert {r["Category"]: r["_median"] for r in R.medians(rows, 2).collect()} == {"a": (n - 1) / 2 / 7, "b": 4.5}
    rows.unpersist()


@pytest.mark.parametrize("profile", ["document_frequency", "sublinear"])
@pytest.mark.parametrize("features,limit", [(5, 20_000), (40, 20_000), (10_000, 20_000), (5, 3)])
def test_pruned_vocabulary_is_the_whole_one(spark, monkeypatch, profile, features, limit):
    monkeypatch.setattr(FT, "PRUNING_WORDS", limit)
    r = random.Random(8)
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    texts = [" ".join(r.choices(words, [1 / (i + 1) for i in range(60)], k=r.randint(0, 12))) for _ in range(300)]
    opts = Options().with_(max_features=features, tfidf_profile=profile, stopwords=("wordad",))
    terms = FT.with_terms(spark.createDataFrame(list(enumerate(texts)), "row_id long, ReasonText string"), opts)
    key = "count" if profile == "sublinear" else "df"
    whole = sorted(((-x[key], x["term"]) for x in FT.term_statistics(terms).collect()))[:features]
    pruned = FT.vocabulary_statistics(terms, opts)
    assert [x["term"] for x in FT.vocabulary_table(terms, opts).orderBy("idx").collect()] == [t for _, t in whole]
    if features == 5 and limit > 3:
        assert pruned.count() < FT.term_statistics(terms).count() / 3


def test_sparse_assignment_equals_the_dense_form(spark):
    rng = np.random.default_rng(4)
    X = rng.random((80, 12)) * (rng.random((80, 12)) < 0.25)
    X[7] = 0
    centers = rng.random((6, 12)) * (rng.random((6, 12)) < 0.4)
    centers[4] = centers[2]
    long = lambda M, name: spark.createDataFrame([(int(i), f"t{j}", float(M[i, j])) for i, j in zip(*np.nonzero(M))], f"{name} long, term string, weight double")
    rows = spark.range(80).select(F.col("id").alias("row_id"))
    dense = {r["id"]: (r["cluster"], r["dist2"]) for r in C.assign_nearest(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, v array<double>"),
                                                                          "v", centers.tolist()).collect()}
    for bound in (None, 72):
        got = C.assign_sparse(rows, long(X, "row_id"), long(centers, "cluster"), bound).collect()
        assert len(got) == 80
        for r in got:
            assert r["cluster"] == dense[r["row_id"]][0] and r["dist2"] == pytest.approx(dense[r["row_id"]][1], abs=1e-9)
