"""Clustering operators against small brute-force models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import comments
from reasonscope.operators import cluster as C
from reasonscope.operators import features as FT
from reasonscope.options import Options
from reasonscope.plans.categorize import categorize


def points(spark, X, labels=None):
    rows = [(i, [float(v) for v in x], int(labels[i]) if labels is not None else 0) for i, x in enumerate(X)]
    return spark.createDataFrame(rows, "id long, v array<double>, label int")


def brute_silhouette_sq(X, lab):
    """From the definition: all squared distances, averaged per group by one-hot sums."""
    groups, of = np.unique(lab, return_inverse=True)
    if len(groups) == 1:
        return -1.0
    member = np.eye(len(groups))[of]
    gram = X @ X.T
    squares = np.diag(gram)[:, None] + np.diag(gram)[None, :] - 2 * gram
    mean = squares @ member / member.sum(axis=0)
    rows = np.arange(len(X))
    own = np.where(member.sum(axis=0)[of] > 1, mean[rows, of], 0.0)
    mean[rows, of] = np.inf
    other = mean.min(axis=1)
    larger = np.maximum(own, other)
    return float(np.divide(other - own, larger, out=np.zeros(len(X)), where=larger > 0).mean())


def test_silhouette_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    X = rng.normal(size=(40, 5))
    lab = rng.integers(0, 4, size=40)
    lab[0] = 9   # a singleton cluster
    got = C.silhouette(points(spark, X, lab), "v", "label").first()[0]
    assert got == pytest.approx(brute_silhouette_sq(X, lab), abs=1e-9)


def test_silhouette_single_label(spark):
    X = np.eye(3)
    assert C.silhouette(points(spark, X, [1, 1, 1]), "v", "label").first()[0] == -1.0


def test_assign_ties_lowest_index(spark):
    df = points(spark, [[0.0, 0.0]])
    out = C.assign_nearest(df, "v", [[1.0, 0.0], [0.0, 1.0]]).first()
    assert out["cluster"] == 0 and out["dist2"] == 1.0


def test_lloyd_matches_numpy(spark):
    rng = np.random.default_rng(3)
    X = np.vstack([rng.normal(0, 0.3, (20, 2)), rng.normal(3, 0.3, (20, 2))])
    init = [X[0].tolist(), X[1].tolist()]
    centers, _ = C.lloyd(points(spark, X), "v", init, max_iter=20)
    c = np.array(init)
    for _ in range(20):
        lab = ((X[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
        new = np.array([X[lab == k].mean(0) if (lab == k).any() else c[k] for k in range(2)])
        if np.allclose(new, c, atol=1e-6):
            c = new
            break
        c = new
    assert np.allclose(np.array(centers), c, atol=1e-9)


def test_tfidf_rows_unit_or_zero(spark):
    rows = [(i, "n", "e", "0", "Y", t) for i, t in enumerate(
        ["cash flow weak", "cash flow strong", "xy", "equipment purchase", "strong equipment"])]
    opts = Options().with_(abbreviations={}, synonyms={}, priority_groups={})
    d, _ = categorize(comments(spark, rows), opts.with_(cluster_unmatched=False))
    w = FT.tfidf_long(FT.term_arrays(d, opts), opts)
    norms = w.groupBy("row_id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("n")).collect()
    assert all(abs(r["n"] - 1.0) < 1e-12 for r in norms)
    # the vector path agrees with the long table
    terms = FT.term_arrays(d, opts)
    vocab = FT.build_vocabulary(terms, opts)
    vec = FT.tfidf_features(terms, vocab, opts).collect()
    long = {(r["row_id"], r["term"]): r["weight"] for r in w.collect()}
    for r in vec:
        for i, v in zip(r["features"].indices, r["features"].values):
            assert abs(long[(r["row_id"], vocab.terms[i])] - v) < 1e-12


def test_label_for_center():
    assert C.label_for_center([0.0, 0.5, 0.5, 0.1], ["a", "c", "b", "d"], 2) == "b, c"
    assert C.label_for_center([0.0, 0.0], ["a", "b"], 6) == "miscellaneous"


def test_hybrid_categorize(spark):
    texts = ["cash flow weak", "cash flow weaker", "equipment purchase", "equipment purchase new",
             "house rule", "zz"]
    rows = [(i, "n", f"e{i}", "0", "Y", t) for i, t in enumerate(texts)]
    opts = Options().with_(abbreviations={}, synonyms={}, priority_groups={"House": ["house"]},
                           n_clusters=2, kmeans_n_init=2)
    d, model = categorize(comments(spark, rows), opts)
    cats = {r["row_id"]: r["Category"] for r in d.collect()}
    assert cats[4] == "House"
    assert cats[0] == cats[1] and cats[2] == cats[3] and cats[0] != cats[2]
    assert all(c.startswith("Auto Group ") for k, c in cats.items() if k != 4)
    assert model.k == 2


def test_all_rows_matched_skips_clustering(spark):
    rows = [(1, "n", "e", "0", "Y", "house one"), (2, "n", "e", "0", "Y", "house two")]
    opts = Options().with_(priority_groups={"House": ["house"]})
    d, model = categorize(comments(spark, rows), opts)
    assert model is None and {r["Category"] for r in d.collect()} == {"House"}


def test_termless_rows_form_one_group(spark):
    rows = [(1, "n", "e", "0", "Y", "the of and"), (2, "n", "e", "0", "Y", "12 34 56")]
    d, model = categorize(comments(spark, rows), Options())
    assert {r["Category"] for r in d.collect()} == {"Auto Group 1: miscellaneous"}


def test_weighted_silhouette_equals_repeated_rows(spark):
    rng = np.random.default_rng(11)
    X = rng.normal(size=(12, 3))
    lab = np.array([0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 0, 1])
    w = rng.integers(1, 4, size=12)
    weighted = spark.createDataFrame([(i, [float(v) for v in X[i]], int(lab[i]), float(w[i])) for i in range(12)],
                                     "id long, v array<double>, label int, w double")
    got = C.silhouette(weighted, "v", "label", "w").first()[0]
    rep = np.repeat(np.arange(12), w)
    assert got == pytest.approx(brute_silhouette_sq(X[rep], lab[rep]), abs=1e-9)


def test_hybrid_without_dedupe(spark):
    texts = ["cash flow weak", "cash flow weak", "equipment purchase", "equipment purchase new", "house rule"]
    rows = [(i, "n", f"e{i}", "0", "Y", t) for i, t in enumerate(texts)]
    opts = Options().with_(abbreviations={}, synonyms={}, priority_groups={"House": ["house"]},
                           n_clusters=2, kmeans_n_init=2, dedupe_texts=False)
    d, model = categorize(comments(spark, rows), opts)
    cats = {r["row_id"]: r["Category"] for r in d.collect()}
    assert cats[4] == "House" and cats[0] == cats[1] and cats[2] == cats[3] and cats[0] != cats[2]
    assert sum(model.sizes.values()) == 4


HOUSE = Options().with_(abbreviations={}, synonyms={}, priority_groups={"House": ["house"]}, n_clusters=3, kmeans_n_init=3)


def many_rows(spark, n=400):
    rng = np.random.default_rng(5)
    words = ["cash", "flow", "weak", "strong", "equipment", "purchase", "rating", "sector", "outlook", "debt"]
    texts = [" ".join(rng.choice(words, 4)) for _ in range(n)]
    return comments(spark, [(i, "n", f"e{i % 7}", "0", "Y", t) for i, t in enumerate(texts)])


def test_fit_is_the_same_for_any_layout(spark):
    rows, results = many_rows(spark), []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for shuffle, parts, dedupe in ((5, 1, True), (8, 7, True), (16, 3, True), (8, 7, False)):
            spark.conf.set("spark.sql.shuffle.partitions", shuffle)
            d, model = categorize(rows.repartition(parts), HOUSE.with_(dedupe_texts=dedupe))
            results.append((sorted((r["row_id"], r["Category"]) for r in d.collect()), model.kmeans.cost))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(r == results[0] for r in results) and len({c for _, c in results[0][0]}) == 3


@pytest.mark.parametrize("texts,opts", [
    (["cash flow weak"], HOUSE), (["cash flow weak", "equipment purchase"], HOUSE), (["cash flow weak"] * 5, HOUSE),
    (["cash flow weak"] * 8, HOUSE.with_(auto_select_k=True)), (["cash flow weak"], HOUSE.with_(n_clusters=1)),
    (["cash flow weak", "equipment purchase", "cash"], HOUSE.with_(n_clusters=1))])
def test_small_and_uniform_input(spark, texts, opts):
    from reasonscope.streaming.classify import classify_stream
    rows = comments(spark, [(i, "n", "e", "0", "Y", t) for i, t in enumerate(texts)])
    d, model = categorize(rows, opts)
    got = {r["row_id"]: r["Category"] for r in d.collect()}
    assert len(got) == len(texts) and all(c.startswith("Auto Group ") for c in got.values())
    assert len(set(got.values())) <= min(opts.n_clusters, len(set(texts)))
    assert {r["row_id"]: r["Category"] for r in classify_stream(rows, opts, model).collect()} == got


def test_numeric_entity_ids_keep_their_order(spark):
    from reasonscope.operators import reports as R
    rows = comments(spark, [(i, "n", "0", "0", "Y", "house rule") for i in range(4)]).withColumn(
        "entity_id", F.element_at(F.array(*[F.lit(v) for v in (100, 9, 10, 9)]), F.col("row_id").cast("int") + 1))
    d, _ = categorize(rows, HOUSE)
    assert [r["EntityId"] for r in R.detail_report(d).collect()] == [9, 9, 10, 100]
    assert R.group_summary(d, HOUSE).first()["EntityIds"] == "100, 9, 10"


def test_planning_starts_no_job(spark):
    from reasonscope.operators.prepare import prepare_comments
    rows = many_rows(spark, 50)
    joined = rows.join(rows.select(F.col("row_id").alias("other")), F.col("row_id") == F.col("other"))
    spark.sparkContext.setJobGroup("plan-only", "plan-only")
    try:
        prepare_comments(joined, HOUSE)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plan-only")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def spread_points(spark, n=120):
    from pyspark.ml.functions import array_to_vector
    rng = np.random.default_rng(2)
    X = np.vstack([rng.normal(0, 0.4, (n // 4, 6)) + 5 * np.eye(6)[c] for c in range(4)])
    return points(spark, X).repartition(5).select("id", array_to_vector("v").alias("features")).cache()


def test_passes_by_jobs_equal_passes_within_one(spark, monkeypatch):
    df = spread_points(spark)
    one = [C.fit_kmeans(df, k, n_init=3) for k in (2, 5)]
    chosen, model = C.choose_k(df, 120, "features", 2, 6, n_init=3)
    assert all(0 < fit.skipped < 1 for fit in one)   # settled points weren't measured again
    monkeypatch.setattr(C, "BLOCK_BYTES", 1 << 10)
    for k, fit in zip((2, 5), one):
        again = C.fit_kmeans(df, k, n_init=3)
        assert again.cost == fit.cost and np.array_equal(again.centers, fit.centers)
    assert C.choose_k(df, 120, "features", 2, 6, n_init=3)[0] == chosen == 4
    labeled = model.transform(df)
    assert C._silhouettes(C._on_grid(df, "features", None), {4: model})[4] == pytest.approx(
        C.silhouette(labeled.withColumn("v", C._dense(df, "features")), "v", "_cluster").first()[0], abs=1e-5)


def test_jobs_do_not_grow_with_the_range_of_k(spark):
    df = spread_points(spark)
    df.count()
    jobs = []
    for high in (3, 8):
        group = f"choose-{high}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            C.choose_k(df, 120, "features", 2, high, n_init=2)
            jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] > 0
