"""Steps whose cost must not grow faster than their input."""

import numpy as np
import pyarrow as pa

from conftest import comments
from reasonscope.operators import cluster as C
from reasonscope.operators import explore as X
from reasonscope.operators import features as FT
from reasonscope.operators import phrases as P
from reasonscope.operators.prepare import explore_reasons
from reasonscope.options import Options
from test_cluster import spread_points


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_points_of_several_blocks_are_dealt_to_all_cores(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_BYTES", 1 << 12)
    data = C._on_grid(spread_points(spark).coalesce(2), "features", None)
    assert not data.block and data.arrays.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism == 4
    data.arrays.unpersist()


def test_step_sums_equal_the_sums_of_members():
    rng = np.random.default_rng(3)
    points = np.rint(rng.normal(size=(500, 7)) * 1e5)
    points[-50:] = points[:50]
    centers = {n: points[n: n + k].copy() for n, k in enumerate((2, 5, 5, 9))}
    for weights in (np.ones(500, np.int64), rng.integers(1, 1 << 20, 500), rng.integers(1, 1 << 28, 500)):
        got, expected = C._step_sums(points, weights, centers), C._fit_sums(points, weights, centers)
        assert list(got) == list(expected)
        for n in centers:
            assert np.array_equal(got[n][:, [0, *range(3, 10)]], expected[n][:, [0, *range(3, 10)]])


def test_a_wide_batch_is_taken_in_parts():
    x = np.random.default_rng(4).normal(size=(4000, 300))
    batch = pa.RecordBatch.from_arrays([pa.array(list(x)), pa.array(np.ones(4000, np.int64))], names=["x", "w"])
    packed = list(C._pack_rows(2.0 ** -18, 300)([batch]))
    parts = [points for points, _ in C._batches(packed)]
    assert max(p.nbytes for p in parts) <= C.PACK_BYTES and np.array_equal(np.concatenate(parts), np.rint(x * 2 ** 18))


def test_word_pairs_are_counted_without_row_lists(spark):
    rows = comments(spark, [(i, "n", "e", "0", "Y", "alpha beta gamma") for i in range(4)])
    tok = X.row_tokens(explore_reasons(rows, Options()), Options())
    found = X.similar_words(tok, X.word_counts(tok))
    plan = optimized(found)
    assert "array_intersect" not in plan and "collect_list(row_id" not in plan
    assert sorted((r.Word1, r.Word2, r.SharedRows) for r in found.collect()) == [("alpha", "beta", 4), ("alpha", "gamma", 4), ("beta", "gamma", 4)]


def test_a_long_text_is_folded_in_stretches(monkeypatch):
    seen = []
    chain = P.Folder._chain
    monkeypatch.setattr(P.Folder, "_chain", lambda self, text: seen.append(text) or chain(self, text))
    folder = P.Folder([("cash", "flow x"), ("flow", "f_"), ("x", "cash")])
    assert folder.apply("Cash, flow cashflow " * 500) == "f_ cash, f_ cashflow " * 500
    assert sorted(seen) == ["Cash", "cashflow", "flow"]


def test_an_entry_is_found_beside_its_equal():
    # folded, both phrases are one iota, but only the second one stands between letters
    assert P.Folder([("\u03b9", "x"), ("\u0345", "y")]).apply("a\u03b9b") == "ayb"


def test_tokens_are_made_once_for_all_their_grams(spark):
    rows = spark.createDataFrame([(1, "new debt now")], "row_id long, ReasonText string")
    for profile in ("document_frequency", "sublinear"):
        plan = optimized(FT.with_terms(rows, Options().with_(tfidf_profile=profile)))
        assert plan.count("regexp_extract_all") == 1, plan
