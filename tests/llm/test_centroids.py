"""Centroid clustering against plain Lloyd rounds in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from reasonscope.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string"


def plain(rows, k=16, rounds=3, dim=64, scale=64):
    kept = [(i, [math.floor(x * scale) if abs(x) < 2**40 else int(x) * scale for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centers = [v for _, v in first]
    for turn in range(rounds + 1):
        found = [min((centroids.squared(v, c), j) for j, c in enumerate(centers)) for _, v in kept]
        if turn < rounds:
            for j in range(len(centers)):
                own = [v for (_, v), (_, label) in zip(kept, found) if label == j]
                if own:
                    centers[j] = [sum(c) // len(own) for c in zip(*own)]
    return sorted((str(i), j, d) for (i, _), (d, j) in zip(kept, found)), centers


def vectors(n, spread, seed=3):
    r = random.Random(seed)
    middles = [[r.uniform(-1, 1) for _ in range(64)] for _ in range(20)]
    return [(i, [m + r.gauss(0, spread) for m in middles[i % 20]]) for i in range(n)]


def run(spark, rows, partitions=3, **kw):
    df = spark.createDataFrame([(i, v, "mine") for i, v in rows], SCHEMA).repartition(partitions)
    return centroids.cluster(df, **kw)


@pytest.mark.parametrize("spread,partitions", [(0.02, 1), (0.3, 5)])
def test_equal_to_plain_rounds(spark, spread, partitions):
    rows = vectors(300, spread)
    rows += [(7, rows[7][1]), (None, rows[3][1]), (None, None), (900, [1.0] * 63), (901, [math.nan] * 64), (902, [None] * 64),
             (903, [math.inf] * 64), (904, []), (905, [0.0] * 64), (906, [0.0] * 64)]
    found = run(spark, rows, partitions)
    expected, centers = plain(rows)
    got = found.rows.collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got) == expected and found.centers == centers
    assert found.total == len(expected)


def test_bounds_settle_vectors_and_inertia_adds_up(spark):
    rows = vectors(600, 0.02)
    found = run(spark, rows)
    assert found.scanned[0] == 600 and found.scanned[-1] < 300
    out = centroids.with_inertia(found).collect()
    assert {r.inertia for r in out} == {sum(r.distance for r in out)}
    for r in out:
        assert r.cluster_inertia == sum(x.distance for x in out if x.cluster == r.cluster)
        assert r.center == ",".join(map(str, found.centers[r.cluster]))


def test_loosening_is_a_bound_and_less_than_the_drift():
    r = np.random.default_rng(1)
    tighter = 0
    for _ in range(200):
        old, new = r.integers(-40, 40, (2, 4, 64)).tolist()
        radius = float(r.uniform(0, 400))
        full, loosen = centroids.drifts(old, new, [radius] * 4)
        for i in range(4):
            x = r.normal(size=(50, 64))
            x = np.array(old[i]) + x / np.linalg.norm(x, axis=1)[:, None] * radius * r.uniform(0, 1, (50, 1)) ** 0.1
            for j in range(4):
                nearer = np.linalg.norm(x - np.array(old[j]), axis=1) - np.linalg.norm(x - np.array(new[j]), axis=1)
                assert nearer.max() <= loosen[i, j] + 1e-9 and loosen[i, j] <= full[j] * (1 + 1e-9)
                tighter += loosen[i, j] < 0.9 * full[j]
    assert tighter > 100


def test_large_components_are_exact(spark):
    rows = vectors(40, 0.1) + [(50, [3e9] * 64), (51, [3e9] * 63 + [1.0]), (52, [1e300] * 64), (53, [-2000.5] * 64)]
    expected, centers = plain(rows, k=5)
    found = run(spark, rows, k=5)
    got = sorted((str(r.vec_id), r.cluster, r.distance) for r in found.rows.collect())
    assert got == [(i, j, d if d <= centroids.LONGEST else None) for i, j, d in expected] and found.centers == centers
    out = centroids.with_inertia(found).collect()
    lost = {r.cluster for r in out if r.distance is None}
    assert all((r.cluster_inertia is None) == (r.cluster in lost) for r in out)
    assert not lost or all(r.inertia is None for r in out)


def test_few_and_no_vectors(spark):
    assert run(spark, []).rows.collect() == [] and centroids.with_inertia(run(spark, [])).columns[-3:] == ["cluster_inertia", "inertia", "center"]
    rows = vectors(5, 0.1)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in run(spark, rows).rows.collect()) == plain(rows)[0]
