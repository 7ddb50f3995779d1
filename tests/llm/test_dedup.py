"""SimHash near-dedup and substring dedup against brute force."""

import collections
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest_llm import SCHEMA, clashing, corpus, table  # noqa: F401
from reasonscope.llm import simhash, substring_dedup

LAST = 2**63


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def brute_removal(rows, width=13):
    key = lambda i: LAST if i is None else i
    least = {}
    for i, t in rows:
        w = words_of(t)
        for p in range(len(w) - width + 1):
            g = tuple(w[p:p + width])
            least[g] = min(least.get(g, LAST + 1), key(i))
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if least[tuple(w[p:p + width])] < key(i):
                gone[p:p + width] = [True] * width
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def test_substring_dedup_equals_brute_force(spark, corpus):
    docs = clashing(table(spark, corpus), "n_removed", "_key")
    out = substring_dedup.remove_repeats(docs)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect()), key=str)
    assert got == brute_removal(corpus)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "n_removed", "kept_text"]


def test_substring_dedup_partial_overlaps(spark):
    r = random.Random(1)
    pool = [f"w{i}" for i in range(60)]
    long = [r.choice(pool) for _ in range(400)]
    rows = []
    for i in range(60):  # pieces of one long text between noise, down to and below the window
        a, n = r.randrange(380), r.randint(5, 30)
        rows.append((i, " ".join([r.choice(pool) for _ in range(4)] + long[a:a + n] + [r.choice(pool) for _ in range(4)])))
    got = sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in
                  substring_dedup.remove_repeats(table(spark, rows, 5)).collect()), key=str)
    assert got == brute_removal(rows) and any(x[2] for x in got)


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_substring_dedup_common_anchors(spark, partitions):
    """Phrases in most documents, in few and in many surroundings, over few and many blocks."""
    r = random.Random(partitions)
    noise = lambda n: [f"n{r.randrange(10**6)}" for _ in range(n)]
    phrase, passage = [f"p{i}" for i in range(11)], [f"q{i}" for i in range(30)]
    sides = [noise(6) for _ in range(5)]
    rows = []
    for i in range(150):
        a = r.randrange(18)
        w = noise(3) + r.choice(sides) + phrase + r.choice(sides) + noise(2) + passage[a:a + r.randint(8, 30)]
        rows.append((i // 2 if i % 10 == 0 else 1000 - i, " ".join(w + (r.choice(rows)[1].split()[:r.randint(5, 40)] if rows else []))))
    got = sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in
                  substring_dedup.remove_repeats(table(spark, rows, partitions)).collect()), key=str)
    assert got == brute_removal(rows) and sum(x[2] for x in got) > 1000


def test_a_block_sends_few_rows_of_a_common_anchor():
    n = 5000
    a, keys = np.full(n, 7, np.uint64), np.arange(n, dtype=np.int64)[::-1].copy()
    one = substring_dedup._sent_rows(a, a, keys, True).to_pydict()
    assert [k for k, s in zip(one["_key"], one["state"]) if s == 0] == [0] and one["state"].count(1) == n - 1
    many = substring_dedup._sent_rows(a, np.arange(n, dtype=np.uint64), keys, True).to_pydict()
    assert many["state"].count(0) == 2 and many["state"].count(2) == n - 2
    assert substring_dedup._sent_rows(a, a, np.zeros(n, np.int64), True).num_rows == 1


def test_substring_dedup_empty(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_winnowing_picks_by_content():
    r = np.random.default_rng(3)
    h = r.integers(0, 6, 500).astype(np.uint64)  # many ties
    place = substring_dedup._anchors(h, 10)
    for i, p in enumerate(place):
        low = h[i:i + 10].min()
        assert p == i + max(j for j in range(10) if h[i + j] == low)


def brute_print(text):
    w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), LAST), LAST if d is None else d)
    return [None if least[find(i)] == LAST else least[find(i)] for i in range(len(ids))]


def test_simhash_equals_brute_force(spark, corpus):
    prints = [brute_print(t) for _, t in corpus]
    want = sorted(zip([i for i, _ in corpus], prints, brute_components([i for i, _ in corpus], prints)), key=str)
    got = simhash.components(clashing(table(spark, corpus), "fp", "key"))
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got.collect()), key=str) == want


def test_keep_first_keeps_one_row_of_each_component(spark, corpus):
    docs = table(spark, corpus)
    parts = simhash.components(docs).select("component_id").distinct().count()
    kept = simhash.keep_first(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == parts and kept.columns == docs.columns
    assert 100 in ids and 101 not in ids and 103 not in ids and ids.count(100) == 1


def test_covering_links_all_close_pairs(spark):
    r = random.Random(9)
    prints = [r.getrandbits(64) for _ in range(40)]
    for _ in range(5):  # chains of steps of 1 to 4 bits
        x = r.choice(prints)
        for _ in range(30):
            for b in r.sample(range(64), r.randint(1, 4)):
                x ^= 1 << b
            prints.append(x)
    prints = sorted(set(prints))
    want = brute_components(list(range(len(prints))), prints)
    table_ = spark.createDataFrame([(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(prints)], "i long, fp long")
    for hot in (simhash.HOT, 2):  # also with every anchor dealt out further
        roots = simhash.connected(simhash._links_of(table_, 3, hot))
        got = table_.join(roots, F.col("fp") == F.col("node"), "left").select("i", F.coalesce("root", "fp").alias("root"))
        least = got.groupBy("root").agg(F.min("i").alias("c"))
        assert [x.c for x in got.join(least, "root").orderBy("i").collect()] == want


def test_every_word_has_an_anchor_within_one_bit():
    half = np.random.default_rng(1).integers(0, 2**32, 2000, dtype=np.uint64)
    for x, s in zip(half, simhash._syndromes(half)):
        anchors = x ^ simhash._MASKS[int(s)]
        assert not simhash._syndromes(anchors).any()
        assert np.bitwise_count(anchors ^ x).min() <= 1 and np.bitwise_count(anchors ^ x).max() <= 2


def test_simhash_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash.components(none).count() == 0 and simhash.keep_first(none).count() == 0


def test_crowded_parts_are_dealt_out_again(spark):
    r = np.random.default_rng(4)
    base = int(r.integers(1 << 62))
    prints = sorted({base ^ sum(1 << int(b) for b in r.choice(63, n, replace=False)) for n in (1, 2, 3, 4, 5) for _ in range(60)})
    rows = spark.createDataFrame([(p,) for p in prints], "fp long")
    once = simhash._links_of(rows, 3, 1 << 20)
    again = simhash._dealt_again(spark.createDataFrame([(0, p, 256 * i + (p >> 32 + 8 * i & 255)) for p in prints for i in range(4)],
                                                       "anchor long, fp long, part int"), F.shiftrightunsigned("fp", 32), 20)
    groups = collections.defaultdict(set)
    for x in again.collect():
        groups[x.part].add(x.fp)
    assert min(groups) >= 0 and max(groups) >= 1024
    high = {p: p >> 32 for p in prints}
    together = {(a, b) for g in groups.values() for a in g for b in g}
    assert all((a, b) in together for a in prints for b in prints if (high[a] ^ high[b]).bit_count() <= 3)
    classes = lambda links: sorted((x.node, x.root) for x in simhash.connected(links).collect())
    assert classes(once) == classes(simhash._links_of(rows, 3, 20))


def test_components_of_one_large_hub_and_a_long_chain(spark):
    from reasonscope.llm.simhash import connected
    n, chain = 20000, 300
    hub = spark.range(1, n).selectExpr("cast(0 as long) u", "id v")
    back = spark.range(1, n, 3).selectExpr("id u", "cast(-5 as long) v")
    line = spark.range(chain).selectExpr("1000000 + (id * 7) % 300 u", "1000000 + ((id + 1) * 7) % 300 v")
    found = {r.node: r.root for r in connected(hub.unionAll(back).unionAll(line).unionAll(hub.limit(5))).collect()}
    assert found == {**{i: -5 for i in range(n)}, -5: -5, **{1000000 + i: 1000000 for i in range(chain)}}
