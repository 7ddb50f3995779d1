"""Decontamination against a plain search for every window, and its word rule."""

import random
import re

import pytest
from pyspark.sql import functions as F

from conftest_llm import clashing, corpus, table  # noqa: F401
from reasonscope.llm import decontamination as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ASCII = str.maketrans(D.UPPER, D.LOWER)


def words(text):
    return WORD.findall((text or "").translate(ASCII))


def plain(docs, items, width=10):
    windows = {}
    for i, text in items:
        w = words(text)
        for s in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[s:s + width]), set()).add("" if i is None else str(i))
    out = []
    for i, text in docs:
        w, hit, own = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in windows:
                    own |= windows[tuple(w[s:s + n])]
                    hit |= set(range(s, s + n))
        out.append((str(i), len(w), len(hit), sorted(own), bool(hit)))
    return sorted(out)


def found(out):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"], r.contaminated) for r in out.collect())


@pytest.fixture(scope="module")
def bench(spark, corpus):
    texts = [t for _, t in corpus if t]
    long = " ".join(texts[3].split()[:25])
    items = [(1, long), (2, long.upper() + "!"), (2, "one more"), (3, "x x x"), (4, ""), (5, None), (6, " ... "), (None, "漢字"), (7, "one"),
             (8, " ".join(texts[4].split()[-12:])), (9, "a b a b a b a b a b a b"), (10, "never seen words in here at all, so out at once")]
    return items, spark.createDataFrame([(i, t, "mine") for i, t in items], "item_id long, text string, words string")


@pytest.mark.parametrize("broadcast", [D.BROADCAST, 0])
def test_every_window_is_found(spark, corpus, bench, broadcast, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST", broadcast)
    items, benchmark = bench
    docs = corpus + [(200, "x X-x x"), (201, "w " * 5 + " ".join(words(items[0][1])[5:16]) + " end")]
    out = D.decontaminate(clashing(table(spark, docs), "n_hit", "_pos", "items"), benchmark)
    assert found(out) == plain(docs, items)
    assert {"lang", "source"} <= set(out.columns) and "text" not in out.columns


def test_random_windows_over_few_words(spark):
    r = random.Random(11)
    text = lambda n: " ".join(r.choice("abcd") for _ in range(n))
    docs, items = [(i, text(r.randint(0, 60))) for i in range(60)], [(i, text(r.randint(1, 9))) for i in range(40)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for width in (3, 6):
        assert found(D.decontaminate(table(spark, docs), benchmark, width=width)) == plain(docs, items, width)


def test_proximity(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, item), (2, item.replace("five", "five extra")), (3, item.replace("five", "other")),
            (4, item.replace("five", "five and then much more")), (5, item.replace("three four", "four three")), (6, "ten nine")]
    out = D.decontaminate(table(spark, docs), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r.doc_id: (r.n_items, r.n_near_items) for r in out.collect()} == {1: (1, 1), 2: (0, 1), 3: (0, 0), 4: (0, 0), 5: (0, 1), 6: (0, 0)}


def test_spans_are_phrase_and_proximity_matches(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = table(spark, [(1, f"before {item} between one two three four five six seven eight nine x ten after")])
    index = D.build_index(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    rows = [r for r in D.find(index).collect() if r.phrases]
    assert [[(s.begin, s.end) for s in r.phrases] for r in rows] == [[(2, 14)]] and rows[0].item_id == "1"


def test_lowering_touches_ascii_only(spark):
    points = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    texts = ["A" + p + "Z" for p in points] + ["ΑΣ Σ ÉÀ İ ΣΑΣ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", D.lowered(F.col("t")).alias("low")).collect()
    assert all(r.low == r.t.translate(ASCII) for r in rows)


def test_empty_tables(spark, corpus, bench):
    none = spark.createDataFrame([], "item_id long, text string")
    assert found(D.decontaminate(table(spark, corpus), none)) == plain(corpus, [])
    assert D.decontaminate(table(spark, []), bench[1]).count() == 0


def test_no_python_in_the_plan(spark, corpus, bench):
    plan = D.decontaminate(table(spark, corpus), bench[1])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
