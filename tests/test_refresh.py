"""The refreshable summary and the skewed dictionary join."""

import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import comments
from reasonscope.operators import explore as X
from reasonscope.operators import refresh as S
from reasonscope.operators import reports as R
from reasonscope.options import Options
from reasonscope.plans.categorize import categorize

OPTS = Options().with_(abbreviations={}, synonyms={}, priority_groups={"House": ["house"], "Cash": ["cash"]}, cluster_unmatched=False,
                       max_sample_reasons=3, max_entity_ids=4, summary_keywords=5)


@pytest.fixture(scope="module")
def detail(spark):
    r = random.Random(9)
    words = ["house", "cash", "flow", "weak", "strong", "loan", "purchase"]
    rows = [(i, "n", r.choice([None, *"abcdefgh"]), r.choice(["1", "-2", "3.5", "n/a"]), "Y", " ".join(r.choices(words, k=r.randint(1, 5)))) for i in range(300)]
    out, _ = categorize(comments(spark, rows), OPTS)
    return out


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_states_of_batches_give_the_whole_summary(spark, detail, tmp_path, batches):
    expected = [tuple(x) for x in R.group_summary(detail, OPTS).collect()]
    parts = [detail.where(F.col("row_id") * 7 % batches == b) for b in range(batches)]
    states = [S.summary_state(p, OPTS) for p in parts]
    assert [tuple(x) for x in S.summary_of_state(S.merged(states), OPTS).collect()] == expected
    for _ in range(2):   # a batch written again replaces itself
        for b, state in enumerate(states):
            S.write_state(state, str(tmp_path), f"b{b}")
    assert [tuple(x) for x in S.summary_of_state(S.read_state(spark, str(tmp_path)), OPTS).collect()] == expected


def test_empty_batches(spark, detail):
    none = S.summary_state(detail.where("false"), OPTS)
    assert S.summary_of_state(none, OPTS).collect() == []
    whole = S.summary_state(detail, OPTS)
    assert S.summary_of_state(S.merged([none, whole, none]), OPTS).collect() == S.summary_of_state(whole, OPTS).collect()


def test_median_of_merged_counts(spark):
    r = random.Random(2)
    groups = {f"g{n}": [r.choice([r.gauss(0, 9), 0.0, 1e200]) for _ in range(n)] for n in (1, 2, 3, 10, 101, 2000)} | {"equal": [3.0] * 9, "two": [1.0] * 5 + [2.0] * 5}
    rows = [(c, v, n) for c, values in groups.items() for v, n in Counter(values).items()]
    rows = [(c, v, n - n // 2) for c, v, n in rows] + [(c, v, n // 2) for c, v, n in rows if n // 2]
    got = S._median(spark.createDataFrame(rows, "Category string, NotchDifference double, c long")).collect()
    assert {x["Category"]: x["_median"] for x in got} == {c: statistics.median(v) for c, v in groups.items()}


def test_a_word_in_most_bigrams_does_not_fill_one_task(spark, monkeypatch):
    rows = [(i, "n", "e", "0", "Y", f"the item{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{chr(97 + i // 676)}") for i in range(900)]
    opts = Options().with_(stopwords=())
    tok = X.row_tokens(X_reasons(spark, rows, opts), opts)
    counts, big = X.word_counts(tok), X.bigram_counts(tok)
    for heavy in (1, 1024):
        monkeypatch.setattr(X, "HEAVY_WORDS", heavy)
        top = counts.orderBy(F.col("n").desc(), "token").limit(heavy).select("token", "n")
        out = X.with_word_count(big, counts, top, "w1", "n1", "w2")
        plain = big.join(counts.select(F.col("token").alias("w1"), F.col("n").alias("n1")), "w1")
        assert sorted(map(tuple, out.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    keys = big.withColumn("f", F.when(F.col("w1") == "the", 1)).select(X.spread_key("w1", "f", "w2").alias("k"))
    assert big.where(F.col("w1") == "the").count() >= 0.9 * big.count()
    assert keys.groupBy("k").count().agg(F.max("count")).first()[0] == 1


def X_reasons(spark, rows, opts):
    from reasonscope.operators.prepare import explore_reasons
    return explore_reasons(comments(spark, rows), opts)
