"""Explore tables on micro inputs."""

import pytest
from pyspark.sql import functions as F

from conftest import comments
from reasonscope.operators import explore as X
from reasonscope.operators.prepare import explore_reasons
from reasonscope.options import Options
from reasonscope.plans.explore import run_explore

OPTS = Options().with_(synonyms={"new_debt": ["new debt", "debt"]})


def reasons(spark, texts, flag="Y"):
    return explore_reasons(comments(spark, [(i, "n", "e", "0", flag, t) for i, t in enumerate(texts)]), OPTS)


def test_abbreviation_examples_one_per_match(spark):
    r = reasons(spark, ["PS and PS again", "the PS", "PS", "BRR only"])
    rows = {x["Abbreviation"]: x.asDict() for x in X.abbreviation_report(r, OPTS).collect()}
    ps = rows["PS"]
    assert ps["ExampleCount"] == 3
    assert (ps["Example1"], ps["Example2"], ps["Example3"]) == ("PS and PS again", "PS and PS again", "the PS")
    assert ps["AlreadyDefined"] == "YES" and ps["CurrentMeaning"] == "Preferred Share"
    assert rows["BRR"]["Example2"] == ""
    order = [x["Abbreviation"] for x in X.abbreviation_report(r, OPTS).collect()]
    assert order == ["PS", "BRR"]


def test_word_frequency_and_stems(spark):
    r = reasons(spark, ["loans loan loaning", "loan debt", "debts"])
    tok = X.row_tokens(r, OPTS)
    counts = X.word_counts(tok)
    wf = {x["Word"]: x.asDict() for x in X.word_frequency(counts, r, OPTS).collect()}
    assert wf["loan"]["TotalOccurrences"] == 2 and wf["loan"]["InNReasons"] == 2
    assert wf["loan"]["PctOfReasons"] == 66.7 and wf["loan"]["Suggestion"] == "Consider adding to STOPWORDS"
    stems = {x["StemRoot"]: x.asDict() for x in X.stem_groups(counts, OPTS).collect()}
    assert stems["loan"]["Variants"] == "loan, loaning, loans"
    assert stems["loan"]["TotalFrequency"] == 4
    assert stems["debt"]["AlreadyInSynonyms"] == "YES"
    assert stems["debt"]["Suggestion"] == "Add to SYNONYMS: \"debt\": ['debt', 'debts']"


def test_collocations_pmi(spark):
    import math
    r = reasons(spark, ["cash flow cash flow", "cash flow issue"])
    tok = X.row_tokens(r, OPTS)
    out = X.collocations(tok, X.word_counts(tok), OPTS).collect()
    got = {x["Phrase"]: x for x in out}
    assert set(got) == {"cash flow", "flow cash"} - {"flow cash"} | {"cash flow"}
    total = 7
    pmi = math.log((3 / total) / ((3 / total) * (3 / total) + 1e-12))
    assert got["cash flow"]["PMI_Score"] == round(pmi, 2)
    assert got["cash flow"]["Count"] == 3


def test_empty_collocations_and_context(spark):
    r = reasons(spark, ["one", "two"], flag="N")
    tok = X.row_tokens(r, OPTS)
    counts = X.word_counts(tok)
    assert X.collocations(tok, counts, OPTS).count() == 0
    ctx = X.context_similarity(tok, counts, OPTS)
    assert ctx.count() == 0 and ctx.columns == list(X.CONTEXT_COLUMNS)


def test_context_similarity_values(spark):
    texts = ["alpha beta", "alpha beta", "alpha gamma", "delta gamma", "delta gamma"]
    r = reasons(spark, texts)
    tok = X.row_tokens(r, OPTS)
    rows = X.context_similarity(tok, X.word_counts(tok), OPTS).collect()
    sims = {(x["Word1"], x["Word2"]): x["ContextSimilarity"] for x in rows}
    assert sims[("alpha", "beta")] == round(2 / (3 ** 0.5 * 2 ** 0.5), 3)
    assert sims[("gamma", "delta")] == round(2 / (3 ** 0.5 * 2 ** 0.5), 3)
    assert all(0 < v <= 1 for v in sims.values())


def test_run_explore_tables(spark):
    r = comments(spark, [(i, "n", "e", "0", "Y", t) for i, t in enumerate(
        ["LOC renewal pending", "LOC renewal approved", "new debt layered"])])
    out = run_explore(r, OPTS)
    assert set(out) >= {"abbreviations", "word_frequencies", "stem_groups", "collocations", "context_similarity"}
    assert out["abbreviations"].first()["Abbreviation"] == "LOC"


def test_repeated_texts_count_per_row(spark):
    # distinct texts are tokenized once but weighted by their rows
    r = reasons(spark, ["cash flow weak", "cash flow weak", "cash flow weak", "weak demand"])
    tok = X.reason_tokens(r, OPTS)
    assert tok.count() == 2
    counts = {x["token"]: (x["n"], x["df"]) for x in X.word_counts(tok).collect()}
    assert counts["cash"] == (3, 3) and counts["weak"] == (4, 4) and counts["demand"] == (1, 1)
    bigrams = {(x["w1"], x["w2"]): x["Count"] for x in X.bigram_counts(tok).collect()}
    assert bigrams[("cash", "flow")] == 3 and bigrams[("flow", "weak")] == 3
    wf = {x["Word"]: x["PctOfReasons"] for x in X.word_frequency(X.word_counts(tok), tok, OPTS).collect()}
    assert wf["weak"] == 100.0 and wf["demand"] == 25.0


def test_dedupe_option_gives_same_tables(spark):
    texts = ["PS cash flow weak", "PS cash flow weak", "weak demand PS", "LOC renewal", "cash flow"]
    r = comments(spark, [(i, "n", "e", "0", "Y", t) for i, t in enumerate(texts)])
    a = run_explore(r, OPTS)
    b = run_explore(r, OPTS.with_(dedupe_texts=False))
    for name in ("abbreviations", "word_frequencies", "stem_groups", "collocations", "context_similarity"):
        assert sorted(map(tuple, a[name].collect())) == sorted(map(tuple, b[name].collect())), name


@pytest.mark.parametrize("least,min_df,list_rows", [(0.3, 2, 1 << 16), (0.3, 1, 7), (0.6, 3, 25), (0.45, 1, 100)])
def test_similar_words_equal_all_pairs(spark, least, min_df, list_rows):
    import random
    from collections import defaultdict
    r = random.Random(6)
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(45)]
    texts = [" ".join(r.choices(words, [1 / (i + 1) for i in range(45)], k=r.choice([0, 1, 2, 3, 5, 40]))) for _ in range(150)]
    texts = [f"common {t}" for t in texts]   # a word in every row
    rows = comments(spark, [(i, "n", "e", "0", "Y", t) for i, t in enumerate(texts)])
    tok = X.row_tokens(explore_reasons(rows, Options()), Options())
    held = defaultdict(set)
    for i, t in enumerate(texts):
        for w in set(t.split()):
            held[w].add(i)
    expected = {}
    for a in held:
        for b in held:
            n = len(held[a] & held[b])
            if a < b and min(len(held[a]), len(held[b])) >= min_df and n / (len(held[a]) ** 0.5 * len(held[b]) ** 0.5) > least:
                expected[a, b] = (n, len(held[a]), len(held[b]))
    got = X.similar_words(tok, X.word_counts(tok), least, min_df, list_rows).collect()
    assert {(x.Word1, x.Word2): (x.SharedRows, x.Rows1, x.Rows2) for x in got} == expected and len(got) == len(expected) > 0


def test_distinct_texts_once_give_the_same_counts(spark):
    r = reasons(spark, ["new debt now", "new debt now", "other words here", "new debt now"])
    strip = lambda tok: sorted((x["token"], x["n"], x["df"], x["first"]["row_id"]) for x in X.word_counts(tok).collect())
    assert strip(X.row_tokens(r, OPTS)) == strip(X.reason_tokens(r, OPTS))


def test_text_column_and_uncapped_match_count(spark):
    rows = comments(spark, [(i, "n", "e", "0", "Y", t) for i, t in enumerate(["LOC LOC due", "LOC  renewal LOC", "PS issue"])])
    opts = Options().with_(abbreviations={"PS": "problem sheet"}, synonyms={})
    counts = lambda o: {x["Abbreviation"]: (x["ExampleCount"], x["MatchCount"]) for x in X.abbreviation_report(explore_reasons(rows, o), o).collect()}
    assert counts(opts.with_(abbreviation_match_count=True)) == {"LOC": (3, 4), "PS": (1, 1)}
    cleaned = opts.with_(abbreviation_match_count=True, text_col="ReasonText")
    assert counts(cleaned) == {"LOC": (3, 4)}
    assert [x["reason"] for x in explore_reasons(rows, cleaned).orderBy("row_id").collect()] == ["LOC LOC due", "LOC renewal LOC", "problem sheet issue"]
    other = explore_reasons(rows.withColumn("note", F.lit(" other words ")), opts.with_(text_col="note"))
    assert {x["reason"] for x in other.collect()} == {"other words"}
    assert "MatchCount" not in X.abbreviation_report(explore_reasons(rows, opts), opts).columns


def test_winners_are_broadcast_not_the_texts(spark):
    r = reasons(spark, ["LOC due", "LOC renewal", "PS issue"])
    plan = X.abbreviation_report(r, OPTS)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildLeft" in plan and "BuildRight" not in plan


def test_caches_are_released(spark):
    from reasonscope.session import release
    rows = comments(spark, [(i, "n", "e", "0", "Y", t) for i, t in enumerate(["LOC due now", "LOC renewal", "PS issue"])])
    release()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    for df in run_explore(rows, Options()).values():
        df.collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() > before
    assert release() > 0 and spark.sparkContext._jsc.getPersistentRDDs().size() == before
