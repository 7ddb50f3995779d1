"""Dictionaries as tables against Python's ``re`` and the chains of regular expressions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import comments
from reasonscope.operators import phrases as P
from reasonscope.operators.rules import priority_category, with_rule_category
from reasonscope.options import Options
from reasonscope.plans.categorize import categorize

PIECES = ["a", "ab", "b", "ab-c", "Été", "é", "STRASSE", "x_y", "a b", "b a", "-a", "a-", "1", "½", "--", "c\\d", "q.e", "$1", "漢字"]
PARTS = ["a", "b", "ab", " ", "-", "É", "é", "x_y", "A", "B", "Ab-C", "t", "1", " a b ", "--", "c\\d", "q.e", "qxe", "$1", "漢字", "\n"]


def text(r):
    return "".join(r.choice(PARTS) for _ in range(r.randint(0, 25)))


def test_folder_equals_the_chain_of_substitutions():
    r = random.Random(1)
    for _ in range(1500):
        entries = [(r.choice(PIECES), r.choice([*PIECES, "", "a a", "zz", "\\1"])) for _ in range(r.randint(1, 6))]
        start = expected = text(r)
        for phrase, new in entries:
            expected = re.sub(r"\b" + re.escape(phrase) + r"\b", lambda m: new, expected, flags=re.I)
        assert P.Folder(entries).apply(start) == expected, (start, entries)


def test_folder_finds_every_place_in_one_pass():
    folder = P.Folder([("cash flow", "x"), ("flow", "y"), ("cash", "z")])
    assert folder.places("Cash flow, cashflow FLOW") == [(0, 0), (0, 2), (5, 1), (20, 1)]
    assert P.Folder([]).apply("as it is") == "as it is" and folder.apply(None) is None and folder.apply("") == ""


def test_replacements_that_make_later_phrases():
    assert P.Folder([("td", "term deposit"), ("term deposit rate", "tdr"), ("deposit", "never")]).apply("TD rate up, td down") == "tdr up, term never down"


def test_fold_table_in_slices(spark, monkeypatch):
    df = spark.createDataFrame([(1, "b a c"), (2, None), (3, "")], "row_id long, t string")
    entries = spark.createDataFrame([(3, "c", "done"), (1, "a", "b"), (2, "b", "c"), (4, "", "never")], "entry_no long, phrase string, replacement string")
    for rows in (P.DICTIONARY_ROWS, 1):
        monkeypatch.setattr(P, "DICTIONARY_ROWS", rows)
        assert [r.o for r in P.fold_phrases(df, "t", "o", entries).orderBy("row_id").collect()] == ["done done done", None, ""]


def test_rule_table_equals_the_chain(spark):
    r = random.Random(4)
    texts = spark.createDataFrame([(i, text(r)) for i in range(300)] + [(900, None), (901, "")], "row_id long, ReasonText string").cache()
    for _ in range(3):
        groups = [(f"g{n}", tuple(r.choice(PIECES) for _ in range(r.randint(1, 3)))) for n in range(8)]
        rules = spark.createDataFrame([(n, name, p) for n, (name, own) in enumerate(groups) for p in own], "rule_no int, name string, phrase string")
        got = P.first_rule(texts, rules)
        both = got.join(texts.select("row_id", priority_category("ReasonText", groups).alias("expected")), "row_id")
        assert both.count() == 302 and both.where(~F.col("Category").eqNullSafe(F.col("expected"))).collect() == []


def test_letter_cases_share_a_key(spark):
    """Characters that the pattern takes for equal have equal keys."""
    chars = [chr(c) for c in range(0x41, 0x2FFF) if chr(c).isalpha()]
    pairs = {(c, d) for c in chars for d in (c.lower(), c.upper(), c.upper().lower(), c.lower().upper()) if len(d) == 1 and d.isalpha()}
    pairs |= {("İ", "i"), ("ı", "I"), ("ſ", "s"), ("K", "k"), ("ẞ", "ß"), ("ς", "σ"), ("µ", "μ")}
    df = spark.createDataFrame(sorted(pairs), "a string, b string")
    met = df.where(F.regexp_like(F.col("a"), P._pattern(F.col("b")))).where(P._words(F.col("a")) != P._words(F.col("b")))
    assert met.collect() == []


def test_thousands_of_rules_are_no_literals(spark):
    rows = [(i, "n", "e", "0", "Y", f"order w{i * 7 % 5000} now, the word w{i}") for i in range(200)]
    groups = {f"Group {n}": [f"w{n}", f"the w{n}"] for n in range(5000)}
    opts = Options().with_(abbreviations={}, synonyms={}, priority_groups=groups, cluster_unmatched=False)
    detail, _ = categorize(comments(spark, rows), opts, persist=False)
    plan = detail._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Group ") < 50
    assert {r.row_id: r.Category for r in detail.collect()} == {i: f"Group {min(i, i * 7 % 5000)}" for i in range(200)}


def test_large_dictionaries_give_the_result_of_small_ones(spark):
    rows = [(i, "n", f"e{i % 3}", "0", "Y", t) for i, t in enumerate(
        ["New loan and TD", "the td was EXPANDED", "rate cut by LOB", "capex up, ebitda down", "", "one more line"])]
    default = Options().with_(cluster_unmatched=False)
    for change in ({}, {"only_override_rows": False}):
        small, _ = categorize(comments(spark, rows), default.with_(**change), persist=False)
        large, _ = categorize(comments(spark, rows), default.with_(chain_limit=0, **change), persist=False)
        assert sorted(map(str, small.collect())) == sorted(map(str, large.select(*small.columns).collect()))


def test_streams_keep_the_chain(spark, tmp_path):
    comments(spark, [(1, "n", "e", "0", "Y", "house rule")]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    opts = Options().with_(priority_groups={"House": ["house"]}, chain_limit=0)
    out = with_rule_category(stream.withColumnRenamed("reason_text", "ReasonText"), opts)
    assert out.isStreaming and "Category" in out.columns
