"""Text functions: golden cases for the parity traps and regex properties."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reasonscope.functions import text as T
from reasonscope.functions.regex import phrase_pattern
from reasonscope.options import Options


def one(spark, value, expr):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(expr(F.col("x")).alias("y")).first()["y"]


def test_whitespace_unicode(spark):
    # NBSP, NEL (U+0085), em space and tabs are whitespace; the result is stripped
    assert one(spark, "  a\u0085\u0085b  c\t", T.clean_whitespace) == "a b c"
    assert one(spark, "a b", T.clean_whitespace) == "a b"
    assert one(spark, "   ", T.clean_whitespace) == ""


def test_abbreviation_case_insensitive_whole_word(spark):
    abbrs = {"RE": "Real Estate", "OP": "Operating", "PS": "Preferred $1 Share"}
    f = lambda c: T.expand_abbreviations(c, abbrs)
    # hyphen is a boundary: the original tool expands inside "re-allocation" too
    assert one(spark, "re-allocation of RE", f) == "Real Estate-allocation of Real Estate"
    assert one(spark, "are there", f) == "are there"
    # "$" in a replacement is literal
    assert one(spark, "ps", f) == "Preferred $1 Share"
    # adjacent hits
    assert one(spark, "RE RE,re", f) == "Real Estate Real Estate,Real Estate"
    # letters with accents are word characters
    assert one(spark, "éRE REé RE", f) == "éRE REé Real Estate"


def test_abbreviations_see_earlier_results(spark):
    abbrs = {"A1": "B2 x", "B2": "done"}
    assert one(spark, "A1", lambda c: T.expand_abbreviations(c, abbrs)) == "done x"


def test_synonyms_longest_first_within_group_only(spark):
    opts = Options().with_(synonyms={
        "g1": ["rate", "interest rate hike"],
        "g2": ["interest g1", "hike"],
    }, abbreviations={})
    # inside g1 the longer phrase wins; g2 then sees g1's output
    assert one(spark, "Interest Rate Hike and rate", lambda c: T.normalize_synonyms(c, opts.synonyms)) == "g1 and g1"
    assert one(spark, "interest rate", lambda c: T.normalize_synonyms(c, opts.synonyms)) == "g2"


def test_clean_reason_null_and_order(spark):
    opts = Options().with_(abbreviations={"TD": "Term Debt"}, synonyms={"term_debt": ["term debt"]})
    assert one(spark, None, lambda c: T.clean_reason(c, opts)) == ""
    assert one(spark, "  New  TD ", lambda c: T.clean_reason(c, opts)) == "New term_debt"


def test_tokenize_and_ngrams(spark):
    toks = one(spark, "The Debt-to-equity isn't OK; it's 12 tons of_it", lambda c: T.tokenize(c))
    assert toks == ["debt-to-equity", "isn't", "it's", "tons"]
    assert one(spark, "x", lambda c: T.ngrams(T.tokenize(c), 1, 2)) == []
    assert one(spark, "alpha", lambda c: T.ngrams(T.tokenize(c), 1, 2)) == ["alpha"]
    assert one(spark, "alpha beta gamma", lambda c: T.ngrams(T.tokenize(c), 1, 3)) == [
        "alpha", "beta", "gamma", "alpha beta", "beta gamma", "alpha beta gamma"]



def test_stem(spark):
    cases = {"restructure": "restructure", "restructuring": "restructur", "restructured": "restructur",
             "tions": "tion", "allocations": "alloca", "buildings": "build", "cats": "cats",
             "payments": "payment", "rated": "rated"}
    df = spark.createDataFrame([(k,) for k in cases], "w string")
    got = {r["w"]: r["s"] for r in df.select("w", T.stem("w").alias("s")).collect()}
    assert got == cases


def test_coerce_notch(spark):
    cases = {" -2 ": -2.0, "1e3": 1000.0, "1.5": 1.5, ".5": 0.5, "5.": 5.0, "n/a": None, "1d": None,
             "1_000": None, "nan": None, "": None, None: None, "inf": float("inf"), "+3": 3.0}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    got = {r["x"]: r["y"] for r in df.select("x", T.coerce_notch("x").alias("y")).collect()}
    assert got == cases


def test_flag_and_repr(spark):
    assert one(spark, " y ", T.canon_flag) == "Y"
    assert one(spark, None, T.canon_flag) == "NAN"
    assert one(spark, "don't", T.repr_quote) == '"don\'t"'
    assert one(spark, "debt", T.repr_quote) == "'debt'"


def test_rint_round_is_half_even_on_doubles(spark):
    df = spark.createDataFrame([(0.125,), (2.675,), (-1.005,), (0.5,)], "x double")
    got = [r[0] for r in df.select(T.rint_round("x", 2)).collect()]
    # numpy gives the same: np.round([0.125, 2.675, -1.005, 0.5], 2)
    assert got == [0.12, 2.68, -1.0, 0.5]


_alphabet = st.sampled_from(list("ab éÉ_-1  .'"))


@settings(max_examples=60, deadline=None)
@given(text=st.text(alphabet=_alphabet, max_size=14), phrase=st.sampled_from(["ab", "a b", "é1", "b-a", "ab_"]))
def test_whole_word_replace_matches_python(spark, text, phrase):
    """Java lookarounds reproduce Python's Unicode \\b (case-insensitive)."""
    expected = re.sub(rf"\b{re.escape(phrase)}\b", "<X>", text, flags=re.IGNORECASE)
    got = one(spark, text, lambda c: F.regexp_replace(c, phrase_pattern(phrase), "<X>"))
    assert got == expected


def test_py_round_matches_python(spark):
    import random
    rnd = random.Random(5)
    xs = [12.35, 0.35, 2.675, 0.125, 1.005, 66.66666666666667, 0.5, -2.5, 1e-9, 99.95]
    xs += [rnd.randint(0, 10000) / rnd.randint(1, 3000) * 100 for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for d in (1, 3):
        got = [r[0] for r in df.select(T.py_round("x", d)).collect()]
        assert got == [round(x, d) for x in xs]
