
import os
import tempfile

import pytest

from pyspark.sql import functions as F

from conftest import comments
from reasonscope import defaults as D
from reasonscope.functions import text as T
from reasonscope.operators.prepare import prepare_comments
from reasonscope.operators.rules import priority_category
from reasonscope.options import Options
from reasonscope.sources.readers import load_table, with_row_id


def test_default_abbreviations_hit_ordinary_text(spark):
    # T5: case-insensitive whole-word expansion also hits "co-op" and "re:"
    df = spark.createDataFrame([("co-op, re: op",)], "x string")
    got = df.select(T.expand_abbreviations("x", D.ABBREVIATIONS).alias("y")).first()["y"]
    assert got == "co-Operating, Real Estate: Operating"


def test_truncated_phrases_are_whole_word(spark):
    # T4: "realloc" matches only the exact word
    groups = tuple((k, tuple(v)) for k, v in D.PRIORITY_GROUPS.items())
    df = spark.createDataFrame([("reallocation of debt",), ("realloc done",), ("reallocating",)], "x string")
    got = [r[0] for r in df.select(priority_category("x", groups)).collect()]
    assert got == ["Reallocation / Current Portion LTD", "Reallocation / Current Portion LTD", None]


def test_digit_led_phrase_boundary(spark):
    opts = Options().with_(synonyms={"rush": ["1-URGENT"]}, abbreviations={})
    df = spark.createDataFrame([("1-URGENT order",), ("11-URGENT order",), ("x1-URGENT",)], "x string")
    got = [r[0] for r in df.select(T.normalize_synonyms("x", opts.synonyms)).collect()]
    assert got == ["rush order", "11-URGENT order", "x1-URGENT"]


def test_flag_values(spark):
    # T11: text flags compare as stripped upper case text
    rows = [(1, "n", "e", "0", " yes ", "long enough"), (2, "n", "e", "0", "1", "long enough"),
            (3, "n", "e", "0", "1.0", "long enough"), (4, "n", "e", "0", None, "long enough"),
            (5, "n", "e", "0", "true", "long enough")]
    got = sorted(r["row_id"] for r in prepare_comments(comments(spark, rows), Options()).collect())
    assert got == [1, 2, 5]


def test_cleaned_length_filter_uses_cleaned_text(spark):
    # the length filter runs on the cleaned text: "a  b" cleans to "a b" (3 chars)
    rows = [(1, "n", "e", "0", "Y", "a  b"), (2, "n", "e", "0", "Y", " ab "), (3, "n", "e", "0", "Y", None)]
    got = sorted(r["row_id"] for r in prepare_comments(comments(spark, rows), Options()).collect())
    assert got == [1]


def test_load_csv_json_and_row_id(spark):
    d = tempfile.mkdtemp(prefix="rs-src-")
    df = spark.createDataFrame([(1, "B1", "note PS"), (2, "B2", "other")], "a long, b string, c string")
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(d + "/csv")
    df.coalesce(1).write.mode("overwrite").json(d + "/json")
    c = load_table(spark, d + "/csv", fmt="csv")
    j = load_table(spark, d + "/json", fmt="json")
    assert c.columns == ["a", "b", "c"] and c.count() == 2
    assert sorted(j.columns) == ["a", "b", "c"] and j.count() == 2
    ids = [r["row_id"] for r in with_row_id(c).collect()]
    assert len(set(ids)) == 2


def test_row_ids_follow_files_of_unequal_size(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n\n1\n2\n")
    (tmp_path / "b.csv").write_text("n\n" + "\n".join(str(i) for i in range(3, 5003)) + "\n")
    df = with_row_id(load_table(spark, str(tmp_path), fmt="csv"))
    assert [int(r["n"]) for r in df.orderBy("row_id").collect()] == list(range(1, 5003))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables not present")
def test_plans_have_no_python_udf_or_cartesian(spark):
    import __spark_entry__ as E
    for name in ["group_summary", "entity_rollup", "word_frequency", "collocations", "tfidf_weights",
                 "prepare_comments", "stem_groups", "abbreviation_report"]:
        plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_whole_number_flags_in_a_float_column(spark):
    from pyspark.sql import functions as F
    from reasonscope.operators.prepare import explore_reasons, prepare_comments
    rows = comments(spark, [(i, "n", "e", "0", "Y", "alpha beta") for i in range(4)]).withColumn(
        "override_flag", F.element_at(F.array(F.lit(1.0), F.lit(0.0), F.lit(1.5), F.lit(None).cast("double")), F.col("row_id").cast("int") + 1))
    opts = Options().with_(override_yes_values=("1",))
    assert [r["row_id"] for r in prepare_comments(rows, opts).collect()] == [0]
    assert [r["row_id"] for r in explore_reasons(rows, opts).collect()] == [0]


def test_prefix_match_is_opt_in(spark):
    from reasonscope.operators.rules import with_rule_category
    df = spark.createDataFrame([(1, "was reallocated"), (2, "realloc"), (3, "unrealloc"), (4, "a refinance, ok")], "row_id long, ReasonText string")
    opts = Options().with_(priority_groups={"Moved": ["realloc", "refinanc"]})
    for chain in (0, 200):
        got = lambda o: {r["row_id"]: r["Category"] for r in with_rule_category(df, o.with_(chain_limit=chain)).collect()}
        assert got(opts) == {1: None, 2: "Moved", 3: None, 4: None}
        assert got(opts.with_(prefix_match=True)) == {1: "Moved", 2: "Moved", 3: None, 4: "Moved"}
