"""Reports and categorisation on hand-computed micro tables."""

from pyspark.sql import functions as F

from conftest import comments
from reasonscope.operators import reports as R
from reasonscope.options import Options
from reasonscope.plans.categorize import categorize

RULES = Options().with_(
    abbreviations={}, synonyms={"rush": ["urgent order"]},
    priority_groups={"Rush": ["rush"], "Home": ["home", "house"]},
    cluster_unmatched=False, unmatched_label="Other")

ROWS = [
    (1, "Acme", "E1", "-1", "Y", "urgent order for home"),     # Rush wins (first group)
    (2, "Acme", "E1", "-2", "yes", "house client"),            # Home
    (3, "Beta", None, "n/a", "Y", "house house client"),       # Home, null entity
    (4, "Beta", "E2", "1", "N", "urgent order"),               # dropped: flag
    (5, "Gamma", "E3", "2", "TRUE", "ab"),                      # dropped: too short
    (6, "Gamma", "E3", "x", "1", "other words here client"),   # Other, notch null
    (7, "Delta", "E1", "0", "Y", "house client"),              # Home, repeated text
]


def detail(spark):
    d, _ = categorize(comments(spark, ROWS), RULES)
    return d


def test_categories_and_filters(spark):
    got = {r["row_id"]: r["Category"] for r in detail(spark).collect()}
    assert got == {1: "Rush", 2: "Home", 3: "Home", 6: "Other", 7: "Home"}


def test_group_summary(spark):
    s = R.group_summary(detail(spark), RULES).collect()
    assert [r["Category"] for r in s] == ["Home", "Rush", "Other"]
    home = s[0].asDict()
    assert home["Count"] == 3 and home["UniqueBorrowers"] == 1
    assert home["AvgNotchDiff"] == -1.0 and home["MedianNotchDiff"] == -1.0
    assert (home["MinNotchDiff"], home["MaxNotchDiff"]) == (-2.0, 0.0)
    assert home["EntityIds"] == "E1"
    assert home["SampleReasons"] == "house client | house house client"
    assert home["TopKeywords"] == "house, client"
    other = s[2].asDict()
    assert other["AvgNotchDiff"] is None and other["MedianNotchDiff"] is None
    assert other["TopKeywords"] == "other, words, here, client"


def test_summary_counts_sum_to_detail(spark):
    d = detail(spark)
    assert sum(r["Count"] for r in R.group_summary(d, RULES).collect()) == d.count()


def test_entity_rollup_null_entity_is_a_group(spark):
    rows = R.entity_rollup(detail(spark), RULES).collect()
    got = [(r["Category"], r["EntityId"], r["BorrowerName"], r["OverrideCount"], r["AvgNotchDiff"]) for r in rows]
    assert got == [("Home", "E1", "Acme / Delta", 2, -1.0), ("Home", None, "Beta", 1, None),
                   ("Other", "E3", "Gamma", 1, None), ("Rush", "E1", "Acme", 1, -1.0)]


def test_top_keywords_tie_first_seen(spark):
    rows = [(i, "n", "e", "0", "Y", t) for i, t in enumerate(
        ["zeta alpha", "alpha zeta beta", "beta gamma"], start=1)]
    d, _ = categorize(comments(spark, rows), RULES)
    kw = R.group_summary(d, RULES).first()["TopKeywords"]
    # alpha, zeta, beta all twice: first seen zeta (row 1), alpha (row 1), beta (row 2)
    assert kw == "zeta, alpha, beta, gamma"


def test_independent_of_partitioning(spark):
    base = comments(spark, ROWS)
    a = R.group_summary(categorize(base.repartition(1), RULES)[0], RULES).collect()
    b = R.group_summary(categorize(base.repartition(7), RULES)[0], RULES).collect()
    assert a == b


def test_empty_input_keeps_schema(spark):
    d, _ = categorize(comments(spark, [(1, "n", "e", "0", "N", "nothing here")]), RULES)
    s = R.group_summary(d, RULES)
    assert s.count() == 0
    assert s.columns == list(R.SUMMARY_COLUMNS)
    assert R.entity_rollup(d, RULES).columns == list(R.ROLLUP_COLUMNS)


def test_checkpoint_materialize_same_result(spark):
    a = R.group_summary(categorize(comments(spark, ROWS), RULES)[0], RULES).collect()
    opts = RULES.with_(materialize="checkpoint")
    b = R.group_summary(categorize(comments(spark, ROWS), opts)[0], opts).collect()
    assert a == b


def test_long_lists_are_cut_in_parts_of_a_group(spark, monkeypatch):
    """Beyond Spark's limit for cuts before the shuffle, the rows and their order stay the same."""
    rows = [("hot" if i % 10 else f"k{i % 3}", f"v{(i * 7919) % 3001:04d}", i) for i in range(6000)]
    df = spark.createDataFrame(rows, "key string, value string, row_id long")
    monkeypatch.setattr(R, "PARTS", 8)

    def run(n):
        out, _ = R.first_n_distinct(df, ["key"], "value", n, ",", "values")
        return {r.key: r["values"].split(",") for r in out.collect()}

    plans = {}
    for limit in ("1000", "5"):
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", limit)
        try:
            got = run(40)
            plans[limit] = R.first_rows(df, ["key"], [F.col("row_id")], 40, ["value"])._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
        for key in ("hot", "k0", "k1", "k2"):
            first = list(dict.fromkeys(v for k, v, _ in rows if k == key))
            assert got[key] == first[:40]
    assert "WindowGroupLimit" in plans["1000"] and "_part" not in plans["1000"]
    assert "WindowGroupLimit" not in plans["5"] and "_part" in plans["5"]
