"""Writers: every table lands in its own folder and reads back whole."""

import tempfile

from conftest import comments
from reasonscope.options import Options
from reasonscope.plans.categorize import run_categorize
from reasonscope.plans.explore import run_explore
import pytest
from pyspark.sql import functions as F

from reasonscope.operators.prepare import map_fields
from reasonscope.sources.columns import ColumnIndex, Header, Position, as_spec, project_fields
from reasonscope.sources.sinks import CATEGORIZE_TABLES, write_tables


def test_run_and_write_categorize(spark):
    rows = [(i, "n", f"e{i % 2}", str(i % 3 - 1), "Y", t) for i, t in enumerate(
        ["cash flow weak", "cash flow weaker", "equipment purchase", "new equipment bought", "house x"])]
    opts = Options().with_(priority_groups={"House": ["house"]}, n_clusters=2, kmeans_n_init=2)
    tables = run_categorize(comments(spark, rows), opts)
    assert tuple(tables) == CATEGORIZE_TABLES
    out = tempfile.mkdtemp(prefix="rs-out-")
    paths = write_tables(tables, out)
    back = spark.read.parquet(paths["detailed_results"])
    assert back.count() == 5
    assert spark.read.parquet(paths["run_info"]).count() == 7
    cats = [r["Category"] for r in back.orderBy("row_id").collect()]
    assert cats[4] == "House"


def test_write_explore_csv(spark):
    rows = [(i, "n", "e", "0", "Y", t) for i, t in enumerate(["LOC due", "LOC renewal", "PS issue"])]
    tables = run_explore(comments(spark, rows), Options())
    out = tempfile.mkdtemp(prefix="rs-ex-")
    paths = write_tables({"abbreviations": tables["abbreviations"]}, out, fmt="csv")
    assert spark.read.option("header", "true").csv(paths["abbreviations"]).count() == 2


def test_column_mapping(spark):
    index = ColumnIndex([f"c{i}" for i in range(60)])
    assert [index.find(x) for x in ("A", "Z", "AA", "ab", Position("b"))] == ["c0", "c25", "c26", "c27", "c1"]
    df = spark.createDataFrame([(1, "x", "y")], "`Row Id` long, `Entity  Id` string, reason string")
    index = ColumnIndex(df.columns)
    assert index.find("C") == "reason" == index.find(as_spec({"header": "Reason"})) == index.find(as_spec({"letters": "c"}))
    assert index.find(Header(" entity id ")) == "Entity  Id" == index.find("Entity Id")
    out = project_fields(df, {"entity_id": "B", "reason_text": Header("REASON")}, keep=())
    assert out.columns == ["entity_id", "reason_text"]
    for spec in ("D", Header("missing"), Position("1")):
        with pytest.raises(KeyError):
            index.find(spec)


def test_default_letters(spark):
    """A table of 18 columns without logical names is read by the default letters."""
    values = [f"v{i}" for i in range(18)]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"col{i} string" for i in range(18))).withColumn("row_id", F.lit(1))
    assert map_fields(df, Options()).first().asDict() == {
        "row_id": 1, "borrower_name": "v1", "entity_id": "v4", "actual_rating": "v12", "model_rating": "v13",
        "notch_difference": "v14", "override_flag": "v15", "reason_text": "v17"}
