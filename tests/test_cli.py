"""Command line entry point."""

import json
import tempfile

from reasonscope.__main__ import main


def test_cli_categorize_and_explore(spark):
    d = tempfile.mkdtemp(prefix="rs-cli-")
    rows = [("B1", "E1", "1", "Y", "new loan taken"), ("B2", "E2", "-1", "Y", "cash flow weak"),
            ("B3", "E3", "0", "Y", "cash flow weaker"), ("B4", "E4", "2", "N", "ignored row")]
    spark.createDataFrame(rows, "name string, ent string, notch string, flag string, why string") \
        .coalesce(1).write.mode("overwrite").option("header", "true").csv(d + "/in")
    cfg = {"column_map": {"borrower_name": "A", "entity_id": "B", "actual_rating": "C", "model_rating": "C",
                          "notch_difference": "C", "override_flag": "D", "reason_text": "E"},
           "n_clusters": 2, "kmeans_n_init": 1}
    with open(d + "/opts.json", "w") as fh:
        json.dump(cfg, fh)
    paths = main(["categorize", "--input", d + "/in", "--format", "csv", "--out", d + "/out",
                  "--options", d + "/opts.json"])
    detail = spark.read.parquet(paths["detailed_results"])
    cats = {r["BorrowerName"]: r["Category"] for r in detail.collect()}
    assert cats["B1"] == "Additional Debt / New Facility" and "B4" not in cats
    paths = main(["explore", "--input", d + "/in", "--format", "csv", "--out", d + "/ex",
                  "--options", d + "/opts.json", "--out-format", "csv"])
    assert spark.read.option("header", "true").csv(paths["word_frequencies"]).count() > 0
