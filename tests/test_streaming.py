"""The batch-fitted model applies to a stream unchanged."""

import tempfile

from conftest import comments
from reasonscope.options import Options
from reasonscope.plans.categorize import categorize
from reasonscope.streaming import classify_stream


def test_classify_stream(spark):
    rows = [(i, "n", "e", "0", "Y", t) for i, t in enumerate(
        ["cash flow weak", "cash flow weaker", "equipment purchase", "equipment purchase new", "house x"])]
    opts = Options().with_(abbreviations={}, synonyms={}, priority_groups={"House": ["house"]},
                           n_clusters=2, kmeans_n_init=1)
    batch = comments(spark, rows)
    detail, model = categorize(batch, opts)
    expected = {r["row_id"]: r["Category"] for r in detail.collect()}
    src = tempfile.mkdtemp(prefix="rs-stream-src-")
    batch.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    q = (classify_stream(stream, opts, model).writeStream.format("memory").queryName("classified")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="rs-stream-ck-")).start())
    q.processAllAvailable()
    q.stop()
    got = {r["row_id"]: r["Category"] for r in spark.sql("SELECT * FROM classified").collect()}
    assert got == expected
