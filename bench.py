"""Headline benchmark: prints one JSON line with per-query seconds.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from reasonscope.operators import cluster as C  # noqa: E402
from reasonscope.operators import reports as R  # noqa: E402
from reasonscope.plans.categorize import categorize  # noqa: E402
from reasonscope.plans.explore import run_explore  # noqa: E402
from reasonscope.registry import QUERIES  # noqa: E402
from reasonscope.session import build_session, release  # noqa: E402
from reasonscope.sources.fixtures import VIEW_OPTIONS, VIEWS, table  # noqa: E402


def _drain(df):
    """Run a DataFrame to completion without moving rows to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", app_name="reasonscope-bench",
                          shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": "16g"})
    times = {}

    def timed(name, fn):
        t = time.time()
        fn()
        times[name] = round(time.time() - t, 3)
        release()
        spark.catalog.clearCache()

    def categorize_order():
        opts = VIEW_OPTIONS["order"]
        detail, _ = categorize(VIEWS["order"](spark, sf_dir), opts)
        _drain(R.group_summary(detail, opts))
        _drain(R.entity_rollup(detail, opts))
        _drain(R.detail_report(detail))

    def explore_doc():
        for df in run_explore(VIEWS["doc"](spark, sf_dir), VIEW_OPTIONS["doc"]).values():
            _drain(df)

    def categorize_turn():
        opts = VIEW_OPTIONS["turn"]
        detail, _ = categorize(VIEWS["turn"](spark, sf_dir), opts)
        _drain(R.group_summary(detail, opts))

    def embeddings():
        emb = table(spark, sf_dir, "embeddings")
        _drain(C.silhouette(emb, "embedding", "label"))
        _drain(QUERIES["kmeans_lloyd"](spark, sf_dir))

    # the session's first plan, so that no query pays for it; part of the total
    timed("warm_up", lambda: _drain(QUERIES["load_comments"](spark, sf_dir)))
    timed("clean_reason_doc", lambda: _drain(QUERIES["prepare_comments"](spark, sf_dir)))
    timed("group_summary_rules", lambda: _drain(QUERIES["group_summary"](spark, sf_dir)))
    timed("categorize_order", categorize_order)
    timed("categorize_turn", categorize_turn)
    timed("explore_doc", explore_doc)
    timed("tfidf_weights", lambda: _drain(QUERIES["tfidf_weights"](spark, sf_dir)))
    timed("embeddings_kmeans", embeddings)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
