"""Run every registered query against its DuckDB oracle (like the driver).

usage: python tests/run_oracles.py [sf_dir] [name ...]
"""

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
sys.path.insert(0, HERE)

from compare import compare, duck  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from reasonscope.session import build_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf)
    qs, sqls = E.queries(), E.oracle_sql()
    results = {}
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                r = compare(df, con, sqls[name])
            else:
                r = {"rows_only": df.count()}
        except Exception as e:  # report and go on
            r = {"error": repr(e)[:1500]}
        r["sec"] = round(time.time() - t, 2)
        results[name] = r
        ok = r.get("values_ok", "rows_only" in r) and r.get("types_ok", True)
        print(("OK  " if ok else "FAIL"), name, json.dumps(r, default=str)[:1500], flush=True)
        spark.catalog.clearCache()
    bad = [k for k, r in results.items() if not (r.get("values_ok", "rows_only" in r) and r.get("types_ok", True))]
    print("failed:", bad)


if __name__ == "__main__":
    main()
