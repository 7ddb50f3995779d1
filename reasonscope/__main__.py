"""Command line: run a job over a table and write its report tables.

    python -m reasonscope categorize --input data/ --format parquet --out reports/run1
    python -m reasonscope explore --input comments.csv --format csv --out reports/explore1 \\
        --options options.json

``--options`` is a JSON object with any :class:`reasonscope.options.Options`
field (dictionaries as objects/lists, e.g. {"column_map": {"reason_text": "R",
"entity_id": {"header": "EntityId"}, ...},
"synonyms": {...}, "n_clusters": 6}).
"""

from __future__ import annotations

import argparse
import json

from reasonscope.options import Options
from reasonscope.plans.categorize import run_categorize
from reasonscope.plans.explore import run_explore
from reasonscope.session import build_session, release
from reasonscope.sources.readers import load_table, with_row_id
from reasonscope.sources.sinks import write_tables


def main(argv=None) -> dict[str, str]:
    ap = argparse.ArgumentParser(prog="reasonscope")
    ap.add_argument("job", choices=("categorize", "explore"))
    ap.add_argument("--input", required=True)
    ap.add_argument("--format", default="parquet")
    ap.add_argument("--out", required=True)
    ap.add_argument("--out-format", default="parquet", choices=("parquet", "csv", "json", "orc"))
    ap.add_argument("--options", help="JSON file with Options fields")
    ap.add_argument("--master", default=None)
    a = ap.parse_args(argv)
    opts = Options()
    if a.options:
        with open(a.options) as fh:
            cfg = json.load(fh)
        if "ngram_range" in cfg:
            cfg["ngram_range"] = tuple(cfg["ngram_range"])
        opts = opts.with_(**cfg)
    opts = opts.with_(input_name=a.input)
    spark = build_session(a.master)
    df = load_table(spark, a.input, fmt=a.format)
    if opts.row_id_col not in df.columns:
        df = with_row_id(df, opts.row_id_col)
    tables = run_categorize(df, opts) if a.job == "categorize" else run_explore(df, opts)
    try:
        return write_tables(tables, a.out, fmt=a.out_format)
    finally:
        release()


if __name__ == "__main__":
    for name, path in main().items():
        print(f"{name}\t{path}")
