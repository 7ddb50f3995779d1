"""Report sinks: every table is written as its own dataset in one folder.

The original tool writes one workbook with sheets; here each sheet becomes a
directory ``<out>/<table>`` in any Spark format (parquet by default, csv for
spreadsheet users). Writes are whole-dataset overwrites, so a re-run after a
failure replaces partial output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reasonscope.options import Options
from reasonscope.session import literal_table

CATEGORIZE_TABLES = ("detailed_results", "group_summary", "entity_rollup", "run_info")


def run_info(spark: SparkSession, opts: Options, engine: str = "spark") -> DataFrame:
    """The settings of a run as (Setting, Value) rows."""
    rows = [
        ("Input file", opts.input_name or ""),
        ("Sheet used", "" if opts.sheet_name is None else str(opts.sheet_name)),
        ("Override-only rows", str(opts.only_override_rows)),
        ("N clusters", str(opts.n_clusters)),
        ("Auto-select K", str(opts.auto_select_k)),
        ("n-gram range", str(tuple(opts.ngram_range))),
        ("Engine", engine),
    ]
    return literal_table(spark, rows, "Setting string, Value string")


def write_tables(tables: dict[str, DataFrame], out_dir: str, fmt: str = "parquet", **options) -> dict[str, str]:
    """Write each table to ``out_dir/<name>``; returns the paths."""
    paths = {}
    for name, df in tables.items():
        path = f"{out_dir.rstrip('/')}/{name}"
        w = df.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            options.setdefault("header", "true")
        if options:
            w = w.options(**{k: str(v) for k, v in options.items()})
        w.save(path)
        paths[name] = path
    return paths
