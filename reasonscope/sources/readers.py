"""Table loading through Spark's data source API."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_IN_PARTITION = (1 << 33) - 1


def load_table(spark: SparkSession, path, fmt: str = "parquet", **options) -> DataFrame:
    """Load one table (any Spark format: parquet, orc, csv, json, ...)."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        options.setdefault("header", "true")
    if options:
        reader = reader.options(**{k: str(v) for k, v in options.items()})
    return reader.load(path)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Number the rows of a file source in source order: by file path, place of
    the split in the file, and row within the split.

    A split is read by one task in order, so the running number of
    ``monotonically_increasing_id`` orders its rows; the splits (a small table)
    are ranked by path and offset, whatever order Spark packs them in. ``df`` must
    come straight from a file reader. A table with an order column of its own
    should name that instead (``Options.row_id_col``).
    """
    read = df.withColumns({"_path": F.col("_metadata.file_path"), "_begin": F.col("_metadata.file_block_start"),
                           "_running": F.monotonically_increasing_id()})
    splits = df.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_begin")).distinct()
    ranked = splits.withColumn("_rank", F.row_number().over(Window.orderBy("_path", "_begin")).cast("long"))
    row = F.shiftleft("_rank", 33) + F.col("_running").bitwiseAND(F.lit(_IN_PARTITION))
    return read.join(ranked, ["_path", "_begin"]).select(*[f"`{c}`" for c in df.columns if c != name], row.alias(name))
