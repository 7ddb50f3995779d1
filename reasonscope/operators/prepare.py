"""Project, coerce, clean and filter comment rows (the detail table)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reasonscope.functions.text import (
    canon_flag, clean_whitespace, coerce_notch, python_strip, with_clean_text,
)
from reasonscope.options import Options
from reasonscope.sources.columns import DEFAULT_COLUMN_MAP, LOGICAL_FIELDS, Header, project_fields


def map_fields(df: DataFrame, opts: Options) -> DataFrame:
    """The logical fields by the column map; without one, by their own names, or by
    the default letters if the table hasn't got them."""
    column_map = opts.column_map
    if not column_map:
        named = all(f in df.columns for f in LOGICAL_FIELDS)
        column_map = [(f, Header(f)) for f in LOGICAL_FIELDS] if named else DEFAULT_COLUMN_MAP
    own = (opts.text_col,) if opts.text_col in df.columns and opts.text_col not in dict(column_map) else ()
    out = project_fields(df, column_map, keep=(opts.row_id_col, *own))
    if opts.input_partitions and not df.isStreaming:
        out = out.repartition(opts.input_partitions, opts.row_id_col)
    return out


def flag_text(df: DataFrame):
    """The flag in its canonical form; a whole number in a floating-point column
    reads without its fraction (1.0 is "1", as the sheet shows it)."""
    flag = F.col("override_flag")
    if df.schema["override_flag"].dataType.typeName() in ("double", "float"):
        flag = F.when(flag == F.floor(flag), flag.cast("decimal(38,0)").cast("string")).otherwise(flag.cast("string"))
    return canon_flag(flag)


def flag_predicate(flag_col, opts: Options):
    return F.col(flag_col).isin(list(opts.override_yes_values))


def prepare_comments(df: DataFrame, opts: Options, clean: bool = True) -> DataFrame:
    """The detail rows before categorisation.

    Notch -> double (failures null), flag -> stripped upper text, reason ->
    cleaned text; rows with a reason shorter than ``min_reason_length`` and,
    when ``only_override_rows``, rows whose flag is not a yes value are
    dropped. The flag filter runs first: it is cheap and independent of the
    cleaning regexes.
    """
    src = map_fields(df, opts)
    out = src.select(
        F.col(opts.row_id_col).alias("row_id"),
        F.col("borrower_name").alias("BorrowerName"),
        F.col("entity_id").alias("EntityId"),
        F.col("actual_rating").alias("ActualRating"),
        F.col("model_rating").alias("ModelRating"),
        coerce_notch(F.col("notch_difference").cast("string")).alias("NotchDifference"),
        flag_text(src).alias("OverrideFlag"),
        F.col("reason_text").cast("string").alias("ReasonText"),
    )
    if opts.only_override_rows:
        out = out.where(flag_predicate("OverrideFlag", opts))
    if clean:
        out = with_clean_text(out, "ReasonText", "ReasonText", opts)
    else:
        out = out.withColumn("ReasonText", clean_whitespace(F.coalesce(F.col("ReasonText"), F.lit(""))))
    return out.where(F.length("ReasonText") >= opts.min_reason_length)


def explore_reasons(df: DataFrame, opts: Options) -> DataFrame:
    """Comment texts for Explore: raw text stripped (no cleaning), length and
    flag filter. A missing text counts as empty and is dropped. ``opts.text_col``
    names another column of the source, or ``ReasonText`` for the cleaned text."""
    src, text = map_fields(df, opts), opts.text_col
    if text == "ReasonText" and text not in src.columns:
        src = with_clean_text(src.withColumn(text, F.col("reason_text").cast("string")), text, text, opts)
    reason = python_strip(F.coalesce(F.col(text).cast("string"), F.lit("")))
    out = src.select(F.col(opts.row_id_col).alias("row_id"), reason.alias("reason"),
                     flag_text(src).alias("flag"))
    cond = F.length("reason") >= opts.min_reason_length
    if opts.only_override_rows:
        cond = cond & flag_predicate("flag", opts)
    return out.where(cond).select("row_id", "reason")
