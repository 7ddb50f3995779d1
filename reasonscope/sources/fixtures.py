"""Comment tables derived from the driver's test tables (see FIXTURES.md).

Each view has the comment schema: row_id, borrower_name, entity_id,
actual_rating, model_rating, notch_difference, override_flag, reason_text
(all strings except row_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reasonscope.options import Options

COMMENT_COLUMNS = ("row_id", "borrower_name", "entity_id", "actual_rating", "model_rating",
                   "notch_difference", "override_flag", "reason_text")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def comments_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey)
    key = F.col("o_orderkey")
    return j.select(
        key.alias("row_id"),
        F.col("c_name").alias("borrower_name"),
        F.when(key % 11 == 0, F.lit(None)).otherwise(F.col("o_custkey").cast("string")).alias("entity_id"),
        F.col("o_orderpriority").alias("actual_rating"),
        F.col("c_mktsegment").alias("model_rating"),
        F.when(key % 7 == 0, F.lit("n/a")).otherwise(
            (F.substring("o_orderpriority", 1, 1).cast("int") - 3).cast("string")).alias("notch_difference"),
        F.when(F.col("o_orderstatus") == "F", F.lit(" y "))
         .when(F.col("o_orderstatus") == "P", F.lit("Yes"))
         .otherwise(F.lit("N")).alias("override_flag"),
        F.when(key % 13 == 0, F.lit(None)).otherwise(
            F.concat(F.col("o_orderpriority"), F.lit("  order for "), F.lower("c_mktsegment"),
                     F.lit(" client, status "), F.col("o_orderstatus"))).alias("reason_text"),
    )


def comments_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id", "left")
    return j.select(
        F.col("doc_id").alias("row_id"),
        F.concat(F.col("source"), F.lit("/"), F.col("lang")).alias("borrower_name"),
        F.col("source").alias("entity_id"),
        F.col("quality").cast("string").alias("actual_rating"),
        F.col("toxic").cast("string").alias("model_rating"),
        (F.col("quality") - 2 * F.col("toxic")).cast("string").alias("notch_difference"),
        F.when(F.col("quality") == 1, F.lit("Y")).when(F.col("quality") == 0, F.lit("n"))
         .alias("override_flag"),
        F.col("text").alias("reason_text"),
    )


def comments_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    return t.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"),
        F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("borrower_name"),
        F.col("conv_id").cast("string").alias("entity_id"),
        F.col("role").alias("actual_rating"),
        F.col("role").alias("model_rating"),
        (F.col("turn") - 3).cast("string").alias("notch_difference"),
        F.when(F.col("role") == "user", F.lit("Y")).otherwise(F.lit("N")).alias("override_flag"),
        F.col("text").alias("reason_text"),
    )


VIEWS = {"order": comments_order, "doc": comments_doc, "turn": comments_turn}

# Test dictionaries that match the texts of each view (FIXTURES.md §4).
ORDER_OPTIONS = Options().with_(
    input_partitions=16,     # the test tables are single files
    abbreviations={"LOW": "Low Priority", "F": "Filled", "P": "Partly Filled"},
    synonyms={"rush_order": ["1-URGENT", "2-HIGH"],
              "home_goods": ["household client", "furniture client"]},
    priority_groups={"Rush": ["rush_order"], "Home": ["home_goods", "building"]},
)

TEXT_OPTIONS = Options().with_(
    input_partitions=16,
    abbreviations={"RE": "Real Estate"},
    synonyms={"article_pair": ["the the", "the and", "and the"]},
    priority_groups={"Spanish or French": ["que"], "German": ["und", "der die"]},
)

VIEW_OPTIONS = {"order": ORDER_OPTIONS, "doc": TEXT_OPTIONS, "turn": TEXT_OPTIONS}
