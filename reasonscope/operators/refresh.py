"""A group summary that is kept up batch by batch.

``summary_state`` reduces a batch of detail rows to tables that can be merged: counts and notch
sums per category, rows per notch value, the first row of each entity, the first texts, and token
counts with their first place. ``write_state`` stores them by batch (a batch written again
replaces itself), ``read_state`` reads all batches, and ``summary_of_state`` merges them into the same table
as ``reports.group_summary`` over all rows. Old rows aren't read again.

Exactness: a text among the first n of all rows is among the first n of its batch. Everything else is
kept whole. Row ids must be unique over all batches; sums of fractional notches can differ in their last bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reasonscope import defaults as D
from reasonscope.functions.text import raw_tokens, rint_round, token_stats
from reasonscope.operators import reports as R
from reasonscope.options import Options
from reasonscope.session import bounded_broadcast

TABLES = ("stats", "notches", "entities", "texts", "tokens")


def _first_texts(texts: DataFrame, n: int) -> DataFrame:
    """The first n distinct texts of each category (Category, digest, row_id, text)."""
    firsts = texts.groupBy("Category", "digest").agg(F.min("row_id").alias("row_id"), F.min_by("text", "row_id").alias("text"))
    w = Window.partitionBy("Category").orderBy("row_id")
    return firsts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def summary_state(detail: DataFrame, opts: Options) -> dict[str, DataFrame]:
    """The mergeable tables of a batch of detail rows."""
    notch = F.col("NotchDifference")
    bound = len(opts.priority_groups) + opts.n_clusters + 1
    rows = detail.where(F.col("ReasonText").isNotNull()).groupBy("Category", F.md5("ReasonText").alias("digest")).agg(F.min("row_id").alias("row_id"))
    w = Window.partitionBy("Category").orderBy("row_id")
    rows = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= opts.max_sample_reasons).drop("_rn")
    texts = detail.select("Category", "row_id", F.col("ReasonText").alias("text")).join(
        bounded_broadcast(rows, bound * opts.max_sample_reasons), ["Category", "row_id"])
    tokens = detail.where(F.col("ReasonText").isNotNull()).select("Category", "row_id", raw_tokens("ReasonText").alias("_t"))
    return {
        "stats": detail.groupBy("Category").agg(
            F.count(F.lit(1)).alias("rows"), F.count(notch).alias("notch_rows"), F.sum(notch).alias("notch_sum"),
            F.min(notch).alias("lo"), F.max(notch).alias("hi"), F.min("row_id").alias("first_row")),
        "notches": detail.where(notch.isNotNull()).groupBy("Category", "NotchDifference").agg(F.count(F.lit(1)).alias("c")),
        "entities": detail.where(F.col("EntityId").isNotNull()).groupBy("Category", "EntityId").agg(F.min("row_id").alias("_first")),
        "texts": texts.select("Category", "digest", "row_id", "text"),
        "tokens": token_stats(tokens, ["Category"], "_t", stopwords=opts.stopwords, min_length=D.TOKEN_MIN_LENGTH).drop("df"),
    }


def write_state(state: dict[str, DataFrame], folder: str, batch: str) -> None:
    for name, df in state.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}/batch={batch}")


def read_state(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of all batches written so far."""
    return {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}").drop("batch") for name in TABLES}


def merged(states: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    out = dict(states[0])
    for state in states[1:]:
        out = {name: out[name].unionByName(state[name]) for name in TABLES}
    return out


def _median(notches: DataFrame) -> DataFrame:
    """Exact median from rows per value: the value at which half of the rows are reached. Partial
    sums over ranges of values come first, so only the range of the middle is looked at one by one."""
    counts = notches.groupBy("Category", "NotchDifference").agg(F.sum("c").alias("c"))
    ends = F.percentile_approx("NotchDifference", [i / 64 for i in range(65)], R.MEDIAN_ACCURACY)
    cuts = counts.groupBy("Category").agg(ends.alias("_cuts"), F.sum("c").alias("n"))
    slot = F.size(F.filter("_cuts", lambda x: x < F.col("NotchDifference")))
    placed = counts.join(F.broadcast(cuts), "Category").select("Category", "n", "NotchDifference", "c", slot.alias("slot"))
    sums = placed.groupBy("Category", "n", "slot").agg(F.sum("c").alias("c"))   # at most 66 rows per category
    over = Window.partitionBy("Category").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    middle = sums.withColumn("below", F.coalesce(F.sum("c").over(over), F.lit(0))).where(
        (F.col("below") < high) & (F.col("below") + F.col("c") >= low)).select("Category", "slot", "below")
    run = Window.partitionBy("Category").orderBy("NotchDifference").rowsBetween(Window.unboundedPreceding, 0)
    first = F.min("below").over(Window.partitionBy("Category"))
    upto = placed.join(F.broadcast(middle), ["Category", "slot"]).withColumn("upto", F.sum("c").over(run) + first)
    at = lambda place: F.max(F.when((F.col("upto") >= place) & (F.col("upto") - F.col("c") < place), F.col("NotchDifference")))
    return upto.groupBy("Category").agg(((at(low) + at(high)) / 2).alias("_median"))


def summary_of_state(state: dict[str, DataFrame], opts: Options, ordered: bool = True) -> DataFrame:
    """The group summary of all rows whose batches the state holds."""
    bound = len(opts.priority_groups) + opts.n_clusters + 1
    stats = state["stats"].groupBy("Category").agg(
        F.sum("rows").alias("Count"), rint_round(F.sum("notch_sum") / F.sum("notch_rows"), 2).alias("AvgNotchDiff"),
        F.min("lo").alias("MinNotchDiff"), F.max("hi").alias("MaxNotchDiff"), F.min("first_row").alias("_first_row"))
    entities = state["entities"].groupBy("Category", "EntityId").agg(F.min("_first").alias("_first"))
    names = R.first_n_from(entities, ["Category"], "EntityId", opts.max_entity_ids, D.ENTITY_SEPARATOR, "EntityIds")
    unique = entities.groupBy("Category").agg(F.count(F.lit(1)).alias("UniqueBorrowers"))
    samples = _first_texts(state["texts"], opts.max_sample_reasons).groupBy("Category").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("row_id", "text"))), lambda x: x["text"]), D.SAMPLE_SEPARATOR).alias("SampleReasons"))
    tokens = state["tokens"].groupBy("Category", "token").agg(
        F.sum("n").alias("n"), F.min(F.struct("first_row", "first_rank")).alias("f"))
    w = Window.partitionBy("Category").orderBy(F.col("n").desc(), "f")
    words = tokens.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= opts.summary_keywords).groupBy("Category").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("_rn", "token"))), lambda x: x["token"]), D.KEYWORD_SEPARATOR).alias("TopKeywords"))
    out = stats
    for small in (_median(state["notches"]), unique, names, samples, words):
        out = out.join(bounded_broadcast(small, bound), "Category", "left")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    if ordered:
        out = out.orderBy(F.col("Count").desc(), F.col("AvgNotchDiff").asc_nulls_last(), F.col("_first_row"))
    return out.select("Category", "Count", F.coalesce("UniqueBorrowers", F.lit(0).cast("long")).alias("UniqueBorrowers"), "AvgNotchDiff",
                      rint_round(F.col("_median").cast("double"), 2).alias("MedianNotchDiff"), "MinNotchDiff", "MaxNotchDiff",
                      empty("EntityIds"), empty("TopKeywords"), empty("SampleReasons"))
