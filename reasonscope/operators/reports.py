"""Report tables over the categorised detail rows.

Reference semantics kept here: first-seen order (by ``row_id``, then token
position) breaks every tie; averages and medians are rounded to 2 digits the
way numpy rounds; a null entity is a group of its own in the rollup.

Scale notes: every "first n" or "top n" list is ranked with
``row_number() <= n`` over a window, which Spark plans as a partial
WindowGroupLimit before the shuffle, so a hot category never gathers more
than n rows per partition into one task. Spark does so up to a limit of its own
(1,000 rows by default); a longer list is cut in ``PARTS`` parts of each group
first, so its last task gets n rows a part. Per-category tables have at most
(#priority groups + #clusters + 1) rows, which bounds the broadcasts below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reasonscope import defaults as D
from reasonscope.functions.text import raw_tokens, rint_round, token_stats
from reasonscope.options import Options
from reasonscope.session import bounded_broadcast


#: parts that a group is dealt into for lists that Spark doesn't cut before the shuffle
PARTS = 256


def first_rows(df: DataFrame, keys: list[str], order: list, n: int, spread: list[str]) -> DataFrame:
    """The first ``n`` rows of each key group in ``order``, numbered by ``_rn``.
    ``spread``: columns whose values tell the rows of a group apart."""
    if n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        part = F.pmod(F.xxhash64(*spread), F.lit(PARTS))
        df = df.withColumn("_part", part)
        df = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
        df = df.where(F.col("_rn") <= n).drop("_part", "_rn")
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n)


def first_n_from(firsts: DataFrame, keys: list[str], value_col: str, n: int, sep: str,
                 out_col: str, first_col: str = "_first") -> DataFrame:
    """Per key group, the first ``n`` values of a (keys, value, first) table in
    first-seen order, joined by ``sep``."""
    ranked = first_rows(firsts, keys, [F.col(first_col), F.col(value_col)], n, [value_col])
    return (ranked.groupBy(*keys)
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", value_col))),
                                          lambda x: x[value_col].cast("string")), sep).alias(out_col)))


def first_n_distinct(df: DataFrame, keys: list[str], value_col: str, n: int, sep: str,
                     out_col: str, order_col: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Per key group: the first ``n`` distinct non-null values in first-seen
    order joined by ``sep``; also returns the distinct table (key, value,
    first) for distinct counts."""
    firsts = (df.where(F.col(value_col).isNotNull())
              .groupBy(*keys, value_col).agg(F.min(order_col).alias("_first")))
    return first_n_from(firsts, keys, value_col, n, sep, out_col), firsts


def sample_texts(detail: DataFrame, keys: list[str], n: int, out_col: str, bound: int,
                 text_col: str = "ReasonText") -> DataFrame:
    """Per key group: the first ``n`` distinct texts in first-seen order, joined by
    the sample separator. Texts are compared by their MD5; only the texts of the
    winning rows (at most n for each of at most ``bound`` groups) are fetched."""
    firsts = (detail.where(F.col(text_col).isNotNull()).groupBy(*keys, F.md5(text_col).alias("_digest"))
              .agg(F.min("row_id").alias("row_id")))
    winners = first_rows(firsts, keys, [F.col("row_id")], n, ["row_id"]).select(*keys, "row_id", "_rn")
    texts = detail.select(*keys, "row_id", text_col).join(bounded_broadcast(winners, n * bound), [*keys, "row_id"])
    return texts.groupBy(*keys).agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("_rn", text_col))), lambda x: x[text_col]), D.SAMPLE_SEPARATOR).alias(out_col))


def top_tokens(detail: DataFrame, keys: list[str], n: int, out_col: str, opts: Options,
               text_col: str = "ReasonText") -> DataFrame:
    """Per key group: the ``n`` most frequent tokens, ties by first
    appearance, joined by ', '. Tokens are made row-locally and summed map-side."""
    toks = detail.where(F.col(text_col).isNotNull()).select(*keys, "row_id", raw_tokens(text_col).alias("_t"))
    counts = token_stats(toks, keys, "_t", stopwords=opts.stopwords,
                         min_length=D.TOKEN_MIN_LENGTH).withColumnRenamed("n", "_n")
    ranked = first_rows(counts, keys, [F.col("_n").desc(), F.col("first_row"), F.col("first_rank")], n, ["token"])
    return (ranked.groupBy(*keys)
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "token"))),
                                          lambda x: x["token"]), D.KEYWORD_SEPARATOR).alias(out_col)))


#: rank error of the bracket around a median: one row in so many
MEDIAN_ACCURACY = 10_000


def median_bracket(detail: DataFrame) -> DataFrame:
    """Per category: the rows with a notch ``n`` and two values (``lo``, ``hi``) that the median lies between.
    The mergeable quantile summary is at most n / MEDIAN_ACCURACY ranks off, and the
    bracket is four times as wide to either side."""
    margin = 4 / MEDIAN_ACCURACY
    ends = F.percentile_approx("NotchDifference", [0.5 - margin, 0.5 + margin], MEDIAN_ACCURACY)
    return (detail.where(F.col("NotchDifference").isNotNull()).groupBy("Category").agg(ends.alias("_b"), F.count(F.lit(1)).alias("n"))
            .select("Category", "n", F.get("_b", F.lit(0)).alias("lo"), F.get("_b", F.lit(1)).alias("hi")))


def median_counts(detail: DataFrame, bound: int) -> DataFrame:
    """(Category, n, v, c): the rows per notch inside the bracket, and below it as one
    null value; what lies above isn't needed. A category leaves about a thousandth of its values."""
    notch = F.col("NotchDifference")
    inside = detail.select("Category", notch).join(bounded_broadcast(median_bracket(detail), bound), "Category").where(notch <= F.col("hi"))
    return inside.groupBy("Category", "n", F.when(notch >= F.col("lo"), notch).alias("v")).agg(F.count(F.lit(1)).alias("c"))


def medians(detail: DataFrame, bound: int) -> DataFrame:
    """Exact median notch per category (at most ``bound`` of them), by selection: only the
    values near the middle are counted one by one, and a running sum over them finds it."""
    counts = median_counts(detail, bound)
    run = Window.partitionBy("Category").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("upto", F.sum("c").over(run))
    at = lambda place: F.max(F.when((F.col("upto") >= place) & (F.col("upto") - F.col("c") < place), F.col("v")))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    return upto.groupBy("Category").agg(((at(low) + at(high)) / 2).alias("_median"))


SUMMARY_COLUMNS = ("Category", "Count", "UniqueBorrowers", "AvgNotchDiff", "MedianNotchDiff",
                   "MinNotchDiff", "MaxNotchDiff", "EntityIds", "TopKeywords", "SampleReasons")


def group_summary(detail: DataFrame, opts: Options, ordered: bool = True) -> DataFrame:
    """One row per category: counts, notch statistics, entity ids, top
    keywords and sample reasons."""
    notch = F.col("NotchDifference")
    stats = detail.groupBy("Category").agg(
        F.count(F.lit(1)).alias("Count"),
        rint_round(F.avg(notch), 2).alias("AvgNotchDiff"),
        F.min(notch).alias("MinNotchDiff"),
        F.max(notch).alias("MaxNotchDiff"),
        F.min("row_id").alias("_first_row"),
    )
    ents, ent_firsts = first_n_distinct(detail, ["Category"], "EntityId", opts.max_entity_ids,
                                        D.ENTITY_SEPARATOR, "EntityIds")
    uniq = ent_firsts.groupBy("Category").agg(F.count(F.lit(1)).alias("UniqueBorrowers"))
    # one row per category: at most (#rule groups + #clusters + 1) rows
    bound = len(opts.priority_groups) + opts.n_clusters + 1
    samples = sample_texts(detail, ["Category"], opts.max_sample_reasons, "SampleReasons", bound)
    kws = top_tokens(detail, ["Category"], opts.summary_keywords, "TopKeywords", opts)
    out = stats
    for small in (medians(detail, bound), uniq, ents, samples, kws):
        out = out.join(bounded_broadcast(small, bound), "Category", "left")
    out = out.select(
        "Category", "Count",
        F.coalesce(F.col("UniqueBorrowers"), F.lit(0).cast("long")).alias("UniqueBorrowers"),
        "AvgNotchDiff", rint_round(F.col("_median").cast("double"), 2).alias("MedianNotchDiff"), "MinNotchDiff", "MaxNotchDiff",
        F.coalesce(F.col("EntityIds"), F.lit("")).alias("EntityIds"),
        F.coalesce(F.col("TopKeywords"), F.lit("")).alias("TopKeywords"),
        F.coalesce(F.col("SampleReasons"), F.lit("")).alias("SampleReasons"),
        "_first_row",
    )
    if ordered:
        out = out.orderBy(F.col("Count").desc(), F.col("AvgNotchDiff").asc_nulls_last(), F.col("_first_row"))
    return out.drop("_first_row")


ROLLUP_COLUMNS = ("Category", "EntityId", "BorrowerName", "OverrideCount", "AvgNotchDiff")


def entity_rollup(detail: DataFrame, opts: Options, ordered: bool = True) -> DataFrame:
    """One row per (Category, EntityId), a null entity being its own group:
    up to 3 distinct names in first-seen order, row count, mean notch."""
    # one struct key, never null itself: nulls inside it are equal, and the join
    # finds both aggregations already dealt out by it
    keyed = detail.select(F.struct("Category", "EntityId").alias("_key"), "row_id", "NotchDifference",
                          F.col("BorrowerName").cast("string").alias("BorrowerName"))
    base = keyed.groupBy("_key").agg(
        F.count(F.lit(1)).alias("OverrideCount"),
        rint_round(F.avg("NotchDifference"), 2).alias("AvgNotchDiff"),
    )
    names, _ = first_n_distinct(keyed, ["_key"], "BorrowerName", opts.rollup_names, D.NAME_SEPARATOR, "_names")
    out = base.join(names, "_key", "left").select(
        "_key.Category", "_key.EntityId", F.coalesce("_names", F.lit("")).alias("BorrowerName"),
        "OverrideCount", "AvgNotchDiff")
    if ordered:
        out = out.orderBy(F.col("Category").asc_nulls_last(), F.col("OverrideCount").desc(),
                          F.col("EntityId").asc_nulls_last())
    return out


def detail_report(detail: DataFrame, ordered: bool = True) -> DataFrame:
    """Detail rows sorted by Category then EntityId (nulls last), ties in
    row order."""
    out = detail.select("row_id", "BorrowerName", "EntityId", "ActualRating", "ModelRating",
                        "NotchDifference", "OverrideFlag", "ReasonText", "Category")
    if ordered:
        out = out.orderBy(F.col("Category").asc_nulls_last(), F.col("EntityId").asc_nulls_last(), "row_id")
    return out


def run_totals(detail: DataFrame) -> DataFrame:
    """Rows analysed and number of distinct groups."""
    return detail.agg(F.count(F.lit(1)).alias("RowsAnalysed"),
                      F.countDistinct("Category").alias("GroupsFound"))


def cluster_sizes(detail: DataFrame) -> DataFrame:
    """Comments per automatic group."""
    return (detail.where(F.col("Category").startswith("Auto Group "))
            .groupBy("Category").agg(F.count(F.lit(1)).alias("Count")))
