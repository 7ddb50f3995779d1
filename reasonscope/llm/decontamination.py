"""Benchmark decontamination by a distributed positional inverted index (DataFrame
functions only).

``build_index`` goes over the texts once and writes the postings (row, position, term)
of all words that some benchmark item uses, and one head row per document. Postings
lie where their document's rows lie, so a word that is everywhere is spread like the corpus.

``find`` takes the windows of every item (``width`` consecutive words; a shorter item is
one window) and intersects offset-adjusted posting lists, rarest term first: a posting of a
window's rarest term at position p, item offset q, puts the item's start at p - q; it
lives on where the second rarest term has a posting at its own offset from there, give or
take ``slop``. Windows with a term that no document has are out at once. What
survives (alignments: document, item, start) is intersected with the lists of all other
terms of the item, read for the aligned documents only. A run of ``width`` terms at their exact
offsets is a phrase match; with all of them within ``slop`` of it, a proximity match.

Small tables are broadcast up to ``BROADCAST`` counted rows, else joined by a shuffle.
Joins beyond the first are keyed by document, term and stretch of positions, so neither a
common term nor a long document falls to one task.

Words: A-Z lowered, then runs of characters other than ASCII non-alphanumerics. Defined
cases: a null text has no words; an item without words has no window. Rows are told apart by a
key of their own, so null and repeated document ids keep their rows. Items are told apart by
``item_id``: rows that share one count as one item, a null id is written as the empty text.
Columns of the documents are carried without the text; added ones replace those of the same name.
An empty benchmark leaves every document clean.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reasonscope.llm.common import without, working_folder

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST = 1 << 18
WIDTH = 10
SLOP = 2
ADDED = ("n_words", "n_hit", "n_items", "n_near_items", "items", "contaminated", "_row", "_pos", "_term")


@dataclass
class Index:
    """Tables in the shared folder. ``postings``: _row, _pos (from 1), _term; ``heads``:
    a row per document; ``items``: _item, item_id, words; ``terms``: _word, _term."""
    postings: DataFrame
    heads: DataFrame
    items: DataFrame
    terms: DataFrame
    folder: str


def lowered(text: Column) -> Column:
    """A-Z in lower case. ``lower`` is much faster than ``translate`` and does the same
    where it leaves the text's other characters alone."""
    other = F.regexp_replace(text, "[\\x00-\\x7F]+", "")
    return F.when((F.octet_length(text) == F.length(text)) | (F.lower(other) == other), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def marked_words(text: Column) -> Column:
    """The words behind an empty mark (and before another, where the text ends in a separator)."""
    return F.split(F.concat(F.lit(". "), lowered(F.coalesce(text.cast("string"), F.lit("")))), SEPARATORS)


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def build_index(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                item_text_col: str = "text") -> Index:
    spark = docs.sparkSession
    folder = working_folder(spark, "index")
    words = F.filter(marked_words(F.col(item_text_col)), lambda w: w != "")
    (benchmark.select(F.monotonically_increasing_id().alias("_item"), F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"),
                      words.alias("words")).where(F.size("words") > 0).write.parquet(f"{folder}/items"))
    items = spark.read.parquet(f"{folder}/items")
    (items.select(F.explode("words").alias("_word")).distinct().select("_word", F.monotonically_increasing_id().alias("_term"))
     .write.parquet(f"{folder}/terms"))
    terms = spark.read.parquet(f"{folder}/terms")
    carried = [c for c in without(docs, ADDED).columns if c.lower() != text_col.lower()]
    marked = docs.select(F.monotonically_increasing_id().alias("_row"), *[F.col(f"`{c}`") for c in carried],
                         marked_words(F.col(text_col)).alias("_words"))
    counted = marked.withColumn("n_words", (F.size("_words") - 1 - (F.element_at("_words", -1) == "").cast("int")).cast("long"))
    # the text ". " alone is two empty marks: no words
    each = counted.select("_row", *[F.col(f"`{c}`") for c in carried], F.greatest("n_words", F.lit(0)).alias("n_words"),
                          F.posexplode_outer("_words").alias("_pos", "_word"))
    mark = terms.sparkSession.range(1).select(F.lit("").alias("_word"), F.lit(-1).cast("long").alias("_term"))
    found = each.join(small(terms.unionByName(mark)), "_word").where((F.col("_pos") == 0) | (F.col("_term") >= 0)).drop("_word")
    found.write.parquet(f"{folder}/postings")
    stored = spark.read.schema(found.schema).parquet(f"{folder}/postings")
    return Index(stored.where(F.col("_pos") > 0).select("_row", "_pos", "_term"),
                 stored.where(F.col("_pos") == 0).drop("_pos", "_term"), items, terms, folder)


def item_terms(index: Index, width: int) -> DataFrame:
    """_item, _n (its words), _q (place in the item), _term, _df (its postings, 0 if there are none), and
    for a window that begins at _q: _rare, its two rarest terms as (f, q, t); null where no window begins."""
    frequency = index.postings.groupBy("_term").agg(F.count(F.lit(1)).alias("_df"))
    known = index.terms.join(frequency, "_term", "left").withColumn("_df", F.coalesce("_df", F.lit(0)))
    words = index.items.select("_item", F.size("words").alias("_n"), F.posexplode("words").alias("_q", "_word"))
    frame = Window.partitionBy("_item").orderBy("_q").rowsBetween(0, width - 1)
    own = F.sort_array(F.collect_list(F.struct(F.col("_df").alias("f"), F.col("_q").alias("q"), F.col("_term").alias("t"))).over(frame))
    begins = (F.size(own) == width) | ((F.col("_q") == 0) & (F.col("_n") < width))
    return words.join(known, "_word").withColumn("_rare", F.when(begins, F.slice(own, 1, 2))).drop("_word")


def anchors(terms: DataFrame) -> DataFrame:
    """The two rarest terms (and their places) of every window that can occur."""
    rarest, second = F.get("_rare", F.lit(0)), F.coalesce(F.get("_rare", F.lit(1)), F.get("_rare", F.lit(0)))
    return terms.where(rarest["f"] > 0).select("_item", rarest["t"].alias("_t0"), rarest["q"].alias("_q0"),
                                               second["t"].alias("_t1"), second["q"].alias("_q1")).distinct()


def _buckets(place: Column, slop: int) -> Column:
    """The one or two stretches of 2 * slop + 1 positions in reach of a position."""
    low, high = (F.floor((place + d) / (2 * slop + 1)) for d in (-slop, slop))
    return F.explode(F.array_distinct(F.array(low, high)))


def alignments(index: Index, terms: DataFrame, slop: int) -> DataFrame:
    """_row, _item, _at: where the postings of a window's two rarest terms agree on the item's start."""
    asked = anchors(terms)
    first = index.postings.join(small(asked.withColumnRenamed("_t0", "_term")), "_term").select(
        "_row", "_item", (F.col("_pos") - F.col("_q0")).alias("_at"), F.col("_t1").alias("_term"), "_q1")
    first = first.withColumn("_bucket", _buckets(F.col("_at") + F.col("_q1"), slop))
    listed = index.postings.join(small(asked.select(F.col("_t1").alias("_term")).distinct()), "_term", "left_semi")
    listed = listed.withColumn("_bucket", F.floor(F.col("_pos") / (2 * slop + 1)))
    both = first.join(listed, ["_row", "_term", "_bucket"]).where(F.abs(F.col("_pos") - F.col("_q1") - F.col("_at")) <= slop)
    both.select("_row", "_item", "_at").distinct().write.parquet(f"{index.folder}/alignments")
    return index.postings.sparkSession.read.parquet(f"{index.folder}/alignments")


def find(index: Index, width: int = WIDTH, slop: int = SLOP) -> DataFrame:
    """Alignments with at least one match: _row, item_id, and ``phrases`` and ``near``,
    arrays of (begin, end): words of the document covered by exact and by
    proximity matches, positions from 1, end excluded, in order and apart."""
    terms = item_terms(index, width)
    terms.write.parquet(f"{index.folder}/item_terms")
    terms = index.postings.sparkSession.read.parquet(f"{index.folder}/item_terms")
    aligned = alignments(index, terms, slop)
    rows = aligned.select("_row").distinct()
    listed = index.postings.join(small(rows), "_row", "left_semi").withColumn("_bucket", F.floor(F.col("_pos") / (2 * slop + 1)))
    asked = terms.where(F.col("_df") > 0).select("_item", "_n", "_q", "_term", F.get("_rare", F.lit(0))["q"].alias("_first"))
    wanted = aligned.join(small(asked), "_item").withColumn("_bucket", _buckets(F.col("_at") + F.col("_q"), slop))
    shift = F.col("_pos") - F.col("_q") - F.col("_at")
    met = wanted.join(listed, ["_row", "_term", "_bucket"]).where(F.abs(shift) <= slop)
    places = met.groupBy("_row", "_item", "_at", "_n").agg(
        F.sort_array(F.collect_set(F.when(shift == 0, F.col("_q")))).alias("_exact"),
        F.sort_array(F.collect_set(F.struct("_q", "_first"))).alias("_near"))
    length = F.least(F.lit(width), F.col("_n"))
    last = lambda i: i + length - 1
    exact = F.filter("_exact", lambda q, i: F.coalesce(F.get("_exact", last(i)) == last(q), F.lit(False)))
    # all terms are near the place of the window's rarest one
    near = F.transform(F.filter("_near", lambda x, i: F.coalesce(F.get("_near", last(i))["_q"] == last(x["_q"]), F.lit(False))
                                & F.array_contains("_exact", x["_first"])), lambda x: x["_q"])
    found = places.withColumns({"_e": exact, "_w": near}).where(F.size("_w") > 0)

    def spans(starts: Column) -> Column:
        begins = F.filter(starts, lambda s, i: (i == 0) | (s - F.get(starts, i - 1) > length))
        lasts = F.filter(starts, lambda s, i: (i == F.size(starts) - 1) | (F.get(starts, i + 1) - s > length))
        return F.zip_with(begins, lasts, lambda b, e: F.struct((F.col("_at") + b).alias("begin"), (F.col("_at") + e + length).alias("end")))

    found = found.select("_row", "_item", spans(F.col("_e")).alias("phrases"), spans(F.col("_w")).alias("near"))
    return found.join(small(index.items.select("_item", "item_id")), "_item").select("_row", "item_id", "phrases", "near")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, slop: int = SLOP, text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with n_words, n_hit (words inside phrase matches),
    n_items and items (sorted ids of items with phrase matches), n_near_items (items
    with proximity matches, phrases included) and contaminated."""
    index = build_index(docs, benchmark, text_col, item_col, item_text_col)
    find(index, width, slop).write.parquet(f"{index.folder}/matches")
    matches = docs.sparkSession.read.parquet(f"{index.folder}/matches")
    spans = matches.select("_row", F.inline("phrases")).distinct()
    before = Window.partitionBy("_row").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("begin", F.coalesce(F.max("end").over(before), F.col("begin"))))
    hits = spans.select("_row", fresh.alias("_new")).groupBy("_row").agg(F.sum("_new").cast("long").alias("n_hit"))
    items = matches.groupBy("_row").agg(
        F.array_sort(F.collect_set(F.when(F.size("phrases") > 0, F.col("item_id")))).alias("items"),
        F.count_distinct("item_id").alias("n_near_items"))
    out = index.heads.join(items, "_row", "left").join(hits, "_row", "left").drop("_row")
    return out.withColumns({
        "n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "n_near_items": F.coalesce("n_near_items", F.lit(0).cast("long")),
        "items": F.coalesce("items", F.array().cast("array<string>")),
    }).withColumns({"n_items": F.size("items").cast("long"), "contaminated": F.col("n_hit") > 0})
