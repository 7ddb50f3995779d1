"""TF-IDF over comment texts, in two profiles.

``document_frequency``: tokens of the categoriser (stopwords and short words
dropped), n-grams, vocabulary = top ``max_features`` terms by document
frequency (ties by term), weight = tf * (ln((n+1)/(df+1)) + 1), rows
L2-normalised (a zero row stays zero).

``sublinear``: ``\\w\\w+`` tokens of lower-cased text, stopwords removed before
n-grams, vocabulary = top terms by total count (ties by term), tf = 1 + ln(count),
same idf and normalisation.

The vocabulary is bounded by ``max_features`` and is the only thing that
reaches the driver; weights are computed row-locally (MLlib
CountVectorizerModel / ElementwiseProduct / Normalizer), and the long
(row_id, term, weight) table is read off those vectors: no row is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reasonscope.functions.regex import WORD_CLASS
from reasonscope.functions.text import ngrams, tokenize
from reasonscope.options import Options
from reasonscope.session import literal_table

SUBLINEAR_TOKEN = WORD_CLASS + "{2,}"


def term_arrays(df: DataFrame, opts: Options, text_col: str = "ReasonText") -> DataFrame:
    """(row_id, terms): the n-grams each row contributes."""
    return with_terms(df, opts, text_col).select("row_id", "terms")


def with_terms(df: DataFrame, opts: Options, text_col: str = "ReasonText") -> DataFrame:
    """Add ``terms``: the n-grams each row contributes (other columns kept)."""
    lo, hi = opts.ngram_range
    if opts.tfidf_profile == "sublinear":
        stop = list(opts.stopwords)
        raw = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(SUBLINEAR_TOKEN), 0)
        toks = F.filter(raw, lambda t: ~t.isin(stop)) if stop else raw
    else:
        toks = tokenize(text_col, opts.stopwords)
    # the tokens are a column of their own: an expression would be evaluated for every n-gram
    return df.withColumn("_tokens", toks).withColumn("terms", ngrams("_tokens", lo, hi)).drop("_tokens")


@dataclass
class Vocabulary:
    terms: list[str]
    df: list[int]
    n_docs: int

    @property
    def idf(self) -> list[float]:
        import math
        return [math.log((self.n_docs + 1) / (d + 1)) + 1.0 for d in self.df]


def term_statistics(terms: DataFrame, weight_col: str | None = None) -> DataFrame:
    """Per term: document frequency and total count (one shuffle by term).
    With ``weight_col`` each row stands for that many identical rows."""
    w = F.col(weight_col).cast("long") if weight_col else F.lit(1).cast("long")
    marked = lambda arr, occ: F.transform(arr, lambda t: F.struct(t.alias("term"), F.lit(occ).alias("occ")))
    # one generator over occurrences and distinct terms: the input is read once
    both = F.concat(marked(F.col("terms"), True), marked(F.array_distinct("terms"), False))
    rows = terms.select(F.explode_outer(both).alias("t"), w.alias("_w")).where(F.col("t.term").isNotNull())
    return rows.groupBy(F.col("t.term").alias("term")).agg(
        F.sum(F.when(F.col("t.occ"), F.col("_w")).otherwise(0)).cast("long").alias("count"),
        F.sum(F.when(F.col("t.occ"), 0).otherwise(F.col("_w"))).cast("long").alias("df"))


#: most words that are taken along to sort out n-grams before they are counted
PRUNING_WORDS = 20_000


def vocabulary_statistics(terms: DataFrame, opts: Options, weight_col: str | None = None) -> DataFrame:
    """``term_statistics`` of all terms that can enter the vocabulary. An n-gram is at most as
    frequent as each of its words, so none can that has a word below the ``max_features``-th word.
    Words are counted first; n-grams with a weaker word go before they are counted (and
    shuffled). With more than ``PRUNING_WORDS`` words tied at the threshold nothing is sorted out."""
    if opts.ngram_range[0] != 1 or opts.ngram_range[1] < 2:
        return term_statistics(terms, weight_col)
    gram = lambda t: F.contains(t, F.lit(" "))
    words = term_statistics(terms.withColumn("terms", F.filter("terms", lambda t: ~gram(t))), weight_col)
    key = "count" if opts.tfidf_profile == "sublinear" else "df"
    top = words.orderBy(F.col(key).desc(), "term").limit(PRUNING_WORDS + 1).toArrow()
    keys = top[key].to_pylist()
    least = keys[opts.max_features - 1] if len(keys) >= opts.max_features else 0
    strong = [t for t, n in zip(top["term"].to_pylist(), keys) if n >= least]
    if len(strong) > PRUNING_WORDS:
        return term_statistics(terms, weight_col)
    kept = terms.withColumn("terms", F.filter("terms", gram))
    if strong and len(strong) < len(keys):
        known = lambda t: F.forall(F.split(t, " "), lambda w: w.isin(strong))
        kept = terms.withColumn("terms", F.filter("terms", lambda t: gram(t) & known(t)))
    counted = terms.sparkSession.createDataFrame(top.slice(0, len(strong)))
    return counted.unionByName(term_statistics(kept, weight_col))


def vocabulary_table(terms: DataFrame, opts: Options, weight_col: str | None = None) -> DataFrame:
    """Top ``max_features`` terms with their df and 0-based index."""
    stats = vocabulary_statistics(terms, opts, weight_col)
    key = F.col("count") if opts.tfidf_profile == "sublinear" else F.col("df")
    top = stats.orderBy(key.desc(), F.col("term")).limit(opts.max_features)
    # a single-partition window is fine here: ``top`` has at most max_features rows
    return top.withColumn("idx", (F.row_number().over(Window.orderBy(key.desc(), F.col("term"))) - 1).cast("int"))


def build_vocabulary(terms: DataFrame, opts: Options, n_docs: int | None = None,
                     weight_col: str | None = None) -> Vocabulary:
    rows = vocabulary_table(terms, opts, weight_col).orderBy("idx").collect()    # <= max_features rows
    n_docs = terms.count() if n_docs is None else n_docs
    return Vocabulary([r["term"] for r in rows], [int(r["df"]) for r in rows], n_docs)


def tfidf_long(terms: DataFrame, opts: Options) -> DataFrame:
    """(row_id, term, weight) for every in-vocabulary term of every row."""
    vocab = build_vocabulary(terms, opts)
    if not vocab.terms:
        return literal_table(terms.sparkSession, [], "row_id long, term string, weight double")
    names = F.array(*[F.lit(t) for t in vocab.terms])     # <= max_features literals
    rows = tfidf_features(terms, vocab, opts).select("row_id", F.posexplode(vector_to_array("features")).alias("i", "weight"))
    # idf and term frequency of a present term are positive: zero means absent
    return rows.where(F.col("weight") > 0).select("row_id", F.element_at(names, F.col("i") + 1).alias("term"), "weight")


def tfidf_features(terms: DataFrame, vocab: Vocabulary, opts: Options, out_col: str = "features") -> DataFrame:
    """Row-local vectorisation: counts -> (sublinear) -> * idf -> L2 norm.
    The document-frequency profile stays sparse end to end."""
    if not vocab.terms:
        raise ValueError("empty vocabulary")
    cv = CountVectorizerModel.from_vocabulary(vocab.terms, inputCol="terms", outputCol="_tf")
    x = cv.transform(terms)
    if opts.tfidf_profile == "sublinear":
        arr = F.transform(vector_to_array("_tf"), lambda c: F.when(c > 0, 1.0 + F.log(c)).otherwise(F.lit(0.0)))
        x = x.withColumn("_tf", array_to_vector(arr))
    x = ElementwiseProduct(scalingVec=Vectors.dense(vocab.idf), inputCol="_tf", outputCol="_w").transform(x)
    x = Normalizer(p=2.0, inputCol="_w", outputCol=out_col).transform(x)
    return x.drop("_tf", "_w")
