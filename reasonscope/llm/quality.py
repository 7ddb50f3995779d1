"""Quality rules by distribution divergence (DataFrame functions only).

Base rules: at least ``min_words`` words, and at most ``max_repeat_percent`` of
the words inside 5-word windows that occur twice or more in the text.

Divergence: a document's histogram over character classes, and its histogram over
the common words of its language (with one bin for all other words), are compared
to the language's reference by Jensen-Shannon distance (base 2, 0..1). References
are the summed histograms of all documents of the language that pass the base
rules, one for each value of the language column; languages without a list of
common words skip the word test. A histogram with fewer than ``min_chars`` characters or
``min_hist_words`` words isn't tested: short texts diverge by chance.

One pass over the texts makes the counts, which are cut off by a checkpoint; the
references (one row per language) are broadcast up to ``BROADCAST`` rows, else
joined by language.

Defined cases: a null text counts as empty and fails; a null or empty language and
the codes of no single language (``NO_LANGUAGE``) have no reference, nor has a
language whose documents all fail: there only the base rules decide. Repeated rows are judged each on its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reasonscope.llm.common import cut_lineage, without

# The most common words of each language, most frequent first.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "with", "as", "are", "was", "be", "by", "this"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "au"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para"],
}
SPACE = "[ \\t-\\r]+"
# Character classes, each counted in what the ones before left over; the rest is a last class.
CLASSES = [("lower", "[a-z]+"), ("space", SPACE), ("upper", "[A-Z]+"), ("letter", "\\p{L}+"), ("digit", "\\p{N}+"),
           ("point", "[.,;:!?'\"()-]+")]
NO_LANGUAGE = ("", "und", "mul", "mis", "zxx")
BROADCAST = 1 << 16


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 10
    repeat_window: int = 5
    max_repeat_percent: int = 20
    max_reference_symbols: int = 5  # per 100 words, in documents that make the references
    min_chars: int = 400
    max_class_distance: float = 0.24
    min_hist_words: int = 120
    max_word_distance: float = 0.265
    common_words: dict[str, list[str]] = field(default_factory=lambda: dict(COMMON_WORDS))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column, width: int) -> Column:
    """Words covered by ``width``-word windows that occur twice or more."""
    def covered(positions: Column) -> Column:
        gap = lambda p, i: F.when(i + 1 < F.size(positions), F.least(F.lit(width), F.get(positions, i + 1) - p)).otherwise(width)
        return F.aggregate(F.transform(positions, gap), F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        found = F.filter(s, lambda x, i: ((i > 0) & same(x, i - 1)) | same(x, i + 1))
        return let(F.sort_array(F.transform(found, lambda x: x["p"])), covered)

    def of_hashes(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(F.sort_array(pairs), repeated)).otherwise(F.lit(0).cast("long"))

    def of_words(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - width)
        hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return F.when(F.size(w) >= width, let(hashes, of_hashes)).otherwise(F.lit(0).cast("long"))

    return let(words, of_words)


def measures(docs: DataFrame, rules: QualityRules, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The base columns, the two histograms and the reference language of each row."""
    added = ("word_chars", "n_words", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
             "class_distance", "word_distance")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    out = without(docs, added).withColumn(
        "_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": _repeat_words(F.col("_words"), rules.repeat_window),
    })
    listed = F.create_map(*[F.lit(x) for k, v in rules.common_words.items() for x in (k, v)])
    every = sorted({w for v in rules.common_words.values() for w in v})
    widest = max(map(len, rules.common_words.values()))
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    out = out.withColumn("_lang", F.when(~F.lower(F.btrim(lang)).isin(list(NO_LANGUAGE)), lang))
    counted = let(F.filter(F.transform("_words", F.lower), lambda w: w.isin(every)), lambda common: F.transform(
        F.element_at(listed, F.col("_lang")), lambda c: F.size(F.filter(common, lambda w: w == c)).cast("long")))
    out = out.withColumn("_common", F.when(F.col("_lang").isin(list(rules.common_words)), counted).otherwise(F.array_repeat(F.lit(0).cast("long"), widest)))
    out = out.withColumn("_common", F.concat("_common", F.array(
        F.col("n_words") - F.aggregate("_common", F.lit(0).cast("long"), lambda a, x: a + x))))
    left = [text]
    for i, (_, pattern) in enumerate(CLASSES):
        out = out.withColumn(f"_left{i}", F.regexp_replace(left[-1], F.lit(pattern), F.lit("")))
        left.append(F.col(f"_left{i}"))
    sizes = [F.length(x).cast("long") for x in left]
    out = out.withColumn("_classes", F.array(*[a - b for a, b in zip(sizes, sizes[1:])], sizes[-1]))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_words", *[f"_left{i}" for i in range(len(CLASSES))])


def _summed(column: str, size: int) -> Column:
    return F.array(*[F.sum(F.get(F.col(column), F.lit(i))) for i in range(size)])


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance (square root of the divergence, base 2) of two count arrays; null
    if either is empty."""
    def distance(n: Column, m: Column) -> Column:
        part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
        terms = F.zip_with(p, q, lambda a, b: part(a / n, b / m) + part(b / m, a / n))
        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))
    n, m = _total(p), _total(q)
    return F.when((n > 0) & (m > 0), let(n, lambda a: let(m, lambda b: distance(a, b))))


def judge(docs: DataFrame, rules: QualityRules | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with word_chars, n_words, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, class_distance, word_distance and kept."""
    rules = rules or QualityRules()
    counts = cut_lineage(measures(docs, rules, text_col, lang_col))
    bins = len(CLASSES) + 1, max(map(len, rules.common_words.values())) + 1
    plain = ~F.col("base_failed") & (100 * F.col("n_symbols") <= rules.max_reference_symbols * F.col("n_words"))
    references = cut_lineage(counts.where(plain & F.col("_lang").isNotNull()).groupBy("_lang").agg(
        _summed("_classes", bins[0]).alias("_class_reference"), _summed("_common", bins[1]).alias("_word_reference")))
    out = counts.join(F.broadcast(references) if references.count() <= BROADCAST else references, "_lang", "left")
    out = out.withColumns({
        "class_distance": F.when(_total(F.col("_classes")) >= rules.min_chars, jensen_shannon(F.col("_classes"), F.col("_class_reference"))),
        "word_distance": F.when((F.col("n_words") >= rules.min_hist_words) & F.col("_lang").isin(list(rules.common_words)),
                                jensen_shannon(F.col("_common"), F.col("_word_reference"))),
    })
    close = [F.coalesce(F.col(c) <= limit, F.lit(True)) for c, limit in (
        ("class_distance", rules.max_class_distance), ("word_distance", rules.max_word_distance))]
    out = out.withColumn("kept", reduce(lambda a, b: a & b, close, ~F.col("base_failed")))
    return out.drop("_lang", "_common", "_classes", "_class_reference", "_word_reference")
