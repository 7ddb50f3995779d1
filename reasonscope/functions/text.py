"""Text Column builders (cleaning, tokenizing, n-grams, stemming, coercion).

All builders return ``pyspark.sql.Column`` expressions evaluated in the JVM
(regex + higher-order array functions), so they stay inside whole-stage code
generation and work on batch and streaming DataFrames alike.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reasonscope import defaults as D
from reasonscope.functions.regex import (
    any_phrase_pattern, java_replacement, phrase_pattern, space_class, space_class_body,
)
from reasonscope.options import Options

_S = space_class()
# the characters Python's str.strip() removes (str.isspace)
_SPACE_CHARS = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())
# whitespace runs that are not already one plain space
_RUN = f"{_S}{{2,}}|[{space_class_body()}&&[^ ]]"
_NUMBER = (r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
           r"|(?i:inf|infinity|nan))$")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def python_strip(col) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.btrim(_c(col), F.lit(_SPACE_CHARS))


def clean_whitespace(col) -> Column:
    """Strip, then collapse every whitespace run to one space (runs that
    already are one plain space are left alone, which saves most matches)."""
    return F.regexp_replace(python_strip(col), _RUN, " ")


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a one-argument Column
    function): the result never duplicates ``value``'s expression tree."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def _guarded(c: Column, guard: str, reps: list[tuple[str, str]]) -> Column:
    """Apply the replacements in order, but only to texts the guard finds a
    phrase in; exact, because no replacement can fire on a text none of the
    phrases matches. Reads ``c`` three times: give it a column reference or
    bind it with :func:`_let`."""
    chain = c
    for pat, rep in reps:
        chain = F.regexp_replace(chain, pat, rep)
    return F.when(c.rlike(guard), chain).otherwise(c)


def _guarded_chain(c: Column, guard: str, reps: list[tuple[str, str]]) -> Column:
    return _let(c, lambda x: _guarded(x, guard, reps))


def expand_abbreviations(col, abbreviations) -> Column:
    """Ordered, case-insensitive whole-word replacement; later entries see the
    result of earlier ones. Texts without any abbreviation skip the chain."""
    items = list(abbreviations.items() if hasattr(abbreviations, "items") else abbreviations)
    c = _c(col)
    if not items:
        return c
    reps = [(phrase_pattern(abbr), java_replacement(full)) for abbr, full in items]
    return _guarded_chain(c, any_phrase_pattern([a for a, _ in items]), reps)


def normalize_synonyms_steps(synonyms) -> list[tuple[str, list[tuple[str, str]]]]:
    """Per synonym group (dictionary order): a guard pattern and the ordered
    replacements, longest phrase first inside the group (stable on ties)."""
    steps = []
    for canonical, phrases in synonyms:
        ordered = sorted([p for p in phrases if p], key=len, reverse=True)
        if not ordered:
            continue
        reps = [(phrase_pattern(p), java_replacement(canonical)) for p in ordered]
        steps.append((any_phrase_pattern(ordered), reps))
    return steps


def normalize_synonyms(col, synonyms) -> Column:
    c = _c(col)
    for guard, reps in normalize_synonyms_steps(synonyms):
        c = _guarded_chain(c, guard, reps)
    return c


def clean_reason(col, opts: Options) -> Column:
    """null -> "", whitespace, abbreviations, synonyms (letter case kept)."""
    c = clean_whitespace(F.coalesce(_c(col), F.lit("")))
    return normalize_synonyms(expand_abbreviations(c, opts.abbreviations), opts.synonyms)


def with_clean_text(df: DataFrame, src: str, dst: str, opts: Options) -> DataFrame:
    """Add (or replace) ``dst`` = cleaned ``src`` (what :func:`clean_reason`
    computes, laid out for the optimizer).

    Each step is its own projection over the previous step's column, so the
    guarded chains (which read their input three times) are evaluated once
    per row without lambda bindings; the optimizer keeps such projections
    apart because merging them would repeat non-cheap expressions. The final
    value comes out of a generator (explode of a one-element array), which
    filters are not pushed below: a later filter on the cleaned text (e.g.
    its length) reads the computed value instead of re-running the chain.
    """
    tmp = "_clean"
    out = df.withColumn(tmp, clean_whitespace(F.coalesce(F.col(src), F.lit(""))))
    items, synonyms = list(opts.abbreviations), opts.synonyms
    if len(items) + len(opts.synonym_phrases) > opts.chain_limit:
        from reasonscope.operators.phrases import fold_phrases, ordered_entries
        out, items, synonyms = fold_phrases(out, tmp, tmp, ordered_entries(items, synonyms)), [], ()
    if items:
        reps = [(phrase_pattern(a), java_replacement(f)) for a, f in items]
        out = out.withColumn(tmp, _guarded(F.col(tmp), any_phrase_pattern([a for a, _ in items]), reps))
    for guard, reps in normalize_synonyms_steps(synonyms):
        out = out.withColumn(tmp, _guarded(F.col(tmp), guard, reps))
    cols = [F.col(f"`{c}`") for c in out.columns if c not in (dst, tmp)]
    return out.select(*cols, F.explode_outer(F.array(F.col(tmp))).alias(dst))


def explode_positions(df: DataFrame, array_col: str, pos_col: str, value_col: str) -> DataFrame:
    """One row per array element with its 0-based position; rows with an
    empty array vanish. Uses the outer generator plus a null filter: for the
    plain generator the optimizer infers ``size(array) > 0`` and pushes it
    below earlier exchanges, computing the array a second time there."""
    cols = [c for c in df.columns if c != array_col]
    out = df.select(*cols, F.posexplode_outer(array_col).alias(pos_col, value_col))
    return out.where(F.col(pos_col).isNotNull())


def explode_values(df: DataFrame, array_col: str, value_col: str) -> DataFrame:
    """One row per array element (see :func:`explode_positions`)."""
    return explode_positions(df, array_col, "_pos", value_col).drop("_pos")


def token_stats(df: DataFrame, keys: list[str], tokens_col: str, row_col: str = "row_id",
                stopwords=None, min_length: int | None = None, weight_col: str | None = None) -> DataFrame:
    """Per (keys, token): occurrences ``n``, rows holding it ``df`` and the
    first appearance as (``first_row``, ``first_rank``).

    The order in which tokens first appear inside one row equals their order
    in ``array_distinct(tokens)`` (also after dropping stopwords, which
    removes whole values), so (row, index in the distinct array) orders
    first appearances exactly like (row, position), and each (token, row)
    pair occurs once: ``min(row)`` and ``min_by(rank, row)`` are exact.
    One generator emits the occurrences (rank -1) and the distinct entries;
    stopwords and short tokens are dropped after it with code-generated
    predicates; one hash aggregation with map-side partial results follows.
    With ``weight_col`` a row stands for that many rows holding the same
    tokens (``row_col`` then being the first of them).
    """
    t = F.col(tokens_col)
    d = F.array_distinct(t)
    wt = (F.col(weight_col) if weight_col else F.lit(1)).cast("long")
    parts = df.select(
        *keys, F.col(row_col).alias("_row"), wt.alias("_wt"),
        t.alias("token"), F.array_repeat(F.lit(-1), F.size(t)).alias("rank"),
        d.alias("_dt"),
        F.when(F.size(d) > 0, F.sequence(F.lit(0), F.size(d) - 1)).otherwise(F.array().cast("array<int>"))
         .alias("_dr"))
    both = parts.select(*keys, "_row", "_wt", F.concat(F.arrays_zip("token", "rank"),
                                               F.arrays_zip(F.col("_dt").alias("token"),
                                                            F.col("_dr").alias("rank"))).alias("_e"))
    ex = explode_values(both, "_e", "_x").select(*keys, "_row", "_wt", F.col("_x.token").alias("token"),
                                                 F.col("_x.rank").alias("rank"))
    if stopwords:
        ex = ex.where(~F.col("token").isin(list(stopwords)))
    if min_length:
        ex = ex.where(F.length("token") >= min_length)
    first = F.col("rank") >= 0
    return ex.groupBy(*keys, "token").agg(
        F.sum(F.when(first, 0).otherwise(F.col("_wt"))).cast("long").alias("n"),
        F.sum(F.when(first, F.col("_wt")).otherwise(0)).cast("long").alias("df"),
        F.min(F.when(first, F.col("_row"))).alias("first_row"),
        F.min_by(F.col("rank"), F.when(first, F.col("_row"))).alias("first_rank"))


def raw_tokens(col) -> Column:
    """All lower-case tokens ``[a-zA-Z][a-zA-Z\\-']+`` in text order."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(D.TOKEN_PATTERN), 0)


def tokenize(col, stopwords=D.STOPWORDS) -> Column:
    """Lower-case tokens ``[a-zA-Z][a-zA-Z\\-']+`` without stopwords and
    without tokens shorter than 3 characters, in text order."""
    raw = F.regexp_extract_all(F.lower(_c(col)), F.lit(D.TOKEN_PATTERN), 0)
    if not stopwords:
        return F.filter(raw, lambda t: F.length(t) >= D.TOKEN_MIN_LENGTH)
    stop = list(stopwords)
    # isin becomes a hash set lookup (INSET) inside the lambda
    return F.filter(raw, lambda t: (~t.isin(stop)) & (F.length(t) >= D.TOKEN_MIN_LENGTH))


def _gram_at(t: Column, n: int):
    # a one-argument lambda: PySpark reads a second parameter as the index
    return lambda i: F.array_join(F.slice(t, i, n), " ")


def ngrams(tokens, lo: int = 1, hi: int = 2) -> Column:
    """n-grams for n = lo..hi, each joined by one space; unigrams first. Give it a column of
    tokens: inside the grams' lambda an expression would run again for every gram."""
    t = _c(tokens)
    parts = []
    for n in range(lo, hi + 1):
        if n == 1:
            parts.append(t)
        else:
            grams = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), _gram_at(t, n))
            parts.append(F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>")))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def stem(col) -> Column:
    """Cut the first listed suffix that leaves at least 4 characters."""
    w = _c(col)
    expr = None
    for suf in D.STEM_SUFFIXES:
        cond = w.endswith(suf) & (F.length(w) - len(suf) >= D.STEM_MIN_ROOT)
        cut = w.substr(F.lit(1), F.length(w) - len(suf))
        expr = F.when(cond, cut) if expr is None else expr.when(cond, cut)
    return expr.otherwise(w)


def coerce_notch(col) -> Column:
    """Numeric coercion with failures -> null (plain decimal / exponent form,
    inf, nan; NaN itself becomes null because it counts as missing)."""
    s = F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(" \t\n\x0b\x0c\r"))
    v = F.when(s.rlike(_NUMBER), s.try_cast("double"))
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)


def canon_flag(col) -> Column:
    """Flag as text, stripped, upper-case; a missing flag reads 'NAN'."""
    return F.upper(python_strip(F.coalesce(_c(col).cast("string"), F.lit("nan"))))


def rint_round(col, digits: int) -> Column:
    """Half-even rounding the way numpy rounds doubles: rint(x*10^d)/10^d."""
    scale = float(10 ** digits)
    return F.rint(_c(col) * F.lit(scale)) / F.lit(scale)


_SPLIT = 134217729.0   # 2^27 + 1: Dekker's splitting constant for doubles


def _split(v: Column):
    c = v * F.lit(_SPLIT)
    hi = c - (c - v)
    return hi, v - hi


def py_round(col, digits: int) -> Column:
    """Python's ``round(x, digits)`` on a float: half-even on the *exact*
    binary value of x (``round(12.35, 1) == 12.3``, while rint(123.5)/10
    gives 12.4).

    p = fl(x * 10^d) is exact enough except when p lands exactly on a .5
    tie; then the sign of the product's rounding error e (Dekker's exact
    two-product, plain double arithmetic) tells on which side the exact
    value lies.
    """
    x = _c(col).cast("double")
    s = F.lit(float(10 ** digits))
    p = x * s
    xh, xl = _split(x)
    sh, sl = _split(s)
    e = ((xh * sh - p) + xh * sl + xl * sh) + xl * sl
    f = F.floor(p).cast("double")
    at_tie = p == f + F.lit(0.5)
    r = (F.when(at_tie & (e > 0), f + F.lit(1.0))
          .when(at_tie & (e < 0), f)
          .otherwise(F.rint(p)))
    return r / s


def repr_quote(col) -> Column:
    """Python ``repr`` of a token (tokens hold only letters, '-' and ')."""
    c = _c(col)
    return F.when(F.instr(c, "'") > 0, F.concat(F.lit('"'), c, F.lit('"'))) \
        .otherwise(F.concat(F.lit("'"), c, F.lit("'")))
