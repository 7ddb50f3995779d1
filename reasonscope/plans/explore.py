"""Explore job: five vocabulary tables that help extend the dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reasonscope.operators import explore as X
from reasonscope.operators.prepare import explore_reasons
from reasonscope.options import Options
from reasonscope.session import materialize


def run_explore(df: DataFrame, opts: Options, persist: bool = True) -> dict[str, DataFrame]:
    """All Explore tables from a comment table (logical fields + row_id).

    Texts are tokenized once; the token arrays and the per-token counts are
    persisted because every table reads them, until ``session.release``.
    """
    reasons = explore_reasons(df, opts)
    tok = X.row_tokens(reasons, opts)
    counts = X.word_counts(tok)
    if persist:
        tok = materialize(tok, opts.materialize)
        counts = materialize(X.word_counts(tok), "persist")
    stems = X.stem_groups(counts, opts)
    colloc = X.collocations(tok, counts, opts)
    context = X.context_similarity(tok, counts, opts, keep_rank=True)
    if persist:
        # small results (<= vocabulary / top-n rows) read again by the views
        stems, colloc, context = (materialize(t) for t in (stems, colloc, context))
    return {
        "abbreviations": X.abbreviation_report(reasons, opts),
        # row total from the kept token rows (weights sum to the rows) instead of a rescan
        "word_frequencies": X.word_frequency(counts, tok, opts),
        "stem_groups": stems,
        "collocations": colloc,
        "context_similarity": context.orderBy(F.col("score").desc(), F.col("i").desc(), F.col("j").desc()).drop("score", "i", "j"),
        "top_stems": X.top_stems(stems),
        "top_phrases": X.top_phrases(colloc),
        "top_context_pairs": X.top_context_pairs(context),
    }
