"""Column builders: text cleaning, tokenizing, stemming, coercion."""

from reasonscope.functions.text import (  # noqa: F401
    canon_flag, clean_reason, clean_whitespace, coerce_notch, expand_abbreviations, normalize_synonyms,
    ngrams, python_strip, repr_quote, rint_round, stem,
    tokenize, with_clean_text,
)
