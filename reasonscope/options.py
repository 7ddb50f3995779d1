"""Run options: the dictionaries and settings of both jobs, with defaults."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from typing import Mapping, Sequence

from reasonscope import defaults as D
from reasonscope.sources.columns import as_spec


def _frozen_groups(groups: Mapping[str, Sequence[str]]) -> tuple[tuple[str, tuple[str, ...]], ...]:
    return tuple((str(k), tuple(str(p) for p in v)) for k, v in groups.items())


@dataclass(frozen=True)
class Options:
    """Everything a run can be configured with.

    Dictionaries keep their insertion order, because order decides which rule
    or synonym applies first. Use :meth:`with_` to derive a changed copy.
    """

    # how the cleaned rows are kept for their several readers:
    # "persist" (cache), "checkpoint" (written to spark.checkpoint.dir), "none"
    materialize: str = "persist"

    # input mapping: logical field -> column spec (letter, header text or name)
    column_map: tuple[tuple[str, str], ...] = ()
    row_id_col: str = "row_id"
    # deal a source that arrives in few partitions (one unsplittable file) out by row id
    input_partitions: int | None = None
    only_override_rows: bool = True
    override_yes_values: tuple[str, ...] = D.OVERRIDE_YES_VALUES
    min_reason_length: int = D.MIN_REASON_LENGTH

    # dictionaries
    stopwords: tuple[str, ...] = D.STOPWORDS
    synonyms: tuple[tuple[str, tuple[str, ...]], ...] = field(
        default_factory=lambda: _frozen_groups(D.SYNONYMS))
    abbreviations: tuple[tuple[str, str], ...] = tuple(D.ABBREVIATIONS.items())
    priority_groups: tuple[tuple[str, tuple[str, ...]], ...] = field(
        default_factory=lambda: _frozen_groups(D.PRIORITY_GROUPS))

    # up to so many phrases a dictionary is a chain of regular expressions in the plan; a
    # larger one is a table (operators.phrases), with the same result
    chain_limit: int = 200

    # clustering
    cluster_unmatched: bool = True
    unmatched_label: str = "Other"          # used when cluster_unmatched is False
    n_clusters: int = D.N_CLUSTERS
    auto_select_k: bool = D.AUTO_SELECT_K
    min_k: int = D.MIN_K
    ngram_range: tuple[int, int] = D.NGRAM_RANGE
    max_features: int = D.MAX_TFIDF_FEATURES
    tfidf_profile: str = "document_frequency"   # or "sublinear"
    top_keywords_per_cluster: int = D.TOP_KEYWORDS_PER_CLUSTER
    kmeans_n_init: int = D.KMEANS_N_INIT
    kmeans_max_iter: int = D.KMEANS_MAX_ITER
    kmeans_seed: int = D.KMEANS_SEED
    kmeans_tol: float = D.KMEANS_TOL

    # reports
    max_sample_reasons: int = D.MAX_SAMPLE_REASONS_PER_GROUP
    max_entity_ids: int = D.MAX_ENTITY_IDS_IN_SUMMARY_CELL
    summary_keywords: int = D.SUMMARY_KEYWORDS
    rollup_names: int = D.ROLLUP_NAMES_PER_CELL

    # fit equal points once, weighted (the fit is exact, so the result is the same)
    dedupe_texts: bool = True

    # rule phrases also match the beginning of a word ("realloc" finds "reallocated")
    prefix_match: bool = False

    # explore
    text_col: str = "reason_text"           # or "ReasonText", the cleaned text, or a column of the source
    abbreviation_match_count: bool = False  # adds MatchCount, all matches of an abbreviation
    abbreviation_examples: int = D.ABBREVIATION_EXAMPLES
    stem_min_variants: int = D.STEM_MIN_VARIANTS
    collocation_top_n: int = D.COLLOCATION_TOP_N
    collocation_min_count: int = D.COLLOCATION_MIN_COUNT
    context_top_words: int = D.CONTEXT_TOP_WORDS
    context_top_pairs: int = D.CONTEXT_TOP_PAIRS
    context_min_doc_freq: int = D.CONTEXT_MIN_DOC_FREQ
    word_frequency_rows: int = D.WORD_FREQUENCY_ROWS

    # run-info texts
    input_name: str = ""
    sheet_name: str | None = None

    def with_(self, **changes) -> "Options":
        for key in ("synonyms", "priority_groups"):
            if key in changes and isinstance(changes[key], Mapping):
                changes[key] = _frozen_groups(changes[key])
        if "abbreviations" in changes and isinstance(changes["abbreviations"], Mapping):
            changes["abbreviations"] = tuple(changes["abbreviations"].items())
        if "column_map" in changes and isinstance(changes["column_map"], Mapping):
            changes["column_map"] = tuple((k, as_spec(v)) for k, v in changes["column_map"].items())
        for key in ("stopwords", "override_yes_values"):
            if key in changes:
                changes[key] = tuple(changes[key])
        return dataclasses.replace(self, **changes)

    # convenient views
    @property
    def synonym_phrases(self) -> tuple[str, ...]:
        return tuple(p for _, phrases in self.synonyms for p in phrases)

    @property
    def abbreviation_map(self) -> dict[str, str]:
        return dict(self.abbreviations)
