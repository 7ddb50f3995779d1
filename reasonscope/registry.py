"""Registered queries: one per operator of the inventory, each over the
driver's test tables (spark, sf_dir) -> DataFrame. Oracle SQL for DuckDB
lives in :mod:`reasonscope.oracle` and is listed by :func:`oracle_sql`."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from reasonscope import oracle as O
from reasonscope.options import Options
from reasonscope.session import ensure_checkpoint_dir, literal_table, materialize
from reasonscope.functions import text as T
from reasonscope.operators import cluster as C
from reasonscope.operators import explore as X
from reasonscope.operators import features as FT
from reasonscope.operators import reports as R
from reasonscope.operators.phrases import first_rule, fold_phrases, ordered_entries
from reasonscope.operators.prepare import explore_reasons, prepare_comments
from reasonscope.operators.refresh import read_state, summary_of_state, summary_state, write_state
from reasonscope.operators.rules import priority_counts
from reasonscope.plans.categorize import categorize, rule_categorized
from reasonscope.sources.columns import Header, project_fields
from reasonscope.sources.fixtures import COMMENT_COLUMNS, VIEW_OPTIONS, VIEWS, table

LLOYD_STEPS = 3
FIXED_K = 4


def _opts(view, **kw):
    return VIEW_OPTIONS[view].with_(**kw) if kw else VIEW_OPTIONS[view]


def _view(spark, sf, view):
    return VIEWS[view](spark, sf)


def _rules_only(view):
    return _opts(view, cluster_unmatched=False)


def _detail_rules(spark, sf, view):
    opts = _rules_only(view)
    d, _ = categorize(_view(spark, sf, view), opts)
    return d, opts


def _reasons_tok(spark, sf, view):
    opts = _opts(view)
    reasons = explore_reasons(_view(spark, sf, view), opts)
    tok = X.row_tokens(reasons, opts)
    return reasons, tok, X.word_counts(tok), opts


# ------------------------------------------------------------------ sources
def q_load_comments(spark, sf):
    return _view(spark, sf, "order")


LETTER_MAP = {"borrower_name": "B", "entity_id": "C", "actual_rating": "D", "model_rating": "E",
              "notch_difference": "F", "override_flag": "G", "reason_text": "H"}
HEADER_MAP = {"borrower_name": Header(" Borrower_Name "), "entity_id": Header("ENTITY_ID"),
              "actual_rating": Header("actual_rating"), "model_rating": Header("Model_Rating"),
              "notch_difference": Header("notch_difference"), "override_flag": Header("Override_Flag"),
              "reason_text": Header("  reason_TEXT")}


def q_project_by_position(spark, sf):
    return project_fields(_view(spark, sf, "turn"), LETTER_MAP)


def q_project_by_header(spark, sf):
    return project_fields(_view(spark, sf, "doc"), HEADER_MAP, keep=("row_id",))


def q_explore_reasons(spark, sf):
    return explore_reasons(_view(spark, sf, "doc"), _opts("doc"))


# ------------------------------------------------------------------ predicates / scalar
def q_prepare_comments(spark, sf):
    return prepare_comments(_view(spark, sf, "doc"), _opts("doc"))


def q_coerce_notch(spark, sf):
    v = _view(spark, sf, "order")
    return v.select("row_id", "notch_difference", T.coerce_notch("notch_difference").alias("NotchDifference"))


def q_flag_filter(spark, sf):
    opts = _opts("order")
    v = _view(spark, sf, "order").select("row_id", T.canon_flag("override_flag").alias("OverrideFlag"))
    return v.where(F.col("OverrideFlag").isin(list(opts.override_yes_values)))


def q_min_length_filter(spark, sf):
    opts = _opts("turn", only_override_rows=False)
    return prepare_comments(_view(spark, sf, "turn"), opts).select("row_id", "ReasonText")


def q_priority_match(spark, sf):
    opts = _opts("doc")
    return rule_categorized(_view(spark, sf, "doc"), opts).select("row_id", "Category")


BENCHMARK_PHRASE = "[A-Za-z]+ [A-Za-z]+"
FOLDED_TERMS = 10_000


def q_priority_match_table(spark, sf):
    """Rules given as a table: the word pairs of the benchmark items, named by item."""
    detail = prepare_comments(_view(spark, sf, "doc"), _opts("doc"))
    rules = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("rule_no"), F.concat(F.lit("Item "), F.col("item_id").cast("string")).alias("name"),
        F.explode(F.regexp_extract_all("text", F.lit(BENCHMARK_PHRASE), 0)).alias("phrase"))
    return first_rule(detail, rules).select("row_id", "Category")


def q_clean_reason_table(spark, sf):
    """The cleaning dictionaries as one table of replacements."""
    opts = _opts("turn")
    v = _view(spark, sf, "turn").select("row_id", T.clean_whitespace(F.coalesce("reason_text", F.lit(""))).alias("text"))
    return fold_phrases(v, "text", "text", ordered_entries(opts.abbreviations, opts.synonyms))


def q_fold_terms(spark, sf):
    """A dictionary of the 10,000 most frequent words: each is replaced by its marked stem."""
    reasons, _, counts, _ = _reasons_tok(spark, sf, "doc")
    top = counts.where(F.col("token").rlike("^[a-z]{4,}$")).orderBy(F.col("n").desc(), "token").limit(FOLDED_TERMS)
    entries = top.select(F.row_number().over(Window.orderBy(F.col("n").desc(), "token")).alias("entry_no"),   # at most FOLDED_TERMS rows
                         F.col("token").alias("phrase"), F.concat(T.stem("token"), F.lit("_")).alias("replacement"))
    return fold_phrases(reasons, "reason", "text", entries).select("row_id", "text")


def q_clean_whitespace(spark, sf):
    return _view(spark, sf, "doc").select("row_id", T.clean_whitespace("reason_text").alias("text"))


def q_expand_abbreviations(spark, sf):
    opts = _opts("doc")
    v = _view(spark, sf, "doc").select("row_id", T.clean_whitespace("reason_text").alias("t"))
    return v.select("row_id", T.expand_abbreviations("t", opts.abbreviations).alias("text"))


def q_normalize_synonyms(spark, sf):
    opts = _opts("doc", abbreviations={})
    v = _view(spark, sf, "doc").select("row_id", T.clean_whitespace("reason_text").alias("text"))
    return T.with_clean_text(v, "text", "text", opts)


def q_clean_reason(spark, sf):
    opts = _opts("turn")
    v = _view(spark, sf, "turn").select("row_id", "reason_text")
    return T.with_clean_text(v, "reason_text", "text", opts).select("row_id", "text")


def q_tokenize(spark, sf):
    opts = _opts("doc")
    t = T.tokenize(F.coalesce(F.col("reason_text"), F.lit("")), opts.stopwords)
    return _view(spark, sf, "doc").select("row_id", F.array_join(t, " ").alias("tokens"),
                                          F.size(t).cast("long").alias("n_tokens"))


def q_ngrams(spark, sf):
    opts = _opts("turn")
    tokens = T.tokenize(F.coalesce(F.col("reason_text"), F.lit("")), opts.stopwords)
    grams = _view(spark, sf, "turn").select("row_id", tokens.alias("t")).select("row_id", T.ngrams("t", 1, 2).alias("g"))
    return grams.select("row_id", F.array_join("g", "|").alias("terms"), F.size("g").cast("long").alias("n_terms"))


def q_stem_words(spark, sf):
    _, tok, counts, _ = _reasons_tok(spark, sf, "doc")
    return counts.select(F.col("token").alias("word"), T.stem("token").alias("stem"))


def q_abbreviation_candidates(spark, sf):
    reasons = explore_reasons(_view(spark, sf, "doc"), _opts("doc"))
    return X.abbreviation_matches(reasons).select("row_id", F.col("pos").cast("long").alias("pos"), "abbr")


# ------------------------------------------------------------------ explore
def q_unigram_counts(spark, sf):
    _, tok, _, _ = _reasons_tok(spark, sf, "turn")
    return X.unigram_counts(tok)


def q_document_frequency(spark, sf):
    _, tok, _, _ = _reasons_tok(spark, sf, "turn")
    return X.document_frequency(tok)


def q_bigram_counts(spark, sf):
    _, tok, _, _ = _reasons_tok(spark, sf, "turn")
    return X.bigram_counts(tok)


def q_word_frequency(spark, sf):
    reasons, _, counts, opts = _reasons_tok(spark, sf, "doc")
    return X.word_frequency(counts, reasons, opts)


def q_abbreviation_report(spark, sf):
    reasons, _, _, opts = _reasons_tok(spark, sf, "doc")
    return X.abbreviation_report(reasons, opts)


def q_stem_groups(spark, sf):
    _, _, counts, opts = _reasons_tok(spark, sf, "doc")
    return X.stem_groups(counts, opts)


def q_top_stems(spark, sf):
    return X.top_stems(q_stem_groups(spark, sf))


def q_collocations(spark, sf):
    _, tok, counts, opts = _reasons_tok(spark, sf, "doc")
    return X.collocations(tok, counts, opts)


def q_top_phrases(spark, sf):
    return X.top_phrases(q_collocations(spark, sf))


def q_context_similarity(spark, sf):
    _, tok, counts, opts = _reasons_tok(spark, sf, "doc")
    return X.context_similarity(tok, counts, opts)


def q_top_context_pairs(spark, sf):
    _, tok, counts, opts = _reasons_tok(spark, sf, "doc")
    return X.top_context_pairs(X.context_similarity(tok, counts, opts, keep_rank=True))


def q_similar_words(spark, sf):
    """Context similarity over the whole vocabulary."""
    _, tok, counts, _ = _reasons_tok(spark, sf, "turn")
    return X.similar_words(tok, counts)


def q_word_frequency_order(spark, sf):
    reasons, _, counts, opts = _reasons_tok(spark, sf, "order")
    return X.word_frequency(counts, reasons, opts)


def q_abbreviation_report_order(spark, sf):
    reasons, _, _, opts = _reasons_tok(spark, sf, "order")
    return X.abbreviation_report(reasons, opts)


def q_collocations_turn(spark, sf):
    _, tok, counts, opts = _reasons_tok(spark, sf, "turn")
    return X.collocations(tok, counts, opts)


# ------------------------------------------------------------------ reports (rules only)
def q_group_summary(spark, sf):
    d, opts = _detail_rules(spark, sf, "order")
    return R.group_summary(d, opts)


def q_group_summary_doc(spark, sf):
    d, opts = _detail_rules(spark, sf, "doc")
    return R.group_summary(d, opts)


def q_group_summary_refreshed(spark, sf):
    """The summary from the stored states of two batches (odd and even row ids)."""
    d, opts = _detail_rules(spark, sf, "order")
    folder = f"{ensure_checkpoint_dir(spark)}/summary-{uuid.uuid4().hex}"
    for batch in (0, 1):
        write_state(summary_state(d.where(F.col("row_id") % 2 == batch), opts), folder, str(batch))
    return summary_of_state(read_state(spark, folder), opts)


def q_summary_entity_ids(spark, sf):
    d, opts = _detail_rules(spark, sf, "turn")
    out, _ = R.first_n_distinct(d, ["Category"], "EntityId", opts.max_entity_ids, ", ", "EntityIds")
    return out


def q_summary_samples(spark, sf):
    d, opts = _detail_rules(spark, sf, "turn")
    return R.sample_texts(d, ["Category"], opts.max_sample_reasons, "SampleReasons", len(opts.priority_groups) + 1)


def q_summary_keywords(spark, sf):
    d, opts = _detail_rules(spark, sf, "turn")
    return R.top_tokens(d, ["Category"], opts.summary_keywords, "TopKeywords", opts)


def q_entity_rollup(spark, sf):
    d, opts = _detail_rules(spark, sf, "order")
    return R.entity_rollup(d, opts)


def q_entity_rollup_turn(spark, sf):
    d, opts = _detail_rules(spark, sf, "turn")
    return R.entity_rollup(d, opts)


def q_entity_rollup_doc(spark, sf):
    d, opts = _detail_rules(spark, sf, "doc")
    return R.entity_rollup(d, opts)


def q_detail_report(spark, sf):
    d, _ = _detail_rules(spark, sf, "order")
    return R.detail_report(d)


def q_priority_counts(spark, sf):
    opts = _opts("order")
    return priority_counts(rule_categorized(_view(spark, sf, "order"), opts))


def q_run_totals(spark, sf):
    d, _ = _detail_rules(spark, sf, "order")
    return R.run_totals(d)


# ------------------------------------------------------------------ features
def _unmatched_terms(spark, sf, view, **kw):
    opts = _opts(view, **kw)
    ruled = rule_categorized(_view(spark, sf, view), opts)
    return FT.term_arrays(ruled.where(F.col("Category").isNull()), opts), opts


def q_tfidf_vocab(spark, sf):
    terms, opts = _unmatched_terms(spark, sf, "turn")
    return FT.vocabulary_table(terms, opts).select("term", "df", F.col("idx").cast("long").alias("idx"))


def q_tfidf_weights(spark, sf):
    terms, opts = _unmatched_terms(spark, sf, "turn")
    w = FT.tfidf_long(terms, opts)
    return w.select("row_id", "term", T.rint_round("weight", 6).alias("weight"))


def q_tfidf_vectors(spark, sf):
    """The MLlib vector path (CountVectorizerModel -> idf -> L2 norm) as a
    long table, checked against the same weights as ``tfidf_weights``."""
    from pyspark.ml.functions import vector_to_array
    terms, opts = _unmatched_terms(spark, sf, "turn")
    vocab = FT.build_vocabulary(terms, opts)
    vec = FT.tfidf_features(terms, vocab, opts)
    terms_arr = F.array(*[F.lit(t) for t in vocab.terms])     # <= max_features literals
    x = vec.select("row_id", F.posexplode(vector_to_array("features")).alias("i", "w")).where(F.col("w") != 0)
    return x.select("row_id", F.element_at(terms_arr, F.col("i") + 1).alias("term"),
                    T.rint_round("w", 6).alias("weight"))


def q_tfidf_sublinear(spark, sf):
    terms, opts = _unmatched_terms(spark, sf, "turn", tfidf_profile="sublinear")
    w = FT.tfidf_long(terms, opts)
    return w.select("row_id", "term", T.rint_round("weight", 6).alias("weight"))


def _role_centers(spark, sf):
    """Centers = mean TF-IDF weight per speaker role."""
    terms, opts = _unmatched_terms(spark, sf, "turn", only_override_rows=False)
    w = FT.tfidf_long(terms, opts)
    role = _view(spark, sf, "turn").select("row_id", F.col("actual_rating").alias("cluster"))
    n = role.join(terms.select("row_id"), "row_id").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    centers = (w.join(role, "row_id").groupBy("cluster", "term").agg(F.sum("weight").alias("s"))
               .join(n, "cluster").select("cluster", "term", T.rint_round(F.col("s") / F.col("n"), 9).alias("weight")))
    return terms, w, centers, opts


def q_cluster_labels(spark, sf):
    _, _, centers, opts = _role_centers(spark, sf)
    return C.center_labels(centers, opts.top_keywords_per_cluster)


def q_kmeans_assign_sparse(spark, sf):
    """Every unmatched row's nearest role center, over the long tables."""
    terms, w, centers, _ = _role_centers(spark, sf)
    out = C.assign_sparse(terms, w, centers)
    return out.select("row_id", "cluster", T.rint_round("dist2", 6).alias("dist2"))


# ------------------------------------------------------------------ clustering on embeddings
def _emb(spark, sf):
    return table(spark, sf, "embeddings")


def _first_centers(emb, k=FIXED_K):
    rows = emb.orderBy("vec_id").limit(k).select("embedding").collect()     # k rows
    return [[float(x) for x in r["embedding"]] for r in rows]


def q_kmeans_assign(spark, sf):
    emb = _emb(spark, sf)
    out = C.assign_nearest(emb, "embedding", _first_centers(emb))
    return out.select("vec_id", F.col("cluster").cast("long").alias("cluster"), T.rint_round("dist2", 6).alias("dist2"))


def q_kmeans_lloyd(spark, sf):
    emb = _emb(spark, sf)
    centers, _ = C.lloyd(emb, "embedding", _first_centers(emb), LLOYD_STEPS, atol=-1.0)
    out = C.assign_nearest(emb, "embedding", centers)
    return out.select("vec_id", F.col("cluster").cast("long").alias("cluster"), T.rint_round("dist2", 6).alias("dist2"))


def q_kmeans_inertia(spark, sf):
    emb = _emb(spark, sf)
    return C.inertia(emb, "embedding", _first_centers(emb)).select(T.rint_round("inertia", 6).alias("inertia"))


def q_silhouette(spark, sf):
    return C.silhouette(_emb(spark, sf), "embedding", "label").select(T.rint_round("silhouette", 6).alias("silhouette"))


def q_kmeans_fit(spark, sf):
    from pyspark.ml.functions import array_to_vector
    emb = materialize(_emb(spark, sf).select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features")))
    model = C.fit_kmeans(emb, 10)
    return model.transform(emb).select("vec_id", F.col("_cluster").cast("long").alias("cluster"))


def q_choose_k(spark, sf):
    from pyspark.ml.functions import array_to_vector
    emb = materialize(_emb(spark, sf).select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features")))
    n = emb.count()
    k, _ = C.choose_k(emb, n, "features", 3, 8)
    return literal_table(emb.sparkSession, [(k,)], "k long")


# ------------------------------------------------------------------ full hybrid
def q_categorize(spark, sf):
    detail, _ = categorize(_view(spark, sf, "order"), _opts("order"))
    return R.detail_report(detail, ordered=False)


def q_categorize_sublinear(spark, sf):
    detail, _ = categorize(_view(spark, sf, "turn"), _opts("turn", tfidf_profile="sublinear"))
    return R.detail_report(detail, ordered=False)


def q_cluster_sizes(spark, sf):
    detail, _ = categorize(_view(spark, sf, "order"), _opts("order"))
    return R.cluster_sizes(detail)


def q_group_summary_hybrid(spark, sf):
    detail, _ = categorize(_view(spark, sf, "order"), _opts("order"))
    return R.group_summary(detail, _opts("order"))


QUERIES = {name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_") and callable(fn)}


# ------------------------------------------------------------------ oracle SQL
def oracle_sql() -> dict[str, str]:
    o, d, t = _opts("order"), _opts("doc"), _opts("turn")
    ro, rd, rt = _rules_only("order"), _rules_only("doc"), _rules_only("turn")
    sql = {}
    sql["load_comments"] = O.VIEW_SQL["order"]
    sql["project_by_position"] = ("SELECT row_id, " + ", ".join(
        f"{c} AS {c}" for c in COMMENT_COLUMNS[1:]) + f" FROM ({O.VIEW_SQL['turn']})")
    sql["project_by_header"] = sql["project_by_position"].replace(O.VIEW_SQL["turn"], O.VIEW_SQL["doc"])
    sql["explore_reasons"] = "WITH " + O.reasons_cte("doc", d) + " SELECT row_id, reason FROM r"
    sql["prepare_comments"] = "WITH " + O.prepared_cte("doc", d) + " SELECT * FROM detail"
    sql["coerce_notch"] = (f"SELECT row_id, notch_difference, {O.notch('notch_difference')} AS NotchDifference "
                           f"FROM ({O.VIEW_SQL['order']})")
    sql["flag_filter"] = (f"SELECT * FROM (SELECT row_id, {O.flag('override_flag')} AS OverrideFlag "
                          f"FROM ({O.VIEW_SQL['order']})) WHERE OverrideFlag IN {O.yes_list(o)}")
    sql["min_length_filter"] = ("WITH " + O.prepared_cte("turn", t.with_(only_override_rows=False))
                                + " SELECT row_id, ReasonText FROM detail")
    sql["priority_match"] = ("WITH " + O.prepared_cte("doc", d)
                             + f" SELECT row_id, {O.rule_case('ReasonText', d)} AS Category FROM detail")
    sql["priority_match_table"] = O.table_rules_sql("doc", d, BENCHMARK_PHRASE)
    sql["clean_reason_table"] = f"SELECT row_id, {O.clean_reason('reason_text', t)} AS text FROM ({O.VIEW_SQL['turn']})"
    sql["fold_terms"] = O.fold_terms_sql("doc", d, FOLDED_TERMS)
    sql["clean_whitespace"] = f"SELECT row_id, {O.ws_clean('reason_text')} AS text FROM ({O.VIEW_SQL['doc']})"
    sql["expand_abbreviations"] = (f"SELECT row_id, {O.expand_abbreviations(O.ws_clean('reason_text'), d)} AS text "
                                   f"FROM ({O.VIEW_SQL['doc']})")
    sql["normalize_synonyms"] = (f"SELECT row_id, {O.clean_reason('reason_text', d.with_(abbreviations={}))} AS text "
                                 f"FROM ({O.VIEW_SQL['doc']})")
    sql["clean_reason"] = f"SELECT row_id, {O.clean_reason('reason_text', t)} AS text FROM ({O.VIEW_SQL['turn']})"
    tk = O.tokens("coalesce(reason_text, '')", d)
    sql["tokenize"] = (f"SELECT row_id, array_to_string({tk}, ' ') AS tokens, CAST(len({tk}) AS BIGINT) AS n_tokens "
                       f"FROM ({O.VIEW_SQL['doc']})")
    tt = O.tokens("coalesce(reason_text, '')", t)
    bi = f"list_transform(generate_series(1, len(tk) - 1), lambda i: tk[i] || ' ' || tk[i + 1])"
    sql["ngrams"] = (f"SELECT row_id, array_to_string(list_concat(tk, {bi}), '|') AS terms, "
                     f"CAST(len(tk) + greatest(len(tk) - 1, 0) AS BIGINT) AS n_terms "
                     f"FROM (SELECT row_id, {tt} AS tk FROM ({O.VIEW_SQL['turn']}))")
    sql["stem_words"] = "WITH " + O.reasons_cte("doc", d) + f" SELECT token AS word, {O.stem_sql('token')} AS stem FROM wc"
    pat = f"(?:^|{O.MARK})([A-Z]{{2,6}})(?:[^{O.W}{O.MARK}]|$)"
    sql["abbreviation_candidates"] = ("WITH " + O.reasons_cte("doc", d) + f""",
ml AS (SELECT row_id, regexp_extract_all({O.mark('reason')}, {O.q(pat)}, 1) AS l FROM r)
SELECT row_id, CAST(unnest(generate_series(0, len(l) - 1)) AS BIGINT) AS pos, unnest(l) AS abbr FROM ml""")
    sql["unigram_counts"] = "WITH " + O.reasons_cte("turn", t) + " SELECT token, n AS Count FROM wc"
    sql["document_frequency"] = "WITH " + O.reasons_cte("turn", t) + " SELECT token, df AS DocFreq FROM wc"
    sql["bigram_counts"] = "WITH " + O.reasons_cte("turn", t) + ",\n" + O.bigram_cte() + " SELECT * FROM bc"
    sql["word_frequency"] = O.word_frequency_sql("doc", d)
    sql["abbreviation_report"] = O.abbreviation_sql("doc", d)
    sql["stem_groups"] = O.stem_groups_sql("doc", d)
    sql["top_stems"] = O.stem_groups_sql("doc", d, top=15)
    sql["collocations"] = O.collocations_sql("doc", d)
    sql["top_phrases"] = O.collocations_sql("doc", d, view_top=20)
    sql["context_similarity"] = O.context_sql("doc", d)
    sql["top_context_pairs"] = O.context_sql("doc", d, view_top=20)
    sql["similar_words"] = O.similar_words_sql("turn", t)
    sql["word_frequency_order"] = O.word_frequency_sql("order", o)
    sql["collocations_turn"] = O.collocations_sql("turn", t)
    sql["abbreviation_report_order"] = O.abbreviation_sql("order", o)
    sql["group_summary"] = "WITH " + O.ruled_cte("order", ro) + O.summary_select(ro)
    sql["group_summary_doc"] = "WITH " + O.ruled_cte("doc", rd) + O.summary_select(rd)
    sql["group_summary_refreshed"] = sql["group_summary"]
    sql["summary_entity_ids"] = ("WITH " + O.ruled_cte("turn", rt) + ",\n"
                                 + O.first_n_sql("ents", "cat", ["Category"], "EntityId", rt.max_entity_ids, ", ", "EntityIds")
                                 + " SELECT * FROM ents")
    sql["summary_samples"] = ("WITH " + O.ruled_cte("turn", rt) + ",\n"
                              + O.first_n_sql("samp", "cat", ["Category"], "ReasonText", rt.max_sample_reasons, " | ",
                                              "SampleReasons") + " SELECT * FROM samp")
    sql["summary_keywords"] = ("WITH " + O.ruled_cte("turn", rt) + ",\n"
                               + O.top_tokens_sql("kw", "cat", ["Category"], rt.summary_keywords, "TopKeywords", rt)
                               + " SELECT * FROM kw")
    sql["entity_rollup"] = O.rollup_sql("order", ro)
    sql["entity_rollup_turn"] = O.rollup_sql("turn", rt)
    sql["entity_rollup_doc"] = O.rollup_sql("doc", rd)
    sql["detail_report"] = ("WITH " + O.ruled_cte("order", ro) + " SELECT row_id, BorrowerName, EntityId, ActualRating, "
                            "ModelRating, NotchDifference, OverrideFlag, ReasonText, Category FROM cat")
    sql["priority_counts"] = ("WITH " + O.prepared_cte("order", o) + f""",
pc AS (SELECT {O.rule_case('ReasonText', o)} AS Category FROM detail)
SELECT Category, count(*) AS Count FROM pc WHERE Category IS NOT NULL GROUP BY Category""")
    sql["run_totals"] = ("WITH " + O.ruled_cte("order", ro)
                         + " SELECT count(*) AS RowsAnalysed, count(DISTINCT Category) AS GroupsFound FROM cat")
    sql["tfidf_vocab"] = O.tfidf_sql("turn", t, "vocab")
    sql["tfidf_weights"] = O.tfidf_sql("turn", t, "weights")
    sql["tfidf_sublinear"] = O.tfidf_sql("turn", t.with_(tfidf_profile="sublinear"), "weights")
    sql["tfidf_vectors"] = O.tfidf_sql("turn", t, "weights")
    sql["cluster_labels"] = O.tfidf_sql("turn", t.with_(only_override_rows=False), "labels")
    sql["kmeans_assign_sparse"] = O.tfidf_sql("turn", t.with_(only_override_rows=False), "nearest")
    sql["kmeans_assign"] = O.kmeans_sql(FIXED_K, 0, "assign")
    sql["kmeans_lloyd"] = O.kmeans_sql(FIXED_K, LLOYD_STEPS, "assign")
    sql["kmeans_inertia"] = O.kmeans_sql(FIXED_K, 0, "inertia")
    sql["silhouette"] = O.silhouette_sql()
    sql["kmeans_fit"] = O.kmeans_fit_sql(10, Options())
    sql["choose_k"] = O.choose_k_sql(3, 8, Options())
    columns = ("SELECT row_id, BorrowerName, EntityId, ActualRating, ModelRating, NotchDifference, OverrideFlag, "
               "ReasonText, Category FROM cat")
    sql["categorize"] = f"{O.hybrid_cte('order', o)}\n{columns}"
    sql["categorize_sublinear"] = f"{O.hybrid_cte('turn', t.with_(tfidf_profile='sublinear'))}\n{columns}"
    sql["cluster_sizes"] = (O.hybrid_cte("order", o) + "\nSELECT Category, count(*) AS Count FROM cat "
                            "WHERE Category LIKE 'Auto Group %' GROUP BY Category")
    sql["group_summary_hybrid"] = O.hybrid_cte("order", o) + O.summary_select(o)
    return sql
