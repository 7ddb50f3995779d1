"""DuckDB SQL for the correctness gate, generated from the same Options.

Each function returns SQL text over the pre-registered test tables. The SQL
re-states every operator independently of the Spark code (regexes with RE2
syntax, window functions, list lambdas), so agreement between the two is a
real check. Word boundaries are written as explicit classes because RE2's
``\\b`` is ASCII-only; whole-word replacement uses a marker character after
every non-word character so that adjacent matches do not share a consumed
separator.
"""

from __future__ import annotations

from reasonscope import defaults as D
from reasonscope.functions.regex import escape_literal, is_word_char, space_class
from reasonscope.options import Options

W = r"\p{L}\p{N}_"
MARK = "﷐"          # a noncharacter; never part of the test texts
S = space_class()


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------- views
VIEW_SQL = {
    "order": """
SELECT o_orderkey AS row_id, c_name AS borrower_name,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS entity_id,
       o_orderpriority AS actual_rating, c_mktsegment AS model_rating,
       CASE WHEN o_orderkey % 7 = 0 THEN 'n/a'
            ELSE CAST(CAST(substr(o_orderpriority, 1, 1) AS INT) - 3 AS VARCHAR) END AS notch_difference,
       CASE o_orderstatus WHEN 'F' THEN ' y ' WHEN 'P' THEN 'Yes' ELSE 'N' END AS override_flag,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL
            ELSE concat(o_orderpriority, '  order for ', lower(c_mktsegment), ' client, status ', o_orderstatus) END AS reason_text
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "doc": """
SELECT d.doc_id AS row_id, concat(d.source, '/', d.lang) AS borrower_name, d.source AS entity_id,
       CAST(l.quality AS VARCHAR) AS actual_rating, CAST(l.toxic AS VARCHAR) AS model_rating,
       CAST(l.quality - 2 * l.toxic AS VARCHAR) AS notch_difference,
       CASE WHEN l.quality = 1 THEN 'Y' WHEN l.quality = 0 THEN 'n' END AS override_flag, d.text AS reason_text
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "turn": """
SELECT conv_id * 1000 + turn AS row_id, concat('conversation ', CAST(conv_id AS VARCHAR)) AS borrower_name,
       CAST(conv_id AS VARCHAR) AS entity_id, role AS actual_rating, role AS model_rating,
       CAST(turn - 3 AS VARCHAR) AS notch_difference,
       CASE role WHEN 'user' THEN 'Y' ELSE 'N' END AS override_flag, text AS reason_text
FROM conversations""",
}


# ---------------------------------------------------------------- scalar pieces
def strip(e: str) -> str:
    return f"regexp_replace({e}, {q('^' + S + '+|' + S + '+$')}, '', 'g')"


def ws_clean(e: str) -> str:
    return f"regexp_replace({strip(e)}, {q(S + '+')}, ' ', 'g')"


def rint(e: str, digits: int) -> str:
    scale = 10 ** digits
    return f"(round_even(CAST({e} AS DOUBLE) * CAST({scale} AS DOUBLE), 0) / CAST({scale} AS DOUBLE))"


def pyround(e: str, digits: int) -> str:
    """Python round() on a double (exact half-even), same formula as Spark's."""
    s = f"CAST({10 ** digits} AS DOUBLE)"
    k = "CAST(134217729.0 AS DOUBLE)"
    x = f"CAST({e} AS DOUBLE)"
    return f"""(SELECT CASE WHEN p = f + 0.5 AND e > 0 THEN f + 1 WHEN p = f + 0.5 AND e < 0 THEN f
                      ELSE round_even(p, 0) END / s FROM (
   SELECT p, floor(p) AS f, ((xh * sh - p) + xh * sl + xl * sh) + xl * sl AS e, s FROM (
     SELECT x * s AS p, xh, x - xh AS xl, sh, s - sh AS sl, s FROM (
       SELECT x, s, ({k} * x) - (({k} * x) - x) AS xh, ({k} * s) - (({k} * s) - s) AS sh FROM (
         SELECT {x} AS x, {s} AS s)))))"""


def _marked(text: str) -> str:
    return "".join(ch + (MARK if not is_word_char(ch) else "") for ch in text)


def _check_word_edges(phrase: str) -> None:
    if not (is_word_char(phrase[0]) and is_word_char(phrase[-1])):
        raise NotImplementedError("oracle supports phrases that start and end with a word character")


def detect(e: str, phrases) -> str:
    """Any phrase found as a whole word, case-insensitive."""
    for p in phrases:
        _check_word_edges(p)
    alts = "|".join(escape_literal(p) for p in phrases)
    pat = f"(?i)(^|[^{W}])(?:{alts})([^{W}]|$)"
    return f"regexp_matches({e}, {q(pat)})"


def mark(e: str) -> str:
    return f"regexp_replace({e}, {q('([^' + W + '])')}, {q(chr(92) + '1' + MARK)}, 'g')"


def unmark(e: str) -> str:
    return f"replace({e}, {q(MARK)}, '')"


def replace_word(e_marked: str, phrase: str, repl: str) -> str:
    """Whole-word, case-insensitive, literal replacement on marked text."""
    _check_word_edges(phrase)
    pat = f"(?i)(^|{MARK})" + escape_literal(_marked(phrase)) + f"([^{W}{MARK}]|$)"
    rep = _marked(repl).replace("\\", "\\\\")
    return f"regexp_replace({e_marked}, {q(pat)}, {q(chr(92) + '1' + rep + chr(92) + '2')}, 'g')"


def expand_abbreviations(e: str, opts: Options) -> str:
    m = mark(e)
    for abbr, full in opts.abbreviations:
        m = replace_word(m, abbr, full)
    return unmark(m)


def normalize_synonyms(e: str, opts: Options) -> str:
    m = mark(e)
    for canonical, phrases in opts.synonyms:
        for p in sorted([p for p in phrases if p], key=len, reverse=True):
            m = replace_word(m, p, canonical)
    return unmark(m)


def clean_reason(e: str, opts: Options) -> str:
    m = mark(ws_clean(f"coalesce({e}, '')"))
    for abbr, full in opts.abbreviations:
        m = replace_word(m, abbr, full)
    for canonical, phrases in opts.synonyms:
        for p in sorted([p for p in phrases if p], key=len, reverse=True):
            m = replace_word(m, p, canonical)
    return unmark(m)


def tokens(e: str, opts: Options) -> str:
    stop = "[" + ", ".join(q(w) for w in opts.stopwords) + "]"
    return (f"list_filter(regexp_extract_all(lower({e}), {q(D.TOKEN_PATTERN)}), "
            f"lambda t: NOT list_contains({stop}, t) AND length(t) > 2)")


def raw_token_set(e: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({e}), {q(D.TOKEN_PATTERN)}))"


NUMBER = (r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
          r"|(?i:inf|infinity|nan))$")


def notch(e: str) -> str:
    t = f"regexp_replace({e}, '^[ \\t\\n\\x0b\\x0c\\r]*|[ \\t\\n\\x0b\\x0c\\r]*$', '', 'g')"
    v = f"(CASE WHEN regexp_full_match({t}, {q(NUMBER)}) THEN TRY_CAST({t} AS DOUBLE) END)"
    return f"(CASE WHEN isnan({v}) THEN NULL ELSE {v} END)"


def flag(e: str) -> str:
    return f"upper({strip(f'coalesce(CAST({e} AS VARCHAR), {q(chr(110) + chr(97) + chr(110))})')})"


def rule_case(e: str, opts: Options) -> str:
    whens = " ".join(f"WHEN {detect(e, list(ph))} THEN {q(name)}" for name, ph in opts.priority_groups if ph)
    return f"(CASE {whens} END)" if whens else "CAST(NULL AS VARCHAR)"


def yes_list(opts: Options) -> str:
    return "(" + ", ".join(q(v) for v in opts.override_yes_values) + ")"


# ---------------------------------------------------------------- CTE builders
def prepared_cte(view: str, opts: Options, clean: bool = True) -> str:
    """CTEs ``src``, ``prep`` and ``detail`` (filtered, cleaned)."""
    text = clean_reason("reason_text", opts) if clean else ws_clean("coalesce(reason_text, '')")
    flag_filter = f"OverrideFlag IN {yes_list(opts)}" if opts.only_override_rows else "TRUE"
    return f"""src AS ({VIEW_SQL[view]}),
prep AS (
  SELECT row_id, borrower_name AS BorrowerName, CAST(entity_id AS VARCHAR) AS EntityId,
         actual_rating AS ActualRating, model_rating AS ModelRating,
         {notch('notch_difference')} AS NotchDifference,
         {flag('override_flag')} AS OverrideFlag,
         {text} AS ReasonText
  FROM src),
detail AS (SELECT * FROM prep WHERE {flag_filter} AND length(ReasonText) >= {opts.min_reason_length})"""


def ruled_cte(view: str, opts: Options) -> str:
    """Adds ``cat``: detail with a Category (rules; unmatched -> label)."""
    return prepared_cte(view, opts) + f""",
cat AS (SELECT *, coalesce({rule_case('ReasonText', opts)}, {q(opts.unmatched_label)}) AS Category FROM detail)"""


def first_n_sql(name: str, src: str, keys: list[str], value: str, n: int, sep: str, out: str) -> str:
    k = ", ".join(keys)
    return f"""{name}_f AS (SELECT {k}, {value}, min(row_id) AS f FROM {src} WHERE {value} IS NOT NULL GROUP BY {k}, {value}),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY f, {value}) AS rn FROM {name}_f),
{name} AS (SELECT {k}, string_agg({value}, {q(sep)} ORDER BY rn) AS {out} FROM {name}_r WHERE rn <= {n} GROUP BY {k})"""


def top_tokens_sql(name: str, src: str, keys: list[str], n: int, out: str, opts: Options,
                   text: str = "ReasonText") -> str:
    k = ", ".join(keys)
    return f"""{name}_t AS (SELECT {k}, row_id, {tokens(text, opts)} AS toks FROM {src}),
{name}_x AS (SELECT {k}, row_id, unnest(toks) AS token, unnest(generate_series(0, len(toks) - 1)) AS pos FROM {name}_t),
{name}_c AS (SELECT {k}, token, count(*) AS n, min(row_id * 1000000 + pos) AS f FROM {name}_x GROUP BY {k}, token),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY n DESC, f) AS rn FROM {name}_c),
{name} AS (SELECT {k}, string_agg(token, ', ' ORDER BY rn) AS {out} FROM {name}_r WHERE rn <= {n} GROUP BY {k})"""


def summary_select(opts: Options, src: str = "cat") -> str:
    return f""",
{first_n_sql('ents', src, ['Category'], 'EntityId', opts.max_entity_ids, D.ENTITY_SEPARATOR, 'EntityIds')},
uniq AS (SELECT Category, count(*) AS UniqueBorrowers FROM ents_f GROUP BY Category),
{first_n_sql('samp', src, ['Category'], 'ReasonText', opts.max_sample_reasons, D.SAMPLE_SEPARATOR, 'SampleReasons')},
{top_tokens_sql('kw', src, ['Category'], opts.summary_keywords, 'TopKeywords', opts)},
stats AS (SELECT Category, count(*) AS Count, {rint('avg(NotchDifference)', 2)} AS AvgNotchDiff,
                 {rint('median(NotchDifference)', 2)} AS MedianNotchDiff,
                 min(NotchDifference) AS MinNotchDiff, max(NotchDifference) AS MaxNotchDiff
          FROM {src} GROUP BY Category)
SELECT s.Category, s.Count, coalesce(u.UniqueBorrowers, 0) AS UniqueBorrowers, s.AvgNotchDiff, s.MedianNotchDiff,
       s.MinNotchDiff, s.MaxNotchDiff, coalesce(e.EntityIds, '') AS EntityIds,
       coalesce(k.TopKeywords, '') AS TopKeywords, coalesce(m.SampleReasons, '') AS SampleReasons
FROM stats s LEFT JOIN uniq u USING (Category) LEFT JOIN ents e USING (Category)
     LEFT JOIN kw k USING (Category) LEFT JOIN samp m USING (Category)"""


# ---------------------------------------------------------------- explore
def reasons_cte(view: str, opts: Options) -> str:
    flag_filter = f"flag IN {yes_list(opts)}" if opts.only_override_rows else "TRUE"
    return f"""src AS ({VIEW_SQL[view]}),
rs AS (SELECT row_id, {strip("coalesce(CAST(reason_text AS VARCHAR), '')")} AS reason, {flag('override_flag')} AS flag FROM src),
r AS (SELECT row_id, reason FROM rs WHERE length(reason) >= {opts.min_reason_length} AND {flag_filter}),
tok AS (SELECT row_id, {tokens('reason', opts)} AS tokens FROM r),
occ AS (SELECT row_id, unnest(tokens) AS token, unnest(generate_series(0, len(tokens) - 1)) AS pos FROM tok),
wc AS (SELECT token, count(*) AS n, count(DISTINCT row_id) AS df, min(row_id * 1000000 + pos) AS f FROM occ GROUP BY token)"""


def _in(col: str, values) -> str:
    values = list(values)
    return f"{col} IN (" + ", ".join(q(v) for v in values) + ")" if values else "FALSE"


def word_frequency_sql(view: str, opts: Options) -> str:
    return "WITH " + reasons_cte(view, opts) + f""",
top AS (SELECT * FROM wc ORDER BY n DESC, f LIMIT {opts.word_frequency_rows}),
tot AS (SELECT CAST(count(*) AS DOUBLE) AS total FROM r)
SELECT token AS Word, n AS TotalOccurrences, df AS InNReasons,
       {pyround('df / total * 100', 1)} AS PctOfReasons,
       CASE WHEN {_in('token', opts.stopwords)} THEN 'YES' ELSE '' END AS AlreadyInStopwords,
       CASE WHEN df / total > CAST(0.4 AS DOUBLE) AND NOT ({_in('token', opts.stopwords)})
            THEN {q(D.SUGGEST_STOPWORD)} ELSE '' END AS Suggestion
FROM top, tot WHERE length(token) >= 3"""


def table_rules_sql(view: str, opts: Options, phrase: str) -> str:
    """First rule (by number) of the benchmark's phrases in each detail row: adjacent runs of
    word characters of a text, with what stands between them, are looked up by phrase."""
    return "WITH " + prepared_cte(view, opts) + f""",
texts AS MATERIALIZED (SELECT row_id, ReasonText FROM detail),
rules AS (SELECT lower(phrase) AS phrase, min(item_id) AS rule_no FROM
  (SELECT item_id, unnest(regexp_extract_all(text, {q(phrase)})) AS phrase FROM benchmark) GROUP BY lower(phrase)),
runs AS (SELECT row_id, regexp_extract_all(lower(ReasonText), {q(f'[{W}]+|[^{W}]+')}) AS l FROM texts),
met AS (SELECT row_id, min(rule_no) AS rule_no FROM
  (SELECT row_id, unnest(list_transform(generate_series(1, len(l) - 2), lambda i: l[i] || l[i + 1] || l[i + 2])) AS phrase FROM runs)
  JOIN rules USING (phrase) GROUP BY row_id)
SELECT row_id, 'Item ' || rule_no AS Category FROM texts LEFT JOIN met USING (row_id)"""


def fold_terms_sql(view: str, opts: Options, n: int) -> str:
    """Runs of word characters replaced one by one (no replacement is a word of the dictionary)."""
    return "WITH " + reasons_cte(view, opts) + f""",
dict AS (SELECT token, {stem_sql('token')} || '_' AS new FROM wc WHERE regexp_full_match(token, '[a-z]{{4,}}') ORDER BY n DESC, token LIMIT {n}),
runs AS (SELECT row_id, regexp_extract_all(reason, {q(f'[{W}]+|[^{W}]+')}) AS l FROM r),
each AS (SELECT row_id, unnest(l) AS run, unnest(generate_series(1, len(l))) AS i FROM runs)
SELECT row_id, string_agg(coalesce(new, run), '' ORDER BY i) AS text FROM each LEFT JOIN dict ON token = lower(run) GROUP BY row_id"""


def abbreviation_sql(view: str, opts: Options) -> str:
    pat = f"(?:^|{MARK})([A-Z]{{2,6}})(?:[^{W}{MARK}]|$)"
    abbrs = opts.abbreviation_map
    known = sorted({a.upper() for a in abbrs})
    meaning = "CASE abbr " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in abbrs.items()) + " ELSE '' END" \
        if abbrs else "''"
    return "WITH " + reasons_cte(view, opts) + f""",
ml AS (SELECT row_id, reason AS text, regexp_extract_all({mark('reason')}, {q(pat)}, 1) AS l FROM r),
m AS (SELECT row_id, text, unnest(l) AS abbr, unnest(generate_series(0, len(l) - 1)) AS pos FROM ml),
rk AS (SELECT *, row_number() OVER (PARTITION BY abbr ORDER BY row_id, pos) AS rn FROM m),
g AS (SELECT abbr, count(*) AS ExampleCount, min(row_id * 1000000 + pos) AS f,
             max(CASE WHEN rn = 1 THEN text END) AS e1, max(CASE WHEN rn = 2 THEN text END) AS e2,
             max(CASE WHEN rn = 3 THEN text END) AS e3
      FROM rk WHERE rn <= {opts.abbreviation_examples} GROUP BY abbr)
SELECT abbr AS Abbreviation, ExampleCount,
       CASE WHEN {_in('abbr', known)} THEN 'YES' ELSE '' END AS AlreadyDefined,
       {meaning} AS CurrentMeaning, '' AS YourMeaning,
       coalesce(e1, '') AS Example1, coalesce(e2, '') AS Example2, coalesce(e3, '') AS Example3
FROM g"""


def stem_sql(e: str) -> str:
    whens = " ".join(
        f"WHEN ends_with({e}, {q(s)}) AND length({e}) - {len(s)} >= {D.STEM_MIN_ROOT} "
        f"THEN left({e}, length({e}) - {len(s)})" for s in D.STEM_SUFFIXES)
    return f"(CASE {whens} ELSE {e} END)"


def stem_groups_sql(view: str, opts: Options, top: int | None = None) -> str:
    rep = "CASE WHEN contains(token, '''') THEN '\"' || token || '\"' ELSE '''' || token || '''' END"
    limit = f" ORDER BY TotalFrequency DESC, StemRoot LIMIT {top}" if top else ""
    return "WITH " + reasons_cte(view, opts) + f""",
s AS (SELECT token, n, {stem_sql('token')} AS stem, {_in('token', opts.synonym_phrases)} AS syn FROM wc),
g AS (SELECT stem, count(*) AS VariantCount, CAST(sum(n) AS BIGINT) AS TotalFrequency,
             string_agg(token, ', ' ORDER BY n DESC, token) AS Variants,
             string_agg({rep}, ', ' ORDER BY n DESC, token) AS qv, bool_or(syn) AS syn
      FROM s GROUP BY stem HAVING count(*) >= {opts.stem_min_variants})
SELECT stem AS StemRoot, Variants, VariantCount, TotalFrequency,
       CASE WHEN syn THEN 'YES' ELSE '' END AS AlreadyInSynonyms,
       'Add to SYNONYMS: "' || stem || '": [' || qv || ']' AS Suggestion
FROM g{limit}"""


def bigram_cte() -> str:
    return """big AS (SELECT unnest(list_transform(generate_series(1, len(tokens) - 1), lambda i: tokens[i])) AS w1,
                    unnest(list_transform(generate_series(1, len(tokens) - 1), lambda i: tokens[i + 1])) AS w2
             FROM tok),
bc AS (SELECT w1, w2, count(*) AS Count FROM big GROUP BY w1, w2)"""


def collocations_sql(view: str, opts: Options, view_top: int | None = None) -> str:
    tail = (f"\nSELECT * FROM co WHERE PMI_Score > CAST(3.0 AS DOUBLE) ORDER BY PMI_Score DESC, Count DESC, Phrase "
            f"LIMIT {view_top}") if view_top else "\nSELECT * FROM co"
    return "WITH " + reasons_cte(view, opts) + ",\n" + bigram_cte() + f""",
tot AS (SELECT CAST(sum(len(tokens)) AS DOUBLE) AS total FROM tok),
j AS (SELECT b.w1, b.w2, b.Count, u1.n AS n1, u2.n AS n2, total
      FROM bc b JOIN wc u1 ON b.w1 = u1.token JOIN wc u2 ON b.w2 = u2.token, tot
      WHERE b.Count >= {opts.collocation_min_count}),
p AS (SELECT w1 || ' ' || w2 AS Phrase, Count, w1, w2,
             ln((Count / total) / ((n1 / total) * (n2 / total) + CAST(1e-12 AS DOUBLE))) AS pmi FROM j),
co AS (SELECT Phrase, Count, {rint('pmi', 2)} AS PMI_Score, w1 AS Word1, w2 AS Word2,
              CASE WHEN {_in('Phrase', opts.synonym_phrases)} THEN 'YES' ELSE '' END AS AlreadyInSynonyms,
              CASE WHEN pmi > CAST(3.0 AS DOUBLE) THEN 'Consider adding "' || Phrase || '" to a SYNONYMS group'
                   ELSE '' END AS Suggestion
       FROM p ORDER BY PMI_Score DESC, Count DESC, Phrase LIMIT {opts.collocation_top_n}){tail}"""


def similar_words_sql(view: str, opts: Options) -> str:
    """All pairs of words that share a row, scored."""
    score = "shared / (sqrt(CAST(a.df AS DOUBLE)) * sqrt(CAST(b.df AS DOUBLE)))"
    return "WITH " + reasons_cte(view, opts) + f""",
tw AS MATERIALIZED (SELECT DISTINCT row_id, token FROM occ),
pairs AS (SELECT x.token AS Word1, y.token AS Word2, count(*) AS shared FROM tw x JOIN tw y ON x.row_id = y.row_id AND x.token < y.token GROUP BY ALL)
SELECT Word1, Word2, shared AS SharedRows, {pyround(score, 3)} AS ContextSimilarity, a.df AS Rows1, b.df AS Rows2
FROM pairs JOIN wc a ON a.token = Word1 JOIN wc b ON b.token = Word2
WHERE {score} > CAST(0.3 AS DOUBLE) AND a.df >= {opts.context_min_doc_freq} AND b.df >= {opts.context_min_doc_freq}"""


def context_sql(view: str, opts: Options, view_top: int | None = None) -> str:
    phrases = opts.synonym_phrases
    already = f"({_in('Word1', phrases)} OR {_in('Word2', phrases)})"
    tail = (f"\nSELECT * FROM cs WHERE ContextSimilarity > CAST(0.5 AS DOUBLE) ORDER BY score DESC, i DESC, j DESC "
            f"LIMIT {view_top}") if view_top else "\nSELECT * FROM cs"
    sql = "WITH " + reasons_cte(view, opts) + f""",
vc AS (SELECT token, n, df, f FROM wc ORDER BY n DESC, f LIMIT {2 * opts.context_top_words}),
vr AS (SELECT token, n, df, row_number() OVER (ORDER BY n DESC, f) - 1 AS idx FROM vc WHERE df >= {opts.context_min_doc_freq}),
vocab AS (SELECT * FROM vr WHERE idx < {opts.context_top_words}),
docs AS (SELECT DISTINCT row_id, unnest(tokens) AS token FROM tok),
dv AS (SELECT d.row_id, v.idx FROM docs d JOIN vocab v USING (token)),
pr AS (SELECT a.idx AS i, b.idx AS j, count(*) AS n FROM dv a JOIN dv b ON a.row_id = b.row_id AND a.idx < b.idx GROUP BY a.idx, b.idx),
sc AS (SELECT pr.i, pr.j, va.token AS Word1, vb.token AS Word2, va.n AS Freq_Word1, vb.n AS Freq_Word2,
              pr.n / (sqrt(va.df) * sqrt(vb.df)) AS score
       FROM pr JOIN vocab va ON pr.i = va.idx JOIN vocab vb ON pr.j = vb.idx),
cs AS (SELECT Word1, Word2, {pyround('score', 3)} AS ContextSimilarity, Freq_Word1, Freq_Word2,
              CASE WHEN {already} THEN 'YES' ELSE '' END AS AlreadyInSynonyms,
              CASE WHEN score > CAST(0.5 AS DOUBLE) AND NOT {already}
                   THEN 'Consider grouping "' || Word1 || '" and "' || Word2 || '" in SYNONYMS' ELSE '' END AS Suggestion,
              score, i, j
       FROM sc WHERE score > CAST(0.3 AS DOUBLE) ORDER BY score DESC, i DESC, j DESC LIMIT {opts.context_top_pairs})"""
    return sql + tail.replace("SELECT *", "SELECT Word1, Word2, ContextSimilarity, Freq_Word1, Freq_Word2, "
                                          "AlreadyInSynonyms, Suggestion")


# ---------------------------------------------------------------- rollup
def rollup_sql(view: str, opts: Options) -> str:
    return "WITH " + ruled_cte(view, opts) + f""",
base AS (SELECT Category, EntityId, count(*) AS OverrideCount, {rint('avg(NotchDifference)', 2)} AS AvgNotchDiff
         FROM cat GROUP BY Category, EntityId),
nf AS (SELECT Category, EntityId, BorrowerName, min(row_id) AS f FROM cat WHERE BorrowerName IS NOT NULL
       GROUP BY Category, EntityId, BorrowerName),
nr AS (SELECT *, row_number() OVER (PARTITION BY Category, EntityId ORDER BY f, BorrowerName) AS rn FROM nf),
nm AS (SELECT Category, EntityId, string_agg(BorrowerName, ' / ' ORDER BY rn) AS names FROM nr
       WHERE rn <= {opts.rollup_names} GROUP BY Category, EntityId)
SELECT b.Category, b.EntityId, coalesce(n.names, '') AS BorrowerName, b.OverrideCount, b.AvgNotchDiff
FROM base b LEFT JOIN nm n ON b.Category IS NOT DISTINCT FROM n.Category AND b.EntityId IS NOT DISTINCT FROM n.EntityId"""


# ---------------------------------------------------------------- tf-idf
def _ngrams12(tk: str) -> str:
    return f"list_concat({tk}, list_transform(generate_series(1, len({tk}) - 1), lambda i: {tk}[i] || ' ' || {tk}[i + 1]))"


def tfidf_sql(view: str, opts: Options, mode: str) -> str:
    if tuple(opts.ngram_range) != (1, 2):
        raise NotImplementedError("oracle covers ngram_range (1, 2)")
    if opts.tfidf_profile == "sublinear":
        stop = "[" + ", ".join(q(w) for w in opts.stopwords) + "]"
        tk = (f"list_filter(regexp_extract_all(lower(ReasonText), {q('[' + W + ']{2,}')}), "
              f"lambda t: NOT list_contains({stop}, t))")
        key, tf = "cnt", "(1 + ln(CAST(c AS DOUBLE)))"
    else:
        tk = tokens("ReasonText", opts)
        key, tf = "df", "(CAST(c AS DOUBLE) / CAST(sum(c) OVER (PARTITION BY row_id) AS DOUBLE))"
    body = "WITH " + prepared_cte(view, opts) + f""",
un AS (SELECT row_id, ReasonText FROM detail WHERE {rule_case('ReasonText', opts)} IS NULL),
tk AS (SELECT row_id, {tk} AS tk FROM un),
tm AS (SELECT row_id, {_ngrams12('tk')} AS terms FROM tk),
occ AS (SELECT row_id, unnest(terms) AS term FROM tm),
st AS (SELECT term, count(*) AS cnt, count(DISTINCT row_id) AS df FROM occ GROUP BY term),
vocab AS (SELECT * FROM (SELECT term, df, cnt, row_number() OVER (ORDER BY {key} DESC, term) - 1 AS idx FROM st)
          WHERE idx < {opts.max_features}),
nd AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM tm),
cn AS (SELECT o.row_id, o.term, count(*) AS c FROM occ o JOIN vocab v USING (term) GROUP BY o.row_id, o.term),
w0 AS (SELECT cn.row_id, cn.term, {tf} * (ln((n + 1) / (v.df + 1)) + 1) AS w FROM cn JOIN vocab v USING (term), nd),
wn AS (SELECT row_id, term, CASE WHEN sqrt(sum(w * w) OVER (PARTITION BY row_id)) > 0
                                 THEN w / sqrt(sum(w * w) OVER (PARTITION BY row_id)) ELSE w END AS weight FROM w0)"""
    if mode == "body":
        return body
    if mode == "vocab":
        return body + "\nSELECT term, df, CAST(idx AS BIGINT) AS idx FROM vocab"
    if mode == "weights":
        return body + f"\nSELECT row_id, term, {rint('weight', 6)} AS weight FROM wn"
    if mode in ("labels", "nearest"):
        body += f""",
role AS (SELECT row_id, actual_rating AS cluster FROM src),
nrole AS (SELECT r.cluster, count(*) AS n FROM role r JOIN tm USING (row_id) GROUP BY r.cluster),
cen AS (SELECT r.cluster, wn.term, {rint('sum(wn.weight) / nr.n', 9)} AS weight
        FROM wn JOIN role r USING (row_id) JOIN nrole nr ON r.cluster = nr.cluster GROUP BY r.cluster, wn.term, nr.n)"""
        if mode == "nearest":   # the dense form: every row against every center, term by term
            return body + f""",
grid AS (SELECT row_id, cluster, v.term FROM tm, (SELECT DISTINCT cluster FROM cen) k, vocab v),
far AS (SELECT g.row_id, g.cluster, sum(power(coalesce(wn.weight, 0) - coalesce(cen.weight, 0), 2)) AS d FROM grid g
        LEFT JOIN wn ON wn.row_id = g.row_id AND wn.term = g.term LEFT JOIN cen ON cen.cluster = g.cluster AND cen.term = g.term GROUP BY g.row_id, g.cluster)
SELECT row_id, cluster, {rint('d', 6)} AS dist2 FROM far QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY round(d, 9), cluster) = 1"""
        return body + f""",
rk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term) AS rn FROM cen),
lab AS (SELECT cluster, string_agg(term, ', ' ORDER BY rn) AS label FROM rk
        WHERE rn <= {opts.top_keywords_per_cluster} AND weight > 0 GROUP BY cluster)
SELECT c.cluster, coalesce(l.label, 'miscellaneous') AS label FROM (SELECT DISTINCT cluster FROM cen) c
LEFT JOIN lab l USING (cluster)"""
    raise ValueError(mode)


# ---------------------------------------------------------------- k-means fit
def fit_cte(name: str, weights: str, k: str, opts: Options) -> str:
    """CTEs of a K-Means fit over the long table ``weights`` (id, i, x; every id has
    a row, x may be 0): ``{name}_best`` (cluster, i, v) are the centers on the grid
    (i = -1 marks a cluster) and ``{name}_label`` (id, cluster) the nearest ones.
    Points are whole numbers of the grid, equal points are one weighted point, and
    all restarts step together until they stop."""
    n = name
    nearest = """SELECT pid, run, arg_min(cluster, d * 1024 + cluster) AS cluster, min(d) AS d FROM (
    SELECT p.pid, s.run, s.cluster, CAST(p.sq + s.c2 - 2 * coalesce(t.dot, 0) AS BIGINT) AS d
    FROM {n}_sq p CROSS JOIN (SELECT run, cluster, sum(v * v) AS c2 FROM {c} GROUP BY run, cluster) s
    LEFT JOIN (SELECT g.pid, c.run, c.cluster, sum(g.v * c.v) AS dot FROM {n}_g g JOIN {c} c ON g.i = c.i
               GROUP BY g.pid, c.run, c.cluster) t ON t.pid = p.pid AND t.run = s.run AND t.cluster = s.cluster) GROUP BY pid, run"""
    return f"""{n}_unit AS (SELECT pow(2.0, ceil(log2(max(abs(x))) - 1e-9) - 20) AS unit FROM {weights}),
{n}_grid AS (SELECT id, i, CAST(round_even(x / unit, 0) AS BIGINT) AS v FROM {weights}, {n}_unit),
{n}_id AS (SELECT id, coalesce(string_agg(CASE WHEN v <> 0 THEN i || ':' || v END, ',' ORDER BY i), '') AS pid FROM {n}_grid GROUP BY id),
{n}_one AS (SELECT pid, min(id) AS id, count(*) AS w FROM {n}_id GROUP BY pid),
{n}_g AS MATERIALIZED (SELECT o.pid, g.i, g.v, o.w FROM {n}_one o JOIN {n}_grid g USING (id) WHERE g.v <> 0),
{n}_sq AS MATERIALIZED (SELECT o.pid, any_value(o.w) AS w, sum(coalesce(g.v, 0) * coalesce(g.v, 0)) AS sq
                        FROM {n}_one o LEFT JOIN {n}_g g USING (pid) GROUP BY o.pid),
{n}_hash AS (SELECT pid, row_number() OVER (ORDER BY CAST('0x' || substr(md5({opts.kmeans_seed} || '|' || pid), 1, 15) AS BIGINT)) AS rn
             FROM {n}_one),
{n}_size AS (SELECT {k} AS k, least(count(*), {opts.kmeans_n_init} * {k}) AS m FROM {n}_one),
{n}_seed AS (SELECT run, s.cluster, pid FROM {n}_size, range({opts.kmeans_n_init}) t(run), range(1024) s(cluster), {n}_hash
             WHERE s.cluster < least(k, m) AND rn = (run * k + s.cluster) % m + 1),
{n}_c AS (
  SELECT 0 AS it, run, cluster, i, v, true AS moving
  FROM (SELECT run, cluster, CAST(-1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS v FROM {n}_seed
        UNION ALL SELECT s.run, s.cluster, CAST(g.i AS BIGINT), g.v FROM {n}_seed s JOIN {n}_g g USING (pid))
  UNION ALL
  (WITH cur AS (SELECT * FROM {n}_c WHERE moving AND it < {opts.kmeans_max_iter}),
   near AS ({nearest.format(n=n, c='cur')}),
   size AS (SELECT run, cluster, sum(w) AS n FROM near JOIN {n}_sq USING (pid) GROUP BY run, cluster),
   total AS (SELECT run, cluster, i, sum(g.v * g.w) AS s FROM near JOIN {n}_g g USING (pid) GROUP BY run, cluster, i),
   new AS (SELECT run, cluster, CAST(i AS BIGINT) AS i, CAST(round_even(CAST(s AS DOUBLE) / CAST(n AS DOUBLE), 0) AS BIGINT) AS v
           FROM total JOIN size USING (run, cluster)
           UNION ALL SELECT run, cluster, i, v FROM cur
           WHERE i = -1 OR NOT EXISTS (SELECT 1 FROM size z WHERE z.run = cur.run AND z.cluster = cur.cluster)),
   step AS (SELECT run, max(abs(coalesce(a.v, 0) - coalesce(b.v, 0))) AS far FROM new a FULL JOIN cur b USING (run, cluster, i) GROUP BY run)
   SELECT (SELECT max(it) FROM cur) + 1, new.run, cluster, i, v, far * unit > {opts.kmeans_tol} FROM new JOIN step USING (run), {n}_unit)),
{n}_last AS MATERIALIZED (SELECT run, cluster, i, v FROM (SELECT *, max(it) OVER (PARTITION BY run) AS last FROM {n}_c) WHERE it = last),
{n}_near AS MATERIALIZED ({nearest.format(n=n, c=f'{n}_last')}),
{n}_run AS (SELECT run FROM {n}_near JOIN {n}_sq USING (pid) GROUP BY run ORDER BY sum(w * d), run LIMIT 1),
{n}_best AS (SELECT cluster, i, v FROM {n}_last JOIN {n}_run USING (run)),
{n}_label AS (SELECT id, cluster FROM {n}_id JOIN {n}_near USING (pid) JOIN {n}_run USING (run))"""


_LONG = "SELECT vec_id AS id, unnest(generate_series(0, len(embedding) - 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"


def kmeans_fit_sql(k: int, opts: Options) -> str:
    return f"WITH RECURSIVE pt AS ({_LONG}),\n" + fit_cte("f", "pt", str(k), opts) + "\nSELECT id AS vec_id, cluster FROM f_label"


def choose_k_sql(min_k: int, max_k: int, opts: Options) -> str:
    """Each k below the number of points, scored over all pairs of points."""
    fits = [fit_cte(f"f{k}", "pt", str(k), opts) for k in range(min_k, max_k + 1)]
    labels = " UNION ALL ".join(f"SELECT {k} AS k, id, cluster FROM f{k}_label" for k in range(min_k, max_k + 1))
    return f"WITH RECURSIVE pt AS ({_LONG}),\n" + ",\n".join(fits) + f""",
lab AS MATERIALIZED ({labels}),
{_PTS},
pr AS MATERIALIZED (SELECT a.vec_id AS id, b.vec_id AS other, {_dist('a.x', 'b.x')} AS d FROM pts a, pts b),
md AS (SELECT l.k, l.id, l.cluster AS la, m.cluster AS lb, avg(d) AS m, count(*) AS n
       FROM pr JOIN lab l ON l.id = pr.id JOIN lab m ON m.id = pr.other AND m.k = l.k GROUP BY ALL),
ab AS (SELECT k, id, max(CASE WHEN la = lb THEN (CASE WHEN n > 1 THEN m ELSE 0 END) END) AS a, min(CASE WHEN la <> lb THEN m END) AS b
       FROM md GROUP BY k, id),
sc AS (SELECT k, avg(CASE WHEN b IS NULL THEN -1 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) AS s FROM ab GROUP BY k)
SELECT CAST(k AS BIGINT) AS k FROM sc WHERE k < (SELECT count(*) FROM embeddings) ORDER BY s DESC, k LIMIT 1"""


def hybrid_cte(view: str, opts: Options) -> str:
    """Adds ``cat``: rule groups, and the automatic groups of the remaining rows."""
    name = D.AUTO_GROUP_FORMAT.format(n="@n@", label="@label@")
    name = q(name).replace("@n@", "' || rn || '").replace("@label@", "' || label || '")
    body = tfidf_sql(view, opts, "body").replace("WITH ", "WITH RECURSIVE ", 1)
    return body + f""",
hx AS (SELECT tm.row_id AS id, coalesce(v.idx, 0) AS i, coalesce(wn.weight, 0) AS x
       FROM tm LEFT JOIN wn USING (row_id) LEFT JOIN vocab v USING (term)),
{fit_cte('h', 'hx', f'least({opts.n_clusters}, (SELECT count(*) FROM tm))', opts)},
hw AS (SELECT b.cluster, v.term, row_number() OVER (PARTITION BY b.cluster ORDER BY b.v DESC, v.term) AS rn
       FROM h_best b JOIN vocab v ON v.idx = b.i WHERE b.v > 0),
hl AS (SELECT c.cluster, coalesce(string_agg(term, ', ' ORDER BY rn) FILTER (WHERE rn <= {opts.top_keywords_per_cluster}), {q(D.MISC_LABEL)}) AS label
       FROM (SELECT cluster FROM h_best WHERE i = -1) c LEFT JOIN hw USING (cluster) GROUP BY c.cluster),
hs AS (SELECT cluster, count(*) AS n FROM h_label GROUP BY cluster),
hn AS (SELECT cluster, label, row_number() OVER (ORDER BY coalesce(n, 0) DESC, label, cluster) AS rn FROM hl LEFT JOIN hs USING (cluster)),
cat AS (SELECT d.*, coalesce({rule_case('ReasonText', opts)}, {name}) AS Category
        FROM detail d LEFT JOIN h_label l ON l.id = d.row_id LEFT JOIN hn USING (cluster))"""


# ---------------------------------------------------------------- k-means on embeddings
_PTS = "pts AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings)"


def _dist(a: str, b: str) -> str:
    return f"list_sum(list_transform(generate_series(1, len({a})), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"


def _assign(step: int) -> str:
    return f"""a{step} AS (SELECT vec_id, x, k, d FROM (
    SELECT p.vec_id, p.x, c.k, {_dist('p.x', 'c.c')} AS d,
           row_number() OVER (PARTITION BY p.vec_id ORDER BY {_dist('p.x', 'c.c')}, c.k) AS rn
    FROM pts p, c{step} c) WHERE rn = 1)"""


def _update(step: int) -> str:
    prev = step - 1
    return f"""u{step} AS (SELECT k, unnest(x) AS v, unnest(generate_series(1, len(x))) AS i FROM a{prev}),
m{step} AS (SELECT k, list(v ORDER BY i) AS c FROM (SELECT k, i, avg(v) AS v FROM u{step} GROUP BY k, i) GROUP BY k),
c{step} AS (SELECT c{prev}.k, coalesce(m{step}.c, c{prev}.c) AS c FROM c{prev} LEFT JOIN m{step} USING (k))"""


def kmeans_sql(k: int, steps: int, mode: str) -> str:
    parts = [_PTS, f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS k, x AS c "
                   f"FROM pts ORDER BY vec_id LIMIT {k})", _assign(0)]
    for s in range(1, steps + 1):
        parts += [_update(s), _assign(s)]
    last = f"a{steps}"
    sel = (f"SELECT vec_id, k AS cluster, {rint('d', 6)} AS dist2 FROM {last}" if mode == "assign"
           else f"SELECT {rint('sum(d)', 6)} AS inertia FROM {last}")
    return "WITH " + ",\n".join(parts) + "\n" + sel


def silhouette_sql() -> str:
    return "WITH " + _PTS + f""",
pr AS (SELECT a.vec_id, a.label AS la, b.label AS lb, {_dist('a.x', 'b.x')} AS d FROM pts a, pts b),
md AS (SELECT vec_id, la, lb, avg(d) AS m, count(*) AS n FROM pr GROUP BY vec_id, la, lb),
ab AS (SELECT vec_id, max(CASE WHEN la = lb THEN (CASE WHEN n > 1 THEN m ELSE 0 END) END) AS a,
              min(CASE WHEN la <> lb THEN m END) AS b FROM md GROUP BY vec_id),
s AS (SELECT CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END AS s FROM ab)
SELECT CASE WHEN (SELECT count(DISTINCT label) FROM pts) <= 1 THEN CAST(-1 AS DOUBLE)
            ELSE {rint('avg(s)', 6)} END AS silhouette FROM s"""
