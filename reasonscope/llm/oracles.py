"""DuckDB SQL for the operators whose contract SQL can state, written from the contracts."""

from __future__ import annotations

from reasonscope.llm.chat import CONTROLS, END, START
from reasonscope.llm.quality import CLASSES, NO_LANGUAGE, QualityRules

def _kmeans(k: int = 16, rounds: int = 3, dim: int = 64) -> str:
    steps = [f"""kept AS MATERIALIZED (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {dim}
  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
points AS MATERIALIZED (SELECT vec_id, i, CAST(floor(64 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS v FROM kept, range(1, {dim + 1}) r(i)),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k FROM kept),
c0 AS MATERIALIZED (SELECT k, i, v FROM seeds JOIN points USING (vec_id) WHERE k < {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, k, d FROM
  (SELECT vec_id, k, sum((p.v - c.v) * (p.v - c.v)) AS d FROM points p JOIN c{r} c USING (i) GROUP BY vec_id, k)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)""")
        if r < rounds:
            steps.append(f"""n{r} AS (SELECT k, i, sum(v) AS s, count(*) AS n FROM a{r} JOIN points USING (vec_id) GROUP BY k, i),
c{r + 1} AS MATERIALIZED (SELECT k, i, CAST(coalesce((s - ((s % n) + n) % n) // n, v) AS BIGINT) AS v FROM c{r} LEFT JOIN n{r} USING (k, i))""")
    return f"""WITH {", ".join(steps)},
written AS (SELECT k, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS digest FROM c{rounds} GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
  CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  digest AS centroid_sha256 FROM a{rounds} JOIN written USING (k)"""


_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""


def _near(slop: int = 2) -> str:
    """Items with a window whose terms all have a posting within ``slop`` of the rarest one's
    place; of equally rare terms the first counts."""
    return f"""terms AS MATERIALIZED (SELECT item_id, w[q] AS term, q, len(w) AS n FROM items, unnest(range(1, len(w) + 1)) u(q)),
posted AS MATERIALIZED (SELECT doc_id, w[p] AS term, p FROM (SELECT doc_id, w FROM docs), unnest(range(1, len(w) + 1)) u(p)
  WHERE w[p] IN (SELECT term FROM terms)),
known AS (SELECT term, count(*) AS f FROM posted GROUP BY term),
windows AS MATERIALIZED (SELECT s.item_id, s.q AS start, t.q, t.term, coalesce(f, 0) AS f, least(10, s.n) AS l FROM terms s
  JOIN terms t ON s.item_id = t.item_id AND t.q BETWEEN s.q AND s.q + 9 LEFT JOIN known k ON k.term = t.term WHERE s.q <= greatest(s.n - 9, 1)),
rare AS (SELECT item_id, start, q, term FROM windows QUALIFY row_number() OVER (PARTITION BY item_id, start ORDER BY f, q) = 1),
places AS MATERIALIZED (SELECT doc_id, item_id, start, p - q AS at FROM rare JOIN posted USING (term)),
met AS (SELECT a.doc_id, a.item_id, a.start, a.at FROM places a JOIN windows w USING (item_id, start)
  JOIN posted p ON p.doc_id = a.doc_id AND p.term = w.term AND p.p BETWEEN a.at + w.q - {slop} AND a.at + w.q + {slop}
  GROUP BY a.doc_id, a.item_id, a.start, a.at HAVING count(DISTINCT w.q) = max(w.l)),
close AS (SELECT doc_id, count(DISTINCT item_id) AS n FROM met GROUP BY doc_id)"""


DECONTAMINATION = f"""WITH items AS MATERIALIZED (SELECT item_id, {_WORDS} AS w FROM benchmark),
docs AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
phrases AS MATERIALIZED (SELECT DISTINCT item_id, least(10, len(w)) AS l, list_aggregate(w[s : s + least(10, len(w)) - 1], 'string_agg', ' ') AS phrase
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) u(s) WHERE len(w) > 0),
found AS MATERIALIZED (SELECT doc_id, s, x.l, item_id FROM (SELECT doc_id, l, s, list_aggregate(w[s : s + l - 1], 'string_agg', ' ') AS phrase
  FROM docs, (SELECT DISTINCT l FROM phrases) lengths, unnest(range(1, len(w) - l + 2)) u(s)) x JOIN phrases USING (l, phrase)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM found, unnest(range(s, s + l)) u(p) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM
  (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id),
{_near()}
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(own.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated,
  CAST(coalesce(close.n, 0) AS BIGINT) AS n_near_items
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN own USING (doc_id) LEFT JOIN close USING (doc_id)"""

SUBSTRINGS = """WITH docs AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS MATERIALIZED (SELECT doc_id, s, list_aggregate(w[s : s + 12], 'string_agg', ' ') AS g FROM docs, unnest(range(1, len(w) - 11)) u(s)),
firsts AS (SELECT g, min(doc_id) AS least FROM windows GROUP BY g),
covered AS MATERIALIZED (SELECT DISTINCT doc_id, p FROM windows JOIN firsts USING (g), unnest(range(s, s + 13)) u(p) WHERE least < doc_id),
words AS (SELECT doc_id, p, w[p] AS word FROM docs, unnest(range(1, len(w) + 1)) u(p)),
each AS (SELECT o.doc_id, o.p, word, c.p IS NOT NULL AS gone FROM words o LEFT JOIN covered c ON c.doc_id = o.doc_id AND c.p = o.p),
counted AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS lost, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM each GROUP BY doc_id)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(lost, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN counted USING (doc_id)"""


def _listed(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _escapes(column: str) -> str:
    """Characters that escaping adds: one for each backslash and for each control string."""
    found = [f"(length({column}) - length(replace({column}, {_listed([c])}, ''))) // {len(c)}" for c in ["\\", *CONTROLS]]
    return f"({' + '.join(found)})"


CHAT = f"""WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
turns AS (SELECT *, role || chr(10) || text || chr(10) AS written, length(role) + {_escapes("role")}
  + length(role) - length(replace(role, chr(10), '')) + length(text) + {_escapes("text")} + {len(START) + len(END) + 2} AS n FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(written, '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


def _quality(rules: QualityRules = QualityRules()) -> str:
    """Base columns by unnested lines and windows; divergence by long histograms (doc, kind, bin, n)."""
    left = ["coalesce(text, '')"]
    for _, pattern in CLASSES:
        quoted = pattern.replace("'", "''")
        left.append(f"regexp_replace({left[-1]}, '{quoted}', '', 'g')")
    lengths = ", ".join(f"length({x})" for x in left)
    width = rules.repeat_window
    common = ", ".join(f"('{lang}', '{word}', {i})" for lang, words in rules.common_words.items() for i, word in enumerate(words))
    failed = f"(n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words)"
    return f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
  CASE WHEN lower(trim(lang)) NOT IN ({_listed(NO_LANGUAGE)}) THEN lang END AS lang,
  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, [{lengths}] AS sizes FROM documents),
windows AS MATERIALIZED (SELECT r, s, list_aggregate(w[s : s + {width - 1}], 'string_agg', ' ') AS g FROM docs, unnest(range(1, len(w) - {width - 2})) u(s)),
repeated AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, s FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1), unnest(range(s, s + {width})) u(p) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
base AS MATERIALIZED (SELECT docs.*, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words FROM docs LEFT JOIN repeated p USING (r) LEFT JOIN lines l USING (r)),
common(lang, word, i) AS (VALUES {common}),
seen AS (SELECT x.r, c.lang, c.i, count(*) AS n FROM (SELECT r, lang, lower(unnest(w)) AS word FROM docs) x JOIN common c USING (lang, word) GROUP BY x.r, c.lang, c.i),
bins AS MATERIALIZED (
  SELECT r, lang, 'class' AS kind, i, sizes[i] - coalesce(sizes[i + 1], 0) AS n FROM docs, range(1, {len(CLASSES) + 2}) u(i) WHERE lang IS NOT NULL
  UNION ALL SELECT r, lang, 'word', i, n FROM seen
  UNION ALL SELECT r, lang, 'word', -1, n_words - coalesce((SELECT sum(n) FROM seen WHERE seen.r = base.r), 0) FROM base WHERE lang IN (SELECT lang FROM common)),
reference AS MATERIALIZED (SELECT lang, kind, i, sum(n) AS n FROM bins WHERE r IN (SELECT r FROM base
  WHERE NOT {failed} AND 100 * n_symbols <= {rules.max_reference_symbols} * n_words) GROUP BY lang, kind, i),
totals AS (SELECT lang, kind, sum(n) AS total FROM reference GROUP BY lang, kind HAVING sum(n) > 0),
own AS (SELECT r, lang, kind, sum(n) AS total FROM bins GROUP BY r, lang, kind HAVING sum(n) > 0),
shares AS (SELECT o.r, o.kind, o.total, coalesce(b.n, 0) / o.total AS a, f.n / t.total AS b FROM own o JOIN totals t USING (lang, kind)
  JOIN reference f ON f.lang = o.lang AND f.kind = o.kind LEFT JOIN bins b ON b.r = o.r AND b.kind = o.kind AND b.i = f.i
  UNION ALL SELECT o.r, o.kind, o.total, b.n / o.total, 0 FROM own o JOIN totals t USING (lang, kind) JOIN bins b ON b.r = o.r AND b.kind = o.kind
  WHERE NOT EXISTS (FROM reference f WHERE f.lang = o.lang AND f.kind = o.kind AND f.i = b.i)),
distances AS (SELECT r, kind, total, sqrt(greatest(0, sum(CASE WHEN a > 0 THEN a * log2(2 * a / (a + b)) ELSE 0 END
  + CASE WHEN b > 0 THEN b * log2(2 * b / (a + b)) ELSE 0 END) / 2)) AS d FROM shares GROUP BY r, kind, total),
judged AS (SELECT base.*, {failed} AS base_failed, c.d AS class_distance, w.d AS word_distance FROM base
  LEFT JOIN distances c ON c.r = base.r AND c.kind = 'class' AND c.total >= {rules.min_chars}
  LEFT JOIN distances w ON w.r = base.r AND w.kind = 'word' AND n_words >= {rules.min_hist_words})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(class_distance, 6) AS class_distance,
  round(word_distance, 6) AS word_distance, NOT base_failed AND coalesce(class_distance <= {rules.max_class_distance}, true)
  AND coalesce(word_distance <= {rules.max_word_distance}, true) AS kept FROM judged"""


ORACLES: dict[str, str] = {
    "op5_chat_formatting": CHAT,
    "op6_substring_dedup": SUBSTRINGS,
    "op10_quality_rules": _quality(),
    "op11_centroid_clustering": _kmeans(),
    "op12_decontamination": DECONTAMINATION,
}
