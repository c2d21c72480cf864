"""DuckDB SQL for the queries that SQL can express; over whole tables, like the queries."""

OP1 = r"""
WITH l AS (
  SELECT doc_id, pos, line, translate(trim(line, E' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), E'\n')) AS line, generate_subscripts(string_split(coalesce(text, ''), E'\n'), 1) AS pos FROM documents)
), g AS (
  SELECT k, count(DISTINCT doc_id) AS n, max(doc_id) AS top FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT l.doc_id, l.pos, l.line, g.k IS NOT NULL AND l.doc_id < g.top AS gone FROM l LEFT JOIN g ON l.k = g.k
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, E'\n' ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP8 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, string_split_regex(trim(coalesce(text, ''), E' \t\n\x0b\f\r'), '[\x20\x09-\x0D]+') AS w0 FROM documents
), w AS (
  SELECT doc_id, t, CASE WHEN trim(t, E' \t\n\x0b\f\r') = '' THEN [] ELSE w0 END AS w FROM d
), p AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM p) WHERE n > 1
), cov AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id
), l AS (
  SELECT doc_id, x, length(x) - length(regexp_replace(x, '[#*$%&|<>]+', '', 'g')) AS s, length(x) - length(regexp_replace(x, '[|>»·•]', '', 'g')) AS seps
  FROM (SELECT doc_id, unnest(string_split(t, E'\n')) AS x FROM w) WHERE trim(x, E' \t\n\x0b\f\r') <> ''
), f AS (
  SELECT doc_id, x, s * 10 > length(x) OR NOT regexp_matches(x, '[\p{L}\p{N}]')
    OR regexp_matches(right(trim(x, E' \t\n\x0b\f\r'), 4), '^[#*$%&|<>=_~^-]{4}\z')
    OR regexp_matches(x, '(?:[!?.*#$%&]{2}[\x20\x09]+[^\x20\x09-\x0D]+[\x20\x09]*){4}')
    OR (seps >= 3 AND length(x) <= (seps + 1) * 40)
    OR regexp_matches(x, '(?i)all rights reserved|licensed under|privacy policy|terms of service|terms of use|cookie policy|accept cookies|sign up|subscribe to|click here|copyright \(c\)|javascript is disabled') AS bad
  FROM l
), k AS (
  SELECT doc_id, count(*) - count(DISTINCT x) AS dup, sum(length(x)) AS all_chars, coalesce(sum(length(x)) FILTER (WHERE NOT bad), 0) AS good FROM f GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(w.w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
         coalesce(k.dup, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(k.good, 0) * 100 >= coalesce(k.all_chars, 0) * 50 AS enough
  FROM w LEFT JOIN k USING (doc_id) LEFT JOIN cov USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed,
       NOT (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AND enough AS kept
FROM m
"""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD, PHONE = r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


RUN = r"[\p{L}\p{N}]+"
CUE = r"(?i)\b(?:token|secret|password|passwd|pwd|credentials?|api[ _-]?key|access[ _-]?key|private[ _-]?key)[\"'']?[ \t]{0,2}[:=]"


def _found(rank: int, kind: str, pattern: str, text: str = "t") -> str:
    return f"SELECT doc_id, t, {rank} AS rank, '{kind}' AS kind, string_split_regex({text}, '{pattern}') AS parts, regexp_extract_all({text}, '{pattern}') AS hits FROM d"


def _shape(w: str) -> str:
    return rf"CASE WHEN length({w}) >= 16 AND regexp_matches({w}, '\p{{N}}') AND regexp_matches({w}, '\p{{L}}') THEN CASE WHEN regexp_full_match({w}, '[0-9a-f]+|[0-9A-F]+') THEN '#x' ELSE '#w' END || least(64, length({w}) - length({w}) % 8) END"


def _terms(text: str) -> str:
    runs = lambda t: rf"list_filter(string_split_regex({t}, '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(list_concat({runs(LOWER.format(text))}, list_filter(list_transform({runs(text)}, lambda w: {_shape('w')}), lambda w: w IS NOT NULL)))"


_KINDS = ((0, "email", EMAIL), (1, "ip", IP), (2, "card", CARD), (3, "phone", PHONE), (4, "term", RUN))
OP2 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), total AS (SELECT count(*) AS n FROM d), m AS (
  {" UNION ALL ".join(_found(*x) for x in _KINDS)} UNION ALL {_found(5, "secret", CUE, "translate(t, '_', ' ')")}
), s0 AS (
  SELECT doc_id, t, rank, kind, hits[i] AS v, regexp_replace(hits[i], '[^0-9]+', '', 'g') AS dg,
         CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m)
), s AS (
  SELECT *, start + length(v) AS stop FROM s0
  WHERE kind IN ('email', 'term', 'secret') OR (kind = 'ip' AND coalesce(list_bool_and(list_transform(string_split(v, '.'), lambda x: TRY_CAST(x AS HUGEINT) <= 255)), FALSE))
     OR (kind = 'phone' AND length(dg) BETWEEN 10 AND 15)
     OR (kind = 'card' AND length(dg) BETWEEN 14 AND 19 AND list_sum(list_transform(range(length(dg)), lambda i: CAST(substr(dg, length(dg) - i, 1) AS INTEGER) * (1 + i % 2) - 9 * CAST(CAST(substr(dg, length(dg) - i, 1) AS INTEGER) * (1 + i % 2) > 9 AS INTEGER))) % 10 = 0)
), base AS (SELECT * FROM s WHERE rank < 4), near0 AS (
  SELECT doc_id, kind || ':' || CASE kind WHEN 'secret' THEN '' WHEN 'email' THEN lower(v) WHEN 'ip' THEN v ELSE dg END AS e,
         CASE WHEN rank = 5 THEN '' ELSE substr(t, greatest(start - 80, 0) + 1, least(start, 80)) END AS before, substr(t, stop + 1, 80) AS after,
         CASE WHEN start > 80 THEN substr(t, start - 80, 1) ELSE '' END AS l, substr(t, stop + 81, 1) AS r FROM s WHERE rank <> 4
), near1 AS (
  SELECT *, CASE WHEN regexp_matches(l, '[\p{{L}}\p{{N}}]') THEN regexp_replace(before, '^[\p{{L}}\p{{N}}]+', '') ELSE before END || ' ' || CASE WHEN regexp_matches(r, '[\p{{L}}\p{{N}}]') THEN regexp_replace(after, '[\p{{L}}\p{{N}}]+$', '') ELSE after END AS around FROM near0
), near AS (
  SELECT DISTINCT doc_id, e, before, after, unnest({_terms("around")}) AS term FROM near1
), ne AS (SELECT e, count(DISTINCT doc_id) AS n_e FROM near GROUP BY e), te AS (
  SELECT term, e, count(DISTINCT (before, after)) AS contexts, count(DISTINCT doc_id) AS n_te FROM near GROUP BY term, e
), nt AS (
  SELECT term, count(*) AS n_t FROM (SELECT doc_id, unnest({_terms("t")}) AS term FROM d) WHERE term IN (SELECT term FROM te) GROUP BY term
), bad AS (
  SELECT DISTINCT term FROM te JOIN ne USING (e) JOIN nt USING (term), total WHERE n_e < n AND n_te * 2 > n_t AND ln(n_te * n / (n_t * n_e) * contexts / (contexts + 2)) / ln(n / n_e) >= 0.85
), spans AS (
  SELECT doc_id, rank, kind, start, stop FROM base
  UNION ALL SELECT doc_id, rank, kind, start, stop FROM s WHERE kind = 'term' AND ({LOWER.format("v")} IN (SELECT term FROM bad) OR coalesce({_shape("v")} IN (SELECT term FROM bad), FALSE)) AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = s.doc_id AND s.start < b.stop AND b.start < s.stop)
)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip, count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
       sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank < 4), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank IS NOT NULL), '') AS spans, count(*) FILTER (WHERE rank IS NOT NULL) AS n_spans
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
"""

OP9 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex({LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id), links AS (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2) JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 85 * (p.n + q.n - shared)
), e AS (SELECT x, y FROM links UNION SELECT y, x FROM links), reach(doc_id, m) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.m FROM reach r JOIN e ON e.x = r.doc_id
), c AS (SELECT doc_id, min(m) AS component_id FROM reach GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

ORACLES = {"op1_line_dedup": OP1, "op2_pii": OP2, "op8_quality_rules": OP8, "op9_minhash_near_dedup": OP9}
