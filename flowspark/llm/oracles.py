"""DuckDB SQL for the queries whose whole result SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Tokens, leaf and masked line; then templates by counts per leaf and place.
LINE_DEDUP = r"""
WITH docs AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS k
  FROM documents WHERE text IS NOT NULL
), masked AS (
  SELECT doc_id, text, k, list_transform(regexp_extract_all(line, '[^\x09-\x0D\x1C-\x20]+'),
         lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS w FROM docs
), lines AS (
  SELECT doc_id, text, k, w, array_to_string(w, ' ') AS tpl,
         len(w) || ' ' || array_to_string(list_slice(w, 1, 3), ' ') AS leaf
  FROM masked WHERE len(w) > 0
), tpls AS (
  SELECT leaf, tpl, any_value(w) AS w, count(DISTINCT (doc_id, text)) AS n FROM lines GROUP BY 1, 2
), leaves AS (
  SELECT leaf FROM tpls GROUP BY 1 HAVING count(*) > 1 AND sum(n) >= 10
), placed AS (
  SELECT leaf, tpl, n, len(w) AS size, unnest(w) AS token, unnest(range(len(w))) AS place
  FROM tpls SEMI JOIN leaves USING (leaf)
), constant AS (
  SELECT leaf, place, token FROM placed GROUP BY ALL HAVING sum(n) >= 10
), general AS (
  SELECT leaf, tpl, leaf || chr(10) || string_agg(place || ' ' || token, chr(10) ORDER BY place) AS g
  FROM placed JOIN constant USING (leaf, place, token)
  GROUP BY leaf, tpl, size HAVING count(*) >= size * 0.7
), final AS (
  SELECT l.doc_id, l.text, l.k, coalesce(g.g, l.tpl) AS template FROM lines l LEFT JOIN general g USING (leaf, tpl)
), recurring AS (
  SELECT template, min(doc_id) AS first FROM final GROUP BY 1 HAVING count(DISTINCT (doc_id, text)) >= 10
), drops AS (
  SELECT f.doc_id, f.text, list(DISTINCT f.k) AS ks FROM final f JOIN recurring r USING (template)
  WHERE f.doc_id <> r.first GROUP BY 1, 2
)
SELECT d.doc_id,
       CASE WHEN x.ks IS NULL THEN d.text ELSE array_to_string(list_filter(string_split(d.text, chr(10)),
         lambda t, i: NOT list_contains(x.ks, i - 1)), chr(10)) END AS text,
       CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(x.ks), 0) AS BIGINT) AS n_dropped
FROM documents d LEFT JOIN drops x ON d.doc_id = x.doc_id AND d.text = x.text
"""

#: Control strings are escaped by doubling their backslashes and adding one.
CHAT_FORMAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length('<turn role="' || role || '">' || chr(10)
           || regexp_replace(text, '(\\*)(</?turn|<part )', '\1\1\\\2', 'g') || chr(10) || '</turn>' || chr(10)) AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars,
       CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens
FROM sized GROUP BY conv_id
"""

DECONTAMINATION = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT item_id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s
        FROM items WHERE len(w) > 0)
), places AS (
  SELECT doc_id, k, s, array_to_string(list_slice(w, s, s + k - 1), ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s
        FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
), found AS (
  SELECT DISTINCT doc_id, item_id, k, s FROM places JOIN windows USING (k, g)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM found) GROUP BY 1
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

JACCARD_JOIN = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
         '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + 3), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS s FROM d WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM shingles x JOIN shingles y USING (g)
    WHERE x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * m >= 85 * (p.n + q.n - m)
), reached AS (
  SELECT doc_id, doc_id AS other FROM d
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY 1
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM d LEFT JOIN sizes USING (doc_id) JOIN least USING (doc_id)
"""

#: Sources are tried as capped one after the other in order of size by weight; rates and draws per document.
SOURCE_MIX = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')), 1, 13) AS BIGINT)
           / 4503599627370496.0 AS u
  FROM documents
), sources AS (
  SELECT source, sum(size)::HUGEINT AS s, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY 1
), weighed AS (
  SELECT *, [5, 2, 1][(place - 1) % 3 + 1]::HUGEINT AS w FROM sources
), ordered AS (
  SELECT *, sum(s) OVER () AS every, sum(w) OVER () AS every_w,
         coalesce(sum(s) OVER o, 0) AS before_s, coalesce(sum(w) OVER o, 0) AS before_w
  FROM weighed WINDOW o AS (ORDER BY s * 10 // w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), settled AS (
  SELECT *, 4 * s * (every_w - before_w) <= (3 * every - 4 * before_s) * w AS capped FROM ordered
), level AS (
  SELECT coalesce(sum(s) FILTER (WHERE capped), 0) AS c, coalesce(sum(w) FILTER (WHERE NOT capped), 0) AS free FROM settled
), targets AS (
  SELECT source, s, CASE WHEN capped THEN (2 * s)::DOUBLE
    ELSE ((3 * every - 4 * c) * w)::DOUBLE / (2 * free)::DOUBLE END AS target FROM settled, level
), taken AS (
  SELECT d.*, t.s, t.target, CASE WHEN t.s > 0 THEN t.target / t.s::DOUBLE ELSE 0.0 END AS rate
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(s AS BIGINT) AS source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM taken
"""

#: All anchors against all rows.
HARD_NEGATIVES = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT a, b, score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
)
SELECT p.a AS anchor_id, p.b AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) AS INTEGER) AS rank,
       n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.a = p.a AND NOT n.same
 AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5
"""
