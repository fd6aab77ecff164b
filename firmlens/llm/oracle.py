"""DuckDB SQL of the registered queries that SQL can express."""

from firmlens.llm import line_templates as L
from firmlens.llm.near_dup import PERCENT, WORDS
from firmlens.llm.topk import K, SCALE

OP3 = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS n
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.n, c.n)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.n) = len(q.n) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""

_PIECES = " || ' ' || ".join(f"w[i + {k}]" for k in range(WORDS))
OP6 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {WORDS} + 2), lambda i: {_PIECES}) END) AS shingle
  FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, least_id) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT e.b, r.least_id FROM r JOIN e ON e.a = r.doc_id WHERE r.least_id < e.b
)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(least_id) AS component_id,
  r.doc_id = min(least_id) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

OP7 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents WHERE text IS NOT NULL
), raw AS (
  SELECT doc_id, line_no, list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '') AS words FROM lines
), t AS (
  SELECT doc_id, line_no, CASE WHEN len(words) < {L.MIN_TOKENS} THEN words ELSE list_transform(words,
    lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{L.FIELD}' ELSE x END) END AS tokens
  FROM raw WHERE len(words) >= {L.MIN_TOKENS} OR length(array_to_string(words, '')) >= {L.MIN_CHARS}
), kinds AS (
  SELECT tokens,
    len(tokens) || ' ' || array_to_string(tokens[1:{L.DEPTH}], ' ') AS leaf
  FROM t GROUP BY tokens
), several AS (SELECT leaf FROM kinds GROUP BY leaf HAVING count(*) > 1),
placed AS (
  SELECT leaf, tokens, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place
  FROM kinds WHERE leaf IN (SELECT leaf FROM several)
), support AS (
  SELECT leaf, place, token, count(DISTINCT doc_id) >= {L.MIN_DOCS} AS stays
  FROM placed JOIN (SELECT DISTINCT doc_id, tokens FROM t) USING (tokens)
  WHERE token <> '{L.FIELD}' GROUP BY ALL
), general AS (
  SELECT p.leaf, p.tokens, count(*) FILTER (stays) AS fixed,
    string_agg(CASE WHEN stays THEN p.token ELSE '{L.FIELD}' END, ' ' ORDER BY p.place) AS template
  FROM placed p LEFT JOIN support s ON s.leaf = p.leaf AND s.place = p.place AND s.token = p.token
  GROUP BY ALL
), template AS (
  SELECT k.tokens, k.leaf, coalesce('general ' || g.template, 'whole ' || array_to_string(k.tokens, ' ')) AS template
  FROM kinds k LEFT JOIN general g ON g.tokens = k.tokens AND g.fixed >= {L.FIXED} * len(k.tokens)
), used AS (
  SELECT t.doc_id, t.line_no, m.leaf, m.template FROM t JOIN template m ON m.tokens = t.tokens
), recurring AS (
  SELECT leaf, template, min(doc_id) AS first FROM used GROUP BY ALL HAVING count(DISTINCT doc_id) >= {L.MIN_DOCS}
), marked AS (
  SELECT u.doc_id, list(u.line_no ORDER BY u.line_no) FILTER (u.doc_id <> r.first) AS drop
  FROM used u JOIN recurring r ON r.leaf = u.leaf AND r.template = u.template GROUP BY u.doc_id
)
SELECT d.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines,
  coalesce(len(drop), 0)::BIGINT AS n_dropped, coalesce(array_to_string(drop, ','), '') AS dropped
FROM documents d LEFT JOIN marked j ON j.doc_id = d.doc_id
"""

_HEX = "(strpos('0123456789abcdef', substr(h || '0', (5 * i) // 4 + {}, 1)) - 1)"
OP10 = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((({_HEX.format(1)} * 16 + {_HEX.format(2)}) >> (3 - (5 * i) % 4)) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

ORACLE = {
    "op3_topk": OP3,
    "op6_near_dup": OP6,
    "op7_line_templates": OP7,
    "op10_archive": OP10,
}
