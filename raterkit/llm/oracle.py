"""DuckDB SQL of the corpus queries that SQL can express.

Written from the definitions, with none of the operators' methods: lines are compared by
looking for the edit, shingles and vectors pair by pair, captures by payload.
"""

from __future__ import annotations

OP2 = """
WITH texts AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(doc_id, 9223372036854775807) AS d, ('0x' || left(sha256(coalesce(text, '')), 15))::BIGINT AS r,
    row_number() OVER (PARTITION BY doc_id, text) AS copy, string_split(text, chr(10)) AS parts
  FROM documents
),
lines AS (
  SELECT id, d, r, copy, p - 1 AS p, parts[p] AS line
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS p FROM texts)
  WHERE length(parts[p]) >= 20
),
firsts AS (SELECT line, min((d, r, copy, p)) AS f, length(line) AS n FROM lines GROUP BY line),
keyed AS (
  SELECT line, f, n, unnest([n - 1, n]) AS longer FROM firsts
),
halves AS (
  SELECT DISTINCT line, f, n, side, h, CASE side WHEN 1 THEN left(line, h) ELSE right(line, h) END AS part
  FROM (SELECT line, f, n, unnest([1, 2]) AS side, h FROM (SELECT line, f, n, unnest([n // 2, (n + 1) // 2]) AS h FROM firsts))
),
near AS (
  SELECT DISTINCT a.line
  FROM halves a JOIN halves b ON a.side = b.side AND a.h = b.h AND a.part = b.part AND abs(a.n - b.n) <= 1 AND b.f < a.f
  WHERE len(list_filter(range(0, greatest(a.n, b.n)), lambda i:
      left(a.line, i) = left(b.line, i)
      AND substr(a.line, i + CASE WHEN a.n >= b.n THEN 2 ELSE 1 END) = substr(b.line, i + CASE WHEN b.n >= a.n THEN 2 ELSE 1 END))) > 0
),
gone AS (
  SELECT l.id, l.p
  FROM lines l JOIN firsts f ON l.line = f.line LEFT JOIN near n ON l.line = n.line
  WHERE n.line IS NOT NULL OR (l.d, l.r, l.copy, l.p) <> f.f
),
lists AS (SELECT id, count(*) AS n, string_agg(p::VARCHAR, ',' ORDER BY p) AS dropped FROM gone GROUP BY id)
SELECT t.doc_id, coalesce(len(t.parts), 0)::BIGINT AS n_lines, coalesce(l.n, 0)::BIGINT AS n_dropped, coalesce(l.dropped, '') AS dropped
FROM texts t LEFT JOIN lists l ON t.id = l.id
"""

OP3 = """
WITH RECURSIVE numbered AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings),
able AS (
  SELECT r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM numbered
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.r AS a, b.r AS b FROM able a JOIN able b ON a.r <> b.r
  WHERE list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.9
),
reach AS (
  SELECT r AS a, r AS b FROM able
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
),
lowest AS (SELECT x.a, min(e.vec_id) AS low FROM reach x JOIN able e ON x.b = e.r GROUP BY x.a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, coalesce(m.low, e.vec_id) AS component_id,
  e.vec_id IS NOT DISTINCT FROM coalesce(m.low, e.vec_id) AS kept
FROM numbered e
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON e.r = c.a
LEFT JOIN lowest m ON e.r = m.a
"""

#: rows of (doc_id, n_links, class_id) of a relation ``{documents}(doc_id, text)``
NEAR = """
words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\t-\\r ]+'), lambda w: w <> '') AS w FROM {documents}
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
),
inverted AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
near_links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM inverted a JOIN inverted b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9
),
near_reach AS (
  SELECT doc_id AS a, doc_id AS b FROM {documents}
  UNION
  SELECT r.a, l.b FROM near_reach r JOIN near_links l ON r.b = l.a
),
near_classes AS (
  SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_links, m.low AS class_id
  FROM {documents} d
  LEFT JOIN (SELECT a, count(*) AS n FROM near_links GROUP BY a) c ON d.doc_id = c.a
  LEFT JOIN (SELECT a, min(b) AS low FROM near_reach GROUP BY a) m ON d.doc_id = m.a
)
"""

OP4 = "WITH RECURSIVE " + NEAR.format(documents="documents") + """
SELECT doc_id, n_links, class_id, doc_id = class_id AS kept FROM near_classes
"""

OP5 = """
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, url, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
),
f AS (
  SELECT payload_digest, page_id AS first_page, r AS first_r FROM p WHERE payload_bytes >= 100
  QUALIFY row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS FIRST, r) = 1
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN f.first_r <> p.r THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first_r <> p.r THEN f.first_page END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""

OP6 = """
WITH able AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM able q JOIN able c ON q.vec_id % 50 = 0 AND q.r <> c.r
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP11 = """
WITH plain AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
),
own AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS turns
  FROM plain GROUP BY conv_id
),
started AS (
  SELECT o.conv_id, o.turns, coalesce(b.turns, []) AS base,
    xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(o.conv_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT)), lambda c, b:
      list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT) % 9 AS h
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5
),
whole AS (SELECT conv_id, list_concat(base[1:h::BIGINT], turns[h::BIGINT + 1:]) AS turns FROM started),
members AS (SELECT conv_id, len(turns) AS length, d, turns[1:d] AS prefix, turns[d].text AS last FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM whole)),
nodes AS (
  SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(coalesce(strlen(last), 0)) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = d), '')) AS ends
  FROM members GROUP BY d, prefix
),
places AS (SELECT m.conv_id AS member, n.d, n.conv_id FROM members m JOIN nodes n ON m.d = n.d AND m.prefix = n.prefix),
tree AS (SELECT n.*, p.conv_id AS parent FROM nodes n LEFT JOIN places p ON p.member = n.conv_id AND p.d = n.d - 1),
kids AS (SELECT parent, d - 1 AS d, count(*) AS n_children FROM tree WHERE d > 0 GROUP BY ALL),
counted AS (SELECT t.*, coalesce(k.n_children, 0) AS n_children FROM tree t LEFT JOIN kids k ON t.conv_id = k.parent AND t.d = k.d),
sums AS (
  SELECT p.conv_id, p.d, sum((c.n_children = 0)::BIGINT) AS n_leaves, sum(c.saved) AS saved_tokens
  FROM counted c JOIN places p ON p.member = c.conv_id AND p.d <= c.d GROUP BY p.conv_id, p.d
)
SELECT c.conv_id, c.d::BIGINT AS depth, c.parent AS parent_conv_id, c.n_convs::BIGINT AS n_convs, c.n_children::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, c.ends AS ends_sha256
FROM counted c JOIN sums s ON c.conv_id = s.conv_id AND c.d = s.d
"""

OP12 = r"""
WITH texts AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
spans AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT lang, w, unnest([1, 2, 3, 4, 5]) AS k FROM words)),
counts AS (
  SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM spans)
  GROUP BY lang, k, phrase HAVING count(*) >= 100
),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, c.w[1:j] AS first, c.w[j + 1:] AS rest, j
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM counts WHERE k > 1) c
),
scored AS (
  SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, t.n, j, (1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.first, ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.rest, ' ') JOIN totals t ON t.lang = c.lang
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM counts o WHERE o.lang = b.lang AND o.f = b.a AND 100 * o.f >= 100 * b.a AND length(o.phrase) > length(b.phrase)
      AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ')
  )
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""

ORACLE: dict[str, str] = {
    "op2_line_dedup": OP2,
    "op3_nn_descent": OP3,
    "op4_lsh_forest": OP4,
    "op5_warc_transactions": OP5,
    "op6_pivot_topk": OP6,
    "op11_prefix_trie": OP11,
    "op12_collocations": OP12,
}
