"""DuckDB SQL for the queries that SQL can express, written from the contracts."""

OP7 = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM words),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c AS component_id, c = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN least ON least.x = d.doc_id
"""

OP1 = """
WITH RECURSIVE usable AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, c = e.vec_id AS kept
FROM embeddings e JOIN least ON least.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id
"""

# crc32 of a conversation's decimal id, bit by bit; nodes are prefixes of lists of turn ids.
OP13 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
named AS (SELECT conv_id, turn, substr(sha256(length(r) || ':' || r || x), 1, 32) AS id,
          len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words FROM t),
own AS MATERIALIZED (
  SELECT conv_id, list({'id': id, 'words': words} ORDER BY turn NULLS FIRST, id) AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
          lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)), 4294967295::BIGINT) % 4 AS h
  FROM named GROUP BY conv_id),
built AS MATERIALIZED (
  SELECT o.conv_id, list_concat(coalesce(b.w[1:o.h], []), o.w[o.h + 1:]) AS w
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
members AS MATERIALIZED (
  SELECT conv_id, d, len(w) = d AS ends, CASE WHEN d > 0 THEN w[d].words ELSE 0 END AS words,
         array_to_string(list_transform(w[1:d], lambda s: s.id), '') AS p
  FROM (SELECT conv_id, w, unnest(range(len(w) + 1)) AS d FROM built)),
nodes AS MATERIALIZED (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY p, d),
linked AS MATERIALIZED (
  SELECT x.*, k.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.d = x.d + 1 AND c.p[1:32 * x.d] = x.p) AS n_children
  FROM nodes x LEFT JOIN nodes k ON x.d = k.d + 1 AND k.p = x.p[1:32 * k.d]),
sums AS (
  SELECT a.p, sum((x.n - 1) * x.words) AS saved, count(*) FILTER (x.n_children = 0) AS leaves
  FROM (SELECT p, n, words, n_children, unnest(range(d + 1)) AS up FROM linked) x JOIN nodes a ON a.d = x.up AND a.p = x.p[1:32 * x.up]
  GROUP BY a.p)
SELECT conv_id, d::BIGINT AS depth, parent_conv_id, n::BIGINT AS n_convs, n_children::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
       saved::BIGINT AS saved_tokens, ends_sha256
FROM linked JOIN sums USING (p)
"""

ORACLES = {"op1_embeddings": OP1, "op7_minhash": OP7, "op13_burst_trie": OP13}
