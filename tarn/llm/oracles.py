"""SQL that gives the rows of this package's queries in DuckDB, where whole tables allow it."""

OP5 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w]
    ELSE [w[i:i + 1] FOR i IN range(1, len(w) - 0)] END) AS shingle
  FROM words
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
numbered AS (SELECT doc_id, dense_rank() OVER (ORDER BY shingle) AS s FROM shingles),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM numbered a JOIN numbered b ON a.s = b.s AND a.doc_id < b.doc_id
    JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN edges l ON l.a = r.b)
SELECT a AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id, a = min(b) AS kept
FROM reach LEFT JOIN sizes ON sizes.doc_id = reach.a
GROUP BY a
"""

OP8 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS pos FROM words WHERE len(w) >= 20),
windows AS (SELECT doc_id, pos, md5(array_to_string(w[pos:pos + 19], ' ')) AS seen FROM starts),
again AS (
  SELECT doc_id, pos FROM windows
  QUALIFY row_number() OVER (PARTITION BY seen ORDER BY doc_id, pos) > 1
),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM again),
lists AS (SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
         [w[i] FOR i IN range(1, len(w) + 1) IF gone IS NULL OR NOT list_contains(gone, i)] AS rest
  FROM words LEFT JOIN lists USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(rest, ' ')) AS kept_sha256 FROM kept
"""

OP11 = r"""
WITH doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
),
lengths AS (SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
item_terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
),
times AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms SEMI JOIN item_terms USING (term) GROUP BY doc_id, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM times, totals GROUP BY term
),
impacts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))) AS impact
  FROM times JOIN weights USING (term) JOIN lengths USING (doc_id), totals
),
scores AS (
  SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM item_terms JOIN impacts USING (term) GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""

OP12 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w]
    ELSE [w[i:i + 3] FOR i IN range(1, len(w) - 2)] END) AS shingle
  FROM words
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
numbered AS (SELECT doc_id, dense_rank() OVER (ORDER BY shingle) AS s FROM shingles),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM numbered a JOIN numbered b ON a.s = b.s AND a.doc_id < b.doc_id
    JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN edges l ON l.a = r.b)
SELECT a AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id
FROM reach LEFT JOIN sizes ON sizes.doc_id = reach.a
GROUP BY a
"""

OP13 = r"""
WITH RECURSIVE lowered AS (
  SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_text,
         -- The CRC-32 of the decimal id: eight shifts for each byte.
         xor(4294967295, list_reduce(list_prepend(4294967295, [ascii(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
             lambda s, i: CASE WHEN s % 2 = 1 THEN xor(3988292384, s // 2) ELSE s // 2 END))) AS crc
  FROM documents
),
leaves AS (
  SELECT row_number() OVER () AS rid, doc_id, source, crc,
         sha256(concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                       coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-'),
                       coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
         sha256(concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                       coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-'),
                       coalesce(strlen(text) || ':' || lower_text, '-'))) AS changed
  FROM lowered
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos FROM leaves
),
nodes AS (
  SELECT source, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY source) AS n FROM ranked
  UNION ALL
  SELECT source, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16
  FROM nodes WHERE n > 1 GROUP BY source, level, pos // 16
),
tops AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM nodes WHERE n = 1
),
upper AS (
  SELECT 0 AS level, pos, subroot AS digest, count(*) OVER () AS n FROM tops
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16
  FROM upper WHERE n > 1 GROUP BY level, pos // 16
),
whole AS (SELECT digest AS root FROM upper WHERE n = 1),
-- Levels of the sources' trees and, from 100 on, of the one above.
steps AS (
  SELECT r.rid, n.level, string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos < r.pos // power(16, n.level)::BIGINT) AS before,
         string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos > r.pos // power(16, n.level)::BIGINT) AS after
  FROM ranked r JOIN nodes n ON n.source IS NOT DISTINCT FROM r.source AND n.n > 1
    AND n.pos // 16 = r.pos // power(16, n.level + 1)::BIGINT
  GROUP BY r.rid, n.level
  UNION ALL
  SELECT r.rid, 100 + u.level, string_agg(u.digest, '' ORDER BY u.pos) FILTER (u.pos < t.pos // power(16, u.level)::BIGINT),
         string_agg(u.digest, '' ORDER BY u.pos) FILTER (u.pos > t.pos // power(16, u.level)::BIGINT)
  FROM ranked r JOIN tops t ON t.source IS NOT DISTINCT FROM r.source
    JOIN upper u ON u.n > 1 AND u.pos // 16 = t.pos // power(16, u.level + 1)::BIGINT
  GROUP BY r.rid, u.level
),
proofs AS (
  SELECT rid, sha256(string_agg(concat(before, after), '' ORDER BY level)) AS proof_sha256,
         list({'b': coalesce(before, ''), 'a': coalesce(after, '')} ORDER BY level) AS path
  FROM steps GROUP BY rid
),
folded AS (
  SELECT r.*, coalesce(proof_sha256, sha256('')) AS proof_sha256,
         list_reduce(list_prepend({'b': CASE WHEN crc % 5 = 0 THEN changed ELSE leaf END, 'a': ''}, coalesce(path, [])),
           lambda done, step: {'b': sha256(concat(step.b, done.b, step.a)), 'a': ''}).b AS folded_root
  FROM ranked r LEFT JOIN proofs USING (rid)
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM folded f JOIN tops t ON t.source IS NOT DISTINCT FROM f.source, whole
"""
