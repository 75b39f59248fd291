"""DuckDB SQL for the queries of this package that SQL can express."""

OP2_MINHASH = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                               ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s
  FROM words
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.doc_id
), least_id AS (
  SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least_id USING (doc_id)
"""

OP7_WARC = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages
), q AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS head FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string([[substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 1 + 5 * g, 5) AS BIGINT) >> (15 - 5 * k)) & 31 AS BIGINT) + 1, 1) FOR k IN range(0, 4)]
    .array_to_string('') FOR g IN range(0, 8)], '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> head THEN head END AS refers_to
FROM q
"""

OP5_LATTICE = """
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0
), unit AS (
  SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS l FROM usable
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id
  WHERE list_inner_product(a.x, b.x) / (a.l * b.l) >= 0.95
), reach(vec_id, r) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.vec_id
), least_id AS (
  SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id
), degree AS (
  SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(d.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN least_id c ON c.vec_id = e.vec_id LEFT JOIN degree d ON d.vec_id = e.vec_id
"""

#: CTE crc_table: t, the list of the 256 steps of CRC-32.
_CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END, i) AS c FROM range(0, 256) AS r(i)
  )
)"""


def _crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text, beside crc_table."""
    codes = f"[CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT) FOR i IN range(0, octet_length(encode({text})))]"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


OP11_RESAMPLING = rf"""
WITH {_CRC_TABLE}, doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), doc_word AS (
  SELECT doc_id, unnest(w) AS word FROM doc_words
), target_word AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), buckets AS (
  SELECT word, {_crc32("word")} % 10000 AS b FROM (SELECT word FROM doc_word UNION SELECT word FROM target_word), crc_table
), source_count AS (
  SELECT b, count(*) AS s FROM doc_word JOIN buckets USING (word) GROUP BY b
), target_count AS (
  SELECT b, count(*) AS t FROM target_word JOIN buckets USING (word) GROUP BY b
), sums AS (
  SELECT CAST((SELECT count(*) FROM doc_word) AS DOUBLE) AS s_all, CAST((SELECT count(*) FROM target_word) AS DOUBLE) AS t_all
), gains AS (
  SELECT b, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (s_all + 10000) / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * (t_all + 10000)))) AS BIGINT) AS gain
  FROM source_count FULL JOIN target_count USING (b), sums
), weights AS (
  SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM doc_word JOIN buckets USING (word) JOIN gains USING (b) GROUP BY doc_id
), scored AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM doc_words LEFT JOIN weights USING (doc_id)
), ranked AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS r, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM ranked
"""

OP12_EXTRACTION = r"""
WITH articles AS (
  SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS a FROM pages
), plain AS (
  SELECT page_id, url, regexp_replace(regexp_replace(a, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS x FROM articles
), decoded AS (
  SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM plain
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM decoded
"""

OP13_TRIE = rf"""
WITH {_CRC_TABLE}, own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS x
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM own), crc_table
), built AS (
  SELECT ids.conv_id, 0 AS part, i, x FROM ids JOIN own ON own.conv_id = ids.base AND own.i < ids.h
  UNION ALL
  SELECT ids.conv_id, 1, i, x FROM ids JOIN own ON own.conv_id = ids.conv_id AND own.i >= ids.h
), sequences AS (
  SELECT ids.conv_id, coalesce(list(x ORDER BY part, i) FILTER (x IS NOT NULL), []) AS s FROM ids LEFT JOIN built ON built.conv_id = ids.conv_id GROUP BY ids.conv_id
), prefixes AS (
  SELECT conv_id, len(s) AS n, unnest(range(0, len(s) + 1)) AS d, s FROM sequences
), nodes AS (
  SELECT s[1:d] AS k, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d) AS ends,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(any_value(s[d].text)) END AS saved
  FROM prefixes GROUP BY s[1:d], d
), children AS (
  SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY k[1:d - 1], d - 1
), marked AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children ON children.k = nodes.k AND children.d = nodes.d
), above AS (
  SELECT k[1:a] AS k, a, n_children = 0 AS leaf, saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM marked)
), subtrees AS (
  SELECT k, a AS d, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY k, a
)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(m.n_convs AS BIGINT) AS n_convs, CAST(m.n_children AS BIGINT) AS n_children,
  CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM marked m JOIN subtrees t ON t.k = m.k AND t.d = m.d LEFT JOIN nodes p ON m.d > 0 AND p.d = m.d - 1 AND p.k = m.k[1:m.d - 1]
"""
