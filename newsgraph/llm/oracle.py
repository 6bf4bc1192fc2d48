"""SQL twins for DuckDB of the queries of this folder that SQL can express."""

OP2 = r"""
WITH t AS (
  SELECT doc_id,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
), g AS (SELECT norm, count(*) AS group_size, max(doc_id) AS keep_id FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept,
       sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)
           / 4503599627370496.0::DOUBLE AS draw
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k FROM s
), c AS (
  SELECT *, sum(source_size * 2.0::DOUBLE) OVER (ORDER BY k) - source_size * 2.0::DOUBLE AS stopped,
         sum(weight) OVER () - sum(weight) OVER (ORDER BY k) + weight AS open_weight,
         sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM r
), l AS (SELECT max((total - stopped) / open_weight) AS level FROM c),
t AS (
  SELECT c.source, c.source_size, least(c.source_size * 2.0::DOUBLE, l.level * c.weight)::DOUBLE AS target
  FROM c, l
), p AS (
  SELECT d.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       size * (CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM p
"""

OP5 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
       CAST(sum(20 + length(role) + length(text)
           + len(regexp_extract_all(role, '[<\[]\\*(s>|INST\]|/INST\]|/s>)'))
           + len(regexp_extract_all(text, '[<\[]\\*(s>|INST\]|/INST\]|/s>)'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

OP7 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html)
SELECT p.page_id, strlen(p.html) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((CAST('0x' || substr(p.hex, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31), 1)
           FOR k IN range(32)], '') AS payload_digest,
       CASE WHEN p.page_id IS NOT DISTINCT FROM g.first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id IS DISTINCT FROM g.first_id THEN g.first_id END AS refers_to
FROM p JOIN g ON p.html = g.html
"""

OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)
), own AS (SELECT DISTINCT n, win FROM win),
pos AS (
  SELECT rid, k, n, array_to_string(w[k : k + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), met AS (SELECT rid, k, pos.n, pos.win FROM pos JOIN own ON pos.win = own.win AND pos.n = own.n),
hit AS (
  SELECT rid, count(DISTINCT spot) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS spot FROM met) GROUP BY rid
), named AS (
  SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM met JOIN win USING (win)) WHERE id IS NOT NULL
  GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""

OP12 = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS donor,
         xor(4294967295, list_reduce([4294967295] || flatten([[ascii(x), -1, -1, -1, -1, -1, -1, -1, -1]
             FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
           lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a // 2, (a % 2) * 3988292384) END)) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.donor WHERE pos <= h
  UNION ALL SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE pos > h
), s AS (
  SELECT c.conv_id, coalesce(path, []) AS path
  FROM c LEFT JOIN (SELECT conv_id, list([role, text] ORDER BY pos) AS path FROM r GROUP BY conv_id) q USING (conv_id)
), p AS (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM s),
n AS (
  SELECT path[1:depth] AS pre, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         CASE WHEN depth = 0 THEN 0 ELSE length(path[1:depth][-1][2]) END AS chars
  FROM p GROUP BY ALL
), kids AS (SELECT pre[1:depth - 1] AS pre, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids ON n.pre = kids.pre),
sub AS (
  SELECT pre[1:k] AS pre, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * chars) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM m) GROUP BY 1
), ends AS (SELECT path AS pre, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM s GROUP BY path)
SELECT m.conv_id, m.depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM m JOIN sub ON sub.pre = m.pre LEFT JOIN ends ON ends.pre = m.pre
LEFT JOIN m up ON m.depth > 0 AND up.pre = m.pre[1:m.depth - 1]
"""

OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), g AS (SELECT DISTINCT lang, source FROM d),
c AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS docs
  FROM (SELECT rid, lang, source, unnest(w) AS term FROM d) GROUP BY ALL
), k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
t AS (SELECT lang, source, sum(c.n) AS total FROM c JOIN k USING (lang, term) GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * v.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 5)) // (v.total + 5 * v.v) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM r WHERE part = 'pair' OR rank <= 50
"""

LLM_ORACLE: dict[str, str] = {
    "op2_exact_dedup": OP2,
    "op5_chat_format": OP5,
    "op7_warc_zip": OP7,
    "op10_mixing": OP10,
    "op11_decontamination": OP11,
    "op12_prefix_trie": OP12,
    "op13_divergence": OP13,
}
