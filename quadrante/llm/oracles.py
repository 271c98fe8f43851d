"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

OP2 = r"""
WITH docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), grams AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS gram
  FROM items, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(k) WHERE len(w) > 0
), windows AS (
  SELECT doc_id, k, size, array_to_string(w[k:k + size - 1], ' ') AS gram
  FROM docs, (SELECT DISTINCT size FROM grams), unnest(range(1, len(w) - size + 2)) AS t(k) WHERE len(w) >= size
), hits AS (
  SELECT doc_id, k, windows.size, item_id FROM windows JOIN grams USING (gram, size)
), marked AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(k, k + size)) AS t(p) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP8 = r"""
WITH marked AS (
  SELECT doc_id, text, list_filter(string_split(regexp_replace(text, '(@L|[^@S@R]+)', chr(57344) || '\1', 'g'), chr(57344)), lambda w: w <> '') AS ws
  FROM documents WHERE text <> ''
), listed AS (
  SELECT doc_id, text, CASE WHEN len(ws) > 1 AND regexp_full_match(ws[1], '[@S]*') THEN list_prepend(ws[1] || ws[2], ws[3:]) ELSE ws END AS ws FROM marked
), words AS (
  SELECT doc_id, k, ws[k] AS w, lower(regexp_extract(ws[k], '@L|[^@S@R]+')) AS word, length(ws[k]) AS size,
    regexp_extract(ws[k - 1], '[@S]*$') AS gap,
    regexp_full_match(ws[k], '[@S]*') AS blank
  FROM listed, unnest(range(1, len(ws) + 1)) AS t(k)
), starts AS (
  SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY k) - size AS start, left(md5(word), 16) AS h,
    k = 1 OR gap LIKE '%' || chr(10) || '%' AS head
  FROM words WHERE NOT blank
), united AS (
  SELECT *, count(*) FILTER (WHERE head) OVER (PARTITION BY doc_id ORDER BY k) AS unit FROM starts
), windowed AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY k) AS place,
    min(struct_pack(h := h, back := -k)) OVER (PARTITION BY doc_id, unit ORDER BY k ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS least FROM united
), cuts AS (
  SELECT DISTINCT doc_id, 1 - least.back AS k FROM windowed WHERE place >= 15
), headed AS (
  SELECT u.*, u.head OR c.k IS NOT NULL AS begins FROM united u LEFT JOIN cuts c USING (doc_id, k)
), numbered AS (
  SELECT *, count(*) FILTER (WHERE begins) OVER (PARTITION BY doc_id ORDER BY k) AS piece FROM headed
), pieces AS (
  SELECT doc_id, piece, min(start) AS start, max(start + size) AS stop, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS norm
  FROM numbered GROUP BY doc_id, piece
), summed AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY piece) AS upto, sum(n) OVER (PARTITION BY doc_id ORDER BY piece) - n AS since FROM pieces
), pairs AS (
  SELECT x.doc_id, x.piece AS a, y.piece AS b FROM summed x ASOF JOIN summed y ON x.doc_id = y.doc_id AND x.since + 20 <= y.upto
  UNION
  SELECT y.doc_id, x.piece, y.piece FROM summed y ASOF JOIN summed x ON x.doc_id = y.doc_id AND y.upto - 20 >= x.since
), spelled AS (
  SELECT r.doc_id, a, b, min(p.start) AS start, max(p.stop) AS stop, string_agg(p.norm, ' ' ORDER BY p.piece) AS norm
  FROM pairs r JOIN pieces p ON p.doc_id = r.doc_id AND p.piece BETWEEN a AND b GROUP BY r.doc_id, a, b
), ranked AS (
  SELECT *, rank() OVER (PARTITION BY norm ORDER BY doc_id, start) > 1 AS later FROM spelled
), gone AS (
  SELECT DISTINCT p.doc_id, p.piece, p.start, p.stop FROM ranked r JOIN pieces p ON p.doc_id = r.doc_id AND p.piece BETWEEN a AND b WHERE later
), runs AS (
  SELECT doc_id, min(start) AS a, max(stop) AS b FROM (
    SELECT *, piece - row_number() OVER (PARTITION BY doc_id ORDER BY piece) AS run FROM gone) GROUP BY doc_id, run
), spans AS (
  SELECT doc_id, sum(b - a) AS n_removed, string_agg(CAST(a AS BIGINT) || '-' || CAST(b AS BIGINT), ',' ORDER BY a) AS removed_spans FROM runs GROUP BY doc_id
), kept AS (
  SELECT n.doc_id, coalesce(string_agg(n.w, '' ORDER BY n.k) FILTER (WHERE g.piece IS NULL), '') AS text
  FROM numbered n LEFT JOIN gone g USING (doc_id, piece) GROUP BY n.doc_id
)
SELECT doc_id, coalesce(kept.text, documents.text) AS text, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  coalesce(removed_spans, '') AS removed_spans
FROM documents LEFT JOIN kept USING (doc_id) LEFT JOIN spans USING (doc_id)
"""
# White space, and letters of scripts that set no blanks between words.
_SPACES = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_LETTERS = r"\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
OP8 = OP8.replace("@L", f"[{_LETTERS}]").replace("@S", _SPACES).replace("@R", _LETTERS)

OP3 = r"""
WITH rows AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS place,
    coalesce(strlen(text), 0) AS bytes FROM documents
), buckets AS (
  SELECT depth, place >> (60 - depth) AS prefix, sum(bytes) AS total, count(DISTINCT place) AS places
  FROM rows, unnest(range(0, 61)) AS t(depth) GROUP BY ALL
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, place) - 1 AS n, row_number() OVER () AS id FROM rows
), placed AS (
  SELECT id, doc_id, bytes, n, min(struct_pack(depth := depth, prefix := prefix, total := total)) AS b
  FROM numbered JOIN buckets ON buckets.prefix = place >> (60 - depth) WHERE total <= 1048576 OR places = 1 GROUP BY ALL
)
SELECT doc_id, CAST(b.depth AS BIGINT) AS depth, b.prefix AS prefix,
  CASE WHEN b.total > 1048576 THEN n // greatest(1, 1048576 // greatest(bytes, 1)) ELSE 0 END AS overflow, bytes FROM placed
"""


OP11 = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, count(*) AS length,
    xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT for x in string_split(conv_id::VARCHAR, '')]),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 9 AS h
  FROM turns GROUP BY conv_id
), plans AS (
  SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.length, 0)) AS taken FROM convs c LEFT JOIN convs b ON b.conv_id = c.base
), rebuilt AS (
  SELECT p.conv_id, t.place AS depth, t.role, t.text FROM plans p JOIN turns t ON t.conv_id = p.base AND t.place <= p.taken
  UNION ALL
  SELECT p.conv_id, t.place - p.h + p.taken, t.role, t.text FROM plans p JOIN turns t ON t.conv_id = p.conv_id AND t.place > p.h
), keyed AS (
  SELECT conv_id, depth, strlen(text) AS n_bytes,
    string_agg(md5(role) || md5(text), '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS k
  FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM plans
), sized AS (
  SELECT *, max(depth) OVER (PARTITION BY conv_id) AS size, min(conv_id) OVER (PARTITION BY k) AS node FROM keyed
), nodes AS (
  SELECT node, depth, count(*) AS n_convs, (count(*) - 1) * any_value(n_bytes) AS own, coalesce(any_value(k), '') AS k,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = size), '')) AS ends_sha256
  FROM sized GROUP BY node, depth
), linked AS (
  SELECT n.*, p.node AS parent FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.k = left(n.k, 64 * (n.depth - 1))
), children AS (
  SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL
), weighed AS (
  SELECT l.*, coalesce(c.n_children, 0) AS n_children FROM linked l LEFT JOIN children c USING (node, depth)
), totals AS (
  SELECT s.node, s.depth, count(*) FILTER (WHERE w.n_children = 0) AS n_leaves, sum(w.own) AS saved
  FROM weighed w JOIN sized s ON s.conv_id = w.node AND s.depth <= w.depth GROUP BY s.node, s.depth
)
SELECT node::BIGINT AS conv_id, depth::BIGINT AS depth, parent::BIGINT AS parent_conv_id, n_convs, n_children, n_leaves,
  saved::BIGINT AS saved_tokens, ends_sha256
FROM weighed JOIN totals USING (node, depth)
"""


def statements() -> dict[str, str]:
    return {"op2_decontaminate": OP2, "op3_sharding": OP3, "op8_substring_dedup": OP8, "op11_conversation_trie": OP11}
