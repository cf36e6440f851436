"""DuckDB SQL for the queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op1_mix_sources"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         coalesce(('0x' || left(md5('mix:' || doc_id::VARCHAR), 15))::BIGINT, -1) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 4 * source_size AS stop, (3 * sum(source_size) OVER ())::BIGINT AS every FROM r),
p AS (SELECT *, stop::DOUBLE / w AS per FROM w),
l AS (SELECT *, every - coalesce((sum(stop) OVER (ORDER BY per, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) AS rest,
             (sum(w) OVER (ORDER BY per, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weights FROM p),
f AS (SELECT * FROM l WHERE rest::DOUBLE / weights <= per ORDER BY per, rank LIMIT 1),
t AS (SELECT l.source, l.source_size,
             CASE WHEN f.per IS NOT NULL AND (l.per > f.per OR (l.per = f.per AND l.rank >= f.rank))
                  THEN least((f.rest * l.w)::DOUBLE / (f.weights * 2)::DOUBLE, (2 * l.source_size)::DOUBLE) ELSE (2 * l.source_size)::DOUBLE END AS target
      FROM l LEFT JOIN f ON true),
x AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
             coalesce((sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
y AS (SELECT *, floor(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS whole FROM x)
SELECT doc_id, source, size, source_size, target,
       (whole * size + greatest(0, least(size, budget - whole * source_size - before)))::BIGINT AS taken
FROM y
"""

ORACLES["op2_chat_perspectives"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
s AS (SELECT t.*, p.perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS chat_role
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, '<|im_start|>' || chat_role || CASE WHEN chat_role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS header FROM s),
r AS (SELECT *, header || text || '<|im_end|>' || chr(10) AS rendered FROM h),
o AS (SELECT *, (sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, sha256(text) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS stop FROM r)
SELECT conv_id, perspective, turn, speaker, chat_role, rendered, stop - length(rendered) AS start, stop, chat_role = 'assistant' AS trained,
       CASE WHEN chat_role = 'assistant' THEN stop - length(rendered) + length(header) ELSE stop END AS mask_start, stop AS mask_stop
FROM o
"""

# Windows are joined as their words with one blank between, which no word holds.
ORACLES["op5_decontaminate"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT item_id, least(10, len(w)) AS size, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
x AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS s FROM v),
sizes AS (SELECT DISTINCT size FROM x),
p AS (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size),
m AS (SELECT p.doc_id, p.i, x.item_id, x.size FROM (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS s FROM p) p JOIN x USING (size, s)),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS q FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
