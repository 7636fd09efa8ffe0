"""DuckDB SQL for the queries that SQL can express.

The others are held against brute force in the tests: op1 and op8 (trained
models), op2 (its CRC-32 column has no SQL function), op3 (patterns with
look-behind and word contexts), op5 and op9 (edit and set similarity joins
with components).
"""

OP4 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM s),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
occ AS (SELECT doc_id, i, p.n, item_id FROM (SELECT doc_id, i, z.n, array_to_string(w[i:i + z.n - 1], ' ') AS gram FROM p, (SELECT DISTINCT n FROM win) z WHERE i + z.n - 1 <= len(w)) p JOIN win ON win.n = p.n AND win.gram = p.gram),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM occ) GROUP BY doc_id),
own AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM occ GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN own ON own.doc_id = d.doc_id
"""

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS first FROM p)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes,
array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(sha, 5 * (i // 4) + 1, 5))::BIGINT >> (5 * (3 - i % 4))) & 31 AS INT), 1)), '') AS payload_digest,
CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < first THEN first END AS refers_to FROM f
"""

OP7 = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, regexp_extract_all(text, '[\x20\x09-\x0D]+') AS gaps, regexp_matches(text, '^[\x20\x09-\x0D]') AS led FROM documents WHERE text <> ''),
q AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS raw, unnest(CASE WHEN led THEN gaps ELSE list_prepend('', gaps) END) AS gap FROM t),
o AS (SELECT doc_id, n, i, lower(raw) AS word, length(raw) AS chars, substr(md5(lower(raw)), 1, 8) = min(substr(md5(lower(raw)), 1, 8)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS ends, i = 1 OR contains(gap, chr(10)) AS line, sum(length(gap) + length(raw)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM q WHERE i <= n),
r AS (SELECT *, coalesce(lag(ends) OVER d, true) AS opens,
  coalesce(min(CASE WHEN ends THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 24 FOLLOWING AND UNBOUNDED FOLLOWING), n) AS last,
  coalesce(min(CASE WHEN line THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - 1, n) AS line_last FROM o WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT doc_id, i, last FROM r WHERE (opens OR line AND line_last - i < 19) AND n - i >= 24 UNION SELECT doc_id, i, line_last FROM r WHERE line AND line_last - i >= 19),
u AS (SELECT b.doc_id, b.i, b.last, min(stop - chars)::BIGINT AS start, max(stop)::BIGINT AS stop, string_agg(word, ' ' ORDER BY o.i) AS words FROM b JOIN o ON o.doc_id = b.doc_id AND o.i BETWEEN b.i AND b.last GROUP BY b.doc_id, b.i, b.last),
f AS (SELECT *, first_value(doc_id) OVER g AS first_doc_id, first_value(start) OVER g AS first_start FROM u WINDOW g AS (PARTITION BY words ORDER BY doc_id, start)),
k AS (SELECT *, CASE WHEN i > coalesce(max(last) OVER (PARTITION BY doc_id ORDER BY i, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) + 1 THEN 1 ELSE 0 END AS opens FROM f WHERE doc_id <> first_doc_id OR start <> first_start),
z AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i, last) AS span FROM k)
SELECT doc_id, min(start) AS start, max(stop) AS stop, (max(last) - min(i) + 1)::BIGINT AS n_words, arg_min(first_doc_id, i * 1000000000 + last) AS first_doc_id, arg_min(first_start, i * 1000000000 + last) AS first_start FROM z GROUP BY doc_id, span
"""

OP10 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, n, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS w FROM (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source)),
q AS (SELECT *, 1.5::DOUBLE * sum(n) OVER () - 2 * coalesce(sum(n) OVER (ORDER BY n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_all, sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_all, row_number() OVER (ORDER BY n / w, source) AS k FROM s),
z AS (SELECT k, rest_all, w_all FROM q WHERE rest_all * w / w_all <= 2 * n ORDER BY k LIMIT 1),
t AS (SELECT source, n, CASE WHEN q.k < coalesce((SELECT k FROM z), 1000000000) THEN 2.0::DOUBLE * n ELSE (SELECT rest_all FROM z) * w / (SELECT w_all FROM z) END AS target FROM q),
v AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END::BIGINT AS passes FROM t),
r AS (SELECT *, target - passes * n AS rest FROM v),
g AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
c AS (SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h) AS through FROM g),
o AS (SELECT r.source, min({'h': h, 't': through, 'n': c.n}) AS b, any_value(rest) AS rest FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source WHERE rest > 0 AND through > rest GROUP BY r.source),
x AS (SELECT source, CASE WHEN b.t - rest < rest - (b.t - b.n) THEN b.h + 1 ELSE b.h END AS cut FROM o)
SELECT d.doc_id, d.size, r.n AS source_size, r.target, (d.size * (r.passes + CASE WHEN x.cut IS NOT NULL AND d.h < x.cut THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN x ON x.source IS NOT DISTINCT FROM d.source
"""

OP12 = r"""
WITH l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN first < t.doc_id THEN 16 ELSE 0 END AS mask
  FROM t LEFT JOIN l ON l.doc_id = t.doc_id),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || d.c || e.c || g.c AS filter_order FROM x a, x b, x d, x e, x g WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
s AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit, coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::INT AS before FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o)),
r AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""

SQL: dict[str, str] = {"op12_filter_audit": OP12, "op4_decontamination": OP4, "op6_warc": OP6, "op7_line_hashes": OP7, "op10_mixture": OP10}
