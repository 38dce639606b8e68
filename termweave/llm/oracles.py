"""What SQL can say of the opN_ queries, for DuckDB. It looks at all pairs and windows, so it is meant for small tables."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

NEAR_DEDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS.format(_LOWER.format("text"))}, []) w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END s FROM w),
e AS (SELECT doc_id, unnest(s) x FROM s), n AS (SELECT doc_id, len(s) n FROM s),
c AS (SELECT a.doc_id a, b.doc_id b, count(*) k FROM e a JOIN e b USING (x) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id a, doc_id b FROM n UNION SELECT r.a, g.b FROM r JOIN g ON g.a = r.b)
SELECT n.doc_id, CAST(n AS BIGINT) n_shingles, m.component_id, n.doc_id = m.component_id kept FROM n JOIN (SELECT a doc_id, min(b) component_id FROM r GROUP BY 1) m USING (doc_id)"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages), d AS (SELECT page_id, strlen(h) payload_bytes, sha1(h) x, min(page_id) OVER (PARTITION BY h) f FROM p),
b AS (SELECT *, array_to_string(list_transform(range(40), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][1 + strpos('0123456789abcdef', substr(x, CAST(i + 1 AS INT), 1)) - 1]), '') bits FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, CAST(5 * i + 1 AS INT), 1) AS INT) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS INT), 1) AS INT) + 4 * CAST(substr(bits, CAST(5 * i + 3 AS INT), 1) AS INT) + 2 * CAST(substr(bits, CAST(5 * i + 4 AS INT), 1) AS INT) + CAST(substr(bits, CAST(5 * i + 5 AS INT), 1) AS INT), 1)), '') payload_digest,
  CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END record_type, CASE WHEN f <> page_id THEN f END refers_to FROM b"""

DECONTAMINATION = f"""
WITH b AS (SELECT item_id, {_ALNUM.format(_LOWER.format("text"))} w FROM benchmark WHERE text IS NOT NULL), i AS (SELECT *, least(10, len(w)) n FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') k FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) s FROM i)),
d AS (SELECT doc_id, coalesce({_ALNUM.format(_LOWER.format("text"))}, []) w FROM documents),
v AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) s FROM d, (SELECT DISTINCT n FROM i))),
h AS (SELECT doc_id, v.n, s, item_id FROM v JOIN k ON v.n = k.n AND v.k = k.k),
c AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) x FROM h GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(x, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) w FROM documents),
v AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) s FROM d WHERE len(w) >= 20)),
l AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) n FROM v) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) p FROM l),
e AS (SELECT doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) p FROM d),
q AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) x, count(*) n FROM e ANTI JOIN g USING (doc_id, p) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) n_removed, sha256(coalesce(x, '')) kept_sha256 FROM d LEFT JOIN q USING (doc_id)"""

ORACLE_SQL = {"op4_near_dedup": NEAR_DEDUP, "op6_warc": WARC, "op8_decontamination": DECONTAMINATION, "op9_substring_dedup": SUBSTRING_DEDUP}
