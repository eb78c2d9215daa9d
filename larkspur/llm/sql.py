"""DuckDB twins of the queries that SQL can express over whole tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_TOKENS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op1_decontaminate"] = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TOKENS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_TOKENS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k + 1 : k + least(len(w), 10)], ' ') AS t
  FROM (SELECT item, w, unnest(range(greatest(1, len(w) - 9))) AS k FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM wins),
starts AS (SELECT r, w, unnest(range(len(w))) AS p FROM d WHERE len(w) > 0),
cand AS (SELECT r, p, n, array_to_string(w[p + 1 : p + n], ' ') AS t FROM starts, sizes WHERE p + n <= len(w)),
hits AS (SELECT c.r, c.p, c.n, wins.item FROM cand c JOIN wins ON c.t = wins.t AND c.n = wins.n),
words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

ORACLES["op8_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
g AS (SELECT body, max(page_id) AS top FROM p GROUP BY body),
x AS (SELECT page_id, octet_length(p.body) AS n, sha1(p.body) AS hex, top FROM p JOIN g ON p.body = g.body),
bits AS (SELECT *, ('0x' || hex) AS h FROM x)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST(list_reduce(list_transform(range(5), lambda j:
      (((strpos('0123456789abcdef', substr(hex, 1 + CAST(floor((5 * k + j) / 4) AS INTEGER), 1)) - 1) >> (3 - (5 * k + j) % 4)) & 1) << (4 - j)), lambda a, b: a + b) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM bits
"""

ORACLES["op11_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT r, doc_id, p, array_to_string(w[p + 1 : p + 13], ' ') AS t FROM (SELECT r, doc_id, w, unnest(range(len(w) - 12)) AS p FROM d WHERE len(w) > 12)),
least AS (SELECT t, min(doc_id) AS first FROM wins GROUP BY t),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 13)) AS q FROM wins JOIN least USING (t) WHERE first < doc_id),
places AS (SELECT r, q, w[q + 1] AS word FROM (SELECT r, w, unnest(range(len(w))) AS q FROM d)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY q) AS s FROM places ANTI JOIN gone USING (r, q) GROUP BY r),
counts AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN counts USING (r)
"""

ORACLES["op12_collocations"] = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
grams AS (SELECT lang, size, array_to_string(w[p + 1 : p + size], ' ') AS g, count(*) AS a
  FROM (SELECT lang, w, size, unnest(range(len(w) - size + 1)) AS p FROM pieces, range(1, 5) AS s(size) WHERE len(w) >= size) GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT lang, size, g, a, string_split(g, ' ') AS w FROM grams WHERE size > 1),
cuts AS (SELECT lang, size, g, a, w, unnest(range(1, size)) AS k FROM cand),
scores AS (SELECT c.lang, c.size, c.g, c.a, k, l.a AS l, r.a AS r, 2000000::HUGEINT * c.a // (l.a + r.a) AS score FROM cuts c
  JOIN grams l ON l.lang = c.lang AND l.g = array_to_string(c.w[1:k], ' ') JOIN grams r ON r.lang = c.lang AND r.g = array_to_string(c.w[k + 1 : c.size], ' ')),
best AS (SELECT lang, size, g, a, l, r, score FROM scores QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_parts AS (SELECT DISTINCT lang, g, a, array_to_string(w[p + 1 : p + m], ' ') AS part FROM (SELECT lang, g, a, w, size, m, unnest(range(size - m + 1)) AS p FROM cand, range(2, 4) AS s(m) WHERE m < size)),
absorbed AS (SELECT DISTINCT b.lang, b.g FROM best b JOIN inner_parts i ON i.lang = b.lang AND i.part = b.g WHERE 100 * i.a >= 80 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM best ANTI JOIN absorbed USING (lang, g))
SELECT lang, CAST(rank AS BIGINT) AS rank, g AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
