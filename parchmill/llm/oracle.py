"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

from parchmill.llm.license_scan import TEMPLATES

ORACLES: dict[str, str] = {}

ORACLES["op2_positional_index"] = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d CROSS JOIN (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hit_words AS (SELECT r, count(*) AS n_hit FROM (
  SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits)) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

ORACLES["op5_warc"] = r"""
WITH p AS (
  SELECT page_id, row_number() OVER () AS r, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS hex
  FROM pages),
five AS (
  SELECT *, list_transform(range(0, 4), lambda g: ('0x' || hex[g * 10 + 1:g * 10 + 10])::BIGINT) AS part FROM p),
text AS (
  SELECT *, array_to_string(list_transform(range(0, 32),
    lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((part[(k // 8 + 1)::INT] >> (35 - 5 * (k % 8))) & 31)::INT + 1, 1)), '')
    AS digest FROM five),
kept AS (
  SELECT *, first_value(r) OVER w AS of, first_value(page_id) OVER w AS of_page
  FROM text WINDOW w AS (PARTITION BY hex ORDER BY page_id DESC NULLS LAST, r DESC))
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN r = of THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN r <> of THEN of_page END AS refers_to
FROM kept
"""

_TEMPLATE_ROWS = ", ".join(
    "('{}', '{}')".format(name, text.replace("'", "''")) for name, texts in TEMPLATES.items() for text in texts
)

ORACLES["op8_license_scan"] = rf"""
WITH t AS (
  SELECT row_number() OVER () AS t, license,
         regexp_extract_all(lower(text), '[a-z0-9]+') AS w
  FROM (VALUES {_TEMPLATE_ROWS}) AS v(license, text)),
tg AS (SELECT t, license, w[i] || ' ' || w[i + 1] AS gram, count(*) AS often
       FROM (SELECT t, license, w, unnest(range(1, len(w))) AS i FROM t) GROUP BY ALL),
tn AS (SELECT t, license, sum(often)::BIGINT AS n FROM tg GROUP BY ALL),
parts AS (
  SELECT r, doc_id, i, regexp_extract_all(x[i], '[a-z0-9]+') AS w
  FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM (
    SELECT row_number() OVER () AS r, doc_id, regexp_split_to_array(regexp_replace(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\r\n]|[.!?;:][ \t]', chr(10), 'g'), '\n') AS x
    FROM documents))),
ends AS (SELECT r, doc_id, sum(len(w)) OVER (PARTITION BY r ORDER BY i) - len(w) AS a,
                sum(len(w)) OVER (PARTITION BY r ORDER BY i) AS b FROM parts WHERE len(w) > 0),
words AS (SELECT r, flatten(list(w ORDER BY i)) AS w FROM parts GROUP BY r),
grams AS (SELECT r, w[i] || ' ' || w[i + 1] AS gram, i - 1 AS place FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM words)),
hits AS (SELECT r, t, tg.gram, often, place FROM grams JOIN tg USING (gram)),
runs AS (
  SELECT s.r, s.doc_id, s.a::BIGINT AS a, e.b::BIGINT AS b, tn.t, tn.license, tn.n AS size
  FROM (SELECT DISTINCT r, t FROM hits) h JOIN tn USING (t) JOIN ends s USING (r)
  JOIN ends e ON e.r = s.r AND e.b > s.a AND e.b - s.a - 1 <= 2 * tn.n AND 2 * (e.b - s.a - 1) >= tn.n),
common AS (
  SELECT doc_id, r, a, b, t, license, size, least(count(*), max(often)) AS c
  FROM runs JOIN hits USING (r, t) WHERE place >= a AND place + 1 < b
  GROUP BY doc_id, r, a, b, t, license, size, gram),
scores AS (SELECT doc_id, r, a, b, license, max(dice) AS dice FROM (
  SELECT doc_id, r, a, b, license, 2.0::DOUBLE * sum(c) / (b - a - 1 + size) AS dice
  FROM common GROUP BY doc_id, r, a, b, t, license, size) WHERE dice >= 0.75 GROUP BY ALL)
SELECT doc_id, a AS first_word, b - a AS n_words, license, dice FROM scores
QUALIFY row_number() OVER (PARTITION BY r, a ORDER BY dice DESC, license, b - a) = 1
    AND row_number() OVER (PARTITION BY r, b ORDER BY dice DESC, license, b - a) = 1
"""

ORACLES["op11_tile_search"] = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_all FROM d WHERE len(w) > 0),
terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
tf AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf CROSS JOIN totals GROUP BY term),
impacts AS (
  SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len(d.w) * n_docs) // n_all)) AS impact
  FROM tf JOIN d USING (r) CROSS JOIN totals),
scores AS (
  SELECT item_id, r, doc_id, sum(weights.w * impact)::BIGINT AS score
  FROM terms JOIN impacts USING (term) JOIN weights USING (term) GROUP BY ALL),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""

ORACLES["op13_url_rules"] = r"""
WITH u AS (
  SELECT page_id, row_number() OVER () AS r,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
cut AS (
  SELECT page_id, r, translate(regexp_extract(rest, '(?s)^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
rules AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS v(verdict, h, p)),
fits AS (
  SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM cut JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM cut LEFT JOIN fits USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
