"""SQL counterparts (DuckDB) of the queries that SQL can express, each written from the definition."""

from __future__ import annotations

from knownthen.llm.queries import URL_RULES

WORD = r"[^\x20\x09-\x0D]+"


def _round(k: int) -> str:
    """Consensus of the variants still open, and who agrees with it."""
    before = "crowded" if k == 0 else f"fits{k - 1} WHERE NOT fits"
    return f"""
open{k} AS (SELECT leaf, line, tokens, docs FROM {before}),
vote{k} AS (SELECT leaf, p, tokens[p] AS token, sum(docs) AS votes
            FROM (SELECT leaf, tokens, docs, unnest(range(1, len(tokens) + 1)) AS p FROM open{k}) GROUP BY ALL),
best{k} AS (SELECT leaf, p, token FROM vote{k}
            QUALIFY row_number() OVER (PARTITION BY leaf, p ORDER BY votes DESC, encode(token) DESC) = 1),
fits{k} AS (SELECT leaf, line, tokens, docs, 100 * hits >= 70 * len(tokens) AS fits
            FROM (SELECT o.leaf, o.line, any_value(o.tokens) AS tokens, any_value(o.docs) AS docs, count(*) FILTER (o.tokens[b.p] = b.token) AS hits
                  FROM open{k} o JOIN best{k} b USING (leaf) GROUP BY o.leaf, o.line)),"""


OP2 = rf"""
WITH raw AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
one AS (SELECT r, doc_id, i, trim(regexp_replace(ls[i], '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS plain FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM raw)),
line AS (SELECT *, string_split(line, ' ') AS tokens, len(string_split(line, ' '))::VARCHAR || ' ' || array_to_string(string_split(line, ' ')[:3], ' ') AS leaf
         FROM (SELECT r, doc_id, i, regexp_replace(plain, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS line FROM one) WHERE len(string_split(line, ' ')) >= 3),
seen AS (SELECT DISTINCT leaf, line, doc_id FROM line),
variant AS (SELECT leaf, line, string_split(line, ' ') AS tokens, count(*) AS docs FROM seen GROUP BY leaf, line),
crowded AS (SELECT * FROM variant QUALIFY count(*) OVER (PARTITION BY leaf) > 1 AND sum(docs) OVER (PARTITION BY leaf) >= 4),
{_round(0)}{_round(1)}
shared AS (SELECT line, leaf || ' 0' AS template FROM fits0 WHERE fits UNION ALL SELECT line, leaf || ' 1' FROM fits1 WHERE fits),
named AS (SELECT DISTINCT coalesce(template, 'line ' || line) AS template, line, doc_id FROM seen LEFT JOIN shared USING (line)),
often AS (SELECT template, min(doc_id) AS first FROM named GROUP BY template HAVING count(DISTINCT doc_id) >= 4),
gone AS (SELECT DISTINCT r, i FROM line JOIN named USING (line, doc_id) JOIN often USING (template) WHERE line.doc_id <> first),
gaps AS (SELECT r, list(i) AS gone FROM gone GROUP BY r)
SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string([ls[x] FOR x IN range(1, len(ls) + 1) IF NOT list_contains(gone, x)], chr(10)) END AS text,
       coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped
FROM raw LEFT JOIN gaps USING (r)
"""

OP5 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{WORD}') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
l AS (SELECT *, list_filter(ls, lambda x:
         regexp_matches(x, '[.!?…:;,][\x22''”’»)\]]*[\x20\x09-\x0D]*$')
         AND len(regexp_replace(x, '[^|›»→]', '', 'g')) <= 2
         AND len(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) * 100 <= len(x) * 10
         AND NOT (len(x) <= 200 AND regexp_matches(lower(x), 'cookie|javascript|privacy policy|terms of (use|service)|all rights reserved|copyright|licensed under|released under|subscribe|sign up|log ?in|click here|read more|skip to|lorem ipsum'))
       ) AS good FROM w),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: len(x))), 0)::BIGINT AS word_chars,
             len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             array_to_string(good, chr(10)) AS cleaned_text, len(array_to_string(ls, chr(10))) AS total
      FROM l LEFT JOIN cov USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND len(cleaned_text) * 100 >= total * 50 AS kept,
       cleaned_text FROM m
"""

OP9 = r"""
WITH word AS (SELECT '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS re, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), up, low), re) AS ws FROM documents, word),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), up, low), re) AS ws FROM benchmark, word),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS w
       FROM (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS w
       FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
m AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, w)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM m) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

OP10 = rf"""
WITH rules(action, host, path) AS (VALUES {URL_RULES}),
p AS (SELECT row_number() OVER () AS r, page_id, coalesce(regexp_extract(url, '^.*?://([^?#]*)', 1, 's'), '') AS rest FROM pages),
h AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             CASE WHEN contains(rest, '/') THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM p)
SELECT page_id, any_value(h.host) AS host, any_value(h.path) AS path,
       max_by(rules.host || rules.path, len(rules.host || rules.path)) AS rule,
       coalesce(max_by(rules.action, len(rules.host || rules.path)), 'allow') AS verdict
FROM h LEFT JOIN rules ON (h.host = rules.host OR ends_with(h.host, '.' || rules.host)) AND starts_with(h.path, rules.path)
GROUP BY r, page_id
"""


OP11 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             (CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END)
             || (CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) THEN 'C' ELSE '' END)
             || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS fails
      FROM w LEFT JOIN l USING (doc_id)),
cell AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
           WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
met AS (SELECT part, filter_order, step, fails, n, good, toxic, filter_order[step] AS x,
               list_min(list_transform(string_split(fails, ''), lambda y: strpos(filter_order, y))) AS gone FROM cell, steps),
res AS (SELECT part, filter_order, step, any_value(x) AS x,
               coalesce(sum(n) FILTER (fails = '' OR gone > step), 0) AS kept, coalesce(sum(n) FILTER (fails <> '' AND gone = step), 0) AS removed,
               coalesce(sum(n) FILTER (contains(fails, x) AND gone < step), 0) AS redundant, coalesce(sum(n) FILTER (fails = x), 0) AS unique_fails,
               coalesce(sum(good) FILTER (fails <> '' AND gone = step), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails <> '' AND gone = step), 0) AS toxic_lost
        FROM met GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM res
"""

OP12 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, body, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM p),
v AS (SELECT *, list_transform(range(0, 32), lambda i: (('0x' || substr(hex, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) AS five FROM h)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
       array_to_string(list_transform(five, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to
FROM v
"""


OP13 = """
WITH v AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.anchor_id, p.other AS positive_id, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other)::INTEGER AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2, "op5_quality_rules": OP5, "op9_decontamination": OP9, "op10_url_filter": OP10, "op11_filter_audit": OP11,
            "op12_warc": OP12, "op13_hard_negatives": OP13}
