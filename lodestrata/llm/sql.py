"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED_LOWER = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x20\x09-\x0D]+')"
_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

URLS = f"""
WITH a AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, rest, coalesce({_LOWER.format("regexp_extract(rest, '^[^/?#]*')")}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(regexp_extract(rest, '^[^#]*'), '\\?((?s:.*))$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)='))), '&') AS query FROM a),
c AS (SELECT *, CASE WHEN rest IS NOT NULL THEN regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical FROM b),
r AS (SELECT c.*, x.rule, x.verdict AS ruled, x.size FROM c LEFT JOIN (VALUES ('net', '/', 'net/', 'block', 4), ('example.net', '/en/', 'example.net/en/', 'allow', 15), ('example.com', '/de/', 'example.com/de/', 'block', 15), ('org', '/fr/', 'org/fr/', 'allow', 7)) x(h, p, rule, verdict, size)
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
l AS (SELECT DISTINCT canonical FROM c WHERE page_id % 50 = 0 AND canonical IS NOT NULL),
o AS (SELECT page_id, any_value(host) AS host, any_value(path) AS path, any_value(canonical) AS canonical, arg_max(rule, size) AS rule, arg_max(ruled, size) AS ruled FROM r GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN canonical IN (FROM l) THEN 'block' ELSE 'allow' END) AS verdict, coalesce(canonical IN (FROM l), false) AS listed FROM o
"""

DECONTAMINATION = f"""
WITH b AS (SELECT item_id, {_ALNUM} AS ws FROM benchmark),
s AS (SELECT item_id, ws, least(len(ws), 13) AS n FROM b WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, n, list_slice(ws, i + 1, i + n) AS k FROM (SELECT *, unnest(range(0, len(ws) - n + 1)) AS i FROM s)),
d AS (SELECT doc_id, {_ALNUM} AS ws FROM documents),
p AS (SELECT doc_id, n, i, list_slice(ws, i + 1, i + n) AS k FROM (SELECT doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM w) WHERE len(ws) >= n)),
h AS (SELECT p.doc_id, p.i, p.n, w.item_id FROM p JOIN w ON p.n = w.n AND p.k = w.k),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED_LOWER} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, hash(k) AS h, k FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [ws] ELSE list_transform(range(0, len(ws) - 4), lambda i: list_slice(ws, i + 1, i + 5)) END) AS k FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.h = b.h AND a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT node AS doc_id, coalesce(n, 0) AS n_shingles, component_id, node = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = node
"""

_BITS = "array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', substr(sha, i::BIGINT, 1)) - 1), 4, '0')), '')"
WARC = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
b AS (SELECT *, {_BITS} AS bits, min(page_id) OVER (PARTITION BY sha) AS first FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(0, 5), lambda k: (16 >> k) * (substr(bits, 5 * j + k + 1, 1)::BIGINT)))::BIGINT, 1)), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""

WORDS = f"""
WITH d AS (SELECT doc_id, {_SPACED} AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(list_slice(ws, i + 1, i + 20), ' ') AS k FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 19)) AS i FROM d WHERE len(ws) >= 20)),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM w) WHERE nth > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM g),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos FROM d),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM x ANTI JOIN c ON c.doc_id = x.doc_id AND c.pos = x.pos GROUP BY x.doc_id),
r AS (SELECT doc_id, count(*) AS n_removed FROM c GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""

BYTES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM w) WHERE first < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM g),
x AS (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS pos FROM d),
k AS (SELECT x.doc_id, string_agg(substr(h, 2 * x.pos + 1, 2), '' ORDER BY x.pos) AS kept FROM x ANTI JOIN c ON c.doc_id = x.doc_id AND c.pos = x.pos GROUP BY x.doc_id),
r AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (gap) AS n_spans FROM (SELECT doc_id, coalesce(pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) > 1, true) AS gap FROM c) GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""

DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT doc, lang, source, unnest(ws) AS t FROM d),
k AS (SELECT lang, t FROM w GROUP BY lang, t HAVING count(DISTINCT doc) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, t, count(*)::HUGEINT AS n FROM w SEMI JOIN k ON k.lang = w.lang AND k.t = w.t GROUP BY ALL),
s AS (SELECT lang, source, sum(n)::HUGEINT AS s FROM c GROUP BY ALL),
l AS (SELECT lang, sum(s)::HUGEINT AS s FROM s GROUP BY lang),
q AS (SELECT k.lang, k.t, 1 + 1000000000::HUGEINT * (sum(n)::HUGEINT + 5) // (l.s + 5 * v.v) AS q FROM k JOIN c ON c.lang = k.lang AND c.t = k.t JOIN l ON l.lang = k.lang JOIN v ON v.lang = k.lang GROUP BY k.lang, k.t, l.s, v.v),
p AS (SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (coalesce(s.s, 0) + 5 * v.v) AS p
    FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    UNION ALL SELECT p.lang, p.source, 'term', p.t, (p - q)::BIGINT FROM p JOIN q ON q.lang = p.lang AND q.t = p.t WHERE n > 0 AND p > q)
SELECT * FROM (SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INTEGER AS rank FROM r) WHERE part = 'pair' OR rank <= 50
"""

PHRASES = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
f AS (SELECT lang, k, count(*)::HUGEINT AS f FROM (SELECT lang, unnest(list_transform(range(0, len(ws) - size + 1), lambda i: list_slice(ws, i + 1, i + size))) AS k FROM w, (VALUES (1), (2), (3)) s(size)) GROUP BY ALL),
c AS (SELECT lang, k, f AS a FROM f WHERE len(k) > 1 AND f >= 10),
u AS (SELECT c.lang, c.k, c.a, cut, list_slice(k, 1, cut) AS x, list_slice(k, cut + 1, len(k)) AS y FROM (SELECT *, unnest(range(1, len(k))) AS cut FROM c) c),
s AS (SELECT u.lang, u.k, u.a, cut, x.f AS l, y.f AS r, 1000000::HUGEINT * u.a * u.a // (x.f * y.f) AS score FROM u JOIN f x ON x.lang = u.lang AND x.k = u.x JOIN f y ON y.lang = u.lang AND y.k = u.y),
b AS (SELECT lang, k, a, arg_min(l, (score, cut)) AS l, arg_min(r, (score, cut)) AS r, min(score) AS score FROM s GROUP BY ALL),
o AS (SELECT lang, list_slice(k, i, i + 1) AS k, max(a) AS a FROM (SELECT lang, k, a, unnest([1, 2]) AS i FROM c WHERE len(k) = 3) GROUP BY ALL),
t AS (SELECT b.lang, array_to_string(b.k, ' ') AS phrase, b.a, l, r, score FROM b LEFT JOIN o ON o.lang = b.lang AND o.k = b.k WHERE o.a IS NULL OR 100 * o.a < 50 * b.a)
SELECT t.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM t) t JOIN n ON n.lang = t.lang WHERE rank <= 2000
"""

SQL = {
    "op4_url_filter": URLS,
    "op5_decontamination": DECONTAMINATION,
    "op6_minhash_dedup": NEAR,
    "op8_warc": WARC,
    "op9_substring_dedup": WORDS,
    "op10_suffix_dedup": BYTES,
    "op12_source_divergence": DIVERGENCE,
    "op13_phrase_mining": PHRASES,
}
