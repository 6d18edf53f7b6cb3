"""SQL of another engine for the operators that SQL can express."""

from __future__ import annotations

URL_REPUTATION = r"""
WITH cut AS (
  SELECT page_id, url,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS after
  FROM pages),
parts AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(after, '^[^/?#]*', 0), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(after, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut),
marked AS (
  SELECT p.host, CASE WHEN l.toxic = 1 OR l.quality = 0 THEN 1 ELSE 0 END AS bad
  FROM parts p JOIN labels l
    ON l.doc_id = TRY_CAST(nullif(regexp_extract(p.url, '/([0-9]{1,18})(\.html|/)?([?#].*)?$', 1), '') AS BIGINT)
  WHERE p.host <> ''),
counted AS (SELECT host, count(*) AS n, sum(bad) AS x FROM marked GROUP BY host),
bare AS (
  SELECT *, regexp_replace(regexp_replace(host, '^[^@]*@', ''), '(:[0-9]*)?\.?$', '') AS b FROM counted),
hosts AS (
  SELECT host, n, x,
    CASE WHEN regexp_matches(b, '^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*)$') THEN 'ip' ELSE split_part(b, '.', -1) END AS suffix,
    CASE WHEN regexp_matches(b, '^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*)$') OR NOT contains(b, '.') THEN b
         ELSE split_part(b, '.', -2) || '.' || split_part(b, '.', -1) END AS domain
  FROM bare),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(x) AS x FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(x) AS x FROM domains GROUP BY ALL),
overall AS (SELECT sum(x) / CAST(sum(n) AS DOUBLE) AS m0 FROM suffixes),
s0 AS (SELECT s.*, m0 AS m FROM suffixes s, overall),
sk AS (SELECT 1 / least(greatest(CASE WHEN plain > 0 AND r > g THEN (spread / plain - g) / (r - g) ELSE 0.0001 END, 0.0001), 0.9) - 1 AS k
  FROM (SELECT sum(n * (x / n::DOUBLE - m) * (x / n::DOUBLE - m)) AS spread, sum(n * m * (1 - m)) / sum(n) AS plain, count(*) AS g, sum(n) AS r FROM s0)),
s1 AS (SELECT suffix, (x + k * m) / (n + k) AS m FROM s0, sk),
d0 AS (SELECT d.*, s1.m FROM domains d JOIN s1 USING (suffix)),
dk AS (SELECT 1 / least(greatest(CASE WHEN plain > 0 AND r > g THEN (spread / plain - g) / (r - g) ELSE 0.0001 END, 0.0001), 0.9) - 1 AS k
  FROM (SELECT sum(n * (x / n::DOUBLE - m) * (x / n::DOUBLE - m)) AS spread, sum(n * m * (1 - m)) / sum(n) AS plain, count(*) AS g, sum(n) AS r FROM d0)),
d1 AS (SELECT suffix, domain, (x + k * m) / (n + k) AS m FROM d0, dk),
h0 AS (SELECT h.*, d1.m FROM hosts h JOIN d1 USING (suffix, domain)),
hk AS (SELECT 1 / least(greatest(CASE WHEN plain > 0 AND r > g THEN (spread / plain - g) / (r - g) ELSE 0.0001 END, 0.0001), 0.9) - 1 AS k
  FROM (SELECT sum(n * (x / n::DOUBLE - m) * (x / n::DOUBLE - m)) AS spread, sum(n * m * (1 - m)) / sum(n) AS plain, count(*) AS g, sum(n) AS r FROM h0)),
everywhere AS (
  SELECT host, regexp_replace(regexp_replace(host, '^[^@]*@', ''), '(:[0-9]*)?\.?$', '') AS b
  FROM (SELECT DISTINCT host FROM parts WHERE host <> '') ANTI JOIN counted USING (host)),
unseen AS (
  SELECT host,
    CASE WHEN regexp_matches(b, '^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*)$') THEN 'ip' ELSE split_part(b, '.', -1) END AS suffix,
    CASE WHEN regexp_matches(b, '^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*)$') OR NOT contains(b, '.') THEN b
         ELSE split_part(b, '.', -2) || '.' || split_part(b, '.', -1) END AS domain
  FROM everywhere),
h1 AS (
  SELECT host, n, (x + k * m) / (n + k) AS m, n + k AS total FROM h0, hk
  UNION ALL
  SELECT host, 0, coalesce(d1.m, s1.m, m0), k
  FROM unseen LEFT JOIN d1 USING (suffix, domain) LEFT JOIN s1 USING (suffix), overall, hk),
known AS (SELECT host, n, m, greatest(m - 1.645 * sqrt(m * (1 - m) / (total + 1)), 0.0) AS bound,
    m - 1.645 * sqrt(m * (1 - m) / (total + 1)) > 0.35 AS blocked FROM h1),
ruled AS (
  SELECT p.*, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parts p)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN coalesce(blocked, false) THEN 'block' ELSE 'allow' END AS verdict,
  round(m, 6) AS posterior_mean, round(bound, 6) AS lower_bound, coalesce(n, 0) AS labelled
FROM ruled LEFT JOIN known USING (host)
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS v FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM shingles a JOIN shingles b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)
  UNION ALL SELECT b, a FROM common WHERE 100 * c >= 85 * (na + nb - c)),
reach AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id, m.component_id = s.doc_id AS kept
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)
"""

LINE_DEDUP = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    unnest(range(len(string_split(text, chr(10))))) AS line_no
  FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT doc_id, CAST(line_no AS INT) AS line_no, list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM raw),
placed AS (SELECT *, min((doc_id, line_no)) OVER (PARTITION BY w) AS first FROM lines WHERE len(w) > 0),
firsts AS (SELECT (doc_id, line_no) AS place, w, len(w) AS n FROM placed WHERE (doc_id, line_no) = first AND len(w) >= 8),
forms AS (
  SELECT place, unnest(list_concat(
    list_transform(range(1, n + 1), lambda i: array_to_string(list_concat(w[:i - 1], [chr(1)], w[i + 1:]), ' ')),
    list_transform(range(0, n + 1), lambda i: array_to_string(list_concat(w[:i], [chr(1)], w[i + 1:]), ' ')))) AS form
  FROM firsts),
near AS (
  SELECT place, min(least_place) AS first FROM (
    SELECT place, min(place) OVER (PARTITION BY form) AS least_place FROM forms) WHERE place <> least_place GROUP BY place)
SELECT doc_id, line_no, struct_extract(first, 1) AS first_doc_id, struct_extract(first, 2) AS first_line_no, 0 AS edits
FROM placed WHERE (doc_id, line_no) <> first
UNION ALL
SELECT struct_extract(place, 1), struct_extract(place, 2), struct_extract(first, 1), struct_extract(first, 2), 1 FROM near
"""

FILTER_AUDIT = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
marked AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM texts),
flags AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT m.part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
     'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
     'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(m.doc_id > least, false)} AS f
  FROM marked m LEFT JOIN flags l ON l.doc_id = m.doc_id),
lettered AS (
  SELECT part, good, toxic, list_filter([CASE WHEN f.A THEN 'A' END, CASE WHEN f.B THEN 'B' END, CASE WHEN f.C THEN 'C' END,
    CASE WHEN f.D THEN 'D' END, CASE WHEN f.E THEN 'E' END], lambda x: x IS NOT NULL) AS failed FROM fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter, string_split(substr(filter_order, 1, step - 1), '') AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
counted AS (SELECT part, good, toxic, failed, count(*) AS n FROM lettered GROUP BY ALL),
judged AS (
  SELECT part, filter_order, step, letter, n, good, toxic, list_contains(failed, letter) AS own,
    list_has_any(failed, earlier) AS gone, len(failed) AS k FROM counted, steps),
report AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (NOT own AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (own AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (own AND gone), 0) AS redundant, coalesce(sum(n) FILTER (own AND k = 1), 0) AS unique_fails,
    coalesce(sum(n) FILTER (own AND NOT gone AND good), 0) AS good_lost, coalesce(sum(n) FILTER (own AND NOT gone AND toxic), 0) AS toxic_lost
  FROM judged GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM report
"""

PREFIX_TRIE = r"""
WITH RECURSIVE bits(i, k, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc_of_byte AS (SELECT i, v FROM bits WHERE k = 8),
ids AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL),
crc(conv_id, s, place, c) AS (
  SELECT conv_id, s, 0, 4294967295 FROM ids
  UNION ALL SELECT conv_id, s, place + 1, xor(b.v, c >> 8)
  FROM crc JOIN crc_of_byte b ON b.i = xor(c & 255, ascii(substr(s, place + 1, 1))) WHERE place < length(s)),
heads AS (SELECT conv_id, xor(c, 4294967295) % 6 AS h, conv_id - conv_id % 100 AS base FROM crc WHERE place = length(s)),
plain AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({'key': md5(concat(length(role), ':', role, ':', text)), 'chars': length(text)}
    ORDER BY turn NULLS FIRST, role, md5(text)) AS turns
  FROM plain GROUP BY conv_id),
built AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[:CAST(h AS INT)], c.turns[CAST(h AS INT) + 1:]) AS turns
  FROM own c JOIN heads USING (conv_id) LEFT JOIN own b ON b.conv_id = base),
prefixes AS (
  SELECT conv_id, len(turns) AS length, unnest(range(len(turns) + 1)) AS depth, turns,
    list_transform(turns, lambda t: t.key) AS keys FROM built),
members AS (
  SELECT conv_id, length, depth, CASE WHEN depth = 0 THEN '' ELSE array_to_string(keys[:depth], '') END AS path,
    CASE WHEN depth = 0 THEN 0 ELSE turns[depth].chars END AS chars FROM prefixes),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (length = depth), '') AS ends
  FROM members GROUP BY path, depth),
children AS (SELECT substr(path, 1, 32 * CAST(depth - 1 AS INT)) AS path, count(*) AS children FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(c.children, 0) AS children FROM nodes n LEFT JOIN children c USING (path)),
below AS (
  SELECT a.path, sum(CASE WHEN b.children = 0 THEN 1 ELSE 0 END) AS leaves, sum((b.n - 1) * b.chars) AS saved
  FROM full_nodes a JOIN full_nodes b ON starts_with(b.path, a.path) GROUP BY a.path)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n AS n_convs, n.children AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_nodes n JOIN below USING (path)
LEFT JOIN nodes p ON n.depth > 0 AND p.path = substr(n.path, 1, 32 * CAST(n.depth - 1 AS INT))
"""
