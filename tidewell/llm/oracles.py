"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from tidewell.llm import licenses

UPPER, LOWER = licenses.UPPER, licenses.LOWER

SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
firsts AS (SELECT t, min(doc_id) AS lo FROM windows GROUP BY t),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN firsts USING (t) WHERE doc_id > lo),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1)::BIGINT AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS m FROM (SELECT item_id, {_words("text")} AS w FROM benchmark) WHERE len(w) > 0),
patterns AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS t FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM b)),
places AS (SELECT doc_id, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS t FROM
  (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM patterns) WHERE len(w) >= m)),
hits AS (SELECT doc_id, i, m, item_id FROM places JOIN patterns USING (m, t)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(k, ',' ORDER BY k)) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

INTERACTIONS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS lo FROM d GROUP BY text),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, concat(CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
  CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) THEN 'C' END,
  CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > lo THEN 'E' END) AS fails,
  count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM d JOIN firsts USING (text) LEFT JOIN known USING (doc_id) GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT o, s, o[s] AS f, left(o, s - 1) AS before FROM orders, (SELECT unnest(range(1, 6)) AS s)),
told AS (SELECT part, o, s, f, n, good, toxic, contains(fails, f) AS failed, fails = f AS alone, translate(fails, before, '') = fails AS alive FROM cells, steps),
sums AS (SELECT part, o, s, f, sum(n) FILTER (alive AND NOT failed) AS kept, sum(n) FILTER (alive AND failed) AS removed, sum(n) FILTER (failed AND NOT alive) AS redundant,
  sum(n) FILTER (alone) AS unique_fails, sum(good) FILTER (alive AND failed) AS good_lost, sum(toxic) FILTER (alive AND failed) AS toxic_lost FROM told GROUP BY part, o, s, f)
SELECT part, o AS filter_order, s::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley FROM sums"""

URL_FILTER = f"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
outcomes AS (SELECT doc_id AS page_id, max((coalesce(quality = 0, false) OR coalesce(toxic = 1, false))::INT) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
counts AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM p LEFT JOIN outcomes USING (page_id) GROUP BY host),
bare AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS b FROM counts),
parts AS (SELECT *, string_split(b, '.') AS l, len(string_split(b, '.')) = 1 OR regexp_matches(b, '^[0-9.]+$|^\\[') AS alone FROM bare),
wides AS (SELECT *, len(l) > 2 AND length(l[-1]) = 2 AND l[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'ne', 'net', 'or', 'org') AS wide FROM parts),
h AS (SELECT host, n, bad, CASE WHEN alone THEN b ELSE array_to_string(l[-(CASE WHEN wide THEN 3 ELSE 2 END):], '.') END AS domain, CASE WHEN alone THEN b ELSE array_to_string(l[-(CASE WHEN wide THEN 2 ELSE 1 END):], '.') END AS suffix FROM wides),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1, 2),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY 1),
s AS (SELECT *, (sum(bad) OVER () - bad + 1) / (sum(n) OVER () - n + 2) AS prior FROM s0),
ks AS (SELECT {{0}} AS k FROM s),
dp AS (SELECT d.*, (k * s.prior + s.bad - d.bad) / (k + s.n - d.n) AS prior FROM d JOIN s USING (suffix), ks),
kd AS (SELECT {{0}} AS k FROM dp),
hp AS (SELECT h.*, (k * dp.prior + dp.bad - h.bad) / (k + dp.n - h.n) AS prior FROM h JOIN dp USING (domain), kd),
kh AS (SELECT {{0}} AS k FROM hp),
posterior AS (SELECT host, (k * prior + bad) / (k + n) AS mean, k + n AS weight FROM hp, kh),
reputation AS (SELECT host, CASE WHEN mean - 1.6449 * sqrt(mean * (1 - mean) / (weight + 1)) > 0.4 THEN 'block' ELSE 'allow' END AS reputation FROM posterior),
ruled AS (SELECT p.*, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' ELSE reputation END AS verdict FROM ruled JOIN reputation USING (host)""".format(
    "CASE WHEN coalesce(sum(n * (n - 1) * prior * (1 - prior)), 0) = 0 THEN 1 WHEN sum(pow(bad - n * prior, 2) - n * prior * (1 - prior)) * 10001 <= sum(n * (n - 1) * prior * (1 - prior)) THEN 10000 "
    "ELSE greatest(1, 1 / (sum(pow(bad - n * prior, 2) - n * prior * (1 - prior)) / sum(n * (n - 1) * prior * (1 - prior))) - 1) END"
)
