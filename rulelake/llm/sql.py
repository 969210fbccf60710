"""DuckDB SQL of those corpus queries that SQL can express, over whole tables and texts."""

#: Of texts that are equal without white space, the longest and then the smallest id stays.
EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY points DESC, doc_id)
"""

#: Equal sets form one class; classes that share a gram are counted, linked, and labelled by the smallest id they reach.
NGRAM_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE CAST([] AS VARCHAR[]) END)) AS grams
  FROM w),
c AS (SELECT doc_id, len(grams) AS n, CASE WHEN len(grams) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY grams) END AS rep FROM s),
g AS (SELECT s.doc_id AS rep, len(grams) AS n, unnest(grams) AS gram FROM s JOIN c USING (doc_id) WHERE c.rep = s.doc_id),
links AS (
  SELECT a.rep AS x, b.rep AS y FROM g a JOIN g b ON a.gram = b.gram AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (
  SELECT DISTINCT rep AS x, rep AS y FROM c
  UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
label AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT c.doc_id, c.n AS n_shingles, label.component_id FROM c JOIN label ON c.rep = label.x
"""

#: Windows of 100 bytes, as hex digits cut from overlapping chunks; all but the first of equal windows cover bytes.
REPEATS = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
chunk AS (SELECT doc_id, k * 1000 AS base, substr(h, k * 2000 + 1, 2198) AS part FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2000 + 1)) AS k FROM b)),
win AS (
  SELECT doc_id, base + i AS p, md5_number(substr(part, 2 * i + 1, 200)) AS h
  FROM (SELECT doc_id, base, part, unnest(range(0, least(1000, length(part) // 2 - 99))) AS i FROM chunk WHERE length(part) >= 200)),
later AS (SELECT doc_id, p FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1),
edge AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER w + 100 THEN 0 ELSE 1 END AS opens FROM later WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
span AS (
  SELECT doc_id, min(p) AS first, max(p) + 100 AS past
  FROM (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM edge) GROUP BY doc_id, k),
gap AS (
  SELECT doc_id, first, past, coalesce(lag(past) OVER w, 0) AS since, lead(first) OVER w IS NULL AS is_last
  FROM span WINDOW w AS (PARTITION BY doc_id ORDER BY first)),
kept AS (
  SELECT doc_id, sum(past - first) AS removed, count(*) AS spans,
    string_agg(substr(h, 2 * since + 1, 2 * (first - since)) || CASE WHEN is_last THEN substr(h, 2 * past + 1) ELSE '' END, '' ORDER BY first) AS rest
  FROM gap JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM b LEFT JOIN kept USING (doc_id)
"""

#: Documents by the filters that they fail, then every order by counting; Shapley's sums over all orders.
FILTER_AUDIT = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (
  SELECT part, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
      regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY t)] AS fails,
    w.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, w.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
  FROM w),
kinds AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(range(1, 6)) AS k),
orders AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS ks FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (SELECT ks, step, ks[step] AS k, ks[1:step - 1] AS before FROM orders, (SELECT k AS step FROM l)),
seen AS (
  SELECT part, ks, step, steps.k, kinds.*, len(list_filter(before, lambda x: fails[x])) > 0 AS gone, fails[steps.k] AS here,
    len(list_filter(fails, lambda x: x)) AS n_fails
  FROM steps, kinds),
sums AS (
  SELECT part, list_reduce(list_transform(ks, lambda x: substr('ABCDE', x, 1)), lambda x, y: x || y) AS filter_order, step, k,
    sum(n) FILTER (NOT gone AND NOT here) AS kept, sum(n) FILTER (NOT gone AND here) AS removed, sum(n) FILTER (gone AND here) AS redundant,
    sum(n) FILTER (here AND n_fails = 1) AS unique_fails, sum(good) FILTER (NOT gone AND here) AS good_lost, sum(toxic) FILTER (NOT gone AND here) AS toxic_lost
  FROM seen GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, k) AS BIGINT) AS shapley
FROM sums
"""

#: Every kept term against every group of its language, and every two groups term by term.
DIVERGENCE = r"""
WITH t AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM t) GROUP BY ALL),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM t) GROUP BY ALL HAVING count(*) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM t),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, v FROM g JOIN k USING (lang) JOIN v USING (lang)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT lang, source, term, n, 1 + (1000000000 * CAST(n + 1 AS HUGEINT)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p,
    1 + (1000000000 * CAST(sum(n) OVER (PARTITION BY lang, term) + 1 AS HUGEINT)) // (sum(n) OVER (PARTITION BY lang) + v) AS q
  FROM grid),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""
