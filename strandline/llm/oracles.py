"""DuckDB SQL for the queries of this subpackage that SQL can express over whole tables."""

OP9 = """
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(rhost, rpath, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT u.page_id, arg_max(struct_pack(rule := rhost || rpath, v := v), length(rhost || rpath)) AS best
  FROM u JOIN r ON (u.host = r.rhost OR u.host LIKE '%.' || r.rhost) AND starts_with(u.path, r.rpath)
  GROUP BY u.page_id)
SELECT u.page_id, u.host, u.path, m.best.rule AS rule, coalesce(m.best.v, 'allow') AS verdict
FROM u LEFT JOIN m ON u.page_id = m.page_id
"""

OP4 = r"""
WITH t AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, list_aggregate(w[i : i + least(10, len(w)) - 1], 'string_agg', ' ') AS g
  FROM t, range(1, 100000) AS s(i)
  WHERE len(w) > 0 AND i <= len(w) - least(10, len(w)) + 1),
d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
sizes AS (SELECT DISTINCT k FROM win),
g AS (
  SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w
  FROM d, sizes WHERE len(w) >= k),
hit AS (
  SELECT g.doc_id, g.i, g.k, win.item_id
  FROM g JOIN win ON win.k = g.k AND win.g = list_aggregate(g.w[g.i : g.i + g.k - 1], 'string_agg', ' ')),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
        FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


#: The pages of the given tables have one layout; for it, SQL can say what the article is.
OP1 = r"""
WITH a AS (SELECT page_id, url, regexp_replace(coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), ''), '<br>', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, url, regexp_split_to_array(regexp_replace(h, '</?b>', '', 'g'), '</?(?:p|h1)>') AS parts FROM a),
c AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(
        replace(replace(replace(replace(replace(x, '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))) AS parts FROM b)
SELECT page_id, url, t AS text, CAST(length(t) AS BIGINT) AS n_chars
FROM (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS t FROM c)
"""


#: Sources are filled one by one in the order of cap over weight; the level at the first that is not full holds for it and the rest.
MIX = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM d GROUP BY source),
o AS (SELECT *, 3 * source_size AS most, 3.0 * source_size / w AS ratio, row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS n FROM s),
l AS (
  SELECT a.n, ((SELECT sum(source_size) FROM s) - coalesce(sum(b.most), 0)) / ((SELECT sum(w) FROM s) - coalesce(sum(b.w), 0)) AS level
  FROM o a LEFT JOIN o b ON b.n < a.n GROUP BY a.n),
f AS (SELECT level FROM l JOIN o USING (n) WHERE level <= ratio ORDER BY n LIMIT 1)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, round(least(CAST(most AS DOUBLE), w * level), 4) AS target
FROM d JOIN o ON o.source IS NOT DISTINCT FROM d.source, f
"""


#: rollup_of_words: what is left after the three batches, counted at once.
OP5 = r"""
WITH l AS (SELECT doc_id, bool_or(toxic = 1) AS toxic, bool_or(quality = 0) AS poor FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT d.source, CASE WHEN coalesce(l.toxic, false) THEN 'toxic' ELSE d.lang END AS lang,
         len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) * CASE WHEN coalesce(l.toxic, false) THEN 2 ELSE 1 END AS n
  FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id
  WHERE d.doc_id IS NOT NULL AND NOT coalesce(l.poor, false))
SELECT source, lang, 'words-1' AS tokenizer_version, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM d GROUP BY source, lang
"""


OP11 = r"""
WITH base AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM base GROUP BY t),
marks AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(base.t, '[^A-Z]', '', 'g')) > 10 * length(base.t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(base.t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN base.doc_id > first_id THEN 16 ELSE 0 END AS fails
  FROM base JOIN firsts ON base.t = firsts.t LEFT JOIN marks ON marks.doc_id = base.doc_id),
l(x, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits
  FROM l p, l q, l r, l s, l t
  WHERE p.b + q.b + r.b + s.b + t.b = 31 AND len(list_distinct([p.b, q.b, r.b, s.b, t.b])) = 5),
e AS (
  SELECT part, filter_order, i AS step, bits[i] AS bit, fails, good, toxic, (fails & coalesce(list_sum(bits[1 : i - 1]), 0)::INT) = 0 AS there, (fails & bits[i]) <> 0 AS failing
  FROM f, o, range(1, 6) AS s(i)),
sums AS (
  SELECT part, filter_order, step,
         count(*) FILTER (there AND NOT failing) AS kept, count(*) FILTER (there AND failing) AS removed,
         count(*) FILTER (NOT there AND failing) AS redundant, count(*) FILTER (fails = bit) AS unique_fails,
         count(*) FILTER (there AND failing AND good) AS good_lost, count(*) FILTER (there AND failing AND toxic) AS toxic_lost
  FROM e GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, CAST(step AS INT), 1)) AS BIGINT) AS shapley
FROM sums
"""

OP12 = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_main_text": OP1, "op4_decontamination": OP4, "rollup_of_words": OP5, "mix_targets": MIX, "op9_url_rules": OP9, "op11_filter_audit": OP11, "op12_exact_dedup": OP12}
