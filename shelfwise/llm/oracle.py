"""SQL statements of the registered queries, where SQL can express them."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op1_url_filter"] = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
                       THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, regexp_extract(r, '^[^?#]*') AS r FROM rest),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN strpos(r, '/') > 0 THEN substr(r, strpos(r, '/')) ELSE '' END AS path FROM cut),
rules(action, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                               ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (
  SELECT page_id, action, h || p AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS n
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT parts.page_id, host, path, rule,
       CASE WHEN action IS NOT NULL THEN action
            WHEN ends_with(host || path, '.exe') OR contains(host || path, '/wp-admin/') OR
                 regexp_full_match(host || path, '[^/]*/login[^/]*') THEN 'block'
            ELSE 'allow' END AS verdict
FROM parts LEFT JOIN fits ON fits.page_id = parts.page_id AND n = 1
"""

ORACLE["op4_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""

ORACLE["op11_merkle_manifest"] = """
WITH RECURSIVE
crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS tab
  FROM range(256) t(i)),
marked AS (
  SELECT d.*, CAST(n_chars AS HUGEINT) + CASE WHEN doc_id IS NOT NULL AND 0 = xor(4294967295, list_reduce(
           list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
           lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8), 4294967295)) % 7 THEN 1 ELSE 0 END AS claimed
  FROM documents d, crc_table),
fields AS (
  SELECT lang, doc_id,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') ||
         coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS own,
         coalesce(strlen(CAST(claimed AS VARCHAR)) || ':' || claimed, '-') AS other,
         coalesce(strlen(text) || ':' || text, '-') AS tail FROM marked),
leaves AS (
  SELECT lang, doc_id, sha256(head || own || tail) AS leaf, sha256(head || other || tail) AS claim FROM fields),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n
  FROM leaves),
tree AS (
  SELECT lang, 0 AS l, p, n, leaf AS h FROM placed
  UNION ALL
  SELECT lang, l + 1, p // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM tree WHERE n > 1 GROUP BY lang, l, p // 2, n),
subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS gs FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS l, g AS p, gs AS n, subroot AS h FROM subroots
  UNION ALL
  SELECT l + 1, p // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM top WHERE n > 1 GROUP BY l, p // 2, n),
steps AS (
  SELECT lang, CAST(l AS BIGINT) AS l, p, n, h FROM tree WHERE n > 1
  UNION ALL
  SELECT s.lang, m.height + t.l, t.p, t.n, t.h FROM top t, subroots s JOIN (SELECT lang, max(l) AS height FROM tree GROUP BY lang) m
    ON m.lang IS NOT DISTINCT FROM s.lang WHERE t.n > 1),
ways AS (
  SELECT lang, doc_id, leaf, claim, p AS start, 0 AS l, p AS at, n, CAST('' AS VARCHAR) AS proof, claim AS cur, FALSE AS up FROM placed
  UNION ALL
  SELECT w.lang, w.doc_id, w.leaf, w.claim, w.start, CASE WHEN w.n > 1 THEN w.l + 1 ELSE w.l END,
         CASE WHEN w.n > 1 THEN w.at // 2 ELSE s.g END, CASE WHEN w.n > 1 THEN (w.n + 1) // 2 ELSE s.gs END,
         w.proof || coalesce(CASE WHEN w.n > 1 THEN x.h END, ''),
         CASE WHEN w.n = 1 THEN w.cur WHEN x.h IS NULL THEN sha256(w.cur) WHEN w.at % 2 = 1 THEN sha256(x.h || w.cur)
              ELSE sha256(w.cur || x.h) END,
         w.up OR w.n = 1
  FROM ways w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang
  LEFT JOIN steps x ON x.lang IS NOT DISTINCT FROM w.lang AND x.l = w.l AND x.p = xor(w.at, 1) AND x.n = w.n
  WHERE NOT (w.up AND w.n = 1)),
roots AS (SELECT h AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM ways w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang, roots WHERE w.up AND w.n = 1
"""

ORACLE["op12_substring_dedup"] = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT r, doc_id, i, sha256(array_to_string(words[i : i + 12], ' ')) AS w
  FROM (SELECT r, doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM texts WHERE doc_id IS NOT NULL)),
firsts AS (SELECT w, min(doc_id) AS least FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)),
covered AS (
  SELECT DISTINCT r, unnest(range(i, i + 13)) AS i FROM windows JOIN firsts USING (w) WHERE least < doc_id),
words AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM texts),
kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS left_over
  FROM words ANTI JOIN covered USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(left_over, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
"""
