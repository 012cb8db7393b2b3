"""DuckDB SQL that gives the rows of the queries that SQL can express, for small tables."""

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all(coalesce({_LOW}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BY_SPACE = rf"regexp_extract_all(coalesce({_LOW}, ''), '[^\x20\x09-\x0D]+')"

#: Every string of 100 bytes by its place; a byte goes where a string that is not the first of its kind covers it.
OP3 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, k, substr(x, 2 * k + 1, 200) AS w FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 99)) AS k FROM d)),
gone AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY md5(w) ORDER BY doc_id, k) AS r FROM s) WHERE r > 1),
runs AS (SELECT doc_id, k, sum(CASE WHEN k <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS run
         FROM (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM gone)),
spans AS (SELECT doc_id, min(k) AS a, max(k) + 100 AS e FROM runs GROUP BY doc_id, run),
cut AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans),
kept AS (SELECT doc_id, sum(e - a)::BIGINT AS removed, count(*) AS n, max(e) AS last, string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS x
         FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(d.x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept.x, '') || substr(d.x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id::VARCHAR AS item, list_slice(w, s, s + 9) AS win FROM i),
sizes AS (SELECT DISTINCT len(win) AS n FROM win),
dw AS (SELECT rid, p, n, list_slice(w, p, p + n - 1) AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes)),
hit AS (SELECT rid, p, n, item FROM dw JOIN win USING (win)),
cov AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, q FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM hit)) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_BY_SPACE} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS x
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM met JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach(doc_id, node) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, e.v FROM reach JOIN e ON reach.node = e.u)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, low AS component_id, doc_id = low AS kept
FROM (SELECT doc_id, min(node) AS low FROM reach GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""
