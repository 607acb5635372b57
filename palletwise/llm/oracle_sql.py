"""DuckDB statements of the queries in this package that SQL can express."""

STATEMENTS: dict[str, str] = {}

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

STATEMENTS["op4_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i AS s, array_to_string(w[i + 1 : i + 20], ' ') AS t
        FROM d, unnest(range(greatest(len(w) - 19, 0))) u(i)),
ord AS (SELECT doc_id, s, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS k FROM win),
gone AS (SELECT doc_id, list(DISTINCT s + j) AS g FROM ord, unnest(range(20)) v(j) WHERE k > 1 GROUP BY doc_id),
kept AS (SELECT d.doc_id, d.w, coalesce(len(g), 0) AS n_removed,
                CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i - 1)) END AS k
         FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(array_to_string(k, ' ')) AS kept_sha256
FROM kept
"""

STATEMENTS["op5_quality_rules"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)),
                              lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
           FROM documents),
win AS (SELECT doc_id, i AS s, array_to_string(w[i + 1 : i + 8], ' ') AS t
        FROM d, unnest(range(greatest(len(w) - 7, 0))) u(i)),
rep AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, t) AS k FROM win) WHERE k > 1),
cov AS (SELECT doc_id, count(DISTINCT s + j) AS n FROM rep, unnest(range(8)) v(j) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
             length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
             length(text) - length(replace(text, '!', '')) AS n_shouts,
             len(list_filter(w, lambda x, i: i > 1 AND w[i - 1] = x)) AS n_stutter
      FROM d LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 2 * n_dup_lines > n_lines OR 10 * n_capitals > 3 * word_chars OR 10 * n_shouts > 3 * n_words
            OR 10 * n_stutter > 3 * n_words) AS kept
FROM b
"""

STATEMENTS["op2_topk_maxscore"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id) q JOIN v c ON c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

# the CRC-32 of a word is reduced over its bytes with the table of its polynomial
STATEMENTS["op11_importance_resampling"] = """
WITH crc AS (SELECT list(v ORDER BY i) AS t
             FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v
                   FROM range(256) r(i))),
rows_ AS (SELECT 0 AS side, row_number() OVER () AS id, doc_id, text FROM documents
          UNION ALL SELECT 1, 0, NULL, text FROM benchmark),
w AS (SELECT side, id, doc_id, list_filter(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM rows_),
f AS (SELECT side, id, unnest(w) AS x FROM w),
names AS (SELECT DISTINCT x, hex(encode(x)) AS h FROM f),
bytes AS (SELECT x, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS b FROM names),
bucket AS (SELECT x, xor(list_reduce(b, lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), 4294967295), 4294967295) % 10000 AS k
           FROM bytes, crc),
n AS (SELECT side, id, k, count(*) AS n FROM f JOIN bucket USING (x) GROUP BY ALL),
total AS (SELECT coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM n),
by_bucket AS (SELECT k, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM n GROUP BY k),
gain AS (SELECT k, CAST(floor(1000 * ln((CAST(b.t AS DOUBLE) + 1) * (CAST(total.s AS DOUBLE) + 10000)
                / ((CAST(b.s AS DOUBLE) + 1) * (CAST(total.t AS DOUBLE) + 10000)))) AS BIGINT) AS g FROM by_bucket b, total),
mean AS (SELECT id, CAST(floor(CAST(sum(n * g) AS DOUBLE) / sum(n)) AS BIGINT) AS weight FROM n JOIN gain USING (k) WHERE side = 0 GROUP BY id),
scored AS (SELECT w.id, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
                  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)
                  AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
           FROM w LEFT JOIN mean USING (id) WHERE side = 0),
ord AS (SELECT id, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS r FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score,
       CASE WHEN r <= (SELECT count(*) * 10 // 100 FROM ord) THEN CAST(r AS BIGINT) END AS rank
FROM scored LEFT JOIN ord USING (id)
"""

STATEMENTS["op13_filter_audit"] = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
lab AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, concat(
         CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
         CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' END,
         CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
         CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' END) AS f,
      coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM d LEFT JOIN lab USING (doc_id)),
c AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, f),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, i AS step, substr(filter_order, i, 1) AS own, substr(filter_order, 1, i - 1) AS before
      FROM o, unnest(range(1, 6)) u(i)),
t AS (SELECT part, filter_order, step, n, good, toxic, contains(f, own) AS fails, f = own AS only_own, greatest(length(f), 1) AS k,
             translate(f, before, '') <> f AS gone FROM s, c)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
       CAST(coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (only_own), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * 120 // k) FILTER (fails), 0) AS BIGINT) AS shapley
FROM t GROUP BY part, filter_order, step
"""
