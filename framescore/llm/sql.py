"""DuckDB SQL for the rows of those queries that SQL can express; plain versions without any of the methods."""

from __future__ import annotations

_WORDS = "list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

#: Windows as digests of their words; a word goes if the last repeated window before it reaches it.
SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
k AS (SELECT doc_id, w, list_transform(range(1, greatest(len(w) - 34, 0) + 1), lambda i: md5(array_to_string(w[i:i + 34], ' '))) AS keys FROM d),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i, unnest(keys) AS key FROM k),
f AS (SELECT doc_id, word, i, key IS NOT NULL AND count(*) OVER (PARTITION BY key) > 1 AS again FROM p),
c AS (SELECT doc_id, word, i, coalesce(i - max(CASE WHEN again THEN i END) OVER (PARTITION BY doc_id ORDER BY i) < 35, false) AS gone FROM f),
r AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""

#: Bytes as two hexadecimal digits each; texts in pieces of 1000 bytes, each with the 199 after it.
SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
q AS (SELECT doc_id, 1000 * j AS base, substr(h, 2000 * j + 1, 2398) AS q FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2000 + 1)) AS j FROM d)),
p AS (SELECT doc_id, unnest(list_transform(range(1, least(len(q) // 2, 1000) + 1), lambda i: substr(q, 2 * i - 1, 2))) AS b, base + unnest(range(1, least(len(q) // 2, 1000) + 1)) AS i,
unnest(list_transform(range(1, greatest(least(len(q) // 2 - 199, 1000), 0) + 1), lambda i: md5(substr(q, 2 * i - 1, 400)))) AS key FROM q),
f AS (SELECT doc_id, b, i, key IS NOT NULL AND count(*) OVER (PARTITION BY key) > 1 AS again FROM p),
c AS (SELECT doc_id, b, i, coalesce(i - max(CASE WHEN again THEN i END) OVER (PARTITION BY doc_id ORDER BY i) < 200, false) AS gone FROM f),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM c),
r AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE starts) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM s GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""

#: The smallest id that links reach, from links in both directions.
_REACHED = "reach AS (SELECT u, u AS low FROM both_ways UNION SELECT b.v, r.low FROM reach r JOIN both_ways b ON r.u = b.u WHERE r.low < b.v), lowest AS (SELECT u, min(low) AS low FROM reach GROUP BY u)"

EMBEDDING_DEDUP = f"""
WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
g AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda y: y * y))) AS size FROM e
WHERE len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
both_ways AS (SELECT a.vec_id AS u, b.vec_id AS v FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_inner_product(a.x, b.x) / (a.size * b.size) >= 0.9),
{_REACHED}, n AS (SELECT u, count(*) AS n FROM both_ways GROUP BY u)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(coalesce(low, vec_id) AS BIGINT) AS component_id, coalesce(low, vec_id) = vec_id AS kept
FROM e LEFT JOIN n ON vec_id = n.u LEFT JOIN lowest ON vec_id = lowest.u
"""

JACCARD_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingles FROM d),
n AS (SELECT doc_id, len(shingles) AS n FROM s), x AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM common JOIN n p ON p.doc_id = u JOIN n q ON q.doc_id = v WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links), {_REACHED}
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(low, doc_id) AS component_id FROM n LEFT JOIN lowest ON doc_id = u
"""

#: The table of crc32 (a byte to eight steps of its polynomial), and the checksum of a list of bytes with that table.
_CRC_TABLE = "crc AS (SELECT list_transform(range(0, 256), lambda b: list_reduce(range(0, 8), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)), b)) AS crc)"
_CRC = "xor(4294967295, list_reduce({bytes}, lambda a, c: xor(a >> 8, crc[(xor(a, c) & 255) + 1]), 4294967295))"
_DIGITS = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(unicode(c) AS BIGINT))"

#: Equal words q apart as islands for each q; of those with the same ends, the smallest q.
PERIODIC_RUNS = f"""
WITH {_CRC_TABLE}, o AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w, {_CRC.format(bytes=_DIGITS)} AS h FROM documents, crc),
s AS (SELECT *, CAST(len(w) AS BIGINT) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM o),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] END) END AS w FROM s),
x AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM d),
m AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND 3 * (b.i - a.i) <= a.n),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
l AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM g GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM l GROUP BY doc_id, start, length),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS k FROM r),
e AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN e ON d.doc_id = e.doc_id LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN b ON d.doc_id = b.doc_id AND b.k = 1
"""

_LETTERS = "list_transform(string_split({text}, ''), lambda c: unicode(c))"
#: UTF-8 bytes of digits, a colon and Latin letters.
_RUN_BYTES = f"flatten(list_transform({_LETTERS.format(text='concat(doc_id, chr(58), word)')}, lambda c: CASE WHEN c < 128 THEN [CAST(c AS BIGINT)] ELSE [CAST(195 AS BIGINT), c - 64] END))"

#: Pairs of near words by their common rest, as plain joins.
SPELLING_VARIANTS = f"""
WITH RECURSIVE {_CRC_TABLE},
t AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM documents),
u AS (SELECT doc_id, word, count(*) AS c FROM t WHERE length(word) >= 7 GROUP BY doc_id, word),
h AS (SELECT word, c, {_CRC.format(bytes=_RUN_BYTES)} AS h FROM u, crc),
x AS (SELECT CASE WHEN h % 31 = 0 THEN concat(substr(word, 1, h % length(word)), substr(word, h % length(word) + 2)) ELSE word END AS word, c FROM h),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM x WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
w AS (SELECT word, n, concat(substr(word, 1, i - 1), '*', substr(word, i + 1)) AS key FROM p),
d AS (SELECT DISTINCT word, n, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest FROM p),
near AS (SELECT a.word, b.word AS other, b.n FROM w a JOIN w b ON a.key = b.key AND a.word <> b.word
UNION ALL SELECT d.word, v.word, v.n FROM d JOIN v ON d.rest = v.word UNION ALL SELECT v.word, d.word, d.n FROM d JOIN v ON d.rest = v.word),
k AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM near),
f AS (SELECT v.word, v.n, coalesce(k.n_near, 0) AS n_near, CASE WHEN k.n >= 10 * v.n THEN k.other END AS form, CASE WHEN k.n >= 10 * v.n THEN k.n END AS form_n FROM v LEFT JOIN k ON v.word = k.word AND k.k = 1),
up AS (SELECT word, word AS root, 0 AS steps FROM f UNION ALL SELECT up.word, f.form, steps + 1 FROM up JOIN f ON up.root = f.word WHERE f.form IS NOT NULL),
r AS (SELECT word, arg_max(root, steps) AS root FROM up GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN r ON f.word = r.word
"""
