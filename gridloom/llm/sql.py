"""DuckDB SQL for the rows of those queries that SQL can express."""

from gridloom.llm.quality import NOTICES

_WORD = r"'[^\x20\x09-\x0D]+'"

QUALITY = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_WORD})) AS l
  FROM documents),
tri AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d))),
rep AS (
  SELECT doc_id, count(*) AS n_repeat_words
  FROM (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n >= 2)) GROUP BY doc_id),
line AS (
  SELECT doc_id, x, w, len(w) AS n,
    coalesce(list_sum(list_transform(range(2, len(w) + 1), lambda i: CASE WHEN w[i] = w[i - 1] THEN 1 ELSE 0 END)), 0) AS echo
  FROM (SELECT doc_id, x, regexp_extract_all(x, {_WORD}) AS w FROM (SELECT doc_id, unnest(l) AS x FROM d))),
good AS (
  SELECT doc_id, count(*) AS n_kept_lines, sum(length(array_to_string(w, ''))) AS kept_chars FROM line
  WHERE NOT (n > 12 AND NOT regexp_matches(x, '[.!?…:;。！？؟]["''”’»)\]]*[\x20\x09-\x0D]*$'))
    AND NOT len(regexp_extract_all(x, '[#*$%&<>]+')) > n * 0.3
    AND NOT len(regexp_extract_all(x, '[!?]{{2,}}')) > n * 0.3
    AND NOT len(regexp_extract_all(x, '[|»•·>]')) > n * 0.3
    AND NOT regexp_matches(x, '(?i)(?:{"|".join(NOTICES)})')
    AND NOT (n >= 6 AND echo > n * 0.3)
  GROUP BY doc_id),
j AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(n_kept_lines, 0) AS BIGINT) AS n_kept_lines,
    CAST(coalesce(kept_chars, 0) AS BIGINT) AS kept_chars
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN good USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND kept_chars >= word_chars * 0.5 AND n_kept_lines > 0 AS kept,
  n_lines, n_kept_lines, kept_chars
FROM j
"""

LINE_DEDUP = r"""
WITH l AS (
  SELECT doc_id, i, s[i] AS line,
    translate(trim(s[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
f AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT l.doc_id, l.i, l.line, f.k IS NOT NULL AND l.doc_id <> f.keeper AS gone FROM l LEFT JOIN f USING (k))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

MIXING = rf"""
WITH d AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS BIGINT) AS size, source, md5(CAST(doc_id AS VARCHAR)) AS key FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [1, 2, 3][CAST(rank % 3 AS INT) + 1] AS w, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
o AS (
  SELECT *, row_number() OVER r AS k,
    total - coalesce(CAST(sum(3 * source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS rest,
    CAST(sum(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS share
  FROM w WINDOW r AS (ORDER BY source_size * 3.0 / w, rank)),
c AS (SELECT min(k) AS k FROM o WHERE CAST(3 * source_size AS DOUBLE) * share >= CAST(rest AS DOUBLE) * w),
t AS (
  SELECT o.source, o.source_size, o.rank,
    CASE WHEN c.k IS NULL OR o.k < c.k THEN CAST(3 * o.source_size AS DOUBLE)
      ELSE (SELECT CAST(rest AS DOUBLE) FROM o p, c WHERE p.k = c.k) * CAST(o.w AS DOUBLE) / (SELECT CAST(share AS DOUBLE) FROM o p, c WHERE p.k = c.k) END AS target
  FROM o, c),
q AS (
  SELECT d.doc_id, d.size, d.key, t.source_size, t.rank, t.target,
    CAST(sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.key, d.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT q.*, e, CASE WHEN target > 0 THEN CAST(e * source_size + cum AS DOUBLE) / target ELSE 0.0 END AS v FROM q, (SELECT unnest(range(3)) AS e)),
r AS (SELECT *, sum(size) OVER (ORDER BY v, rank, key, doc_id, e ROWS UNBOUNDED PRECEDING) AS run, (SELECT sum(size) FROM d) AS budget FROM e)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN run <= budget THEN size ELSE 0 END) AS BIGINT) AS taken
FROM r GROUP BY doc_id, size, source_size, target
"""

NGRAM_JOIN = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT x AS doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(y) AS component_id FROM r LEFT JOIN n ON n.doc_id = x GROUP BY x
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS lead FROM pages),
c AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(sha1(h), CAST(i * 5 + 1 AS INT), 5) AS INT)) AS five FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(flatten(list_transform(five, lambda x: [x >> 15, (x >> 10) & 31, (x >> 5) & 31, x & 31])), lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v + 1 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> lead THEN lead END AS refers_to
FROM c
"""
