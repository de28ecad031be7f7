"""SQL for DuckDB that states the results of those queries that SQL can express, by plainer paths."""

WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"

OP2 = """
WITH sound AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
  FROM sound q JOIN sound c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM scored) WHERE k <= 20
"""

OP5 = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS uri FROM pages), h AS (SELECT page_id, b, uri, octet_length(b) AS payload_bytes, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS top FROM p),
d AS (SELECT page_id, b, uri, payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (k // 4) AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM h),
r AS (SELECT *, encode(replace('WARC/1.1~WARC-Type: ' || record_type || '~WARC-Record-ID: <urn:page:' || page_id || '>~' || coalesce('WARC-Target-URI: ' || uri || '~', '') || 'WARC-Date: 2024-01-01T00:00:00Z~WARC-Payload-Digest: sha1:' || payload_digest || '~'
  || coalesce('WARC-Refers-To: <urn:page:' || refers_to || '>~WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest~', '') || 'Content-Type: text/html~Content-Length: ' || CASE WHEN refers_to IS NULL THEN payload_bytes ELSE 0 END || '~~', '~', chr(13) || chr(10)))
  || CASE WHEN refers_to IS NULL THEN b ELSE ''::BLOB END || encode(chr(13) || chr(10) || chr(13) || chr(10)) AS record FROM d)
SELECT page_id, payload_bytes, payload_digest, record_type, refers_to, octet_length(record) AS record_bytes, sha256(record) AS record_sha256 FROM r
"""

OP7 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(t="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN '  ' || array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 80 * (p.n + q.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), k AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a),
r AS (SELECT doc_id, doc_id AS to_id FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.to_id = e.a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) JOIN (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY doc_id) USING (doc_id)
"""

OP10 = rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text, {WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
x AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (SELECT doc_id, i, w[i : i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 4))),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM x WHERE c > 1) GROUP BY doc_id),
t AS (SELECT DISTINCT host, text FROM d),
y AS (SELECT host, text, array_to_string(w, ' ') AS line, sum(len(w)) AS words FROM (SELECT host, text, {WORDS.format(t="lower(unnest(string_split(text, chr(10))))")} AS w FROM t) WHERE len(w) > 0 GROUP BY ALL),
f AS (SELECT host, line FROM (SELECT host, line, count(*) AS c FROM y GROUP BY ALL) WHERE c >= 8),
g AS (SELECT host, text, sum(words) AS gone FROM y JOIN f USING (host, line) GROUP BY ALL),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda v: length(v))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(string_split(text, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, coalesce(gone, 0) AS gone FROM d LEFT JOIN r USING (doc_id) LEFT JOIN g USING (host, text))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR gone > 0.75 * n_words) AS kept FROM b
"""
