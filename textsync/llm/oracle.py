"""SQL for the second engine, with the rules' values written out."""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS turn FROM sized GROUP BY source
), bounds AS (
  SELECT *, CAST([3, 1, 2][turn % 3 + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap,
         2.0::DOUBLE * source_size / CAST([3, 1, 2][turn % 3 + 1] AS DOUBLE) AS bound
  FROM totals
), levels AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM totals)
             - coalesce(sum(cap) OVER (ORDER BY bound, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY bound, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM bounds
), chosen AS (
  SELECT level FROM levels WHERE level <= bound ORDER BY bound, turn LIMIT 1
), targets AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT level FROM chosen) * weight), cap) AS target FROM bounds
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS place FROM sized
), rated AS (
  SELECT r.doc_id, r.size, r.place, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(r.source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS shift
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (floor(shift + place * rate) - floor(shift + (place - 1) * rate)) AS BIGINT) AS taken
FROM rated
"""

TOPK = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), parts AS (
  SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM v
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
  GROUP BY ALL
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

QUALITY = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), counted AS (
  SELECT *, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS upper,
         length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS lower,
         len(list_filter(w, lambda x: right(x, 1) IN ('!', '?'))) AS marks,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS stutters
  FROM d
), runs AS (
  SELECT r, unnest(list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(w[i : i + 7], ' '))) AS run,
         unnest(range(1, greatest(len(w) - 6, 1))) AS place
  FROM d
), twice AS (
  SELECT r, place FROM runs QUALIFY count(*) OVER (PARTITION BY r, run) > 1
), covered AS (
  SELECT r, CAST(count(DISTINCT place + k) AS BIGINT) AS n_repeat_words FROM twice, range(0, 8) AS t(k) GROUP BY r
), lines AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line FROM d
), doubled AS (
  SELECT r, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), base AS (
  SELECT c.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM counted c LEFT JOIN doubled USING (r) LEFT JOIN covered USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 60 * n_lines
            OR 100 * stutters > 20 * n_words OR upper > lower OR 100 * marks > 30 * n_words
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM base
"""

NEAR_COPIES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN list_transform(w[1:1], lambda x: x)
                                      ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM w
), sized AS (
  SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
), least AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sized USING (doc_id)
"""

WARC = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), bits AS (
  SELECT page_id, html, list_reduce(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', h[i]) - 1), 4, '0')), lambda a, b: a || b) AS b,
         min(page_id) OVER (PARTITION BY html) AS first
  FROM p
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       list_reduce(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
         1 + 16 * CAST(b[5 * i + 1] AS INTEGER) + 8 * CAST(b[5 * i + 2] AS INTEGER) + 4 * CAST(b[5 * i + 3] AS INTEGER)
           + 2 * CAST(b[5 * i + 4] AS INTEGER) + CAST(b[5 * i + 5] AS INTEGER)]), lambda a, b: a || b) AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits
"""

SPELLING = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL
), messages AS (
  SELECT row_number() OVER () AS m, run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS bytes FROM runs
), bits AS (
  SELECT b, 0 AS step, b AS x FROM (SELECT unnest(range(256)) AS b)
  UNION ALL SELECT b, step + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM bits WHERE step < 8
), tab AS (
  SELECT b, x FROM bits WHERE step = 8
), shifted AS (
  SELECT 0 AS k, b, x FROM tab UNION ALL
  SELECT k + 1, s.b, xor(s.x >> 8, tab.x) FROM shifted s JOIN tab ON tab.b = s.x & 255 WHERE k < (SELECT max(length(bytes)) / 2 FROM messages)
), begun AS (
  SELECT 0 AS k, 4294967295::BIGINT AS x UNION ALL
  SELECT k + 1, xor(s.x >> 8, tab.x) FROM begun s JOIN tab ON tab.b = s.x & 255 WHERE k < (SELECT max(length(bytes)) / 2 FROM messages)
), crcs AS (
  SELECT m, bit_xor(s.x) AS x
  FROM (SELECT m, length(bytes) // 2 - i AS k, CAST('0x' || bytes[2 * i - 1 : 2 * i] AS BIGINT) AS b
        FROM (SELECT m, bytes, unnest(range(1, length(bytes) // 2 + 1)) AS i FROM messages)) e
  JOIN shifted s ON s.k = e.k AND s.b = e.b
  GROUP BY m
), hashed AS (
  SELECT run, n, xor(xor(c.x, b.x), 4294967295) AS h
  FROM messages JOIN crcs c USING (m) JOIN begun b ON b.k = length(bytes) // 2
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cuts AS (
  SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word AS a, b.word AS b FROM cuts a JOIN cuts b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON w.word = c.v
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON w.word = c.v
), best AS (
  SELECT a AS word, b AS near, wb.n AS near_n, count(*) OVER (PARTITION BY a) AS n_near
  FROM near JOIN words wb ON wb.word = b QUALIFY row_number() OVER (PARTITION BY a ORDER BY wb.n DESC, b) = 1
), formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root FROM formed UNION ALL SELECT w.word, f.form FROM walk w JOIN formed f ON f.word = w.root WHERE f.form IS NOT NULL
), ends AS (
  SELECT w.word, w.root FROM walk w JOIN formed f ON f.word = w.root WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""

LEADS = ", ".join(["w", *(f"lead(w, {j}) OVER run" for j in range(1, 10))])
CONTAMINATION = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT row_number() OVER () AS r, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), dt AS (
  SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d
), bt AS (
  SELECT r, item_id, least(10, len(w)) AS k, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM b
), dg AS (
  SELECT r, i, [{LEADS}] AS g FROM dt WINDOW run AS (PARTITION BY r ORDER BY i)
), bg AS (
  SELECT item_id, k, [{LEADS}] AS g FROM bt WINDOW run AS (PARTITION BY r ORDER BY i)
), items AS (
  SELECT DISTINCT item_id, k, array_to_string(g[1:k], ' ') AS s FROM bg WHERE g[k] IS NOT NULL
), met AS (
  SELECT r, i, k, item_id
  FROM (SELECT r, i, k, array_to_string(g[1:k], ' ') AS s FROM dg, (SELECT DISTINCT k FROM items) WHERE g[k] IS NOT NULL) JOIN items USING (k, s)
), hits AS (
  SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS place FROM met) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM met WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""

ORACLE = {"op6_warc": WARC, "op2_near_copies": NEAR_COPIES, "op3_mixing": MIXING, "op5_quality": QUALITY, "op10_topk": TOPK, "op11_spelling": SPELLING, "op12_contamination": CONTAMINATION}
