"""The same queries as plain SQL for another engine, to check results by value."""

from __future__ import annotations

from textsync.functions.markup import HIDDEN_TAGS, LINE_TAGS
from textsync.functions.text import COMMON_WORDS

# The references that the given pages hold, ampersand last; the whole table is checked by planted text.
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": "\u00a0", "&copy;": "©", "&middot;": "·", "&ndash;": "–", "&mdash;": "—",
    "&hellip;": "…", "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&amp;": "&",
}
SP = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
AN = r"[\p{L}\p{M}\p{N}]"
TOK = rf"{AN}+(?:[''’\-]+{AN}+)*"


def norm(x: str) -> str:
    return rf"regexp_replace(replace(lower({x}), 'ς', 'σ'), '[''’\-]', '', 'g')"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def toks(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{TOK}'), lambda t: {norm('t')})"


SEC = "sec AS (SELECT doc_id // 5 AS book_id, doc_id % 5 AS section_ord, 'doc/' || doc_id AS href, text FROM documents)"


def lines_of(sec: str = "sec") -> str:
    return f"""lines AS (
  SELECT book_id, section_ord, href, unnest(string_split(text, chr(10))) AS raw,
         unnest(range(0, len(string_split(text, chr(10))))) AS line_index FROM {sec}),
blk AS (
  SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY section_ord, line_index) - 1 AS block_ord,
         section_ord, href, line_index, {trim('raw')} AS text
  FROM lines WHERE {trim('raw')} <> '')"""


BLK = f"{SEC}, {lines_of()}"

SLICE = f"""{BLK}, ws AS (
  SELECT book_id, block_ord, section_ord, href, line_index, list_filter(string_split(text, ' '), lambda w: w <> '') AS ws FROM blk),
parts AS (SELECT *, unnest(range(0, (len(ws) - 1) // 12 + 1)) AS part FROM ws),
slice AS (
  SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY block_ord, part) - 1 AS seg, section_ord, href, line_index, part,
         ws[part * 12 + 1 : part * 12 + 12] AS words FROM parts)"""

SEG = f"""{SLICE}, seg AS (
  SELECT book_id, seg,
    CASE seg % 7
      WHEN 4 THEN list_filter(words, lambda w, i: (i - 1) % 6 <> 5)
      WHEN 5 THEN list_transform(words, lambda w, i: CASE WHEN (i - 1) % 5 = 4 THEN 'zzz' ELSE w END)
      WHEN 6 THEN list_transform(words, lambda w: 'qx' || w)
      ELSE words END AS said,
    coalesce(sum(len(words) * 200 + 100) OVER (PARTITION BY book_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms,
    len(words) * 200 AS ms FROM slice),
segments AS (SELECT book_id, seg, start_ms, (start_ms + ms)::BIGINT AS end_ms, array_to_string(said, ' ') AS text FROM seg)"""

TOKENS = f"""{BLK}, lt AS (SELECT book_id, section_ord, line_index, {toks('raw')} AS toks FROM lines),
tk AS (SELECT book_id, section_ord, line_index, unnest(toks) AS norm, unnest(range(0, len(toks))) AS pos FROM lt),
tok AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY section_ord, line_index, pos) - 1 AS tok, section_ord, line_index, norm FROM tk)"""

WORDS = f"regexp_extract_all(replace(lower(text), 'ς', 'σ'), '{AN}+')"
COMMON = "[" + ", ".join(f"'{w}'" for w in COMMON_WORDS) + "]"

# pieces of a section: a token, or what lies between two tokens
POSITIONS = f"""WITH {SEC}, pc AS (
  SELECT book_id, section_ord, unnest(regexp_extract_all(text, '(?s){TOK}|[^\\p{{L}}\\p{{M}}\\p{{N}}]+')) AS piece,
         unnest(range(0, len(regexp_extract_all(text, '(?s){TOK}|[^\\p{{L}}\\p{{M}}\\p{{N}}]+')))) AS pos FROM sec),
run AS (
  SELECT *, regexp_matches(piece, '^{AN}') AS is_tok,
    coalesce(sum(length(piece)) OVER w, 0) AS start_char,
    coalesce(sum(CASE WHEN NOT regexp_matches(piece, '^{AN}') THEN length(piece) - length(replace(piece, chr(10), '')) ELSE 0 END) OVER w, 0) AS line_index
  FROM pc WINDOW w AS (PARTITION BY book_id, section_ord ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pos AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY section_ord, pos) - 1 AS tok, section_ord,
  line_index::BIGINT AS line_index, {norm('piece')} AS norm, start_char::BIGINT AS start_char, (start_char + length(piece))::BIGINT AS end_char
  FROM run WHERE is_tok)"""


def page_text(c: str = "html") -> str:
    x = f"regexp_replace({c}, '(?s)<!--.*?-->', '', 'g')"
    x = f"regexp_replace({x}, '(?s)<\\?.*?\\?>|<![^>]*>', '', 'g')"
    for tag in HIDDEN_TAGS:
        x = f"regexp_replace({x}, '(?s)<{tag}(?:\\s[^>]*)?/>', '', 'g')"
        x = f"regexp_replace({x}, '(?s)<{tag}(?:\\s[^>]*)?>.*?</{tag}\\s*>', '', 'g')"
    x = f"regexp_replace({x}, '{SP}+', ' ', 'g')"
    x = f"regexp_replace({x}, '</?(?:{'|'.join(LINE_TAGS)})(?:\\s[^>]*)?/?>', chr(10), 'g')"
    x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for name, char in ENTITIES.items():
        char = char.replace("'", "''")
        x = f"replace({x}, '{name}', '{char}')"
    x = f"regexp_replace({x}, '[ \\t\\x{{A0}}]+', ' ', 'g')"
    x = f"regexp_replace({x}, ' *\\n[ \\n]*', chr(10), 'g')"
    return f"regexp_replace({x}, '^[ \\n]+|[ \\n]+$', '', 'g')"


LINKS = f"""WITH raw AS (
  SELECT page_id, regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<a\\s[^>]*>.*?</a>') AS links FROM pages),
one AS (SELECT page_id, unnest(links) AS link, unnest(range(0, len(links))) AS image_ordinal FROM raw),
link AS (
  SELECT page_id, image_ordinal, replace(regexp_extract(link, 'href="([^"]*)"', 1), '&amp;', '&') AS href,
    trim(regexp_replace({page_text('link')}, '{SP}+', ' ', 'g')) AS hint FROM one)"""


def grams(n: int, cols: str, source: str, key: str = "tok") -> str:
    """n-grams inside one block from a numbered token table."""
    part = f"PARTITION BY {cols} ORDER BY {key}"
    later = "".join(f" || ' ' || lead(norm, {k}) OVER ({part})" for k in range(1, n))
    return f"SELECT *, norm{later} AS gram FROM {source}"


SEGTOK = f"""st AS (SELECT book_id, seg, {toks('text')} AS toks FROM segments)"""


def votes(n: int) -> str:
    """Votes of n-grams between tables tok and st."""
    at = lambda k: f"toks[o + 1 + {k}]"
    gram = " || ' ' || ".join(at(k) for k in range(n))
    return f"""b{n} AS (SELECT book_id, tok, gram FROM ({grams(n, 'book_id, section_ord, line_index', 'tok')}) WHERE gram IS NOT NULL),
s{n} AS (SELECT book_id, seg, o, {gram} AS gram FROM (SELECT *, unnest(range(0, len(toks) - {n - 1})) AS o FROM st WHERE len(toks) >= {n})),
v{n} AS (SELECT book_id, seg, tok - o AS start, count(*) AS votes FROM b{n} JOIN s{n} USING (book_id, gram) WHERE tok >= o GROUP BY ALL)"""


ALPHA = "".join(chr(i) for i in range(33, 127)).replace("'", "''")


def scores(starts: str, key: str = "book_id, seg", item: str = "st", reach: int = 60) -> str:
    """Best acceptable window of each (segment, start): one letter per distinct segment word. ``reach``
    exceeds the longest window."""
    code = lambda src, words: (
        f"array_to_string(list_transform({src}, lambda t: CASE WHEN list_position({words}, t) IS NULL OR list_position({words}, t) = 0 THEN ' ' "
        f"ELSE substr('{ALPHA}', list_position({words}, t)::INT, 1) END), '')"
    )
    return f"""sw AS (SELECT *, len(toks) AS L, greatest(least(len(toks) // 4, 8), 1) AS v, list_distinct(toks) AS words,
    CASE WHEN len(toks) <= 3 THEN 0.9::DOUBLE WHEN len(toks) <= 7 THEN 0.72::DOUBLE ELSE 0.6::DOUBLE END AS need FROM {item}),
sc AS (SELECT *, {code('toks', 'words')} AS code FROM sw),
fw AS MATERIALIZED (SELECT book_id, tok, list(norm) OVER w AS norms, list(section_ord * 100000000 + line_index) OVER w AS blks FROM tok
  WINDOW w AS (PARTITION BY book_id ORDER BY tok ROWS BETWEEN CURRENT ROW AND {reach} FOLLOWING)),
reg AS (SELECT c.book_id, c.seg, c.start, s.L, s.v, s.need, s.code, s.words,
    b.norms[1 : s.L + s.v] AS run, b.blks[1 : s.L + s.v] AS bl
  FROM {starts} c JOIN sc s ON c.seg = s.seg {'AND c.book_id = s.book_id' if 'book_id' in key else ''} JOIN fw b ON b.book_id = c.book_id AND b.tok = c.start),
reg2 AS (SELECT * REPLACE ({code('run', 'words')} AS run) FROM reg),
win AS (SELECT *, unnest(range(L - v, L + v + 1)) AS n FROM reg2 WHERE length(replace(run, ' ', '')) >= need * L),
sco AS (SELECT book_id, seg, start, n, need, 1.0::DOUBLE - levenshtein(substr(run, 1, n::INT), code)::DOUBLE / greatest(n, L)::DOUBLE AS score
  FROM win WHERE n <= len(bl) AND bl[n] = bl[1]),
best AS (SELECT book_id, seg, start, max(score) AS score, arg_max(n, struct_pack(s := score, n := -n)) AS n
  FROM sco WHERE score >= need GROUP BY ALL)"""


ALIGN = f"""WITH RECURSIVE {SEG}, {SEGTOK}, {TOKENS.replace(BLK + ', ', '')}, {votes(3)}, {votes(2)}, {votes(1)},
cand AS (SELECT 3 AS g, * FROM v3 UNION ALL SELECT 2, * FROM v2
  UNION ALL SELECT 1, v1.* FROM v1 JOIN st USING (book_id, seg) WHERE len(toks) = 2),
starts AS (SELECT DISTINCT book_id, seg, unnest(range(greatest(start - 3, 0), start + 4)) AS start FROM cand),
{scores('starts')},
blist AS (SELECT book_id, seg, map_from_entries(list(struct_pack(k := start, v := struct_pack(score := score, n := n)))) AS best FROM best GROUP BY ALL),
clist AS (SELECT book_id, seg, list(struct_pack(g := g, start := start, votes := votes)) AS cands FROM cand GROUP BY ALL),
size AS (SELECT book_id, count(*) AS n_tokens FROM tok GROUP BY ALL),
rows AS MATERIALIZED (SELECT st.book_id, st.seg, len(toks) AS L, n_tokens,
    CASE WHEN best IS NULL OR len(toks) < 2 THEN NULL ELSE cands END AS cands, best
  FROM st LEFT JOIN clist USING (book_id, seg) LEFT JOIN blist USING (book_id, seg) LEFT JOIN size USING (book_id)),
rec AS (
  SELECT book_id, -1::BIGINT AS seg, 0::BIGINT AS cur, NULL::STRUCT(score DOUBLE, i BIGINT, s BIGINT, e BIGINT) AS hit, 0::BIGINT AS L
  FROM (SELECT DISTINCT book_id FROM st)
  UNION ALL
  SELECT book_id, seg, CASE WHEN hit.score >= 0 THEN greatest(cur, hit.e) ELSE cur END, hit, L FROM (
    SELECT book_id, seg, cur, L, list_max(list_transform(flatten(list_transform(
        list_sort(list_transform(list_filter(inw, lambda x: x.g = top), lambda x: struct_pack(v := -x.votes, d := abs(x.start - cur), s := x.start)))[1:12],
        lambda r: range(greatest(r.s - 3, lo), least(r.s + 3, hi) + 1))),
        lambda s, i: struct_pack(score := coalesce(best[s].score, -1.0), i := -i, s := s, e := (s + coalesce(best[s].n, 0))::BIGINT))) AS hit
    FROM (SELECT *, list_max(list_transform(inw, lambda x: x.g)) AS top FROM (
      SELECT r.book_id, q.seg, r.cur, q.L, q.best, greatest(r.cur - 12, 0) AS lo, least(r.cur + 6000, q.n_tokens - 1) AS hi,
        list_filter(q.cands, lambda x: x.start >= greatest(r.cur - 12, 0) AND x.start <= least(r.cur + 6000, q.n_tokens - 1)) AS inw
      FROM rec r JOIN rows q ON q.book_id = r.book_id AND q.seg = r.seg + 1)))),
al AS (SELECT book_id, seg, L, CASE WHEN hit.score >= 0 THEN hit.s END AS s, CASE WHEN hit.score >= 0 THEN hit.e END AS e,
    CASE WHEN hit.score >= 0 THEN hit.score END AS score FROM rec WHERE seg >= 0)"""

TRUTH = f"""WITH {SLICE}, truth AS (
  SELECT book_id, seg, start_ms, (start_ms + ms)::BIGINT AS end_ms, text, n_tokens, CASE WHEN lost THEN 'unmatched' ELSE 'matched' END AS status,
    CASE WHEN NOT lost THEN 100.0::DOUBLE - seg % 3 END AS match_percent, CASE WHEN NOT lost THEN href END AS href, CASE WHEN NOT lost THEN line_index END AS line_index,
    CASE WHEN NOT lost THEN part * 12 END AS start_char, CASE WHEN NOT lost THEN part * 12 + n_tokens END AS end_char
  FROM (SELECT *, coalesce(sum(len(words) * 200 + 100) OVER (PARTITION BY book_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms,
      len(words) * 200 AS ms, array_to_string(words, ' ') AS text, len(words) AS n_tokens,
      seg % 7 = 6 OR seg < 2 OR seg >= count(*) OVER (PARTITION BY book_id) - 2 AS lost FROM slice))"""

ORACLE = {
    "blocks": f"WITH {BLK} SELECT * FROM blk",
    "token_positions": f"{POSITIONS} SELECT * FROM pos",
    "ngram_counts": f"""WITH {TOKENS}, g AS (
  SELECT book_id, 1 AS n, gram FROM ({grams(1, 'book_id', 'tok')})
  UNION ALL SELECT book_id, 2, gram FROM ({grams(2, 'book_id, section_ord, line_index', 'tok')})
  UNION ALL SELECT book_id, 3, gram FROM ({grams(3, 'book_id, section_ord, line_index', 'tok')})),
k AS (SELECT book_id, n, gram, count(*) AS k FROM g WHERE gram IS NOT NULL GROUP BY ALL)
SELECT book_id, n::BIGINT AS n, sum(k)::BIGINT AS grams, count(*) AS kinds, max(k) AS most FROM k GROUP BY ALL""",
    "corpus_summary": f"WITH {SEC} SELECT book_id, count(*) AS sections, sum(length(text))::BIGINT AS characters FROM sec GROUP BY ALL",
    "word_sets": f"""WITH w AS (SELECT doc_id, {WORDS} AS seq FROM documents)
SELECT doc_id, len(seq) AS n_words, len(list_distinct(seq)) AS n_distinct,
  len(list_filter(list_distinct(seq), lambda w: length(w) >= 4 AND NOT list_contains({COMMON}, w))) AS n_distinctive FROM w""",
    "block_overlap": f"""WITH {BLK}, w AS (SELECT book_id, block_ord, text, list_distinct({WORDS}) AS words FROM blk),
j AS (SELECT a.*, b.words AS prior, len(list_intersect(a.words, b.words)) AS hits FROM w a JOIN w b ON a.book_id = b.book_id AND b.block_ord = a.block_ord - 1)
SELECT book_id, block_ord,
  CASE WHEN len(words) = 0 OR len(prior) = 0 THEN 0 ELSE hits * 1000 // (len(words) + len(prior) - hits) END AS jaccard_milli,
  CASE WHEN len(prior) = 0 THEN 0 ELSE least(1000, hits * 1000 // len(prior)) END AS coverage_milli,
  regexp_matches(text, '[.!?]["''”’)\\]]*$') AS ends FROM j""",
    "clocks": """WITH m AS (SELECT event_id, epoch_us(ts) // 1000 % 90000000 AS ms FROM events),
c AS (SELECT *, format('{}:{:02d}:{:02d}.{:03d}', ms // 3600000, ms % 3600000 // 60000, ms % 60000 // 1000, ms % 1000) AS c FROM m)
SELECT event_id, ms,
  CASE event_id % 10 WHEN 0 THEN replace(c, '.', ':') WHEN 1 THEN c || '9' WHEN 2 THEN substr(c, 1, length(c) - 4) ELSE c END AS clock,
  CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN ms - ms % 1000 ELSE ms END AS parsed FROM c""",
    "page_text": f"SELECT page_id, {page_text()} AS text FROM pages",
    "page_lines": f"""WITH sec AS (SELECT page_id AS book_id, 0 AS section_ord, url AS href, {page_text()} AS text FROM pages), {lines_of()}
SELECT book_id, block_ord, line_index, text FROM blk""",
    "page_links": f"{LINKS} SELECT page_id, image_ordinal, href, hint AS hints FROM link",
    "resolved_links": f"""{LINKS}, h AS (SELECT *, image_ordinal % 3 = 0 AS own FROM link)
SELECT page_id, image_ordinal,
  'site/' || CASE WHEN own THEN 'pages' || href ELSE regexp_replace(href, '^/', '') || ' x' END AS path, NULL::VARCHAR AS reason,
  CASE WHEN own THEN NULL ELSE 'site/' || regexp_replace(href, '^/', '') || ' x' END AS optional_path FROM h""",
    "encoded_links": f"""{LINKS}, t AS (SELECT *, 'site' || href AS target FROM link)
SELECT page_id, image_ordinal, replace(replace(url_encode(target), '%2F', '/'), '%7E', '~') AS as_path, replace(url_encode(target), '%7E', '~') AS as_fragment,
  target AS decoded, '../..' || href AS relative, regexp_extract(target, '^(.*)/[^/]*$', 1) AS parent,
  replace(replace(replace(replace(replace(href, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped FROM t""",
    "link_hints": f"""{LINKS}, f AS (
  SELECT *, translate(hint, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM link
  WHERE length(regexp_replace(hint, '[^\\p{{L}}\\p{{M}}\\p{{N}}]', '', 'g')) BETWEEN 2 AND 240),
u AS (SELECT page_id, min(image_ordinal) AS o, arg_min(hint, image_ordinal) AS hint FROM f GROUP BY page_id, k),
l AS (SELECT page_id, string_agg(hint, '|' ORDER BY o) AS lines, count(*) AS n FROM u GROUP BY page_id)
SELECT page_id, coalesce(lines, '') AS lines, coalesce(n, 0) AS n FROM (SELECT DISTINCT page_id FROM link) LEFT JOIN l USING (page_id)""",
    "media_types": """WITH e AS (SELECT event_id, ['mp3', 'm4b', 'opus', 'wav', 'mp4'][event_id % 5 + 1] AS ext,
  CASE WHEN event_id % 7 < 5 THEN 'copy' WHEN event_id % 7 = 5 THEN 'opus' ELSE 'aac' END AS codec FROM events),
m AS (SELECT event_id, CASE codec WHEN 'opus' THEN 'audio.opus' WHEN 'aac' THEN 'audio.m4a' ELSE CASE WHEN ext <> 'wav' THEN 'audio.' || ext END END AS file_name,
  CASE codec WHEN 'opus' THEN 'audio/ogg; codecs=opus' WHEN 'aac' THEN 'audio/mp4'
    ELSE CASE ext WHEN 'mp3' THEN 'audio/mpeg' WHEN 'opus' THEN 'audio/ogg; codecs=opus' WHEN 'wav' THEN NULL ELSE 'audio/mp4' END END AS media_type FROM e)
SELECT *, file_name IS NOT NULL AS allowed FROM m""",
    "candidate_votes": f"""WITH {SEG}, {SEGTOK}, {TOKENS.replace(BLK + ', ', '')}, {votes(3)}
SELECT book_id, seg, count(*) AS starts, sum(votes)::BIGINT AS votes, max(votes) AS most, min(start) AS first FROM v3 GROUP BY ALL""",
    "window_scores": f"""WITH {SEG}, {SEGTOK}, {TOKENS.replace(BLK + ', ', '')}, {votes(3)},
starts AS (SELECT DISTINCT book_id, seg, unnest(range(greatest(start - 3, 0), start + 4)) AS start FROM v3),
{scores('starts')}
SELECT book_id, seg, count(*) AS starts, max(floor(score * 1000 + 1e-6))::BIGINT AS best_milli, sum(n)::BIGINT AS lengths, min(start) AS first FROM best GROUP BY ALL""",
    "alignment": f"""{ALIGN}, {POSITIONS.replace('WITH ' + SEC + ', ', '')}
SELECT al.book_id, al.seg, CASE WHEN s IS NULL THEN 'unmatched' ELSE 'matched' END AS status, round(score * 100.0, 6) AS match_percent,
  'doc/' || (al.book_id * 5 + a.section_ord) AS start_href, a.line_index AS start_line_index, a.start_char AS start_char_offset,
  'doc/' || (al.book_id * 5 + b.section_ord) AS end_href, b.line_index AS end_line_index, b.end_char AS end_char_offset
FROM al LEFT JOIN pos a ON a.book_id = al.book_id AND a.tok = s LEFT JOIN pos b ON b.book_id = al.book_id AND b.tok = e - 1""",
    "alignment_summary": f"""{TRUTH} SELECT book_id, count(*) AS total_segments, count(*) FILTER (status = 'matched') AS matched_segments,
  round(sum(coalesce(match_percent, 0) * n_tokens) / sum(n_tokens), 6) AS match_percent FROM truth GROUP BY ALL""",
    "alignment_progress": f"""{TRUTH} SELECT book_id, seg, seg + 1 AS processed, count(*) OVER (PARTITION BY book_id) AS total_segments,
  round(sum(coalesce(match_percent, 0) * n_tokens) OVER w / sum(n_tokens) OVER w, 6) AS match_percent
FROM truth WINDOW w AS (PARTITION BY book_id ORDER BY seg)""",
    "locate_passages": f"""WITH sec AS (SELECT doc_id AS book_id, 0 AS section_ord, '' AS href, text FROM documents), {TOKENS.replace(SEC + ', ', '')},
st AS (SELECT 0 AS book_id, item_id AS seg, {toks('text')} AS toks FROM benchmark),
{votes(3).replace('USING (book_id, gram)', 'ON b3.gram = s3.gram').replace('SELECT book_id, seg, tok - o', 'SELECT b3.book_id AS book_id, seg, tok - o')},
{votes(2).replace('USING (book_id, gram)', 'ON b2.gram = s2.gram').replace('SELECT book_id, seg, tok - o', 'SELECT b2.book_id AS book_id, seg, tok - o')},
cand AS (SELECT * FROM v3 UNION ALL SELECT * FROM v2 ANTI JOIN (SELECT DISTINCT book_id, seg FROM v3) USING (book_id, seg)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY book_id, seg ORDER BY votes DESC, start) AS rank FROM cand QUALIFY rank <= 12),
tried AS (SELECT book_id, seg, rank, unnest(range(greatest(start - 3, 0), start + 4)) AS start FROM ranked),
starts AS (SELECT DISTINCT book_id, seg, start FROM tried),
{scores('starts', key='seg', reach=400)}
SELECT seg AS item_id, book_id AS doc_id, w.start AS start, w.start + w.n AS "end", floor(w.score * 1000 + 1e-6)::INT AS score_milli FROM (
  SELECT seg, book_id, arg_min(struct_pack(start := start, n := n, score := score), struct_pack(a := -score, r := rank, s := start)) AS w
  FROM tried JOIN best USING (book_id, seg, start) GROUP BY ALL)""",
}
