"""SQL of the timeline, review, cue, audit and ledger queries."""

from __future__ import annotations

from textsync.operators.ledger import LABELS, STAGES, WEIGHTS
from textsync.operators.overlay import SIDES
from textsync.operators.review import BULK_REASON, EDGE_REASON
from textsync.plans.text_oracle import BLK, COMMON, SLICE, TRUTH, WORDS, trim

T = TRUTH[len("WITH "):]

TIMED = f"""{SLICE}, wn AS (
  SELECT book_id, words, coalesce(sum(len(words)) OVER (PARTITION BY book_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM slice),
wo AS (SELECT book_id, unnest(words) AS word, first + unnest(range(0, len(words))) AS n FROM wn),
tw AS (SELECT book_id, (n * 200 + n // 17 * 800) // 25000 AS chunk_idx, n AS pos, word, (n * 200 + n // 17 * 800) % 25000 AS start_ms,
  (n * 200 + n // 17 * 800) % 25000 + 200 AS end_ms FROM wo)"""

# phrases: cut flags, then a walk over the words of each run that counts to 24
PHRASES = f"""WITH RECURSIVE {TIMED},
f AS (SELECT *, max(end_ms) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, lag(word) OVER w AS prior,
  row_number() OVER w AS i FROM tw WINDOW w AS (PARTITION BY book_id, chunk_idx ORDER BY pos)),
g AS MATERIALIZED (SELECT *, coalesce(start_ms >= before, false) AS free,
  coalesce(start_ms >= before AND (start_ms - before >= 700 OR regexp_matches(prior, '[.!?]["''”’)\\]]*$')), false) AS cut FROM f),
walk AS (
  SELECT book_id, chunk_idx, i, 1 AS n, 0 AS phrase FROM g WHERE i = 1
  UNION ALL
  SELECT g.book_id, g.chunk_idx, g.i, CASE WHEN g.cut OR (g.free AND w.n >= 24) THEN 1 ELSE w.n + 1 END,
    CASE WHEN g.cut OR (g.free AND w.n >= 24) THEN w.phrase + 1 ELSE w.phrase END
  FROM walk w JOIN g ON g.book_id = w.book_id AND g.chunk_idx = w.chunk_idx AND g.i = w.i + 1)
SELECT book_id, chunk_idx, phrase::BIGINT AS pos, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(word, ' ' ORDER BY pos) AS text
FROM walk JOIN g USING (book_id, chunk_idx, i) GROUP BY book_id, chunk_idx, phrase"""

MARKS = """ev AS (SELECT user_id AS book_id, event_id, event_type, epoch_us(ts) AS us FROM events),
tl AS (SELECT book_id, event_id, event_type, (us - min(us) OVER (PARTITION BY book_id)) // 10000000 AS t FROM ev),
bk AS (SELECT book_id, max(t) AS duration_ms FROM tl GROUP BY book_id HAVING max(t) > 0),
ch AS (SELECT book_id, t AS boundary_ms FROM tl WHERE event_type = 'purchase'),
si AS (SELECT book_id, t AS from_ms, until_ms FROM (
  SELECT *, lead(t) OVER (PARTITION BY book_id ORDER BY t, event_id) AS until_ms FROM tl) WHERE event_type = 'error' AND until_ms IS NOT NULL)"""

PLAN = f"""{MARKS},
plan AS (
  SELECT book_id, -1::BIGINT AS chunk_idx, 0::BIGINT AS start_ms, 0::BIGINT AS end_ms FROM bk
  UNION ALL
  SELECT p.book_id, p.chunk_idx + 1, p.end_ms,
    CASE WHEN any_value(b.duration_ms) - p.end_ms <= 25000 THEN any_value(b.duration_ms)
      ELSE coalesce(max(c.boundary_ms), p.end_ms + 25000) END
  FROM plan p JOIN bk b ON b.book_id = p.book_id
    LEFT JOIN ch c ON c.book_id = p.book_id AND c.boundary_ms BETWEEN greatest(p.end_ms + 22500, p.end_ms + 1) AND p.end_ms + 25000 AND c.boundary_ms > 0 AND c.boundary_ms < b.duration_ms
  WHERE p.end_ms < b.duration_ms GROUP BY p.book_id, p.chunk_idx, p.end_ms)"""


def cuts(plan: str) -> str:
    """Nearest silence midpoint of each open cut, clipped to its window."""
    return f"""near AS (
  SELECT p.book_id, p.chunk_idx, p.end_ms, greatest(s.from_ms, greatest(p.end_ms - 2500, 0)) AS a, least(s.until_ms, least(p.end_ms + 2500, b.duration_ms)) AS z
  FROM {plan} p JOIN bk b USING (book_id) JOIN si s ON s.book_id = p.book_id AND s.until_ms > s.from_ms
  WHERE p.end_ms < b.duration_ms AND NOT EXISTS (SELECT 1 FROM ch WHERE ch.book_id = p.book_id AND ch.boundary_ms = p.end_ms)),
mid AS (SELECT book_id, chunk_idx, arg_min(a + (z - a) // 2, struct_pack(d := abs(a + (z - a) // 2 - end_ms), a := a)) AS moved FROM near WHERE z - a >= 350 GROUP BY ALL)"""


EVEN = """even AS (SELECT book_id, duration_ms, unnest(range(0, duration_ms, 25000)) AS s0 FROM bk),
ep AS (SELECT book_id, s0 // 25000 AS chunk_idx, s0 AS start_ms, least(s0 + 25000, duration_ms) AS end_ms, duration_ms FROM even)"""

PARTS = f"""cv AS (SELECT conv_id AS book_id, turn AS chunk_idx, role, list_filter(list_transform(string_split(text, chr(10)), lambda x: {trim('x')}), lambda x: x <> '') AS ls
  FROM conversations WHERE role <> 'system'),
pt AS (SELECT book_id, chunk_idx, role, unnest(ls) AS text, unnest(range(0, len(ls))) AS pos FROM cv)"""


def rules(source: str, entity: str, **tests: str) -> str:
    return " UNION ALL ".join(
        f"SELECT book_id, '{rule}' AS rule, ({entity})::VARCHAR AS entity FROM {source} WHERE {test}" for rule, test in tests.items()
    )


LE = lambda x: "||".join(f"substr(lpad(hex({x}::BIGINT), 16, '0'), {2 * i + 1}, 2)" for i in reversed(range(8)))
ENDS = f"""{T}, ends AS (SELECT book_id, min(seg) AS f, max(seg) AS l, arg_min(href, seg) AS ih, arg_max(href, seg) AS chref FROM truth WHERE status = 'matched' GROUP BY ALL),
rep AS (SELECT t.book_id, t.seg, t.start_ms, t.end_ms, t.text, t.n_tokens,
    'review-' || sha256(unhex({LE('seg')} || {LE('start_ms')} || {LE('end_ms')} || hex(encode(text)))) AS id,
    CASE WHEN seg < f THEN 'introduction' WHEN seg > l THEN 'credits' END AS edge, CASE WHEN seg < f THEN ih WHEN seg > l THEN chref END AS edge_href
  FROM truth t LEFT JOIN ends USING (book_id) WHERE status = 'unmatched')"""


def items(policy: str) -> str:
    auto = "edge IS NOT NULL AND edge_href IS NOT NULL" if policy == "smart" else "false"
    return f"""{ENDS}, it AS (SELECT r.*, s.href AS own_href, s.line_index AS own_line,
    CASE WHEN r.seg % 5 = 0 THEN 'x' WHEN r.seg % 7 = 6 THEN 'line' WHEN {auto} THEN 'edge' ELSE 'pending' END AS k
  FROM rep r JOIN slice s USING (book_id, seg)),
dec AS (SELECT book_id, seg, id, text, start_ms, end_ms, edge,
    CASE k WHEN 'x' THEN 'excluded' WHEN 'pending' THEN 'pending' ELSE 'assigned' END AS state,
    CASE k WHEN 'line' THEN own_href WHEN 'edge' THEN edge_href END AS href, CASE k WHEN 'line' THEN own_line END AS line_index, NULL::VARCHAR AS image_href,
    CASE WHEN k = 'edge' THEN CASE edge WHEN 'introduction' THEN 'before_anchor' ELSE 'after_anchor' END END AS supplemental,
    CASE WHEN k = 'edge' THEN edge END AS classification, CASE k WHEN 'x' THEN 'noise' END AS reason,
    CASE k WHEN 'pending' THEN NULL WHEN 'edge' THEN 'automatic' ELSE 'manual' END AS source FROM it)"""


DEC = "book_id, seg, state, href, line_index, image_href, supplemental, classification, reason, source"
NEAR = """pl AS (SELECT t.*, b.block_ord FROM truth t LEFT JOIN blk b ON b.book_id = t.book_id AND b.href = t.href AND b.line_index = t.line_index AND t.status = 'matched'),
nb AS (SELECT *, last_value(block_ord IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_block,
  first_value(block_ord IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY seg ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_block FROM pl)"""


def jaccard(k: int) -> str:
    return f"""win AS (SELECT n.book_id, n.seg, list_distinct({WORDS.replace('text', 'n.text')}) AS words, coalesce(prev_block, 0) AS lo, coalesce(next_block, mx) AS hi
  FROM nb n JOIN (SELECT book_id, max(block_ord) AS mx FROM blk GROUP BY ALL) USING (book_id) WHERE status = 'unmatched'),
bw AS (SELECT book_id, block_ord, list_distinct({WORDS}) AS bws FROM blk),
ja AS (SELECT w.book_id, seg, block_ord, len(list_intersect(words, bws)) AS hits, len(words) AS a, len(bws) AS b FROM win w JOIN bw ON bw.book_id = w.book_id AND block_ord BETWEEN lo AND hi),
js AS (SELECT book_id, seg, block_ord, (CASE WHEN a = 0 OR b = 0 THEN 0 ELSE hits * 1000 // (a + b - hits) END)::BIGINT AS score_milli FROM ja),
tc AS (SELECT * FROM js QUALIFY row_number() OVER (PARTITION BY book_id, seg ORDER BY score_milli DESC, block_ord) <= {k})"""


APPLIED = f"""{items('smart')}, {NEAR},
ex AS (SELECT book_id, seg, CASE WHEN seg % 50 = 13 THEN 'changed' ELSE text END AS i_text,
    CASE WHEN state = 'pending' THEN 'excluded' ELSE state END AS state, supplemental,
    CASE WHEN seg % 70 = 27 AND state = 'assigned' AND line_index IS NOT NULL THEN 'doc/' || (book_id * 5) ELSE href END AS d_href,
    CASE WHEN seg % 70 = 27 AND state = 'assigned' AND line_index IS NOT NULL THEN 0 ELSE line_index END AS d_line FROM dec),
ap AS (SELECT n.*, e.state, e.supplemental, e.d_href, e.d_line, e.i_text, e.state = 'assigned' AND e.d_line IS NOT NULL AS line, b.block_ord AS t_block, length(b.text) AS t_chars
  FROM nb n LEFT JOIN ex e USING (book_id, seg) LEFT JOIN blk b ON b.book_id = n.book_id AND b.href = e.d_href AND b.line_index = e.d_line AND e.state = 'assigned'),
gd AS (SELECT *, coalesce(line AND status = 'unmatched' AND i_text = text AND t_block IS NOT NULL AND t_block >= coalesce(prev_block, 0) AND t_block <= coalesce(next_block, t_block), false) AS good FROM ap),
ef AS (SELECT book_id, seg, CASE WHEN good THEN 'matched' ELSE status END AS status, CASE WHEN NOT good THEN match_percent END AS match_percent,
    CASE WHEN good THEN d_href ELSE href END AS href, CASE WHEN good THEN d_line ELSE line_index END AS line_index,
    CASE WHEN good THEN 0 ELSE start_char END AS start_char, CASE WHEN good THEN t_chars ELSE end_char END AS end_char, CASE WHEN good THEN t_block ELSE block_ord END AS at_block FROM gd)"""

CANDS = f"""{ENDS}, pn AS (SELECT *, href[5:]::BIGINT % 5 AS ord FROM truth),
nx AS (SELECT book_id, seg, status,
  last_value(CASE WHEN status = 'matched' THEN struct_pack(seg := seg, ord := ord) END IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
  first_value(CASE WHEN status = 'matched' THEN struct_pack(seg := seg, ord := ord) END IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY seg ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM pn),
fo AS (SELECT x.book_id, seg, coalesce(p.ord, 0) AS lo, coalesce(n.ord, last) AS hi,
  coalesce(p.ord + (n.ord - p.ord) * (seg - p.seg) // greatest(n.seg - p.seg, 1), p.ord, n.ord, 0) AS focus
  FROM nx x JOIN (SELECT book_id, max(section_ord) AS last FROM sec GROUP BY ALL) USING (book_id) WHERE status = 'unmatched'),
fig AS (SELECT book_id, section_ord, href, line_index, 'img/' || book_id || '-' || block_ord AS image_href, block_ord % 50 * 1000000 AS size,
  trim(regexp_replace(text, '[ \\t]+', ' ', 'g')) AS hint FROM blk WHERE block_ord % 5 = 0 AND block_ord % 35 <> 10),
pg AS (SELECT f.book_id, f.seg, s.section_ord, abs(s.section_ord - focus) AS far FROM fo f JOIN sec s ON s.book_id = f.book_id AND s.section_ord BETWEEN lo AND hi),
rc AS (SELECT p.book_id, p.seg, p.section_ord AS spine_ord, g.href, g.line_index, g.image_href, g.hint,
  row_number() OVER (PARTITION BY p.book_id, p.seg ORDER BY far, p.section_ord, g.line_index) AS rank
  FROM pg p JOIN fig g USING (book_id, section_ord) WHERE size BETWEEN 1 AND 26214400 QUALIFY rank <= 24)"""

SCORED = f"""{CANDS}, ev AS (SELECT rc.*, list_distinct({WORDS.replace('text', 'r.text')}) AS said, {WORDS.replace('text', 'hint')} AS seq
  FROM rc JOIN rep r USING (book_id, seg) WHERE length(hint) BETWEEN 1 AND 512 AND length(regexp_replace(hint, '[^\\p{{L}}\\p{{M}}\\p{{N}}]', '', 'g')) BETWEEN 2 AND 240),
hi2 AS (SELECT *, list_intersect(list_distinct(seq), said) AS hits, len(list_distinct(seq)) AS nw, len(said) AS ns FROM ev WHERE len(seq) BETWEEN 5 AND 120 AND len(said) > 0),
m AS (SELECT *, least(1000, len(hits) * 1000 // nw) AS coverage_milli, least(1000, len(hits) * 1000 // least(nw, ns)) AS similarity_milli,
  len(list_filter(hits, lambda w: length(w) >= 4 AND NOT list_contains({COMMON}, w))) AS distinctive FROM hi2),
q AS (SELECT *, (coverage_milli * 2 + similarity_milli) // 3 AS score_milli FROM m),
qq AS (SELECT *, coverage_milli >= 360 AND distinctive >= 2 AND score_milli >= CASE WHEN len(seq) <= 12 THEN 770 ELSE 690 END AS qualifies FROM q),
rk AS (SELECT *, row_number() OVER w AS place, lead(score_milli) OVER w AS second FROM qq
  WINDOW w AS (PARTITION BY book_id, seg ORDER BY qualifies DESC, score_milli DESC, coverage_milli DESC, spine_ord, line_index, image_href)),
rr AS (SELECT *, place = 1 AND qualifies AND (second IS NULL OR score_milli - second >= 80) AS recommended FROM rk)"""

CLOCK = lambda x: f"format('{{}}:{{:02d}}:{{:02d}}.{{:03d}}', {x} // 3600000, {x} % 3600000 // 60000, {x} % 60000 // 1000, {x} % 1000)"
CUES = f"""{T}, cu AS (SELECT t.book_id, s.section_ord, t.seg, t.start_ms, t.end_ms, 'stl-par-' || (s.section_ord + 1) || '-' || (t.seg + 1) AS cue_id, 'b' || t.line_index || 'é' AS anchor
  FROM truth t JOIN sec s ON s.book_id = t.book_id AND s.href = t.href WHERE status = 'matched')"""
FAULTY = f"""{CUES}, fc AS (SELECT book_id, section_ord, start_ms - CASE WHEN (seg + 1) % 60 = 0 THEN 101 ELSE 0 END AS start_ms,
  CASE WHEN (seg + 1) % 50 = 0 THEN start_ms ELSE end_ms END AS end_ms, cue_id, CASE WHEN (seg + 1) % 70 = 0 THEN '' ELSE anchor END AS anchor FROM cu)"""
SUPP = f"""{items('smart')}, su AS (SELECT book_id, seg AS review_ord, classification, supplemental AS placement, href AS anchor_href,
  'stl-extra-page-' || lpad((seg + 1)::VARCHAR, greatest(4, length((seg + 1)::VARCHAR))::INT, '0') AS page_id, 'text/' || classification || '-' || lpad((seg + 1)::VARCHAR, greatest(4, length((seg + 1)::VARCHAR))::INT, '0') || '.xhtml' AS href,
  end_ms - start_ms AS duration_ms, text FROM dec WHERE supplemental IS NOT NULL)"""
ESC = lambda x: f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"

PACK = """mf AS (SELECT doc_id // 5 AS book_id, doc_id, 'i' || doc_id AS id, 'doc/' || doc_id AS href, CASE WHEN doc_id % 13 = 5 THEN 'image/png' ELSE 'application/xhtml+xml' END AS media_type,
  doc_id % 11 = 3 AS nav, CASE WHEN doc_id % 3 > 0 THEN 'm' || (doc_id - doc_id % 17 % 2) END AS media_overlay FROM documents WHERE doc_id % 31 <> 7),
sp AS (SELECT doc_id // 5 AS book_id, doc_id AS spine_ord, 'i' || doc_id AS idref FROM documents WHERE doc_id % 7 <> 2)"""


def fingerprint(changed: bool) -> str:
    text = "text || CASE WHEN doc_id % 10 = 3 THEN '!' ELSE '' END" if changed else "text"
    back = "'align-' || source || CASE WHEN doc_id % 7 = 2 THEN '!' ELSE '' END" if changed else "'align-' || source"
    nl = "chr(10)"
    head = lambda label: f"'stage:{label}' || {nl} || 'epub:' || sha256({text}) || {nl} || 'audio:audio-' || doc_id || {nl}"
    speech, book = "lang || 'base'", f"'audio-settings:Copy' || {nl} || {back} || 'audio-1'"
    tails = ["''", f"source || {speech}", f"source || {back} || {speech}", f"source || {back} || 'ocr-1' || {speech} || 'review-policy:Smart' || {nl}",
             book, f"{book} || 'ocr-1epub-1'", f"{book} || 'ocr-1epub-1'"]
    return " UNION ALL ".join(
        f"SELECT doc_id AS book_id, '{s}' AS stage, {i} AS o, 'sha256:' || sha256({head(label)} || {tail}) AS fingerprint FROM documents"
        for i, (s, label, tail) in enumerate(zip(STAGES, LABELS, tails))
    )


RECOMPUTE = f"""cur AS ({fingerprint(True)}), old AS (SELECT * FROM ({fingerprint(False)}) WHERE NOT (book_id % 12 = 5 AND stage = 'encode')),
pw AS (SELECT c.*, min(CASE WHEN o.fingerprint IS DISTINCT FROM c.fingerprint THEN c.o END) OVER (PARTITION BY c.book_id) AS stale
  FROM cur c LEFT JOIN old o ON o.book_id = c.book_id AND o.stage = c.stage)"""
STAGE_LIST = "[" + ", ".join(f"'{s}'" for s in STAGES) + "]"
ARTIFACTS = f"""ar AS (SELECT doc_id AS book_id, unnest({STAGE_LIST}) AS stage, text FROM documents),
ak AS (SELECT *, book_id + length(stage) AS k FROM ar),
df AS (SELECT book_id, stage, stage || '/out' AS path,
  CASE WHEN k % 29 = 3 THEN CASE WHEN k % 23 <> 1 THEN 'missing' END WHEN k % 23 = 1 THEN 'unsealed' WHEN k % 19 = 2 THEN 'changed' END AS change FROM ak)"""

ORACLE = {
    "word_phrases": PHRASES,
    "word_check": f"""WITH {TIMED}, p AS (SELECT book_id, chunk_idx || '/' || pos AS e, pos, start_ms FROM tw)
{rules('p', 'e', word_blank='pos % 101 = 0', word_probability='pos % 97 = 0', word_time='pos % 103 = 0')}""",
    "chunk_plan": f"WITH RECURSIVE {PLAN} SELECT * FROM plan WHERE chunk_idx >= 0",
    "silence_cuts": f"""WITH {MARKS}, {EVEN}, {cuts('ep')} SELECT ep.book_id, ep.chunk_idx, ep.end_ms, moved FROM ep LEFT JOIN mid USING (book_id, chunk_idx)""",
    "chunk_refine": f"""WITH RECURSIVE {PLAN}, pp AS (SELECT * FROM plan WHERE chunk_idx >= 0), {cuts('pp')},
rw AS MATERIALIZED (SELECT pp.book_id, pp.chunk_idx, pp.end_ms, moved, coalesce(lead(pp.end_ms) OVER (PARTITION BY pp.book_id ORDER BY pp.chunk_idx), pp.end_ms) AS later FROM pp LEFT JOIN mid USING (book_id, chunk_idx)),
fold AS (SELECT book_id, -1::BIGINT AS chunk_idx, 0::BIGINT AS start_ms, 0::BIGINT AS end_ms FROM bk
  UNION ALL SELECT r.book_id, r.chunk_idx, f.end_ms, CASE WHEN moved > f.end_ms AND moved < later AND moved - f.end_ms <= 30000 AND later - moved <= 30000 THEN moved ELSE r.end_ms END
  FROM fold f JOIN rw r ON r.book_id = f.book_id AND r.chunk_idx = f.chunk_idx + 1)
SELECT * FROM fold WHERE chunk_idx >= 0""",
    "chunk_audit": f"""WITH {MARKS}, {EVEN}, fa AS (SELECT book_id, chunk_idx, duration_ms, CASE WHEN chunk_idx = 0 AND book_id % 3 = 0 THEN 7 ELSE start_ms END AS start_ms,
  end_ms - CASE WHEN chunk_idx % 5 = 4 THEN 1 ELSE 0 END AS end_ms FROM ep),
fb AS (SELECT *, lag(end_ms) OVER (PARTITION BY book_id ORDER BY start_ms, chunk_idx) AS before, row_number() OVER (PARTITION BY book_id ORDER BY start_ms, chunk_idx) - 1 AS r FROM fa),
fe AS (SELECT book_id, any_value(duration_ms) AS duration_ms, max(end_ms) AS covered FROM fa GROUP BY ALL)
{rules('fb', 'chunk_idx', chunk_index='chunk_idx <> r', chunk_start='r = 0 AND start_ms <> 0', chunk_gap='r > 0 AND start_ms <> before', chunk_empty='end_ms <= start_ms', chunk_long='end_ms - start_ms > 30000', chunk_beyond='end_ms > duration_ms')}
UNION ALL {rules('fe', 'duration_ms', plan_short='covered < duration_ms')}""",
    "coverage_audit": f"""WITH {MARKS}, ro AS (SELECT book_id, t AS start_ms, max(t + event_id % 9000) AS end_ms FROM tl WHERE event_id % 9000 > 0 GROUP BY ALL),
rb AS (SELECT *, coalesce(lag(end_ms) OVER (PARTITION BY book_id ORDER BY start_ms), 0) AS before FROM ro),
re AS (SELECT bk.book_id, duration_ms, coalesce(max(end_ms), 0) AS covered FROM bk LEFT JOIN ro USING (book_id) GROUP BY ALL)
{rules('rb', 'start_ms', coverage_gap='start_ms - before > 2', coverage_overlap='before - start_ms > 2', row_short='end_ms - start_ms <= 10')}
UNION ALL {rules('re', 'duration_ms', coverage_end='abs(covered - duration_ms) > 2')}""",
    "edge_refine": f"""WITH {MARKS}, ed AS (SELECT DISTINCT book_id, boundary_ms AS edge_ms FROM ch),
mi AS (SELECT book_id, from_ms + (until_ms - from_ms) // 2 AS mid FROM si WHERE until_ms - from_ms BETWEEN 650 AND 8000),
be AS (SELECT e.book_id, edge_ms, arg_min(mid, struct_pack(d := abs(mid - edge_ms), m := mid)) AS m FROM ed e JOIN mi USING (book_id) WHERE abs(mid - edge_ms) <= 6000 GROUP BY ALL)
SELECT ed.book_id, ed.edge_ms, coalesce(m, ed.edge_ms) AS refined_ms FROM ed LEFT JOIN be USING (book_id, edge_ms)""",
    "merged_segments": f"""WITH {PARTS}, la AS (SELECT book_id, CASE WHEN count(*) FILTER (role = 'assistant') > 0 THEN 'en' END AS language FROM pt GROUP BY ALL)
SELECT pt.book_id, row_number() OVER (PARTITION BY pt.book_id ORDER BY chunk_idx, pos) - 1 AS seg, chunk_idx, chunk_idx * 25000 + pos * 500 AS start_ms, chunk_idx * 25000 + pos * 500 + 500 AS end_ms, text, language
FROM pt JOIN la USING (book_id)""",
    "stream_merge": f"""WITH {PARTS}, bad AS (SELECT DISTINCT conv_id AS book_id FROM conversations WHERE conv_id % 11 = 3 AND turn = 1),
s AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY chunk_idx, pos) - 1 AS seg, chunk_idx,
  chunk_idx * 25000 + pos * 500 AS start_ms, chunk_idx * 25000 + pos * 500 + 500 AS end_ms, text FROM pt WHERE chunk_idx < 1 OR book_id NOT IN (SELECT book_id FROM bad)),
al AS (SELECT DISTINCT conv_id AS book_id FROM conversations WHERE conv_id NOT IN (SELECT book_id FROM bad))
SELECT *, 'segment' AS status FROM s
UNION ALL SELECT book_id, NULL, 1, NULL, NULL, NULL, 'failed' FROM bad
UNION ALL SELECT book_id, NULL, NULL, NULL, coalesce(max(end_ms), 0), NULL, 'complete' FROM al LEFT JOIN s USING (book_id) GROUP BY book_id
UNION ALL SELECT conv_id, NULL, 1000, NULL, NULL, NULL, 'unplanned' FROM conversations WHERE conv_id % 13 = 5 AND turn = 0""",
    "merge_audit": f"""WITH {PARTS}, lt AS (SELECT *, CASE WHEN book_id % 5 = 0 THEN 24000 ELSE 0 END AS late FROM pt),
lo AS (SELECT book_id, chunk_idx || '/' || pos AS e, pos * 500 + 500 + late AS z, chunk_idx * 25000 + pos * 500 + late AS gs,
  lag(chunk_idx * 25000 + pos * 500 + 500 + late) OVER (PARTITION BY book_id ORDER BY chunk_idx, pos) AS before FROM lt),
no AS (SELECT DISTINCT conv_id AS book_id FROM conversations WHERE conv_id NOT IN (SELECT book_id FROM pt))
{rules('lo', 'e', segment_beyond_chunk='z > 25000', segment_overlap='gs < before')} UNION ALL {rules('no', 'book_id', transcript_empty='true')}""",
    "segment_audit": f"""WITH {T}, a AS (SELECT book_id, seg, start_ms - CASE WHEN seg % 60 = 59 THEN 101 ELSE 0 END AS start_ms, CASE WHEN seg % 50 = 49 THEN start_ms ELSE end_ms END AS end_ms, seg % 70 = 69 AS blank FROM truth),
b AS (SELECT *, lag(end_ms) OVER (PARTITION BY book_id ORDER BY seg) AS before FROM a)
{rules('b', 'seg', text_blank='blank', duration='end_ms <= start_ms', overlap='start_ms < before')}""",
    "transcript_summary": f"WITH {T} SELECT book_id, count(*) AS segments, max(end_ms) AS duration_ms FROM truth GROUP BY ALL",
    "word_json": f"""WITH {TIMED}, c AS (SELECT book_id, chunk_idx, count(*) AS words, sum(length(word))::BIGINT AS letters, max(end_ms) AS last_ms,
  chunk_idx % 11 = 7 AS lang, bool_or(false) AS z, regexp_replace(arg_min(word, pos), '[^\\p{{L}}\\p{{M}}\\p{{N}}]', '', 'g') AS w1,
  sum(length(word)) - length(arg_min(word, pos)) AS l1 FROM tw GROUP BY ALL),
r AS (SELECT *, CASE WHEN lang THEN 'language' WHEN chunk_idx % 13 = 5 AND words = 1 THEN 'text_without_words' WHEN chunk_idx % 13 = 5 AND w1 <> '' THEN 'words_incomplete' END AS reason FROM c)
SELECT book_id, chunk_idx, CASE WHEN reason IS NULL THEN words - CASE WHEN chunk_idx % 13 = 5 THEN 1 ELSE 0 END END AS words,
  CASE WHEN reason IS NULL THEN CASE WHEN chunk_idx % 13 = 5 THEN l1 ELSE letters END END AS letters, CASE WHEN reason IS NULL THEN last_ms END AS last_ms, reason FROM r""",
    "segment_json": f"""WITH {PARTS}, n AS (SELECT *, count(*) OVER (PARTITION BY book_id, chunk_idx) * 500 AS d FROM pt),
g AS (SELECT * FROM n WHERE book_id % 17 <> 3 AND d <= 30000 AND pos % 3 <> 2 AND text NOT IN ('[Silence]', '[silence]', '[BLANK_AUDIO]'))
SELECT book_id, chunk_idx, row_number() OVER (PARTITION BY book_id, chunk_idx ORDER BY pos) - 1 AS pos, pos * 500 AS start_ms, least(pos * 500 + 507, d) AS end_ms, text, NULL AS reason FROM g
UNION ALL SELECT DISTINCT book_id, chunk_idx, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL, CASE WHEN d > 30000 THEN 'duration' ELSE 'language' END FROM n WHERE book_id % 17 = 3 OR d > 30000""",
    "silence_log": f"""WITH {MARKS}, m AS (SELECT * FROM tl WHERE event_type IN ('error', 'purchase')),
o AS (SELECT *, lag(event_type) OVER w AS pt, lag(t) OVER w AS pv, lead(event_id) OVER w AS nx FROM m WINDOW w AS (PARTITION BY book_id ORDER BY event_id))
SELECT book_id, pv AS from_ms, t AS until_ms FROM o WHERE event_type = 'purchase' AND pt = 'error' AND t > pv
UNION ALL SELECT book_id, t, duration_ms FROM o JOIN bk USING (book_id) WHERE event_type = 'error' AND nx IS NULL AND duration_ms > t""",
    "chapter_log": f"""WITH {MARKS} SELECT book_id, CASE WHEN event_id % 2 = 0 THEN t ELSE (t * 90 + 7) * 1000 // 90000 END AS boundary_ms
FROM tl WHERE event_type = 'purchase' AND event_id % 5 <> 4""",
    "duration_log": f"WITH {MARKS} SELECT book_id, arg_min(t, event_id) // 10 * 10 AS duration_ms FROM tl GROUP BY ALL",
    "ocr_evidence": f"""WITH {BLK}, w AS (SELECT book_id, block_ord, unnest(regexp_split_to_array(text, ' +')) AS word, unnest(range(0, len(regexp_split_to_array(text, ' +')))) AS i FROM blk),
c AS (SELECT *, CASE WHEN i % 5 = 4 THEN -1.0 WHEN block_ord % 4 = 1 THEN 10.0 ELSE (block_ord + i) % 90 + 10.0 END AS conf FROM w WHERE word <> ''),
l AS (SELECT book_id, block_ord, i // 6 AS ln, string_agg(word, ' ' ORDER BY i) AS line, sum(conf) AS cs, count(*) AS n FROM c WHERE conf >= 0 GROUP BY ALL),
b AS (SELECT book_id, block_ord, sum(cs) / sum(n) AS mean FROM l GROUP BY ALL),
f AS (SELECT book_id, block_ord, min(ln) AS ln, arg_min(line, ln) AS line FROM l WHERE length(regexp_replace(line, '[^\\p{{L}}\\p{{M}}\\p{{N}}]', '', 'g')) BETWEEN 2 AND 240
  GROUP BY book_id, block_ord, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')),
e AS (SELECT book_id, block_ord, string_agg(line, '|' ORDER BY ln) AS lines FROM f GROUP BY ALL)
SELECT book_id, block_ord, lines, floor(least(greatest(mean, 0), 100) + 0.5)::BIGINT AS confidence_percent FROM b JOIN e USING (book_id, block_ord) WHERE mean >= 20""",
    "review_report": f"""WITH {ENDS} SELECT book_id, seg, id, edge, CASE edge WHEN 'introduction' THEN '{EDGE_REASON["introduction"]}' WHEN 'credits' THEN '{EDGE_REASON["credits"]}' END AS reason, edge_href FROM rep""",
    "review_decisions": f"WITH {items('smart')} SELECT {DEC} FROM dec",
    "review_all_decisions": f"WITH {items('review_all')} SELECT {DEC} FROM dec",
    "review_summary": f"""WITH {items('smart')} SELECT book_id, count(*) AS unmatched, count(*) FILTER (state = 'pending') AS pending, bool_and(state <> 'pending') AS complete FROM dec GROUP BY ALL""",
    "applied_decisions": f"""WITH {items('smart')}, a AS (SELECT *, seg % 3 = 0 OR seg % 4 = 1 AS asked, seg % 10 = 3 AS unknown, seg % 4 = 1 AS bad FROM dec),
u AS (SELECT *, asked AND NOT unknown AND NOT bad AS ok FROM a)
SELECT book_id, seg, CASE WHEN ok OR state = 'pending' THEN 'excluded' ELSE state END AS state, CASE WHEN ok THEN 'cut' WHEN state = 'pending' THEN '{BULK_REASON}' ELSE reason END AS detail FROM u
UNION ALL SELECT -1, count(*), 'refused', CASE WHEN unknown THEN 'unknown_id' ELSE 'reason_missing' END FROM u WHERE asked AND NOT ok GROUP BY ALL""",
    "decision_audit": f"""WITH {items('smart')}, b AS (SELECT book_id, seg, state, CASE WHEN seg % 4 = 0 THEN ' ' ELSE href END AS href, CASE WHEN seg % 4 = 1 THEN 1 ELSE line_index END AS line_index,
  supplemental, CASE WHEN seg % 4 = 2 THEN 'credits' ELSE classification END AS classification, CASE WHEN seg % 4 = 3 THEN NULL ELSE reason END AS reason FROM dec)
{rules('b', 'seg', href_blank="state = 'assigned' AND trim(coalesce(href, '')) = ''", target_count="state = 'assigned' AND (line_index IS NOT NULL)::INT + (supplemental IS NOT NULL)::INT <> 1",
       before_needs_introduction="state = 'assigned' AND supplemental = 'before_anchor' AND coalesce(classification, '') <> 'introduction'",
       after_needs_credits="state = 'assigned' AND supplemental = 'after_anchor' AND coalesce(classification, '') <> 'credits'",
       reason_missing="state = 'excluded' AND trim(coalesce(reason, '')) = ''")}""",
    "review_audit": f"""WITH {ENDS}, a AS (SELECT book_id, seg, CASE WHEN seg % 9 = 0 THEN '' WHEN seg % 9 = 1 THEN 'same' ELSE id END AS id, CASE WHEN seg % 8 = 1 THEN 0 ELSE start_ms END AS s,
  CASE WHEN seg % 10 = 0 THEN CASE WHEN seg % 8 = 1 THEN 0 ELSE start_ms END ELSE end_ms END AS e0, start_ms, end_ms FROM rep),
a2 AS (SELECT *, CASE WHEN seg % 10 = 0 THEN start_ms ELSE end_ms END AS e FROM a),
b AS (SELECT *, lag(e) OVER (PARTITION BY book_id ORDER BY seg) AS before FROM a2),
d AS (SELECT book_id, id FROM a GROUP BY ALL HAVING count(*) > 1)
{rules('b', 'seg', id_blank="id = ''", time_range='e <= s', overlap='s < before')} UNION ALL {rules('d', 'id', id_repeated='true')}""",
    "text_candidates": f"WITH {T}, {NEAR}, {jaccard(4)} SELECT * FROM tc",
    "wide_candidates": f"""WITH {T.replace('truth AS (', 'truth0 AS (')}, truth AS (SELECT * REPLACE (CASE WHEN seg % 400 = 2 AND status = 'matched' THEN 'matched' ELSE 'unmatched' END AS status) FROM truth0), {NEAR}, {jaccard(24)} SELECT * FROM tc""",
    "silence_evidence": f"""WITH {MARKS}, v AS (SELECT book_id, event_id AS seg, t AS s, t + 2500 AS e FROM tl),
x AS (SELECT v.book_id, v.seg, sum(CASE WHEN from_ms IS NOT NULL THEN least(e, until_ms) - greatest(s, from_ms) ELSE 0 END)::BIGINT AS q FROM v LEFT JOIN si ON si.book_id = v.book_id AND until_ms > from_ms AND s < until_ms AND from_ms < e GROUP BY ALL)
SELECT book_id, seg, least(coalesce(q, 0), 2500) AS silent_ms, 2500 AS duration_ms, least(coalesce(q, 0), 2500) * 100 // 2500 AS percent FROM x""",
    "effective_alignment": f"WITH {APPLIED} SELECT book_id, seg, status, match_percent, href, line_index, start_char, end_char FROM ef",
    "effective_summary": f"""WITH {APPLIED} SELECT book_id, count(*) AS total_segments, count(*) FILTER (status = 'matched') AS matched_segments,
  round(count(*) FILTER (status = 'matched') * 100.0::DOUBLE / count(*), 6) AS match_percent FROM ef GROUP BY ALL""",
    "effective_violations": f"""WITH {APPLIED}, mo AS (SELECT book_id, seg, at_block, last_value(at_block IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ef)
{rules('ap', 'seg', undecided="status = 'unmatched' AND state IS NULL", content_changed='i_text <> text', target_missing='line AND t_block IS NULL', before_previous='line AND t_block < prev_block', after_next='line AND t_block > next_block')}
UNION ALL {rules('mo', 'seg', not_monotonic='at_block < before')}""",
    "review_worklist": f"""WITH {CANDS}, {NEAR}, {jaccard(24)},
a AS (SELECT book_id, seg, 0 AS kind, block_ord AS place, score_milli, row_number() OVER (PARTITION BY book_id, seg ORDER BY score_milli DESC, block_ord) AS r FROM tc QUALIFY r <= 4),
l AS (SELECT a.book_id, a.seg, kind, place, score_milli, b.text AS label FROM a JOIN blk b ON b.book_id = a.book_id AND b.block_ord = place
  UNION ALL SELECT book_id, seg, 1, rank, NULL, CASE WHEN length(hint) BETWEEN 1 AND 512 THEN hint ELSE regexp_extract(image_href, '([^/]*)$', 1) END FROM rc WHERE rank <= 2)
SELECT book_id, seg, row_number() OVER (PARTITION BY book_id, seg ORDER BY kind, place) AS position, CASE kind WHEN 0 THEN 'text' ELSE 'resource' END AS kind, score_milli, label FROM l""",
    "resource_candidates": f"WITH {CANDS} SELECT book_id, seg, rank, spine_ord, image_href FROM rc",
    "resource_scores": f"WITH {SCORED} SELECT book_id, seg, image_href, coverage_milli, similarity_milli, score_milli, distinctive, qualifies, place, recommended FROM rr",
    "assigned_resources": f"""WITH {SCORED} SELECT rr.book_id, min(rr.seg) AS seg, href, image_href FROM rr JOIN rep USING (book_id, seg) WHERE recommended AND edge IS NULL GROUP BY rr.book_id, href, image_href""",
    "manual_assignments": f"""WITH {CANDS}, w AS (SELECT book_id, seg, edge, 'doc/' || (book_id * 5) AS document_href, 'img/' || book_id || '-5' AS image_href FROM rep)
SELECT w.book_id, w.seg, w.document_href, w.image_href, CASE WHEN edge IS NOT NULL THEN 'edge_item' WHEN rc.rank IS NULL THEN 'not_a_candidate' END AS reason
FROM w LEFT JOIN rc ON rc.book_id = w.book_id AND rc.seg = w.seg AND rc.href = w.document_href AND rc.image_href = w.image_href""",
    "cue_timeline": f"WITH {CUES} SELECT book_id, section_ord, start_ms, end_ms, cue_id, anchor FROM cu",
    "cue_order_audit": f"""WITH {FAULTY}, o AS (SELECT *, lag(end_ms) OVER (PARTITION BY book_id, section_ord ORDER BY start_ms, end_ms, cue_id) AS before FROM fc)
{rules('o', 'cue_id', anchor_missing="anchor = ''", time_range='end_ms <= start_ms', overlap='start_ms < before')}""",
    "page_durations": f"""WITH {CUES}, p AS (SELECT book_id, section_ord, sum(end_ms - start_ms)::BIGINT AS duration_ms FROM cu GROUP BY GROUPING SETS ((book_id, section_ord), (book_id)))
SELECT *, {CLOCK('duration_ms')} AS clock FROM p""",
    "overlay_documents": f"""WITH {CUES}, p AS (SELECT c.*, s.href || '.xhtml' AS th, '<par id="' || cue_id || '"><text src="' || s.href || '.xhtml#b' || (anchor[2:-2]) || '%C3%A9"/><audio src="../audio/a&amp;b.mp3" clipBegin="' ||
  {CLOCK('start_ms')} || '" clipEnd="' || {CLOCK('end_ms')} || '"/></par>' AS par FROM cu c JOIN sec s USING (book_id, section_ord))
SELECT book_id, section_ord, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<smil xmlns="http://www.w3.org/ns/SMIL" xmlns:epub="http://www.idpf.org/2007/ops" version="3.0"><body><seq epub:textref="' || any_value(th) || '">'
  || string_agg(par, '' ORDER BY start_ms, end_ms, cue_id) || '</seq></body></smil>' AS document FROM p GROUP BY book_id, section_ord""",
    "build_summary": f"WITH {CUES} SELECT book_id, count(DISTINCT section_ord) AS pages, count(*) AS segments, sum(end_ms - start_ms)::BIGINT AS duration_ms FROM cu GROUP BY ALL",
    "sync_documents": f"""WITH {T} SELECT book_id, href, count(*) AS segments FROM truth WHERE status = 'matched' GROUP BY ALL
UNION ALL SELECT book_id, 'crosses_block', count(*) FROM truth WHERE status = 'matched' AND seg % 80 = 7 GROUP BY ALL""",
    "supplemental_pages": f"""WITH {SUPP} SELECT book_id, review_ord, classification, placement, anchor_href, page_id, href, duration_ms,
  '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="en"><head><title>' || ti || '</title><meta charset="utf-8"/></head><body epub:type="' || ty || '"><section><h1>' || ti
  || '</h1><p id="stl-extra-text-' || (review_ord + 1) || '">' || {ESC('text')} || '</p></section></body></html>' AS xhtml
FROM (SELECT *, CASE classification WHEN 'introduction' THEN '{SIDES["introduction"][0]}' ELSE '{SIDES["credits"][0]}' END AS ti, CASE classification WHEN 'introduction' THEN '{SIDES["introduction"][1]}' ELSE '{SIDES["credits"][1]}' END AS ty FROM su)""",
    "extended_spine": f"""WITH {SUPP}, r AS (SELECT book_id, href, section_ord AS a0, 0 AS side, 0 AS turn FROM sec
  UNION ALL SELECT su.book_id, su.href, s.section_ord, CASE placement WHEN 'before_anchor' THEN -1 ELSE 1 END, review_ord FROM su JOIN sec s ON s.book_id = su.book_id AND s.href = su.anchor_href)
SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY a0, side, turn) - 1 AS spine_ord, href, side <> 0 AS supplemental FROM r""",
    "unique_names": f"""WITH {BLK}, a AS (SELECT book_id, block_ord AS ord, lower(substr(text, 1, 1)) AS base, row_number() OVER (PARTITION BY book_id, lower(substr(text, 1, 1)) ORDER BY block_ord) AS nth FROM blk),
u AS (SELECT DISTINCT book_id, lower(substr(text, 1, 1)) AS base, CASE WHEN block_ord % 2 = 0 THEN 1 ELSE block_ord % 5 END AS k FROM blk WHERE block_ord % 9 = 4 AND (block_ord % 2 = 0 OR block_ord % 5 >= 2)),
fr AS (SELECT b.book_id, b.base, i, row_number() OVER (PARTITION BY b.book_id, b.base ORDER BY i) AS nth
  FROM (SELECT book_id, base, unnest(range(1, count(*) + 7)) AS i FROM a GROUP BY book_id, base) b ANTI JOIN u ON u.book_id = b.book_id AND u.base = b.base AND u.k = b.i)
SELECT a.book_id, a.ord, a.base || CASE WHEN i = 1 THEN '' ELSE '-' || i END AS name FROM a JOIN fr USING (book_id, base, nth)""",
    "reading_order": f"""WITH {PACK} SELECT sp.book_id, row_number() OVER (PARTITION BY sp.book_id ORDER BY spine_ord) - 1 AS section_ord, href AS entity FROM sp JOIN mf ON mf.book_id = sp.book_id AND id = idref WHERE media_type = 'application/xhtml+xml' AND NOT nav
UNION ALL SELECT sp.book_id, -1, idref FROM sp WHERE idref NOT IN (SELECT id FROM mf)""",
    "package_audit": f"""WITH {PACK}, b AS (SELECT DISTINCT book_id, CASE WHEN book_id % 8 = 3 THEN '2.0' ELSE '3.0' END AS version, (book_id % 6 <> 1)::INT + (book_id % 9 = 2)::INT AS n FROM mf),
i AS (SELECT * FROM mf WHERE doc_id % 20 = 4), r AS (SELECT book_id, media_overlay FROM mf WHERE media_overlay IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
{rules('i', 'id', id_repeated='true')} UNION ALL {rules('r', 'media_overlay', duration_repeated='true')} UNION ALL {rules('b', 'version', version="version = '2.0'", total_missing='n = 0', total_repeated='n > 1')}""",
    "overlay_audit": f"""WITH {PACK}, o AS (SELECT DISTINCT book_id, media_overlay, media_overlay[2:]::BIGINT AS n FROM mf WHERE media_overlay IS NOT NULL),
pg AS (SELECT m.book_id, m.id, m.media_overlay, n FROM mf m JOIN o USING (book_id, media_overlay) WHERE media_type = 'application/xhtml+xml'),
sh AS (SELECT book_id, media_overlay FROM pg GROUP BY ALL HAVING count(*) > 1),
bb AS (SELECT DISTINCT book_id FROM mf), ns AS (SELECT book_id FROM bb WHERE book_id NOT IN (SELECT book_id FROM pg))
{rules('pg', 'media_overlay', overlay_missing='n % 10 = 1', overlay_type='n % 10 = 2', overlay_without_cues='n % 4 = 0')} UNION ALL {rules('sh', 'media_overlay', overlay_shared='true')}
UNION ALL {rules('bb', 'book_id', audio_missing='book_id % 5 = 4')} UNION ALL {rules('ns', 'book_id', no_synced_page='true')}""",
    "cue_audit": f"""WITH {FAULTY}, ids AS (SELECT book_id, section_ord, 'b' || line_index || 'é' AS anchor FROM blk WHERE line_index % 9 <> 8),
dg AS (SELECT * FROM fc ANTI JOIN ids USING (book_id, section_ord, anchor))
{rules('fc', 'cue_id', text_missing="anchor = ''", clip_range='end_ms <= start_ms')} UNION ALL {rules('dg', 'cue_id', fragment_missing="anchor <> ''")}""",
    "id_audit": f"""WITH {BLK} SELECT book_id, 'id_repeated' AS rule, section_ord || '#h' || sha256(text) AS entity FROM blk GROUP BY book_id, section_ord, text HAVING count(*) > 1""",
    "duration_audit": f"""WITH {CUES}, p AS (SELECT book_id, section_ord, book_id * 5 + section_ord AS n FROM cu GROUP BY ALL)
{rules('p', 'section_ord', duration_missing='n % 13 = 6', duration_differs='n % 10 = 3 AND n % 13 <> 6')}""",
    "archive_audit": f"""WITH d AS (SELECT doc_id // 5 AS book_id, doc_id, 'd/' || CASE WHEN doc_id % 10 = 1 THEN doc_id - 1 ELSE doc_id END AS path, CASE WHEN doc_id % 9 = 4 THEN 0 ELSE length(text) END AS size FROM documents),
b AS (SELECT DISTINCT book_id, CASE WHEN book_id % 7 = 1 THEN 'mime' ELSE 'mimetype' END AS path FROM d), t AS (SELECT book_id, path FROM d GROUP BY ALL HAVING count(*) > 1)
{rules('b', 'path', first_name='book_id % 7 = 1', first_value='book_id % 6 = 2', first_compressed='book_id % 5 = 3')} UNION ALL {rules('d', 'path', resource_empty='size = 0', oversize='size > 10000')}
UNION ALL {rules('t', 'path', name_repeated='true')}""",
    "row_fingerprints": """SELECT doc_id, 'sha256:' || sha256('{"doc_id":' || doc_id || ',"quality":' || quality || ',"toxic":' || toxic || '}') AS fingerprint FROM labels""",
    "stage_fingerprints": f"SELECT book_id, stage, fingerprint FROM ({fingerprint(False)})",
    "recompute_plan": f"WITH {RECOMPUTE} SELECT book_id, stage, o < coalesce(stale, 7) AS reuse FROM pw",
    "artifact_diff": f"WITH {ARTIFACTS} SELECT * FROM df WHERE change IS NOT NULL",
    "reusable_prefix": f"""WITH {RECOMPUTE}, {ARTIFACTS}, bad AS (SELECT book_id, min(list_position({STAGE_LIST}, stage) - 1) AS bad FROM df WHERE change IN ('missing', 'changed') GROUP BY ALL)
SELECT pw.book_id, pw.stage, pw.o < coalesce(stale, 7) AND pw.o < coalesce(bad, 6) AND pw.o < 6 AS reuse FROM pw LEFT JOIN bad USING (book_id)""",
    "run_progress": f"""WITH r AS (SELECT event_id // 7 AS book_id, {WEIGHTS}[event_id % 7 + 1] AS w, ['completed', 'cached', 'running', 'failed', 'pending', 'skipped'][(event_id * 5 + user_id) % 6 + 1] AS s, user_id * 13 % 101 AS p FROM events)
SELECT book_id, least(sum(w * CASE WHEN s IN ('completed', 'cached', 'skipped') THEN 100 WHEN s IN ('running', 'failed') THEN p ELSE 0 END) // 100, 100)::BIGINT AS percent FROM r GROUP BY ALL""",
    "chunk_progress": f"""WITH {MARKS}, c AS (SELECT book_id, event_id % 700 + 1 AS n, event_type = 'click' AS done FROM tl)
SELECT book_id, count(*) FILTER (done) AS completed_chunks, count(*) AS total_chunks, least((coalesce(sum(n) FILTER (done), 0) * 100) // sum(n), 100)::BIGINT AS percent FROM c GROUP BY ALL""",
}
