"""SQL of the queries through files, all values written out."""

from textsync.plans import text_oracle
from textsync.plans.text_oracle import page_text

CONTAINERS = "body address article aside blockquote dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header li main nav ol p pre section table td th tr ul".split()
HIDDEN = "head script style svg math noscript".split()


def visible(c: str) -> str:
    """Pages without comments, declarations and hidden subtrees."""
    x = f"regexp_replace(regexp_replace({c}, '(?s)<!--.*?-->', '', 'g'), '(?s)<\\?.*?\\?>|<![^>]*>', '', 'g')"
    for tag in HIDDEN:
        x = f"regexp_replace({x}, '(?s)<{tag}(?:\\s[^>]*)?/>', '', 'g')"
        x = f"regexp_replace({x}, '(?s)<{tag}(?:\\s[^>]*)?>.*?</{tag}\\s*>', '', 'g')"
    return x


ORACLE = {
    "line_anchors": f"""WITH e AS (SELECT page_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pos
          FROM (SELECT page_id, regexp_extract_all({visible('html')}, '(?s)<[^>]*>|[^<]+') AS pieces FROM pages)),
        t AS (SELECT *, starts_with(piece, '<') AS tag, starts_with(piece, '</') AS shut, regexp_extract(piece, '^</?(?:[\\w.\\-]+:)?([\\w\\-]+)', 1) AS name FROM e),
        f AS (SELECT *, tag AND name IN ({", ".join(f"'{x}'" for x in CONTAINERS)}) AND NOT ends_with(piece, '/>') AS holds,
          tag AND name IN ('br', {", ".join(f"'{x}'" for x in CONTAINERS if x != 'body')}) AS breaks,
          NOT tag AND trim(regexp_replace(replace(piece, '&nbsp;', ' '), '[\\s\\x{{A0}}]+', ' ', 'g')) <> '' AS says FROM t),
        g AS (SELECT *, sum(CASE WHEN holds AND shut THEN -1 WHEN holds THEN 1 ELSE 0 END) OVER w AS depth, sum(breaks::INT) OVER w AS line,
          CASE WHEN holds AND NOT shut THEN sum((holds AND NOT shut)::INT) OVER w END AS number FROM f WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
        o AS (SELECT *, last_value(number IGNORE NULLS) OVER (PARTITION BY page_id, depth ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS inside FROM g),
        l AS (SELECT page_id, line, arg_min(inside, pos) FILTER (depth > 0 AND inside IS NOT NULL) AS owner FROM o WHERE says GROUP BY page_id, line),
        i AS (SELECT page_id, number AS owner, nullif(trim(regexp_extract(piece, '\\sid\\s*=\\s*"([^"]*)"', 1)), '') AS id FROM g WHERE number IS NOT NULL)
        SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY line) - 1 AS line_index,
          CASE WHEN owner IS NULL THEN NULL ELSE coalesce(id, 'stl-mo-s1-b' || owner) END AS anchor, owner IS NOT NULL AND id IS NULL AS generated
        FROM l LEFT JOIN i USING (page_id, owner)""",
    "archive_corpus": f"""WITH p AS (SELECT page_id AS k, page_id // 5 AS b, {page_text()} AS text FROM pages),
        r AS (SELECT *, count(*) OVER (PARTITION BY b ORDER BY k) - 1 AS ord FROM p WHERE k % 9 <> 4 AND b % 13 NOT IN (1, 2, 3, 4))
        SELECT b AS book_id, 'section' AS rule, ord || ' OPS/p' || k || '.xhtml ' || sha256(text) AS entity FROM r WHERE k % 11 <> 3 AND text <> ''
        UNION ALL SELECT b, 'page_missing', 'OPS/p' || k || '.xhtml' FROM r WHERE k % 11 = 3
        UNION ALL SELECT DISTINCT b, 'idref_missing', 'lost' FROM p WHERE b % 6 = 2 AND b % 13 NOT IN (1, 2, 3, 4)
        UNION ALL SELECT DISTINCT b, CASE b % 13 WHEN 1 THEN 'container_missing' WHEN 4 THEN 'archive_broken' ELSE 'package_missing' END,
          CASE WHEN b % 13 = 3 THEN 'OPS/book.opf' ELSE '' END FROM p WHERE b % 13 IN (1, 2, 3, 4)""",
    "documents_written": """WITH j AS (SELECT doc_id // 5 AS book_id, doc_id % 5 AS o, '{"section_ord":' || doc_id % 5 || ',"href":"doc/' || doc_id || '","n":' || coalesce(length(text)::VARCHAR, 'null') || '}' AS row FROM documents)
        SELECT book_id, (o // 2)::BIGINT AS part, sha256('[' || string_agg(row, ',' ORDER BY o) || ']') AS digest FROM j GROUP BY ALL""",
    "documents_published": """WITH j AS (SELECT '{"doc_id":' || doc_id || ',"lang":' || coalesce('"' || lang || '"', 'null') || ',"n_chars":' || n_chars || '}' AS row FROM documents),
        t AS (SELECT count(*) AS rows, sum(('0x' || substr(sha256(row), 1, 15))::BIGINT)::VARCHAR AS digest FROM j)
        SELECT rows, digest FROM t, range(3)""",
    "stream_alignment": f"SELECT book_id, seg, status, match_percent FROM ({text_oracle.ORACLE['alignment']})",
}
