"""SQL of the planted queries, all values written out."""

ORACLE = {
    "markup_references": """SELECT page_id, 'café € &lt; &lt; &nosuch; éé <i> ' || page_id || chr(10) || 'z…' || chr(10) || 'end &' AS text FROM pages""",
    "markup_nested": """SELECT page_id, 'a' || page_id || chr(10) || 'b' || chr(10) || 'c' || chr(10) || 'd' || chr(10) || CASE WHEN page_id % 2 = 0 THEN 'own' ELSE 'open e' END AS text FROM pages""",
    "images_quoted": """SELECT page_id, n AS image_ordinal, replace(h, '#', page_id::VARCHAR) AS href, replace(w, '#', page_id::VARCHAR) AS hints
        FROM pages, (VALUES (0::BIGINT, 'p#.png', 'one>two|Title'), (1, 'm.png', 'Map #'), (2, 'd.png', 'deep words'), (3, 'x>y.jpg', ''), (10, 'l>#', 'to > there|link text')) t(n, h, w)""",
    "silence_bounds": """SELECT c_custkey AS book_id, 0::BIGINT AS from_ms, (1500 + c_custkey % 3 * 1000)::BIGINT AS until_ms FROM customer
        UNION ALL SELECT c_custkey, ((c_custkey % 7 + 5) * 1000)::BIGINT, 9000::BIGINT FROM customer WHERE c_custkey % 7 < 4""",
    "decisions_repeated": """SELECT o_custkey AS book_id, o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 11 = 0 THEN 'pending' ELSE 'excluded' END AS state,
          NULL::VARCHAR AS rejected FROM orders
        UNION ALL SELECT o_custkey, o_orderkey::VARCHAR, 'reason ' || n, 'decision_repeated' FROM orders, (VALUES (1), (2)) t(n) WHERE o_orderkey % 5 = 0 AND o_orderkey % 11 <> 0
        UNION ALL SELECT o_custkey, 'no-' || o_orderkey, 'reason ' || n, 'unknown_id' FROM orders, (VALUES (1), (2)) t(n) WHERE o_orderkey % 11 = 0 AND (n = 1 OR o_orderkey % 5 = 0)""",
    "drafts_repeated": """SELECT o_custkey AS book_id, o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 9 <> 0 THEN 'excluded' ELSE 'pending' END AS state,
        CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 9 <> 0 THEN 'draft 1' END AS reason FROM orders""",
    "drafts_read": """WITH o AS (SELECT o_custkey AS b, o_orderkey AS k, o_orderkey::VARCHAR AS id FROM orders)
        SELECT b AS book_id, id, CASE WHEN x THEN 'excluded' ELSE 'pending' END AS state,
          CASE WHEN x THEN CASE WHEN k % 27 = 18 THEN 'draft 2' ELSE 'draft 1' END END AS said, NULL::VARCHAR AS rejected
        FROM (SELECT *, k % 3 = 0 AND k % 11 <> 0 AND k % 13 <> 0 AND k % 27 <> 9 AS x FROM o)
        UNION ALL SELECT b, id, 'draft', CASE WHEN k % 13 = 0 THEN ' ' WHEN k % 27 = 0 THEN 'draft 1' ELSE 'draft ' || n END,
          CASE WHEN k % 11 = 0 THEN 'draft_version' WHEN k % 13 = 0 THEN 'reason_missing' WHEN k % 27 = 9 THEN 'draft_repeated' ELSE 'draft_older' END
        FROM o, (VALUES (1), (2)) t(n)
        WHERE k % 3 = 0 AND (n = 1 OR k % 9 = 0) AND (k % 11 = 0 OR k % 13 = 0 OR k % 27 = 9 OR (k % 27 = 18 AND n = 1))""",
    "reports_read": """SELECT o_custkey AS book_id, CASE WHEN o_orderkey % 5 > 1 THEN o_orderkey::VARCHAR ELSE 'review-' || sha256(unhex('04000000000000000A000000000000001400000000000000') || encode('spoken words')) END AS id,
          CASE WHEN o_orderkey % 3 = 0 OR o_custkey % 4 = 1 THEN 'excluded' ELSE 'pending' END AS state,
          CASE WHEN o_orderkey % 3 = 0 THEN 'own' WHEN o_custkey % 4 = 1 THEN 'Legacy whole-report unmatched-audio exclusion.' END AS reason
        FROM orders""",
    "totals_audited": """WITH o AS (SELECT o_custkey AS b, o_orderkey AS k FROM orders),
        i AS (SELECT b, k, n FROM o, (VALUES (1), (2)) t(n) WHERE (k % 2 = 0 OR k % 15 = 1) AND k % 14 <> 2 AND (n = 1 OR k % 22 = 4)),
        c AS (SELECT b, count(*) AS total, count(*) FILTER (k % 2 = 1) AS hit FROM o GROUP BY b),
        s AS (SELECT c.*, coalesce(listed, 0) AS listed FROM c LEFT JOIN (SELECT b, count(*) AS listed FROM i GROUP BY b) USING (b))
        SELECT b AS book_id, 'matched_exceeds_total' AS rule, 'book' AS entity FROM s WHERE hit + CASE WHEN b % 7 = 0 THEN 1000 ELSE 0 END > total + CASE WHEN b % 5 = 0 THEN 1 ELSE 0 END
        UNION ALL SELECT b, 'total_differs', 'book' FROM s WHERE b % 5 = 0
        UNION ALL SELECT b, 'matched_differs', 'book' FROM s WHERE b % 7 = 0
        UNION ALL SELECT b, 'unmatched_differs', 'book' FROM s WHERE listed <> total - hit
        UNION ALL SELECT b, 'segment_missing', (-k)::VARCHAR FROM i WHERE k % 26 = 6
        UNION ALL SELECT b, 'segment_matched', k::VARCHAR FROM i WHERE k % 2 = 1
        UNION ALL SELECT b, 'segment_changed', k::VARCHAR FROM i WHERE k % 34 = 8 AND k % 26 <> 6
        UNION ALL SELECT DISTINCT b, 'segment_repeated', CASE WHEN k % 26 = 6 THEN -k ELSE k END::VARCHAR FROM i WHERE k % 22 = 4""",
    "ocr_source": """WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS h FROM orders)
        SELECT k AS book_id, 'page' || k || ' two words|line' || k AS said, 80::BIGINT AS row FROM o
        UNION ALL SELECT k, r, (h + i)::BIGINT FROM o, (VALUES ('confidence', 3), ('confidence', 4), ('columns', 5), ('text_blank', 7)) t(r, i)""",
    "overlay_documents_audited": """SELECT o_orderkey AS book_id, r AS rule, 'smil/o.smil ' || e AS entity FROM orders, (VALUES (1, 'text_missing', 'par 1'), (2, 'fragment_missing', 'par 1'),
          (3, 'target_other_page', 'par 1'), (4, 'fragment_blank', 'par 1'), (5, 'target_missing', 'par 1'), (6, 'audio_missing', 'par 1'), (6, 'clip_begin_missing', 'par 1'), (6, 'clip_end_missing', 'par 1'),
          (7, 'clip_begin_missing', 'par 1'), (8, 'clip_range', 'par 1'), (9, 'audio_undeclared', 'par 1'), (10, 'audio_empty', 'par 1'), (11, 'nested_pair', 'par 1'), (12, 'open_pair', 'par 1'),
          (13, 'clock_invalid', 'par 1'), (14, 'textref_missing', 'seq 0'), (15, 'target_other_page', 'seq 0')) t(n, r, e) WHERE o_orderkey % 16 = n""",
    "source_packages_audited": """SELECT o_orderkey AS book_id, r AS rule, e AS entity FROM orders, (VALUES (1, 'earlier_overlay', '3.0'), (1, 'page_overlaid', 'OPS/p q.xhtml'), (2, 'earlier_overlay', '3.0'),
          (3, 'version_missing', ''), (4, 'version_unsupported', '2.0'), (5, 'metadata_missing', '3.0'), (6, 'earlier_overlay', '3.0'), (7, 'manifest_missing', '3.0')) t(n, r, e) WHERE o_orderkey % 8 = n""",
    "recompute_unknown": """WITH s(stage, o) AS (VALUES ('prepare', 0), ('analyze', 1), ('align', 2), ('review_audio', 3), ('encode', 4), ('build_epub', 5), ('validate', 6))
        SELECT doc_id AS book_id, stage, o < least(CASE WHEN doc_id % 4 = 1 THEN 3 ELSE 7 END, CASE WHEN doc_id % 5 = 2 THEN 0 ELSE 7 END, CASE WHEN doc_id % 7 = 3 THEN 4 ELSE 7 END) AS reuse
        FROM documents, s""",
    "edges_kept": """SELECT o_custkey AS book_id, o_orderkey::VARCHAR AS id, CASE WHEN k THEN 'assigned' ELSE 'pending' END AS state, CASE WHEN k THEN 'page-' || o_orderkey END AS href,
          CASE WHEN k THEN CASE o_orderkey % 3 WHEN 0 THEN 'before_anchor' ELSE 'after_anchor' END END AS supplemental,
          CASE WHEN k THEN CASE o_orderkey % 3 WHEN 0 THEN 'introduction' ELSE 'credits' END END AS classification, CASE WHEN k THEN 'manual' END AS source
        FROM (SELECT *, o_orderkey % 2 = 0 AND o_orderkey % 3 < 2 AS k FROM orders)""",
    "readouts_checked": """WITH o AS (SELECT o_custkey AS b, o_orderkey AS k, 'page-' || o_orderkey % 50 AS h, 'img-' || o_orderkey % 20 AS i FROM orders)
        SELECT b AS book_id, 'readout_without_image' AS rule, k::VARCHAR AS entity FROM o WHERE k % 5 <> 0 AND k % 4 = 0
        UNION ALL SELECT b, 'image_without_readout', k::VARCHAR FROM o WHERE k % 4 <> 0 AND k % 5 = 0
        UNION ALL SELECT b, 'mixed_target', k::VARCHAR FROM o WHERE k % 4 <> 0 AND k % 17 = 0
        UNION ALL SELECT b, 'time_range', k::VARCHAR FROM o WHERE k % 4 <> 0 AND k % 13 = 0
        UNION ALL SELECT b, 'target_repeated', h || '#' || i FROM o WHERE k % 4 <> 0 GROUP BY b, h, i HAVING count(*) > 1
        UNION ALL SELECT b, 'readout', k || ' ' || h || ' ' || i FROM o WHERE k % 4 <> 0""",
    "resources_anchored": """SELECT o_orderkey AS book_id, CASE WHEN o_orderkey % 7 = 5 THEN 'absent' ELSE 'image' END AS image_href,
          CASE WHEN o_orderkey % 7 = 5 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'own-' || o_orderkey WHEN o_orderkey % 2 = 0 THEN 'stl-graphic-s1-r1-2' ELSE 'stl-graphic-s1-r1' END AS anchor
        FROM orders""",
    "windows_reversed": "SELECT o_orderkey AS book_id, 'window_reversed' AS rule, '1' AS entity FROM orders WHERE o_orderkey % 2 = 0",
}
