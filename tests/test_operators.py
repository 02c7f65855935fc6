"""Literal cases of the other operators, publication, and the stream."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from textsync.functions.markup import markup_to_text, tag_attr
from textsync.functions.paths import relative_path, resolve_href
from textsync.functions.text import evidence_lines, format_clock, parse_clock
from textsync.operators import overlay, resources, timeline
from textsync.operators.ordered import last_before, next_after, scan, total_before
from textsync.sources import archives, logs, sinks, transcripts
from textsync.streaming import merge


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


def test_markup(spark):
    html = ("<html><head><title>x</title><style>p{}</style></head><body><script>a()</script><h1>Chapter &amp; One</h1>"
            "<p>Hello&nbsp;<b>world</b>.</p><p>Second\n paragraph<br/>next line.</p></body></html>")
    assert one(spark, markup_to_text(F.lit(html))) == "Chapter & One\nHello world.\nSecond paragraph\nnext line."
    assert one(spark, markup_to_text(F.lit("<p>&lt;p&gt; &amp;lt; &#65;</p>"))) == "<p> &lt; A"
    assert one(spark, tag_attr(F.lit('<image xlink:href="a&amp;b"/>'), "href")) == "a&b"


def test_paths_and_clocks(spark):
    href = lambda b, h: one(spark, resolve_href(F.lit(b), F.lit(h)))
    assert href("OPS/package", "../Text/chapter.xhtml#frag").path == "OPS/Text/chapter.xhtml"
    assert href("OPS", "../../outside.xhtml").reason == "bad_path"
    assert href("", "Text/ch%201.xhtml").path == "Text/ch 1.xhtml"
    assert one(spark, relative_path(F.lit("OPS/extra/overlays"), F.lit("OPS/Text/chapter.xhtml"))) == "../../Text/chapter.xhtml"
    assert one(spark, format_clock(F.lit(3723045).cast("bigint"))) == "1:02:03.045"
    assert one(spark, parse_clock(F.lit("1:02:03.04"))) == 3723040
    assert one(spark, parse_clock(F.lit("1:62:03.04"))) is None


def test_evidence_lines(spark):
    lines = F.array(F.lit(" Family   tree "), F.lit("family tree"), F.lit("Figure two"))
    assert one(spark, evidence_lines(lines)) == ["Family tree", "Figure two"]


def test_scan_equals_window(spark):
    rows = [(i % 2, i, i if i % 3 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "k bigint, o bigint, v bigint").repartition(5)
    got = scan(df, ["k"], ["o"], [F.floor(F.col("o") / 7), F.floor(F.floor(F.col("o") / 7) / 3)],
               n=total_before(F.lit(1)), last=last_before(F.col("v")), nxt=next_after(F.col("v")))
    for r in got.collect():
        mine = [x for x in rows if x[0] == r.k]
        before = [x[2] for x in mine if x[1] < r.o and x[2] is not None]
        after = [x[2] for x in mine if x[1] > r.o and x[2] is not None]
        assert (r.n, r["last"], r.nxt) == (sum(x[1] < r.o for x in mine), (before or [None])[-1], (after or [None])[0])


def test_chunk_plan(spark):
    books = spark.createDataFrame([(1, 60001), (2, 1), (3, 30000), (4, 30001), (5, 36000001)], "book_id bigint, duration_ms bigint")
    chapters = spark.createDataFrame([(1, 28000), (1, 30001), (1, 58000)], "book_id bigint, boundary_ms bigint")
    plan = timeline.plan_chunks(books, chapters, 30000).cache()
    assert [r.end_ms for r in plan.where("book_id = 1").orderBy("chunk_idx").collect()] == [28000, 58000, 60001]
    assert timeline.audit_chunks(plan, books).isEmpty()


def test_phrases(spark):
    words = [("Hello", 0.1, 0.4), ("world.", 0.4, 1.0), ("Next", 1.2, 1.5), ("sentence.", 1.5, 2.0)]
    late = [(b, 0, i, w, 0.9 if b == 2 and i == 2 else s, e, 0.9, 2000) for b in (1, 2) for i, (w, s, e) in enumerate(words)]
    df = spark.createDataFrame(late, "book_id bigint, chunk_idx bigint, pos int, word string, start double, end double, probability double, duration_ms bigint")
    rows = timeline.phrases(df).orderBy("book_id", "pos").collect()
    assert [(r.book_id, r.start_ms, r.end_ms) for r in rows] == [(1, 100, 1000), (1, 1200, 2000), (2, 100, 2000)]


def test_logs_and_json(spark):
    text = ["Duration: 10:02:03.450,", "[CHAPTER]", "TIMEBASE=1/1000", "END=1800000", "[CHAPTER]", "TIMEBASE=1/10000000", "END=36000000000",
            "silence_start: 12.500", "silence_end: 13.250"]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(text)], "book_id bigint, line_no bigint, line string")
    assert logs.read_durations(lines).first().duration_ms == 36123450
    assert sorted(r.boundary_ms for r in logs.read_chapter_metadata(lines).collect()) == [1800000, 3600000]
    assert logs.read_silence_log(lines).collect() == [(1, 12500, 13250)]
    json = ('{"params":{"language":"en","translate":false},"result":{"language":"en"},"transcription":['
            '{"offsets":{"from":120,"to":1850},"text":" Hello world. "},{"offsets":{"from":1,"to":2},"text":"[BLANK_AUDIO]"}]}')
    good, bad = transcripts.read_segment_json(spark.createDataFrame([(1, 0, 2000, json), (2, 0, 2000, "{")], "book_id bigint, chunk_idx int, duration_ms bigint, json string"))
    assert [(r.start_ms, r.end_ms, r.text) for r in good.collect()] == [(120, 1850, "Hello world.")]
    assert bad.first().book_id == 2


def test_anchors_and_names(spark):
    html = '<html><body id="b"><h1>T</h1><div>one <p id="x">two<br/>three</p> four</div></body></html>'
    pages = spark.createDataFrame([(1, 0, html)], "book_id bigint, section_ord int, html string")
    rows = overlay.line_anchors(pages).orderBy("line_index").collect()
    assert [r.anchor for r in rows] == ["stl-mo-s1-b2", "stl-mo-s1-b3", "x", "x", "stl-mo-s1-b3"]
    asked = spark.createDataFrame([(1, b, i) for i, b in enumerate(["a", "a", "a", "c", "d", "d-2", "d"])], "book_id int, base string, ord int")
    used = spark.createDataFrame([(1, "a-2"), (1, "c"), (1, "d-3")], "book_id int, name string")
    names = overlay.unique_names(asked, used, ["book_id"]).orderBy("ord").collect()
    assert [r.name for r in names] == ["a", "a-3", "a-4", "c-2", "d", "d-2", "d-4"]


def test_images(spark):
    html = '<svg><title>Big map</title><image xlink:href="m.png"/></svg><img src="q.png" alt="A  b" title="a B"/>'
    refs = resources.resource_refs(spark.createDataFrame([(1, html)], "book_id bigint, html string")).orderBy("image_ordinal").collect()
    assert [(r.href, r.hints) for r in refs] == [("m.png", ["Big map"]), ("q.png", ["A b"])]


def test_archive(spark, tmp_path):
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        z.writestr("OPS/p.opf", '<package version="3.0"><manifest><item id="n" href="n.xhtml" media-type="application/xhtml+xml" properties="nav"/>'
                   '<item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="n"/><itemref idref="a"/></spine></package>')
        z.writestr("OPS/n.xhtml", "<p>nav</p>")
        z.writestr("OPS/a.xhtml", "<html><body><p>Hello</p><p>there</p></body></html>")
    (tmp_path / "b.epub").write_bytes(body.getvalue())
    entries = archives.scan_archives(spark, str(tmp_path)).withColumn("book_id", F.lit(1))
    sections, broken = archives.corpus_of_archives(entries)
    assert [(r.href, r.text) for r in sections.collect()] == [("OPS/a.xhtml", "Hello\nthere")]
    assert broken.isEmpty()


def test_publication(spark, tmp_path):
    out, intents = str(tmp_path / "out"), str(tmp_path / "intents")
    df = spark.range(20).withColumn("x", F.col("id") * 2)
    first = sinks.publish_table(df, out, intents).first()
    assert sinks.publish_table(df.repartition(3), out, intents).first() == first
    with pytest.raises(sinks.PublicationError):
        sinks.publish_table(df.where("id < 9"), out, intents)
    broken = timeline.violations(spark.range(1).select(F.lit(1).alias("book_id")), F.lit("e"), bad=F.lit(True))
    with pytest.raises(sinks.PublicationError):
        sinks.publish_table(df, str(tmp_path / "other"), intents, [broken])


def test_publication_with_two_writers(spark, tmp_path):
    out, intents = str(tmp_path / "out"), str(tmp_path / "intents")
    df = spark.range(20)
    held = sinks._lease(spark, out, intents, "first", 3600)
    (tmp_path / "out.staging-first").mkdir()
    with pytest.raises(sinks.PublicationError, match="under way"):
        sinks.publish_table(df, out, intents)
    assert (tmp_path / "out.staging-first").exists() and not (tmp_path / "out").exists()  # the second touched nothing
    assert sinks.publish_table(df, out, intents, lease_seconds=-1).first().rows == 20  # the first has died: taken over and cleaned
    assert not (tmp_path / "out.staging-first").exists() and not any(p.name.endswith(".lease") for p in (tmp_path / "intents").iterdir())
    seen = []
    inner = sinks.content_digest

    def interleaved(table):  # a second attempt in the middle of the first
        if not seen:
            seen.append(1)
            with pytest.raises(sinks.PublicationError, match="under way"):
                sinks.publish_table(df, str(tmp_path / "two"), intents)
        return inner(table)

    sinks.content_digest = interleaved
    try:
        assert sinks.publish_table(df, str(tmp_path / "two"), intents).first().rows == 20
    finally:
        sinks.content_digest = inner
    assert spark.read.parquet(str(tmp_path / "two")).count() == 20 and held.endswith(".lease")


def test_many_requests_of_one_name(spark):
    asked = spark.range(20000).select(F.lit(1).alias("book_id"), F.lit("x").alias("base"), F.col("id").alias("ord"))
    used = spark.range(1, 5000).select(F.lit(1).alias("book_id"), F.concat(F.lit("x-"), F.col("id") * 3).alias("name"))
    got = [r["name"] for r in overlay.unique_names(asked, used, ["book_id"]).orderBy("ord").collect()]
    taken, want, k = {3 * i for i in range(1, 5000)}, [], 1
    while len(want) < 20000:
        if k not in taken:
            want.append("x" if k == 1 else f"x-{k}")
        k += 1
    assert got == want


def test_stream_order(spark, tmp_path):
    schema = "book_id bigint, chunk_idx bigint, ok boolean, segments array<struct<start_ms:bigint,end_ms:bigint,text:string>>"
    plans = spark.createDataFrame([(b, i, i * 25000, i * 25000 + 25000) for b in (1, 2, 3) for i in range(3)], "book_id bigint, chunk_idx bigint, start_ms bigint, end_ms bigint")
    source = str(tmp_path / "in")
    parts = [[(1, 2, True, [(0, 5, "c")]), (2, 0, True, [(1, 2, "x")])], [(1, 0, True, [(0, 9, "a")]), (2, 1, False, [])], [(1, 1, True, []), (1, 0, True, [(0, 9, "a")]), (3, 1, True, [(0, 1, "z")])]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")
    merged = merge.stream_merge_chunks(stream, plans, timeout_ms=None)
    query = merged.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    rows = spark.read.schema(merge.OUT).parquet(out).collect()
    assert sorted((r.seg, r.start_ms, r.text) for r in rows if r.book_id == 1 and r.status == "segment") == [(0, 0, "a"), (1, 50000, "c")]
    assert {(r.book_id, r.status) for r in rows if r.status != "segment"} == {(1, "complete"), (2, "failed")}
