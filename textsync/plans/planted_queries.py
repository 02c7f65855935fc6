"""Queries whose input holds planted faults, one a row of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsync.functions import markup
from textsync.operators import audit, ledger, overlay, resources, review
from textsync.plans import fixtures as fx
from textsync.sources import logs, recognised


def markup_references(spark: SparkSession, d: str) -> DataFrame:
    """Named and numeric references, references of references, quoted tag ends and hidden subtrees around each page's id."""
    page = F.concat(
        F.lit('<p title="a>b">caf&eacute; &euro; &#38;lt; &amp;lt; &nosuch; &#233;&#xE9; &lt;i> '), F.col("page_id"),
        F.lit("</p><script src=\"a>b\">hidden</script><b data-x='>'>z</b>&hellip;<br class=\"x>y\"/>end &"),
    )
    return fx.table(spark, d, "pages").select("page_id", markup.markup_to_text(page).alias("text"))


def markup_nested(spark: SparkSession, d: str) -> DataFrame:
    """Hidden subtrees inside their own kind, one never closed and a stray closing tag, around each page's id and before its markup."""
    page = F.concat(
        F.lit("<p>a"), F.col("page_id"), F.lit('</p><svg><g><x:svg y="a>b">in</x:svg>still</g></svg><p>b</p><noscript><p>x</p><noscript>y</noscript><svg>z</noscript><p>c</p></svg>'),
        F.lit("<math><math/><math>q</math></math><p>d</p>"), F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise(F.lit("<svg>open <b>e</b><script>no</script>")),
    )
    text = F.col("text")
    return fx.table(spark, d, "pages").select("page_id", markup.markup_to_text(page).alias("text"), markup.markup_to_text(F.col("html")).alias("own")).select(
        "page_id", F.when(F.col("page_id") % 2 == 0, F.replace(text, F.col("own"), F.lit("own"))).otherwise(text).alias("text")
    )


def images_quoted(spark: SparkSession, d: str) -> DataFrame:
    """Images and links of a page for each id: tag ends inside quotes, images of nested drawings with the words of their own one."""
    key = F.col("page_id").cast("string")
    page = F.concat(
        F.lit('<img alt="one>two" src="p'), key, F.lit('.png" title="Title"/><svg id=">"><title lang=">">Map '), key,
        F.lit('</title><image xlink:href="m.png"/><svg><desc>deep words</desc><image href="d.png"/></svg></svg>'),
        F.lit("<img src='x>y.jpg'/><image href='no.png'/><a title='to > there' href=\"l>"), key, F.lit('">link <b x=">">text</b></a>'),
    )
    docs = fx.table(spark, d, "pages").select("page_id", page.alias("html"))
    found = resources.resource_refs(docs).unionByName(resources.link_refs(docs).withColumn("image_ordinal", F.col("image_ordinal") + 10))
    return found.select("page_id", F.col("image_ordinal").cast("bigint").alias("image_ordinal"), "href", F.array_join("hints", "|").alias("hints"))


def silence_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Silences that begin before the start or end past the duration, for each customer."""
    key = F.col("book_id")
    marks = [("silence_start: -0.02", 1), (F.concat(F.lit("silence_end: "), key % 3 + 1, F.lit(".5")), 2), (F.concat(F.lit("silence_start: "), key % 7 + 5), 3), ("silence_end: 11.25", 4)]
    line = F.explode(F.array(*[F.struct(F.lit(n).cast("bigint").alias("line_no"), (F.lit(x) if isinstance(x, str) else x).alias("line")) for x, n in marks]))
    books = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("book_id"))
    lines = books.select("book_id", line.alias("m")).select("book_id", "m.line_no", "m.line")
    return logs.read_silence_log(lines, books.withColumn("duration_ms", F.lit(9000).cast("bigint")))


def decisions_repeated(spark: SparkSession, d: str) -> DataFrame:
    """One decision for each order, two for every fifth, and for every eleventh one that names no item."""
    key = F.col("o_orderkey")
    orders = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("book_id"), key, key.cast("string").alias("id"))
    items = orders.withColumn("decision", review.decision("pending")).drop("o_orderkey")
    given = orders.withColumn("id", F.when(key % 11 == 0, F.concat(F.lit("no-"), "id")).otherwise(F.col("id")))
    given = given.withColumn("n", F.explode(F.when(key % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    given = given.select("book_id", "id", review.decision("excluded", reason=F.concat(F.lit("reason "), F.col("n")), source="manual").alias("decision"))
    updated, rejected = review.apply_decisions(items, given)
    return updated.select("book_id", "id", F.col("decision.state").alias("state"), F.lit(None).cast("string").alias("rejected")).unionByName(
        rejected.select("book_id", "id", F.col("decision.reason").alias("state"), F.col("reason").alias("rejected"))
    )


def drafts_repeated(spark: SparkSession, d: str) -> DataFrame:
    """A review item for each order; every third has one manual draft, every ninth two that differ."""
    key = F.col("o_orderkey")
    orders = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("book_id"), key, key.cast("string").alias("id"))
    report = orders.select("book_id", "id", F.lit(None).cast("string").alias("edge"), F.lit(None).cast("string").alias("edge_href"))
    drafts = orders.where(key % 3 == 0).withColumn("n", F.explode(F.when(key % 9 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    drafts = drafts.select("book_id", "id", review.decision("excluded", reason=F.concat(F.lit("draft "), F.col("n")), source="manual").alias("decision"))
    return review.decide(report, drafts, "review_all").select("book_id", "id", F.col("decision.state").alias("state"), F.col("decision.reason").alias("reason"))


def drafts_read(spark: SparkSession, d: str) -> DataFrame:
    """Drafts of every third order: equal ones, contradicting ones, saved one after the other, of another layout, without a reason."""
    key = F.col("o_orderkey")
    orders = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("book_id"), key, key.cast("string").alias("id"))
    report = orders.select("book_id", "id", F.lit(None).cast("string").alias("edge"), F.lit(None).cast("string").alias("edge_href"))
    n = F.explode(F.when(key % 9 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    said = F.when(key % 13 == 0, " ").when(key % 27 == 0, "draft 1").otherwise(F.concat(F.lit("draft "), F.col("n")))
    drafts = orders.where(key % 3 == 0).withColumn("n", n).select(
        "book_id", "id", F.when(key % 27 == 18, F.col("n")).otherwise(7).alias("revision"), F.when(key % 11 == 0, 2).otherwise(1).alias("version"),
        review.decision("excluded", reason=said, source="manual").alias("decision"),
    )
    decided = review.decide(report, drafts, "review_all")
    _, rejected = review.read_drafts(drafts)
    return decided.select("book_id", "id", F.col("decision.state").alias("state"), F.col("decision.reason").alias("said"), F.lit(None).cast("string").alias("rejected")).unionByName(
        rejected.select("book_id", "id", F.lit("draft").alias("state"), F.col("decision.reason").alias("said"), F.col("reason").alias("rejected"))
    )


def reports_read(spark: SparkSession, d: str) -> DataFrame:
    """Stored items of each order: blank ids, and customers whose old report was accepted as a whole."""
    key = F.col("o_orderkey")
    state = F.when(key % 3 == 0, review.decision("excluded", reason="own", source="manual")).otherwise(review.decision("pending"))
    items = fx.table(spark, d, "orders").select(
        F.col("o_custkey").alias("book_id"), F.lit(4).cast("bigint").alias("seg"), F.lit(10).cast("bigint").alias("start_ms"), F.lit(20).cast("bigint").alias("end_ms"),
        F.lit("spoken words").alias("text"), F.when(key % 5 == 0, "\t ").when(key % 5 != 1, key.cast("string")).alias("id"), state.alias("decision"),
    )
    books = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("book_id"), (F.col("c_custkey") % 4 == 1).alias("accepted_exclusion"))
    return review.read_report(items, books).select("book_id", "id", F.col("decision.state").alias("state"), F.col("decision.reason").alias("reason"))


def totals_audited(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as an alignment whose report states wrong totals, repeats, misses or misquotes items."""
    key = F.col("o_orderkey")
    orders = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("book_id"), key.alias("seg"))
    unmatched = F.col("seg") % 2 == 0
    alignment = orders.select(
        "book_id", "seg", F.when(unmatched, "unmatched").otherwise("matched").alias("status"), F.col("seg").alias("start_ms"), (F.col("seg") + 1).alias("end_ms"),
        F.concat(F.lit("said "), F.col("seg")).alias("text"),
    )
    base = alignment.where("seg % 2 = 0 OR seg % 15 = 1").where("seg % 14 <> 2")
    twice = base.withColumn("n", F.explode(F.when(F.col("seg") % 22 == 4, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    items = twice.select(
        "book_id", F.when(F.col("seg") % 26 == 6, -F.col("seg")).otherwise(F.col("seg")).alias("seg"), F.col("start_ms"), (F.col("end_ms") + F.when(F.col("seg") % 34 == 8, 1).otherwise(0)).alias("end_ms"), "text",
    )
    total, hit = F.count(F.lit(1)), F.count(F.when(F.col("seg") % 2 == 1, 1))
    stated = orders.groupBy("book_id").agg((total + F.when(F.col("book_id") % 5 == 0, 1).otherwise(0)).alias("total_segments"), (hit + F.when(F.col("book_id") % 7 == 0, 1000).otherwise(0)).alias("matched_segments"))
    return review.audit_totals(alignment, items, stated)


def ocr_source(spark: SparkSession, d: str) -> DataFrame:
    """A recogniser's table for each order with every fault, read into evidence; rejected lines with their reason."""
    key = F.col("o_orderkey")
    word = lambda line, conf, text: F.concat(F.lit(f"5\t1\t1\t1\t{line}\t1\t0\t0\t9\t9\t"), conf if not isinstance(conf, str) else F.lit(conf), F.lit("\t"), text if not isinstance(text, str) else F.lit(text))
    parts = [
        F.when(key % 2 == 0, "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"),
        word(1, "90.5", F.concat(F.lit("page"), key)), word(1, " 80.5 ", "two\twords"), F.lit("  "),
        word(2, "-1", "box"), word(2, F.when(key % 3 == 0, "NaN").otherwise("5f"), "odd"), F.lit("5\t1\t1\t1"), word(3, "70", F.concat(F.lit("line"), key, F.lit("\r"))), word(3, "10", " \t "),
    ]
    tables = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("book_id"), F.concat_ws("\n", *parts).alias("tsv"))
    words, rejected = recognised.read_words(tables, ["book_id"])
    found = resources.ocr_evidence(words, ["book_id"]).select("book_id", F.array_join("lines", "|").alias("said"), F.col("confidence_percent").cast("bigint").alias("row"))
    return found.unionByName(rejected.select("book_id", F.col("reason").alias("said"), F.col("row").cast("bigint").alias("row")))


def overlay_documents_audited(spark: SparkSession, d: str) -> DataFrame:
    """An overlay document for each order with one fault by its number, next to a sound pair and a comment with a faulty one."""
    key = F.col("o_orderkey")
    pair = lambda text, audio: F.concat(F.lit("<par id='x>'>"), F.lit(text), F.lit(audio), F.lit("</par>"))
    text, sound = '<text src="../page%20one.xhtml#a%20b"/>', '<audio src="a/one.mp3" clipBegin="0:00:01.5" clipEnd="0:00:02"/>'
    faults = {
        1: pair("", sound), 2: pair('<text src="../page%20one.xhtml"/>', sound), 3: pair('<text src="other.xhtml#a%20b"/>', sound), 4: pair('<text src="../page%20one.xhtml#%20"/>', sound),
        5: pair('<text src="../page%20one.xhtml#none"/>', sound), 6: pair(text, ""), 7: pair(text, '<audio src="a/one.mp3" clipEnd="0:00:02"/>'), 8: pair(text, '<audio src="a/one.mp3" clipBegin="0:00:02" clipEnd="0:00:02"/>'),
        9: pair(text, '<audio src="a/two.mp3" clipBegin="0:00:01" clipEnd="0:00:02"/>'), 10: pair(text, '<audio src="a/empty.mp3" clipBegin="0:00:01" clipEnd="0:00:02"/>'),
        11: F.concat(F.lit("<par>"), pair(text, sound)), 12: F.lit(f"<par>{text}{sound}"), 13: pair(text, '<audio src="a/one.mp3" clipBegin="0:00:01" clipEnd="0:75:02"/>'),
    }
    fault = F.lit("")
    for number, xml in faults.items():
        fault = F.when(key % 16 == number, xml).otherwise(fault)
    textref = F.when(key % 16 == 14, "<seq>").when(key % 16 == 15, '<seq epub:textref="other.xhtml">').otherwise('<seq epub:textref="../page%20one.xhtml#a%20b">')
    overlays = fx.table(spark, d, "orders").select(
        key.alias("book_id"), F.lit("smil/o.smil").alias("path"), F.lit("page one.xhtml").alias("page_path"),
        F.concat(F.lit("<smil><!-- <par> -->"), textref, pair(text, sound), fault, F.lit("</seq></smil>")).alias("xml"),
    )
    books = overlays.select("book_id")
    ids = books.select("book_id", F.lit("page one.xhtml").alias("path"), F.lit("a b").alias("id"))
    audio = books.select("book_id", F.explode(F.array(F.struct(F.lit("smil/a/one.mp3").alias("path"), F.lit(9).alias("size")), F.struct(F.lit("smil/a/empty.mp3").alias("path"), F.lit(0).alias("size")))).alias("a")).select("book_id", "a.*")
    return audit.audit_overlay_documents(overlays, ids, audio)


def source_packages_audited(spark: SparkSession, d: str) -> DataFrame:
    """A package for each order with one fault by its number."""
    key = F.col("o_orderkey") % 8
    item = lambda more: f'<item id="p" href="p%20q.xhtml" media-type="application/xhtml+xml"{more}/>'
    inner = F.when(key == 1, item(' media-overlay="o"')).when(key == 2, item("") + '<item id="o" href="o.smil" media-type="application/smil+xml"/>').otherwise(item(""))
    version = F.when(key == 3, "").when(key == 4, ' version="2.0"').otherwise(' version="3.0"')
    meta = F.when(key == 5, "").when(key == 6, '<metadata><meta property="media:duration">0:00:01</meta></metadata>').otherwise("<metadata/>")
    manifest = F.when(key == 7, "").otherwise(F.concat(F.lit("<manifest>"), inner, F.lit("</manifest>")))
    packages = fx.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("book_id"), F.lit("OPS/b.opf").alias("package_path"), F.concat(F.lit("<package"), version, F.lit(">"), meta, manifest, F.lit("</package>")).alias("xml")
    )
    return audit.audit_source_packages(packages, packages.select("book_id", F.lit("OPS/p q.xhtml").alias("href")))


def recompute_unknown(spark: SparkSession, d: str) -> DataFrame:
    """Books with an unknown recogniser, and ledgers that lack the rows of some stages."""
    inputs = fx.stage_inputs(spark, d).withColumn("ocr_backend", F.when(F.col("book_id") % 3 != 0, F.col("ocr_backend")))
    now = ledger.stage_fingerprints(inputs)
    book = F.col("book_id")
    lost = (book % 4 == 1) & F.col("stage").isin("review_audio", "build_epub", "validate") | (book % 5 == 2) & (F.col("stage") == "prepare")
    saved = now.where(~lost).withColumn("fingerprint", F.when(~((book % 7 == 3) & (F.col("stage") == "encode")), F.col("fingerprint")))
    return ledger.recompute_plan(saved, now)


def windows_reversed(spark: SparkSession, d: str) -> DataFrame:
    """An unmatched segment between two matches of each order; every second pair of matches is crossed."""
    book = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("book_id"))
    block = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("block_ord")
    blocks = book.select("book_id", block).select("book_id", F.lit("doc").alias("href"), F.col("block_ord").cast("int").alias("line_index"), F.col("block_ord").cast("bigint"), F.lit("text").alias("text"))
    place = lambda line: F.struct(F.lit("doc").alias("href"), line.cast("int").alias("line_index"), F.lit(0).alias("char_offset"))
    after = F.when(F.col("book_id") % 2 == 0, F.lit(2)).otherwise(F.lit(8))
    segment = lambda n, status, line: F.struct(F.lit(n).cast("bigint").alias("seg"), F.lit(status).alias("status"), place(line).alias("book_start"), place(line).alias("book_end"))
    none = F.lit(None).cast("int")
    rows = book.select("book_id", F.explode(F.array(segment(0, "matched", F.lit(5)), segment(1, "unmatched", none), segment(2, "matched", after))).alias("s"))
    alignment = rows.select("book_id", "s.seg", F.lit("words").alias("text"), "s.status", "s.book_start", "s.book_end")
    return review.reversed_windows(review.review_windows(alignment, blocks))


def edges_kept(spark: SparkSession, d: str) -> DataFrame:
    """Manual "keep" of every second order's item; a third each are introductions, credits and inner items."""
    key = F.col("o_orderkey")
    orders = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("book_id"), key, key.cast("string").alias("id"))
    edge = F.when(key % 3 == 0, "introduction").when(key % 3 == 1, "credits")
    items = orders.select("book_id", "id", edge.alias("edge"), F.concat(F.lit("page-"), key).alias("edge_href"), review.decision("pending").alias("decision"))
    kept = review.keep_edges(items, orders.where(key % 2 == 0).select("book_id", "id"))
    fields = [F.col(f"decision.{f}").alias(f) for f in ("state", "href", "supplemental", "classification", "source")]
    return kept.select("book_id", "id", *fields)


def readouts_checked(spark: SparkSession, d: str) -> DataFrame:
    """Resource decisions of orders with every fault a readout can have, and the readouts themselves."""
    key = F.col("o_orderkey")
    image = F.when(key % 4 != 0, F.concat(F.lit("img-"), key % 20))
    kind = F.when(key % 5 != 0, "graphic_readout")
    given = review.decision("assigned", href=F.concat(F.lit("page-"), key % 50), image_href=image, classification=kind, line_index=F.when(key % 17 == 0, 3))
    items = fx.table(spark, d, "orders").select(
        F.col("o_custkey").alias("book_id"), key.alias("seg"), F.lit(0).cast("bigint").alias("start_ms"),
        F.when(key % 13 == 0, 0).otherwise(100).cast("bigint").alias("end_ms"), given.alias("decision"),
    )
    readouts, broken = overlay.resource_readouts(items)
    return broken.unionByName(readouts.select("book_id", F.lit("readout").alias("rule"), F.concat_ws(" ", F.col("seg").cast("string"), "href", "image_href").alias("entity")))


def resources_anchored(spark: SparkSession, d: str) -> DataFrame:
    """A wanted resource in a page of each order: with an id of its own, without, with the made id taken, or absent."""
    key = F.col("o_orderkey")
    page = fx.table(spark, d, "orders").select(key.alias("book_id"), F.lit("page").alias("href"))
    book = F.col("book_id")
    twice = page.withColumn("image_ordinal", F.explode(F.array(F.lit(0), F.lit(1))))
    own = F.when((book % 3 == 0) & (F.col("image_ordinal") == 0), F.concat(F.lit("own-"), book)).when(F.col("image_ordinal") == 1, "second").otherwise(" ")
    refs = twice.select("book_id", "href", F.lit("image").alias("image_href"), "image_ordinal", own.alias("element_id"), F.lit(0).alias("section_ord"))
    wanted = page.select("book_id", "href", F.when(book % 7 == 5, "absent").otherwise("image").alias("image_href"), F.lit(0).cast("bigint").alias("review_ord"))
    used = page.where(book % 2 == 0).select("book_id", "href", F.lit(f"{overlay.ID_PREFIX}-graphic-s1-r1").alias("name"))
    return overlay.resource_anchors(refs, wanted, used).select("book_id", "image_href", "anchor")


QUERIES = {
    f.__name__: f
    for f in (
        markup_references, markup_nested, images_quoted, silence_bounds, decisions_repeated, drafts_repeated, drafts_read, reports_read, totals_audited, ocr_source, overlay_documents_audited, source_packages_audited, recompute_unknown, windows_reversed, edges_kept, readouts_checked,
        resources_anchored,
    )
}
