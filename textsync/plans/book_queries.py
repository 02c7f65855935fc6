"""Registered queries on timelines, review, resources, cues, audits and ledgers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsync.functions.text import idiv
from textsync.operators import audit, ledger, overlay, resources, review, timeline, tokens
from textsync.plans import fixtures as fx
from textsync.session import shared_dir, stage
from textsync.sources import logs, transcripts
from textsync.streaming import merge

long = lambda c: F.col(c).cast("bigint").alias(c)

# ---------------------------------------------------------------- timeline


def word_phrases(spark: SparkSession, d: str) -> DataFrame:
    return timeline.phrases(fx.timed_words(spark, d)).select("book_id", "chunk_idx", long("pos"), "start_ms", "end_ms", "text")


def word_check(spark: SparkSession, d: str) -> DataFrame:
    """Planted faults: every 97th word has an illegal probability, every 101st is blank, every 103rd ends
    before it starts."""
    n = F.col("pos")
    words = fx.timed_words(spark, d).withColumns({
        "probability": F.when(n % 97 == 0, 1.5).otherwise(F.col("probability")),
        "word": F.when(n % 101 == 0, " ").otherwise(F.col("word")),
        "end": F.when(n % 103 == 0, F.col("start") - 0.1).otherwise(F.col("end")),
    })
    return timeline.check_words(words)


def chunk_plan(spark: SparkSession, d: str) -> DataFrame:
    return timeline.plan_chunks(fx.timeline_books(spark, d), fx.timeline_chapters(spark, d))


def chunk_refine(spark: SparkSession, d: str) -> DataFrame:
    chapters = fx.timeline_chapters(spark, d)
    chunks = stage(timeline.plan_chunks(fx.timeline_books(spark, d), chapters))
    return timeline.refine_chunks(chunks, chapters, fx.timeline_silences(spark, d)).select("book_id", "chunk_idx", "start_ms", "end_ms")


def silence_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Where each cut of an even 25 s plan would move to."""
    books = fx.timeline_books(spark, d)
    chunks = stage(timeline.plan_chunks(books, fx.timeline_chapters(spark, d).where("false")))
    return timeline.silence_cuts(chunks, fx.timeline_chapters(spark, d), fx.timeline_silences(spark, d)).select("book_id", "chunk_idx", "end_ms", "moved")


def chunk_audit(spark: SparkSession, d: str) -> DataFrame:
    """Faults planted in even plans: every third book starts late, every fifth chunk is too short."""
    books = fx.timeline_books(spark, d)
    spans = F.sequence(F.lit(0).cast("bigint"), F.col("duration_ms") - 1, F.lit(25000).cast("bigint"))
    rows = books.select("book_id", "duration_ms", F.posexplode(spans).alias("chunk_idx", "at"))
    start = F.when((F.col("chunk_idx") == 0) & (F.col("book_id") % 3 == 0), F.lit(7).cast("bigint")).otherwise(F.col("at"))
    end = F.least(F.col("at") + 25000, "duration_ms") - F.when(F.col("chunk_idx") % 5 == 4, 1).otherwise(0)
    return timeline.audit_chunks(rows.select("book_id", long("chunk_idx"), start.alias("start_ms"), end.alias("end_ms")), books)


def coverage_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.timelines(spark, d).select("book_id", F.col("t").alias("start_ms"), (F.col("t") + F.col("event_id") % 9000).alias("end_ms"))
    return timeline.audit_coverage(rows.where("end_ms > start_ms").groupBy("book_id", "start_ms").agg(F.max("end_ms").alias("end_ms")), fx.timeline_books(spark, d))


def edge_refine(spark: SparkSession, d: str) -> DataFrame:
    edges = fx.timeline_chapters(spark, d).select("book_id", F.col("boundary_ms").alias("edge_ms")).distinct()
    return timeline.refine_edges(edges, fx.timeline_silences(spark, d))


def merged_segments(spark: SparkSession, d: str) -> DataFrame:
    return timeline.merge_chunks(fx.chunk_plans(spark, d), fx.chunk_parts(spark, d))


def merge_audit(spark: SparkSession, d: str) -> DataFrame:
    """Planted faults: every fifth conversation's segments are late by 24 s."""
    late = F.when(F.col("book_id") % 5 == 0, F.lit(24000).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    parts = fx.chunk_parts(spark, d).withColumns({"start_ms": F.col("start_ms") + late, "end_ms": F.col("end_ms") + late})
    return timeline.audit_merge(fx.chunk_plans(spark, d), parts)


def segment_audit(spark: SparkSession, d: str) -> DataFrame:
    seg = F.col("seg")
    rows = fx.truth(spark, d).select(
        "book_id", "seg", (F.col("start_ms") - F.when(seg % 60 == 59, 101).otherwise(0)).alias("start_ms"),
        F.when(seg % 50 == 49, F.col("start_ms")).otherwise(F.col("end_ms")).alias("end_ms"),
        F.when(seg % 70 == 69, "  ").otherwise(F.col("text")).alias("text"),
    )
    return timeline.audit_segments(rows)


def transcript_summary(spark: SparkSession, d: str) -> DataFrame:
    return timeline.transcript_summary(fx.truth(spark, d))


# ---------------------------------------------------------------- sources


def word_json(spark: SparkSession, d: str) -> DataFrame:
    """Recogniser results rebuilt from the words of each chunk; every 11th chunk is in another language
    and every 13th lacks its first word."""
    n = lambda i: F.col("pos") + i
    local = lambda i: (n(i) * 200 + idiv(n(i), 17) * 800) % 25000
    listed = F.transform(F.split("text", " "), lambda w, i: F.struct(
        w.alias("word"), (local(i) / 1000).alias("start"), ((local(i) + 200) / 1000).alias("end"), F.lit(0.9).alias("probability")))
    chunks = fx.chunk_texts(spark, d).withColumn("ws", listed)
    some = F.when(F.col("chunk_idx") % 13 == 5, F.slice("ws", 2, F.size("ws"))).otherwise(F.col("ws"))
    language = F.when(F.col("chunk_idx") % 11 == 7, "de").otherwise("en")
    rows = chunks.select(
        "book_id", "chunk_idx", F.lit(25200).cast("bigint").alias("duration_ms"),
        F.to_json(F.struct("text", language.alias("language"), some.alias("words"))).alias("json"),
    )
    good, bad = transcripts.read_word_json(rows)
    counted = good.groupBy("book_id", "chunk_idx").agg(
        F.count("*").alias("words"), F.sum(F.length("word")).cast("bigint").alias("letters"), F.max(F.round(F.col("end") * 1000)).cast("bigint").alias("last_ms")
    ).withColumn("reason", F.lit(None).cast("string"))
    return counted.unionByName(bad.select("book_id", "chunk_idx", "reason"), allowMissingColumns=True)


def segment_json(spark: SparkSession, d: str) -> DataFrame:
    """Recogniser results rebuilt from conversation turns; every third line is a silence marker, and
    every 17th conversation is translated."""
    parts = fx.chunk_parts(spark, d)
    text = F.when(F.col("pos") % 3 == 2, "[Silence]").otherwise(F.concat(F.lit(" "), F.col("text"), F.lit(" ")))
    item = F.struct("pos", F.struct(F.col("start_ms").alias("from"), (F.col("end_ms") + 7).alias("to")).alias("offsets"), text.alias("text"))
    chunks = parts.groupBy("book_id", "chunk_idx").agg(F.array_sort(F.collect_list(item)).alias("items"))
    json = F.to_json(F.struct(
        F.struct(F.lit("en").alias("language"), (F.col("book_id") % 17 == 3).alias("translate")).alias("params"),
        F.struct(F.lit("en").alias("language")).alias("result"),
        F.transform("items", lambda x: F.struct(x.offsets.alias("offsets"), x.text.alias("text"))).alias("transcription"),
    ))
    rows = chunks.select("book_id", "chunk_idx", (F.size("items") * 500).cast("bigint").alias("duration_ms"), json.alias("json"))
    good, bad = transcripts.read_segment_json(rows)
    good = good.select("book_id", "chunk_idx", long("pos"), "start_ms", "end_ms", "text").withColumn("reason", F.lit(None).cast("string"))
    return good.unionByName(bad.select("book_id", "chunk_idx", "reason"), allowMissingColumns=True)


def silence_log(spark: SparkSession, d: str) -> DataFrame:
    """The detector's log, one line per event: an error opens a silence, a purchase ends one."""
    sec = F.format_string("%d.%03d", idiv(F.col("t"), 1000), F.col("t") % 1000)
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("[d] silence_start: "), sec)).when(
        F.col("event_type") == "purchase", F.concat(F.lit("[d] silence_end: "), sec, F.lit(" | silence_duration: 1"))).otherwise("frame")
    lines = fx.timelines(spark, d).select("book_id", F.col("event_id").alias("line_no"), line.alias("line"))
    return logs.read_silence_log(lines, fx.timeline_books(spark, d))


def chapter_log(spark: SparkSession, d: str) -> DataFrame:
    """Chapter metadata, three lines per purchase event, with two time bases."""
    rows = fx.timelines(spark, d).where("event_type = 'purchase'")
    fine = F.col("event_id") % 2 == 0
    lines = F.array(
        F.when(F.col("event_id") % 5 == 4, "[STREAM]").otherwise("[CHAPTER]"),
        F.when(fine, "TIMEBASE=1/1000").otherwise("TIMEBASE=1/90000"),
        F.concat(F.lit("END="), F.when(fine, F.col("t")).otherwise(F.col("t") * 90 + 7)),
    )
    log = rows.select("book_id", "event_id", F.posexplode(lines).alias("i", "line"))
    return logs.read_chapter_metadata(log.select("book_id", (F.col("event_id") * 3 + F.col("i")).alias("line_no"), "line"))


def duration_log(spark: SparkSession, d: str) -> DataFrame:
    clock = F.format_string("%d:%02d:%02d.%02d", idiv(F.col("t"), 3600000), idiv(F.col("t") % 3600000, 60000), idiv(F.col("t") % 60000, 1000), idiv(F.col("t") % 1000, 10))
    line = F.concat(F.lit("  Duration: "), clock, F.lit(", start: 0"))
    return logs.read_durations(fx.timelines(spark, d).select("book_id", F.col("event_id").alias("line_no"), line.alias("line")))


def ocr_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Recognised words rebuilt from blocks: one image per block, six words per line."""
    blocks = tokens.blocks_of(fx.sections(spark, d))
    words = blocks.select("book_id", "block_ord", F.posexplode(F.split("text", " +")).alias("i", "text"))
    n = F.col("block_ord")
    conf = F.when(F.col("i") % 5 == 4, -1.0).when(n % 4 == 1, 10.0).otherwise((n + F.col("i")) % 90 + 10.0)
    rows = words.select(
        "book_id", "block_ord", F.lit(1).alias("page_num"), F.lit(1).alias("block_num"), F.lit(1).alias("par_num"),
        idiv(F.col("i"), 6).cast("int").alias("line_num"), F.col("i").alias("word_num"), conf.alias("conf"), "text",
    )
    out = resources.ocr_evidence(rows, ["book_id", "block_ord"])
    return out.select("book_id", "block_ord", F.array_join("lines", "|").alias("lines"), long("confidence_percent"))


# ---------------------------------------------------------------- review


def _items(spark: SparkSession, d: str, policy: str = "smart", slices: DataFrame | None = None) -> DataFrame:
    """Review items with saved drafts: every fifth is excluded by hand, every seventh assigned to its
    neighbour's line by hand, every eleventh carries an old automatic decision."""
    slices = fx.word_slices(spark, d) if slices is None else slices
    report = stage(review.review_report(fx.truth(spark, d, slices)))
    own = slices.select("book_id", "seg", F.col("href").alias("own_href"), F.col("line_index").alias("own_line"))
    rows = report.join(own, ["book_id", "seg"])
    n = F.col("seg")
    saved = (
        F.when(n % 5 == 0, review.decision("excluded", reason="noise", source="manual"))
        .when(n % 7 == 6, review.decision("assigned", href=F.col("own_href"), line_index=F.col("own_line"), source="manual"))
        .when(n % 11 == 0, review.decision("excluded", reason="old", source="automatic"))
    )
    drafts = rows.select("book_id", "id", saved.alias("decision")).where("decision is not null")
    return review.decide(report, drafts, policy)


def review_report(spark: SparkSession, d: str) -> DataFrame:
    rows = review.review_report(fx.truth(spark, d))
    return rows.select("book_id", "seg", "id", "edge", F.col("suggestion.reason").alias("reason"), "edge_href")


def _flat(items: DataFrame) -> DataFrame:
    return items.select("book_id", "seg", *[F.col(f"decision.{f}").alias(f) for f in review.FIELDS]).withColumn("line_index", F.col("line_index").cast("bigint"))


def review_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_items(spark, d))


def review_all_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_items(spark, d, "review_all"))


def review_summary(spark: SparkSession, d: str) -> DataFrame:
    return review.review_summary(_items(spark, d))


def applied_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decisions upserted by id: exclusions for every third item, broken ones for every fourth, and some
    for unknown ids; then the rest is excluded in bulk."""
    items = stage(_items(spark, d))
    n = F.col("seg")
    given = F.when(n % 4 == 1, review.decision("excluded", reason=" ", source="manual")).otherwise(
        review.decision("excluded", reason="cut", source="manual"))
    wanted = items.where("seg % 3 = 0 or seg % 4 = 1").select(
        "book_id",
        F.when(n % 10 == 3, F.concat(F.lit("no-"), "id")).otherwise(F.col("id")).alias("id"), given.alias("decision")
    )
    updated, refused = review.apply_decisions(items, wanted)
    rows = _flat(review.exclude_pending(updated)).select("book_id", "seg", "state", F.col("reason").alias("detail"))
    counts = refused.groupBy("reason").agg(F.count("*").alias("seg"))
    return rows.unionByName(counts.select(F.lit(-1).cast("bigint").alias("book_id"), "seg", F.lit("refused").alias("state"), F.col("reason").alias("detail")))


def decision_audit(spark: SparkSession, d: str) -> DataFrame:
    """Faults planted in edge and line decisions."""
    n, e = F.col("seg"), F.col("decision")
    bad = (
        F.when(n % 4 == 0, e.withField("href", F.lit(" ")))
        .when(n % 4 == 1, e.withField("line_index", F.lit(1)))
        .when(n % 4 == 2, e.withField("classification", F.lit("credits")))
        .otherwise(e.withField("reason", F.lit(None).cast("string")))
    )
    return review.audit_decisions(_items(spark, d).withColumn("decision", bad).withColumn("id", F.col("seg").cast("string")))


def review_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = review.review_report(fx.truth(spark, d))
    n = F.col("seg")
    rows = rows.withColumns({
        "id": F.when(n % 9 == 0, "").when(n % 9 == 1, "same").otherwise(F.col("id")),
        "start_ms": F.when(n % 8 == 1, F.lit(0).cast("bigint")).otherwise(F.col("start_ms")),
        "end_ms": F.when(n % 10 == 0, F.col("start_ms")).otherwise(F.col("end_ms")),
    })
    return review.audit_review(rows)


def text_candidates(spark: SparkSession, d: str) -> DataFrame:
    blocks = stage(tokens.blocks_of(fx.sections(spark, d)))
    return review.text_candidates(fx.truth(spark, d), blocks, 4).select("book_id", "seg", "block_ord", long("score_milli"))


def wide_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The same without any match between a book's first and last slices: whole-book windows."""
    sparse = (F.col("seg") % 400 == 2) & (F.col("status") == "matched")
    rows = fx.truth(spark, d).withColumn("status", F.when(sparse, "matched").otherwise("unmatched"))
    blocks = stage(tokens.blocks_of(fx.sections(spark, d)))
    return review.text_candidates(rows, blocks, 24).select("book_id", "seg", "block_ord", long("score_milli"))


def silence_evidence(spark: SparkSession, d: str) -> DataFrame:
    marks = fx.timelines(spark, d).select("book_id", F.col("event_id").alias("seg"), F.col("t").alias("start_ms"), (F.col("t") + 2500).alias("end_ms"))
    return review.silence_evidence(marks, fx.timeline_silences(spark, d))


def _applied(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    slices = fx.word_slices(spark, d)
    items = review.exclude_pending(_items(spark, d, slices=slices))
    n = F.col("seg")
    # planted faults: some items were decided on other content, some point before their neighbours
    items = items.withColumn("text", F.when(n % 50 == 13, "changed").otherwise(F.col("text")))
    back = F.col("decision").withField("line_index", F.lit(0)).withField("href", F.concat(F.lit("doc/"), F.col("book_id") * 5))
    items = items.withColumn("decision", F.when((n % 70 == 27) & (F.col("decision.state") == "assigned") & F.col("decision.line_index").isNotNull(), back).otherwise(F.col("decision")))
    return review.effective_alignment(fx.truth(spark, d, slices), stage(items), stage(tokens.blocks_of(fx.sections(spark, d))))


def effective_alignment(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = _applied(spark, d)
    return rows.select(
        "book_id", "seg", "status", "match_percent", F.col("book_start.href").alias("href"), F.col("book_start.line_index").cast("bigint").alias("line_index"),
        F.col("book_start.char_offset").cast("bigint").alias("start_char"), F.col("book_end.char_offset").cast("bigint").alias("end_char"),
    )


def effective_violations(spark: SparkSession, d: str) -> DataFrame:
    return _applied(spark, d)[1]


def effective_summary(spark: SparkSession, d: str) -> DataFrame:
    return review.effective_summary(_applied(spark, d)[0]).withColumn("match_percent", F.round("match_percent", 6))


def review_worklist(spark: SparkSession, d: str) -> DataFrame:
    truth, blocks = fx.truth(spark, d), stage(tokens.blocks_of(fx.sections(spark, d)))
    items = review.decide(review.review_report(truth), _no_drafts(spark), "review_all")
    figures = fx.figures(spark, d, blocks)
    offered = _candidates(spark, d, items, truth, figures, k=2, hints=False)  # two of them are offered
    rows = review.review_worklist(items, review.text_candidates(truth, blocks, 24), offered, blocks, resources.resource_images(figures))
    return rows.select("book_id", "seg", long("position"), "kind", long("score_milli"), "label")


def _no_drafts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"book_id bigint, id string, decision {review.DECISION}")


# ---------------------------------------------------------------- resources


def _candidates(spark: SparkSession, d: str, items: DataFrame, truth: DataFrame, figures: DataFrame | None = None, **limits) -> DataFrame:
    figures = fx.figures(spark, d) if figures is None else figures
    manifest = figures.select("book_id", F.col("image_href").alias("href"), "media_type", "size")
    return resources.resource_candidates(items, truth, fx.spine_of(spark, d), figures, manifest, **limits)


def _open_items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    truth = fx.truth(spark, d)
    return truth, review.decide(stage(review.review_report(truth)), _no_drafts(spark), "smart")


def resource_candidates(spark: SparkSession, d: str) -> DataFrame:
    truth, items = _open_items(spark, d)
    return _candidates(spark, d, items, truth, hints=False).select("book_id", "seg", long("rank"), "spine_ord", "image_href")


def _ranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    truth, items = _open_items(spark, d)
    figures = stage(fx.figures(spark, d))
    # evidence is read once an image, not once a candidate
    evidence = resources.evidence_words(resources.choose_evidence(resources.resource_images(figures))).drop("hints", "image_ordinal")
    listed = _candidates(spark, d, items, truth, figures, hints=False).join(stage(evidence), ["book_id", "document_href", "image_href"])
    return items, resources.recommend_resource(stage(resources.score_resources(items, listed)))


def resource_scores(spark: SparkSession, d: str) -> DataFrame:
    _, ranked = _ranked(spark, d)
    return ranked.select("book_id", "seg", "image_href", long("coverage_milli"), long("similarity_milli"), long("score_milli"), long("distinctive"), "qualifies", long("place"), "recommended")


def assigned_resources(spark: SparkSession, d: str) -> DataFrame:
    items, ranked = _ranked(spark, d)
    given = resources.assign_resources(items, ranked).where("decision.image_href is not null")
    return given.select("book_id", "seg", F.col("decision.href").alias("href"), F.col("decision.image_href").alias("image_href"))


def manual_assignments(spark: SparkSession, d: str) -> DataFrame:
    """Each item asks by hand for the first figure of the book."""
    truth, items = _open_items(spark, d)
    candidates = stage(_candidates(spark, d, items, truth, hints=False))
    wanted = items.select("book_id", "seg", F.concat(F.lit("doc/"), F.col("book_id") * 5).alias("document_href"), F.concat(F.lit("img/"), F.col("book_id"), F.lit("-5")).alias("image_href"))
    return resources.check_manual_assignments(items, wanted, candidates)


# ---------------------------------------------------------------- cues and pages


def _cues(spark: SparkSession, d: str) -> DataFrame:
    anchors = tokens.blocks_of(fx.sections(spark, d)).select(
        "book_id", "section_ord", "line_index", F.concat(F.lit("b"), F.col("line_index"), F.lit("é")).alias("anchor")
    )
    return overlay.cues(fx.truth(spark, d), fx.sections(spark, d), anchors)


def _faulty_cues(spark: SparkSession, d: str) -> DataFrame:
    """Every 60th cue begins 101 ms early, every 70th lacks its anchor, every 50th ends where it begins."""
    n = F.regexp_extract("cue_id", r"(\d+)$", 1).cast("bigint")
    return _cues(spark, d).withColumn("n", n).select(
        "book_id", "section_ord", (F.col("start_ms") - F.when(F.col("n") % 60 == 0, 101).otherwise(0)).alias("start_ms"),
        F.when(F.col("n") % 50 == 0, F.col("start_ms")).otherwise(F.col("end_ms")).alias("end_ms"), "cue_id",
        F.when(F.col("n") % 70 == 0, "").otherwise(F.col("anchor")).alias("anchor"), "kind",
    )


def cue_timeline(spark: SparkSession, d: str) -> DataFrame:
    return _cues(spark, d).select("book_id", long("section_ord"), "start_ms", "end_ms", "cue_id", "anchor")


def cue_order_audit(spark: SparkSession, d: str) -> DataFrame:
    return overlay.audit_cue_order(_faulty_cues(spark, d))


def page_durations(spark: SparkSession, d: str) -> DataFrame:
    return overlay.durations(overlay.overlay_pages(_cues(spark, d))).select("book_id", long("section_ord"), "duration_ms", "clock")


def overlay_documents(spark: SparkSession, d: str) -> DataFrame:
    hrefs = fx.sections(spark, d).select("book_id", "section_ord", F.concat("href", F.lit(".xhtml")).alias("text_href"), F.lit("../audio/a&b.mp3").alias("audio_href"))
    return overlay.overlay_documents(_cues(spark, d), hrefs).select("book_id", long("section_ord"), "document")


def build_summary(spark: SparkSession, d: str) -> DataFrame:
    return overlay.build_summary(_cues(spark, d))


def sync_documents(spark: SparkSession, d: str) -> DataFrame:
    """Pages with matched segments, and violations where every 80th match ends in the next line."""
    n = F.col("seg")
    rows = fx.truth(spark, d).withColumn("book_end", F.when(n % 80 == 7, F.col("book_end").withField("line_index", F.col("book_end.line_index") + 1)).otherwise(F.col("book_end")))
    pages, broken = overlay.sync_documents(rows)
    return pages.select("book_id", "href", "segments").unionByName(
        broken.groupBy("book_id", F.col("rule").alias("href")).agg(F.count("*").alias("segments")))


def _supplemental(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d).withColumn("review_ord", F.col("seg"))
    return overlay.supplemental_pages(items)


def supplemental_pages(spark: SparkSession, d: str) -> DataFrame:
    return _supplemental(spark, d).select("book_id", "review_ord", "classification", "placement", "anchor_href", "page_id", "href", "duration_ms", "xhtml")


def extended_spine(spark: SparkSession, d: str) -> DataFrame:
    spine = fx.spine_of(spark, d).select("book_id", "spine_ord", F.col("document_href").alias("href"))
    return overlay.extended_spine(spine, _supplemental(spark, d))[0]


def unique_names(spark: SparkSession, d: str) -> DataFrame:
    """Names asked for each block from its first letter, where some are taken."""
    blocks = tokens.blocks_of(fx.sections(spark, d))
    asked = blocks.select("book_id", F.lower(F.substring("text", 1, 1)).alias("base"), F.col("block_ord").alias("ord"))
    used = blocks.where("block_ord % 9 = 4").select("book_id", F.when(F.col("block_ord") % 2 == 0, F.lower(F.substring("text", 1, 1))).otherwise(
        F.concat(F.lower(F.substring("text", 1, 1)), F.lit("-"), F.col("block_ord") % 5)).alias("name"))
    return overlay.unique_names(asked, used, ["book_id"]).select("book_id", "ord", "name")


# ---------------------------------------------------------------- packages and audits


def _package(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A manifest and spine per book with planted faults: some items are navigation, some not markup,
    some spine entries non-linear or dangling."""
    s = fx.table(spark, d, "documents").select(idiv(F.col("doc_id"), 5).alias("book_id"), "doc_id")
    n = F.col("doc_id")
    manifest = s.where("doc_id % 31 <> 7").select(
        "book_id", F.concat(F.lit("i"), n).alias("id"), F.concat(F.lit("doc/"), n).alias("href"),
        F.when(n % 13 == 5, "image/png").otherwise("application/xhtml+xml").alias("media_type"),
        F.when(n % 11 == 3, "cover nav").alias("properties"),
        F.when(n % 3 > 0, F.concat(F.lit("m"), n - n % 17 % 2)).alias("media_overlay"),
    )
    spine = s.select("book_id", n.alias("spine_ord"), F.concat(F.lit("i"), n).alias("idref"), F.when(n % 7 == 2, "No").alias("linear"))
    return manifest, spine


def reading_order(spark: SparkSession, d: str) -> DataFrame:
    manifest, spine = _package(spark, d)
    pages, broken = overlay.reading_order(spine, manifest)
    return pages.select("book_id", "section_ord", F.col("href").alias("entity")).unionByName(broken.select("book_id", F.lit(-1).cast("bigint").alias("section_ord"), "entity"))


def package_audit(spark: SparkSession, d: str) -> DataFrame:
    manifest, _ = _package(spark, d)
    twice = manifest.where("cast(substr(id, 2) as bigint) % 20 = 4")
    n = F.col("book_id")
    books = manifest.select("book_id").distinct()
    declared = manifest.where("media_overlay is not null").select("book_id", F.col("media_overlay").alias("refines"), F.lit(1).cast("bigint").alias("duration_ms"))
    total = lambda rule: books.where(rule).select("book_id", F.lit(None).cast("string").alias("refines"), F.lit(9).cast("bigint").alias("duration_ms"))
    declared = declared.unionByName(total("book_id % 6 <> 1")).unionByName(total("book_id % 9 = 2"))
    versions = books.select("book_id", F.when(n % 8 == 3, "2.0").otherwise("3.0").alias("version"))
    return audit.audit_packages(manifest.unionByName(twice), declared, versions)


def overlay_audit(spark: SparkSession, d: str) -> DataFrame:
    manifest, _ = _package(spark, d)
    n = F.regexp_extract("media_overlay", r"(\d+)", 1).cast("bigint")
    overlays = manifest.where("media_overlay is not null").select("book_id", "media_overlay").distinct().withColumn("n", n)
    items = overlays.where("n % 10 <> 1").select(
        "book_id", F.col("media_overlay").alias("id"), F.lit("o").alias("href"),
        F.when(F.col("n") % 10 == 2, "text/plain").otherwise("application/smil+xml").alias("media_type"))
    audio = manifest.select("book_id").distinct().where("book_id % 5 <> 4").select(
        "book_id", F.lit("audio").alias("id"), F.lit("a").alias("href"), F.lit("audio/mpeg").alias("media_type"))
    counts = overlays.select("book_id", F.col("media_overlay").alias("overlay_id"), (F.col("n") % 4).alias("cues"))
    whole = manifest.unionByName(items, allowMissingColumns=True).unionByName(audio, allowMissingColumns=True)
    return audit.audit_overlays(whole, counts)


def cue_audit(spark: SparkSession, d: str) -> DataFrame:
    """Faulty cues against the ids of the page, of which every ninth line's is missing."""
    ids = tokens.blocks_of(fx.sections(spark, d)).where("line_index % 9 <> 8").select(
        "book_id", "section_ord", F.concat(F.lit("b"), F.col("line_index"), F.lit("é")).alias("id"))
    return audit.audit_cues(_faulty_cues(spark, d), ids)


def id_audit(spark: SparkSession, d: str) -> DataFrame:
    ids = tokens.blocks_of(fx.sections(spark, d)).select("book_id", "section_ord", F.concat(F.lit("h"), F.sha2("text", 256)).alias("id"))
    return audit.audit_ids(ids)


def duration_audit(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth declared page duration is 5 ms off, every 13th is missing."""
    pages = stage(overlay.overlay_pages(_cues(spark, d)))
    n = F.col("book_id") * 5 + F.col("section_ord")
    off = F.col("duration_ms") + F.when(n % 10 == 3, 5).otherwise(0)
    declared = overlay.durations(pages).withColumn("duration_ms", off.cast("bigint")).where(n.isNull() | (n % 13 != 6))
    return audit.audit_durations(declared, pages)


def archive_audit(spark: SparkSession, d: str) -> DataFrame:
    """Entries of one archive per book: first the mimetype, then its documents; faults by book and
    document number."""
    docs = fx.table(spark, d, "documents")
    b, n = F.col("book_id"), F.col("doc_id")
    rows = docs.select(idiv(F.col("doc_id"), 5).alias("book_id"), "doc_id", "text")
    first = rows.select("book_id").distinct().select(
        "book_id", F.lit(0).alias("entry_ord"), F.when(b % 7 == 1, "mime").otherwise("mimetype").alias("path"),
        F.when(b % 6 == 2, "text/plain").otherwise(audit.MIMETYPE).cast("binary").alias("bytes"), F.lit(20).cast("bigint").alias("size"), (b % 5 != 3).alias("stored"))
    files = rows.select(
        "book_id", (n % 5 + 1).cast("int").alias("entry_ord"), F.concat(F.lit("d/"), F.when(n % 10 == 1, n - 1).otherwise(n)).alias("path"),
        F.encode("text", "UTF-8").alias("bytes"), F.when(n % 9 == 4, 0).otherwise(F.length("text")).cast("bigint").alias("size"), F.lit(False).alias("stored"))
    return audit.audit_archives(first.unionByName(files).withColumns({"is_dir": F.lit(False), "oversize": F.col("size") > 10000}))


# ---------------------------------------------------------------- ledger


def row_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return ledger.fingerprints(fx.table(spark, d, "labels"), ["doc_id"])


def stage_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return ledger.stage_fingerprints(fx.stage_inputs(spark, d))


def _plan(spark: SparkSession, d: str) -> DataFrame:
    saved = ledger.stage_fingerprints(fx.stage_inputs(spark, d)).where("not (book_id % 12 = 5 and stage = 'encode')")
    return ledger.recompute_plan(saved, ledger.stage_fingerprints(fx.stage_inputs(spark, d, changed=True)))


def recompute_plan(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d)


def _artifacts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    stages = F.array(*[F.lit(s) for s in ledger.STAGES])
    rows = docs.select(F.col("doc_id").alias("book_id"), F.explode(stages).alias("stage"), "text")
    rows = rows.withColumn("path", F.concat("stage", F.lit("/out"))).withColumn("k", F.col("book_id") + F.length("stage"))
    sealed = rows.where("k % 23 <> 1").select("book_id", "stage", "path", F.octet_length("text").cast("bigint").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    text = F.when(F.col("k") % 19 == 2, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    now = rows.where("k % 29 <> 3").select("book_id", "stage", "path", F.octet_length(text).cast("bigint").alias("bytes"), F.sha2(text, 256).alias("sha256"))
    return sealed, now


def artifact_diff(spark: SparkSession, d: str) -> DataFrame:
    return ledger.artifact_diff(*_artifacts(spark, d))


def reusable_prefix(spark: SparkSession, d: str) -> DataFrame:
    return ledger.reusable_prefix(_plan(spark, d), ledger.artifact_diff(*_artifacts(spark, d)))


def run_progress(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(s) for s in ledger.STAGES])
    status = F.array(*[F.lit(s) for s in ("completed", "cached", "running", "failed", "pending", "skipped")])
    events = fx.table(spark, d, "events")
    runs = events.select(
        idiv(F.col("event_id"), 7).alias("book_id"), F.element_at(names, (F.col("event_id") % 7 + 1).cast("int")).alias("stage"),
        F.element_at(status, ((F.col("event_id") * 5 + F.col("user_id")) % 6 + 1).cast("int")).alias("status"), (F.col("user_id") * 13 % 101).cast("int").alias("percent"))
    return ledger.run_progress(runs).withColumn("percent", F.col("percent").cast("bigint"))


def chunk_progress(spark: SparkSession, d: str) -> DataFrame:
    chunks = fx.timelines(spark, d).select("book_id", F.col("t").alias("start_ms"), (F.col("t") + F.col("event_id") % 700 + 1).alias("end_ms"), (F.col("event_type") == "click").alias("done"))
    return ledger.chunk_progress(chunks).withColumn("percent", F.col("percent").cast("bigint"))


# ---------------------------------------------------------------- stream


def stream_merge(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns read as a file stream of chunk results and merged in order, with every state a book can end
    in: some books' second chunk fails, some have a result that no plan knows."""
    source = spark.read.parquet(f"{d}/conversations.parquet").schema
    # a pattern, which a stream takes for one file as well as for a folder of part files
    turns = spark.readStream.schema(source).parquet(f"{d}/conversations.parque[t]")
    lines = F.filter(F.transform(F.split("text", "\n"), fx.trim_space), lambda x: x != "")
    spoken = F.when(F.col("role") == "system", F.array().cast("array<string>")).otherwise(lines)
    segments = F.transform(spoken, lambda x, i: F.struct((i * 500).alias("start_ms"), (i * 500 + 500).alias("end_ms"), x.alias("text")))
    book, turn = F.col("conv_id"), F.col("turn").cast("bigint")
    places = F.when((book % 13 == 5) & (turn == 0), F.array(turn, turn + 1000)).otherwise(F.array(turn))
    chunks = turns.select(book.alias("book_id"), F.explode(places).alias("chunk_idx"), (~((book % 11 == 3) & (turn == 1))).alias("ok"), segments.alias("segments"))
    # the generator drops the names of fields made inside the lambda
    chunks = chunks.withColumn("segments", F.col("segments").cast("array<struct<start_ms:bigint,end_ms:bigint,text:string>>"))
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    merged = merge.stream_merge_chunks(chunks, stage(fx.chunk_plans(spark, d)), timeout_ms=None)
    query = merged.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(merge.OUT).parquet(f"{base}/out")
    return out


def line_anchors(spark: SparkSession, d: str) -> DataFrame:
    pages = fx.table(spark, d, "pages").select("page_id", F.lit(0).alias("section_ord"), "html")
    return overlay.line_anchors(pages).select("page_id", long("line_index"), "anchor", "generated")


QUERIES = {f.__name__: f for f in (
    word_phrases, word_check, chunk_plan, chunk_refine, silence_cuts, chunk_audit, coverage_audit, edge_refine, merged_segments,
    merge_audit, segment_audit, transcript_summary, word_json, segment_json, silence_log, chapter_log, duration_log, ocr_evidence,
    review_report, review_decisions, review_all_decisions, review_summary, applied_decisions, decision_audit, review_audit,
    text_candidates, wide_candidates, silence_evidence, effective_alignment, effective_violations, effective_summary,
    review_worklist, resource_candidates, resource_scores, assigned_resources, manual_assignments, cue_timeline, cue_order_audit,
    page_durations, overlay_documents, build_summary, sync_documents, supplemental_pages, extended_spine, unique_names,
    reading_order, package_audit, overlay_audit, cue_audit, id_audit, duration_audit, archive_audit, row_fingerprints,
    stage_fingerprints, recompute_plan, artifact_diff, reusable_prefix, run_progress, chunk_progress, stream_merge, line_anchors,
)}
