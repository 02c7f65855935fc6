"""Registered queries on blocks, tokens, markup, references and alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsync.functions import markup, paths, text
from textsync.operators import align, passages, resources, tokens
from textsync.plans import fixtures as fx

long = lambda c: F.col(c).cast("bigint").alias(c)
long_of = lambda c: c.cast("bigint")


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return tokens.blocks_of(fx.sections(spark, d)).select(
        "book_id", "block_ord", long("section_ord"), "href", long("line_index"), "text"
    )


def token_positions(spark: SparkSession, d: str) -> DataFrame:
    return tokens.tokenize(fx.sections(spark, d)).select(
        "book_id", "tok", long("section_ord"), long("line_index"), "norm", long("start_char"), long("end_char")
    )


def ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    grams = tokens.gram_counts(fx.sections(spark, d), (1, 2, 3))
    return grams.groupBy("book_id", "n").agg(
        F.sum("k").cast("bigint").alias("grams"), F.count("*").alias("kinds"), F.max("k").alias("most")
    ).withColumn("n", F.col("n").cast("bigint"))


def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    return tokens.corpus_summary(fx.sections(spark, d))


def word_sets(spark: SparkSession, d: str) -> DataFrame:
    seq = text.word_seq(F.col("text"))
    words = fx.table(spark, d, "documents").select("doc_id", seq.alias("seq"), F.array_distinct(seq).alias("words"))
    return words.select(
        "doc_id", F.size("seq").cast("bigint").alias("n_words"), F.size("words").cast("bigint").alias("n_distinct"),
        F.size(text.distinctive_words(F.col("words"))).cast("bigint").alias("n_distinctive"),
    )


def block_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Word overlap of each block with the block before it in its section."""
    rows = tokens.blocks_of(fx.sections(spark, d)).withColumn("words", text.word_set(F.col("text")))
    prior = rows.select("book_id", (F.col("block_ord") + 1).alias("block_ord"), F.col("words").alias("prior"))
    joined = rows.join(prior, ["book_id", "block_ord"])
    hits = F.size(F.array_intersect("words", "prior"))
    return joined.select(
        "book_id", "block_ord", text.jaccard_milli(F.col("words"), F.col("prior")).cast("bigint").alias("jaccard_milli"),
        text.ratio_milli(hits, F.size("prior")).cast("bigint").alias("coverage_milli"),
        text.ends_sentence(F.col("text")).alias("ends"),
    )


def clocks(spark: SparkSession, d: str) -> DataFrame:
    ms = text.idiv(F.unix_micros(F.col("ts").cast("timestamp")), 1000) % 90000000
    rows = fx.table(spark, d, "events").select("event_id", ms.alias("ms"))
    clock = text.format_clock(F.col("ms"))
    broken = F.when(F.col("event_id") % 10 == 0, F.replace(clock, F.lit("."), F.lit(":"))).when(
        F.col("event_id") % 10 == 1, F.concat(clock, F.lit("9"))).when(
        F.col("event_id") % 10 == 2, F.substring(clock, 1, F.length(clock) - 4)).otherwise(clock)
    return rows.select("event_id", "ms", broken.alias("clock")).withColumn("parsed", text.parse_clock(F.col("clock")))


def page_text(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "pages").select("page_id", markup.markup_to_text(F.col("html")).alias("text"))


def _page_sections(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "pages").select(
        F.col("page_id").alias("book_id"), F.lit(0).alias("section_ord"), F.col("url").alias("href"),
        markup.markup_to_text(F.col("html")).alias("text"),
    )


def page_lines(spark: SparkSession, d: str) -> DataFrame:
    return tokens.blocks_of(_page_sections(spark, d)).select("book_id", "block_ord", long("line_index"), "text")


def _links(spark: SparkSession, d: str) -> DataFrame:
    return resources.link_refs(fx.table(spark, d, "pages").select("page_id", "url", "html"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).select("page_id", long("image_ordinal"), "href", F.array_join("hints", " · ").alias("hints"))


def resolved_links(spark: SparkSession, d: str) -> DataFrame:
    """Every link read as relative to a page folder, one level up; every third keeps its own form."""
    links = _links(spark, d)
    own = F.col("image_ordinal") % 3 == 0
    href = F.when(own, F.col("href")).otherwise(F.concat(F.lit(".."), F.col("href"), F.lit("%20x#top")))
    rows = links.withColumn("r", paths.resolve_href(F.lit("site/pages"), href))
    rows = rows.withColumn("o", paths.resolve_href(F.lit("site/pages"), href, optional=True))
    return rows.select("page_id", long("image_ordinal"), F.col("r.path").alias("path"), F.col("r.reason").alias("reason"), F.col("o.path").alias("optional_path"))


def encoded_links(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d)
    target = F.concat(F.lit("site"), F.col("href"))
    return links.select(
        "page_id", long("image_ordinal"), paths.encode_path(target).alias("as_path"), paths.encode_fragment(target).alias("as_fragment"),
        paths.percent_decode(paths.encode_fragment(target)).alias("decoded"),
        paths.relative_path(F.lit("site/pages/a"), target).alias("relative"), paths.parent_path(target).alias("parent"),
        text.escape_xml(F.col("href")).alias("escaped"),
    )


def link_hints(spark: SparkSession, d: str) -> DataFrame:
    """Evidence lines of a page: the texts of all its links, repeats dropped."""
    links = _links(spark, d).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("image_ordinal", "hints"))).alias("l"))
    lines = text.evidence_lines(F.flatten(F.transform("l", lambda x: x.hints)))
    return links.select("page_id", F.array_join(lines, "|").alias("lines"), F.size(lines).cast("bigint").alias("n"))


def media_types(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("mp3", "M4B", "opus", "wav", "mp4")])
    name = F.concat("event_type", F.lit("."), F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")))
    codec = F.when(F.col("event_id") % 7 < 5, "copy").when(F.col("event_id") % 7 == 5, "opus").otherwise("aac")
    rows = fx.table(spark, d, "events").select("event_id", codec.alias("codec"), name.alias("name"))
    rows = rows.withColumn("m", paths.media_type_of(F.col("codec"), F.col("name")))
    ok = paths.audio_descriptor_ok(F.col("m.file_name"), F.col("m.media_type"), F.col("codec"))
    return rows.select("event_id", F.col("m.file_name").alias("file_name"), F.col("m.media_type").alias("media_type"), F.coalesce(ok, F.lit(False)).alias("allowed"))


# ---------------------------------------------------------------- alignment


def _lists(spark: SparkSession, d: str, score: bool) -> DataFrame:
    packed = align.stage(tokens.coded(tokens.token_arrays(fx.sections(spark, d))))
    segs = align.stage(align.segment_tokens(fx.segments(spark, d), ["book_id", "seg"]).drop("words", "code"))
    return align.candidate_lists(segs, packed, sizes=(3,), score=score)


def candidate_votes(spark: SparkSession, d: str) -> DataFrame:
    total = F.aggregate("c_votes", F.lit(0).cast("bigint"), lambda a, v: a + v)
    return _lists(spark, d, False).where(F.size("c_start") > 0).select(
        "book_id", "seg", long_of(F.size("c_start")).alias("starts"), total.alias("votes"), long_of(F.array_max("c_votes")).alias("most"), F.array_min("c_start").alias("first"),
    )


def window_scores(spark: SparkSession, d: str) -> DataFrame:
    lengths = F.aggregate("b_len", F.lit(0).cast("bigint"), lambda a, n: a + n)
    return _lists(spark, d, True).where(F.size("b_start") > 0).select(
        "book_id", "seg", long_of(F.size("b_start")).alias("starts"), F.floor(F.array_max("b_score") * 1000 + 1e-6).cast("bigint").alias("best_milli"),
        lengths.alias("lengths"), F.array_min("b_start").alias("first"),
    )


def _alignment(spark: SparkSession, d: str) -> DataFrame:
    return align.align_segments(fx.segments(spark, d), fx.sections(spark, d))


def alignment(spark: SparkSession, d: str) -> DataFrame:
    at = lambda side: [F.col(f"book_{side}.{f}").alias(f"{side}_{f}") for f in ("href", "line_index", "char_offset")]
    rows = _alignment(spark, d).select("book_id", "seg", "status", F.round("match_percent", 6).alias("match_percent"), *at("start"), *at("end"))
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("start_line_index", "start_char_offset", "end_line_index", "end_char_offset")})


def alignment_summary(spark: SparkSession, d: str) -> DataFrame:
    return align.alignment_summary(fx.truth(spark, d)).withColumn("match_percent", F.round("match_percent", 6))


def alignment_progress(spark: SparkSession, d: str) -> DataFrame:
    return align.alignment_progress(fx.truth(spark, d)).withColumn("match_percent", F.round("match_percent", 6))


def locate_passages(spark: SparkSession, d: str) -> DataFrame:
    documents = fx.table(spark, d, "documents").select("doc_id", "text")
    return passages.locate_passages(fx.table(spark, d, "benchmark"), documents)


QUERIES = {f.__name__: f for f in (
    blocks, token_positions, ngram_counts, corpus_summary, word_sets, block_overlap, clocks, page_text, page_lines, page_links,
    resolved_links, encoded_links, link_hints, media_types, candidate_votes, window_scores, alignment, alignment_summary,
    alignment_progress, locate_passages,
)}
