"""Inputs of the registered queries, derived by Spark from the given tables (whole tables)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textsync.functions.text import hint_list, idiv, trim_space
from textsync.operators.ordered import next_after, scan
from textsync.operators.tokens import blocks_of
from textsync.session import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Use every core when a table is one small file. A scan with enough splits is left alone, so no
    large table is shuffled for this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 64) else df


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five consecutive documents make a book, one section each."""
    return table(spark, sf_dir, "documents").select(
        idiv(F.col("doc_id"), 5).alias("book_id"),
        (F.col("doc_id") % 5).cast("int").alias("section_ord"),
        F.concat(F.lit("doc/"), F.col("doc_id")).alias("href"),
        "text",
    )


def word_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block cut in slices of twelve words, numbered through the book; ``first`` words come before a slice of ``size`` words, and
    its book has ``n`` slices. The one shuffle moves texts; a query that uses slices several times derives all from one staged table."""
    book = Window.partitionBy("book_id")
    before = book.orderBy("section_ord", "line_index").rowsBetween(Window.unboundedPreceding, -1)
    lines = sections(spark, sf_dir).repartition("book_id").select("book_id", "section_ord", "href", F.posexplode(F.split("text", "\n")).alias("line_index", "line"))
    # words hold no spaces: a line stays one string, with one space between words, until it is cut
    words = F.array_remove(F.split(trim_space(F.col("line")), " +"), "")
    lines = lines.select("book_id", "section_ord", "href", "line_index", words.alias("words"))
    lines = lines.select("book_id", "section_ord", "href", "line_index", F.array_join("words", " ").alias("line"), F.size("words").alias("size")).where("size > 0")
    cuts = F.floor((F.col("size") - 1) / 12).cast("int")
    lines = lines.withColumns({
        "seg": F.coalesce(F.sum(cuts + 1).over(before), F.lit(0)), "first": F.coalesce(F.sum("size").over(before), F.lit(0)), "n": F.sum(cuts + 1).over(book),
    })
    cut = lines.withColumn("words", F.split("line", " ")).drop("line")
    parts = F.transform(F.sequence(F.lit(0), cuts), lambda p: F.array_join(F.slice("words", p * 12 + 1, F.lit(12)), " "))
    cut = cut.select("book_id", "seg", "section_ord", "href", "line_index", "first", "n", "size", F.posexplode(parts).alias("part", "text"))
    return stage(cut.select(
        "book_id", (F.col("seg") + F.col("part")).cast("bigint").alias("seg"), "section_ord", "href", "line_index", "part", "text",
        F.least(F.col("size") - F.col("part") * 12, F.lit(12)).alias("size"), (F.col("first") + F.col("part") * 12).cast("bigint").alias("first"), "n",
    ))


def _starts() -> Column:
    """When a slice begins to be read: 200 ms for each word and 100 ms for each slice before it."""
    return (F.col("first") * 200 + F.col("seg") * 100).cast("bigint")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A perturbed timed reading of each book: mostly exact, some words dropped, replaced or spoilt."""
    kind, words = F.col("seg") % 7, F.split("text", " ")
    text = (
        F.when(kind == 4, F.array_join(F.filter(words, lambda w, i: i % 6 != 5), " "))
        .when(kind == 5, F.array_join(F.transform(words, lambda w, i: F.when(i % 5 == 4, F.lit("zzz")).otherwise(w)), " "))
        .when(kind == 6, F.array_join(F.transform(words, lambda w: F.concat(F.lit("qx"), w)), " "))
        .otherwise(F.col("text"))
    )
    return word_slices(spark, sf_dir).select(
        "book_id",
        "seg",
        _starts().alias("start_ms"),
        (_starts() + F.col("size") * 200).cast("bigint").alias("end_ms"),
        text.alias("text"),
    )


def truth(spark: SparkSession, sf_dir: str, slices: DataFrame | None = None) -> DataFrame:
    """The alignment the slices themselves define: every seventh slice, the first two and the last two
    of a book count as unmatched, all others match where they were cut from."""
    slices = word_slices(spark, sf_dir) if slices is None else slices
    lost = (F.col("seg") % 7 == 6) | (F.col("seg") < 2) | (F.col("seg") >= F.col("n") - 2)
    at = lambda offset: F.when(~lost, F.struct("href", "line_index", offset.cast("int").alias("char_offset")))
    return slices.select(
        "book_id", "seg", _starts().alias("start_ms"), (_starts() + F.col("size") * 200).cast("bigint").alias("end_ms"),
        "text", F.col("size").alias("n_tokens"),
        F.when(lost, "unmatched").otherwise("matched").alias("status"),
        F.when(~lost, F.lit(100.0) - F.col("seg") % 3).alias("match_percent"),
        at(F.col("part") * 12).alias("book_start"), at(F.col("part") * 12 + F.col("size")).alias("book_end"),
    )


def timed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of a book spoken at 0.2 s each, with a pause before every 17th, in chunks of 25 s."""
    words = word_slices(spark, sf_dir).select("book_id", "first", F.posexplode(F.split("text", " ")).alias("at", "word"))
    n = (F.col("first") + F.col("at")).cast("bigint")
    words = words.select("book_id", n.alias("n"), "word").withColumn("ms", F.col("n") * 200 + idiv(F.col("n"), 17) * 800)
    local = F.col("ms") % 25000
    return words.select(
        "book_id", idiv(F.col("ms"), 25000).alias("chunk_idx"), F.col("n").alias("pos"), "word",
        (local / 1000).alias("start"), ((local + 200) / 1000).alias("end"),
        F.lit(0.9).alias("probability"), F.lit(25200).cast("bigint").alias("duration_ms"),
    )


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of :func:`timed_words` as one string a chunk, with the number of its first word. A slice moves as a string, or as two
    where a chunk ends inside it."""
    slices = word_slices(spark, sf_dir)
    chunk = idiv(F.col("first") * 200 + idiv(F.col("first"), 17) * 800, 25000)
    # 17 words and their pause take 4.2 s: the first word of the next chunk follows from its beginning
    ends = (chunk + 1) * 25000
    cut = idiv(ends, 4200) * 17 + F.least(F.lit(17), idiv(ends % 4200 + 199, 200)) - F.col("first")
    slices = slices.select("book_id", "first", "size", "text", chunk.alias("chunk_idx"), F.least(cut, F.col("size")).cast("int").alias("cut"))
    words = F.split("text", " ")
    part = lambda later, text: F.struct((F.col("chunk_idx") + later).alias("chunk_idx"), (F.col("first") + later * F.col("cut")).alias("pos"), text.alias("text"))
    both = F.array(part(0, F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ")), part(1, F.array_join(F.slice(words, F.col("cut") + 1, F.col("size")), " ")))
    pieces = slices.select("book_id", F.explode(F.when(F.col("cut") < F.col("size"), both).otherwise(F.array(part(0, F.col("text"))))).alias("p"))
    chunks = pieces.groupBy("book_id", "p.chunk_idx").agg(F.array_sort(F.collect_list(F.struct("p.pos", "p.text"))).alias("parts"))
    return chunks.select("book_id", "chunk_idx", F.get("parts", F.lit(0))["pos"].alias("pos"), F.array_join("parts.text", " ").alias("text"))


def chunk_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each conversation turn as half-second segments of a chunk; system turns are silent."""
    turns = table(spark, sf_dir, "conversations").where("role <> 'system'")
    lines = F.filter(F.transform(F.split("text", "\n"), trim_space), lambda x: x != "")
    return turns.select(
        F.col("conv_id").alias("book_id"), F.col("turn").cast("bigint").alias("chunk_idx"), "role", F.posexplode(lines).alias("pos", "text")
    ).select(
        "book_id", "chunk_idx", "pos", F.when(F.col("role") == "assistant", "en").alias("language"),
        (F.col("pos") * 500).cast("bigint").alias("start_ms"), (F.col("pos") * 500 + 500).cast("bigint").alias("end_ms"), "text",
    )


def chunk_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn").cast("bigint")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("book_id"), turn.alias("chunk_idx"), (turn * 25000).alias("start_ms"), (turn * 25000 + 25000).alias("end_ms")
    ).distinct()


def timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user as marks on a scaled timeline (book_id, t, event_id, event_type)."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("book_id"), "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    )
    first = events.groupBy("book_id").agg(F.min("us").alias("first"))
    return events.join(first, "book_id").select("book_id", idiv(F.col("us") - F.col("first"), 10**7).alias("t"), "event_id", "event_type")


def timeline_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timelines(spark, sf_dir).groupBy("book_id").agg(F.max("t").alias("duration_ms")).where("duration_ms > 0")


def timeline_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timelines(spark, sf_dir).where("event_type = 'purchase'").select("book_id", F.col("t").alias("boundary_ms"))


def timeline_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error opens a silence that the next event closes."""
    rows = scan(
        timelines(spark, sf_dir), ["book_id"], ["t", "event_id"], [idiv(F.col("t"), 50000)], until_ms=next_after(F.col("t"))
    )
    return rows.where("event_type = 'error' and until_ms is not null").select("book_id", F.col("t").alias("from_ms"), "until_ms")


def figures(spark: SparkSession, sf_dir: str, blocks: DataFrame | None = None) -> DataFrame:
    """Every fifth block counts as a figure whose caption is the block's text; every seventh of them is no image."""
    blocks = (blocks_of(sections(spark, sf_dir)) if blocks is None else blocks).where("block_ord % 5 = 0")
    image = F.concat(F.lit("img/"), F.col("book_id"), F.lit("-"), F.col("block_ord"))
    return blocks.select(
        "book_id", F.col("href").alias("document_href"), image.alias("image_href"), F.col("line_index").alias("image_ordinal"),
        hint_list(F.array("text")).alias("hints"),
        F.when(F.col("block_ord") % 35 == 10, "audio/mpeg").otherwise("image/png").alias("media_type"), (F.col("block_ord") % 50 * 1000000).cast("bigint").alias("size"),
    )


def spine_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(spark, sf_dir).select("book_id", F.col("section_ord").cast("bigint").alias("spine_ord"), F.col("href").alias("document_href"))


def stage_inputs(spark: SparkSession, sf_dir: str, changed: bool = False) -> DataFrame:
    """One book per document: its text is the source, its ``source`` names the backends. In the changed
    version every tenth document has another text and every seventh another alignment backend."""
    doc = F.col("doc_id")
    edit = lambda c, n, k: F.when(doc % n == k, F.concat(c, F.lit("!"))).otherwise(c) if changed else c
    return table(spark, sf_dir, "documents").select(
        doc.alias("book_id"), F.sha2(edit(F.col("text"), 10, 3), 256).alias("epub_source"),
        F.concat(F.lit("audio-"), doc).alias("audiobook_source"),
        F.col("source").alias("transcription_backend"),
        edit(F.concat(F.lit("align-"), F.col("source")), 7, 2).alias("alignment_backend"),
        F.lit("ocr-1").alias("ocr_backend"), F.lit("audio-1").alias("audio_backend"), F.lit("epub-1").alias("epub_backend"),
        F.col("lang").alias("language"), F.lit("base").alias("model"), F.lit("Smart").alias("policy"), F.lit("Copy").alias("encoding"),
    )
