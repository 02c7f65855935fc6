"""Timed words, phrases, chunk plans and the merge of chunk results into one timeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsync.functions.text import ends_sentence, idiv, trim_space
from textsync.operators.ordered import (
    fold_slabs,
    last_before,
    next_after,
    scan,
    slabs_of,
    total_before,
)

# Fixed values (ms unless said otherwise).
MAX_CHUNK, CHUNK_LIMIT, CHAPTER_REACH = 25000, 30000, 2500
SILENCE_REACH, SILENCE_LEAST = 2500, 350
PHRASE_WORDS, PHRASE_GAP, FRAME_SLACK = 24, 700, 80


def violations(df: DataFrame, entity: Column, **rules: Column) -> DataFrame:
    """Rows (book_id, rule, entity, detail) for every rule that holds; null means not violated."""
    named = [F.when(F.coalesce(test, F.lit(False)), F.lit(rule)) for rule, test in rules.items()]
    broken = df.select("book_id", entity.cast("string").alias("entity"), F.array(*named).alias("rules"))
    return broken.select(
        "book_id", F.explode(F.filter("rules", lambda r: r.isNotNull())).alias("rule"), "entity"
    )


# ---------------------------------------------------------------- words and phrases


def check_words(words: DataFrame) -> DataFrame:
    """Violations of timed words (book_id, chunk_idx, pos, word, start, end, probability, duration_ms).
    A chunk is at most thirty seconds of speech, so its words are one small ordered group."""
    earlier = F.lag("start").over(Window.partitionBy("book_id", "chunk_idx").orderBy("pos"))
    finite = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
    bad_time = (
        ~finite("start") | ~finite("end") | (F.col("start") < 0) | (F.col("end") < F.col("start"))
        | (F.col("start") < F.coalesce("earlier", F.lit(0.0)))
        | (F.col("end") * 1000 > F.col("duration_ms") + FRAME_SLACK)
        | (F.round(F.col("start") * 1000) > F.col("duration_ms"))
    )
    return violations(
        words.withColumn("earlier", earlier),
        F.concat_ws("/", "chunk_idx", "pos"),
        word_blank=trim_space(F.col("word")) == "",
        word_time=F.coalesce(bad_time, F.lit(True)),
        word_probability=F.coalesce(~F.col("probability").between(0, 1) | F.isnan("probability"), F.lit(True)),
    )


def phrases(words: DataFrame, max_words: int = PHRASE_WORDS, gap_ms: int = PHRASE_GAP) -> DataFrame:
    """Timed words → phrases (book_id, chunk_idx, pos, start_ms, end_ms, text).

    A phrase ends before a word that starts after all earlier words have ended, if the pause is long,
    the sentence is over or the phrase is full. Long pauses and sentence ends are window conditions;
    only the word count depends on the cut before, and is folded over the words of one run.
    """
    chunk = Window.partitionBy("book_id", "chunk_idx").orderBy("pos")
    timed = words.select(
        "book_id", "chunk_idx", "pos", trim_space(F.col("word")).alias("word"),
        F.round(F.col("start") * 1000).cast("bigint").alias("start_ms"),
        F.least(F.round(F.col("end") * 1000).cast("bigint"), F.col("duration_ms")).alias("end_ms"),
    )
    before = F.max("end_ms").over(chunk.rowsBetween(Window.unboundedPreceding, -1))
    timed = timed.withColumn("before", before).withColumn("prior", F.lag("word").over(chunk))
    free = F.coalesce(F.col("start_ms") >= F.col("before"), F.lit(False))
    ends = (F.col("start_ms") - F.col("before") >= gap_ms) | ends_sentence(F.col("prior"))
    cut = (free & ends).cast("int")
    runs = timed.select(
        "book_id", "chunk_idx", F.sum(cut).over(chunk).alias("run"),
        F.struct("pos", free.alias("free"), "start_ms", "end_ms", "word").alias("w"),
    )
    grouped = runs.groupBy("book_id", "chunk_idx", "run").agg(F.array_sort(F.collect_list("w")).alias("ws"))

    def number(state: Column, w: Column) -> Column:
        full = w.free & (state["n"] >= max_words)
        return F.struct(
            F.when(full, 1).otherwise(state["n"] + 1).alias("n"),
            F.concat(state["ids"], F.array(F.element_at(state["ids"], -1) + full.cast("int"))).alias("ids"),
        )

    start = F.struct(F.lit(0).alias("n"), F.array(F.lit(0)).alias("ids"))
    ids = F.aggregate("ws", start, number, lambda s: F.slice(s["ids"], 2, F.size(s["ids"])))
    numbered = grouped.withColumn("ids", ids).withColumn("pairs", F.arrays_zip("ids", "ws"))
    cuts = numbered.select("book_id", "chunk_idx", "run", F.explode("pairs").alias("p"))
    out = cuts.groupBy("book_id", "chunk_idx", "run", F.col("p.ids").alias("part")).agg(
        F.min("p.ws.start_ms").alias("start_ms"),
        F.max("p.ws.end_ms").alias("end_ms"),
        F.array_join(F.transform(F.array_sort(F.collect_list("p.ws")), lambda w: w.word), " ").alias("text"),
    )
    order = F.row_number().over(Window.partitionBy("book_id", "chunk_idx").orderBy("run", "part"))
    return out.select("book_id", "chunk_idx", (order - 1).alias("pos"), "start_ms", "end_ms", "text")


# ---------------------------------------------------------------- chunk plans


def _snap(max_ms: int):
    """Whether a chapter mark ends a chunk, given the open chunk's start; the next chunk then starts there."""
    reach = min(CHAPTER_REACH, max_ms // 2)

    def snap(start: int, mark: int, later: int, duration: int) -> tuple[int, bool]:
        at = start + max(0, -((start - mark) // max_ms) - 1) * max_ms
        target = at + max_ms
        hit = duration - at > max_ms and max(target - reach, at + 1) <= mark <= target < later
        return (mark if hit else start), hit

    return snap


def plan_chunks(books: DataFrame, chapters: DataFrame, max_ms: int = MAX_CHUNK) -> DataFrame:
    """Cut [0, duration) of each book into chunks of at most ``max_ms``, moving a cut back to the latest
    chapter mark near it. Only marks are walked in order; the even cuts between two of them are a
    sequence."""
    books = books.where("duration_ms > 0").select("book_id", "duration_ms")
    marks = (
        chapters.join(books, "book_id").where("boundary_ms > 0 and boundary_ms < duration_ms")
        .select("book_id", F.col("boundary_ms").alias("mark"), "duration_ms").distinct()
        .withColumn("slab", idiv(F.col("mark"), max_ms * 4096))
    )
    marks = scan(marks, ["book_id"], ["mark"], [F.col("slab")], later=next_after(F.col("mark")))
    marks = marks.withColumn("later", F.coalesce("later", F.lit(2**62)))
    entries = marks.select("book_id", "slab").distinct().withColumn("entry", F.col("slab") * max_ms * 4096)
    first = entries.groupBy("book_id").agg(F.min("slab").alias("first_slab"))
    entries = entries.join(first, "book_id").select(
        "book_id", "slab", F.when(F.col("slab") == F.col("first_slab"), F.lit(0)).otherwise(F.col("entry")).alias("entry")
    )
    walked = fold_slabs(marks, entries, ["book_id"], "mark", ["mark", "later", "duration_ms"], _snap(max_ms), "taken boolean")
    anchors = walked.where("taken").select("book_id", F.col("mark").alias("at")).join(books, "book_id")
    anchors = anchors.unionByName(books.withColumn("at", F.lit(0).cast("bigint")))
    wide = max_ms * 4096
    stretch = scan(anchors, ["book_id"], ["at"], [idiv(F.col("at"), wide)], until=next_after(F.col("at")))
    until = F.coalesce("until", "duration_ms")
    spans = stretch.withColumn("until", until).withColumn(
        "span", F.explode(F.sequence("at", F.col("until") - 1, F.lit(wide)))
    )
    stop = F.least(F.col("span") + wide, F.col("until"))
    cuts = spans.withColumn("stop", stop).select(
        "book_id", "stop", F.explode(F.sequence("span", F.col("stop") - 1, F.lit(max_ms))).alias("start_ms")
    )
    cuts = cuts.select("book_id", "start_ms", F.least(F.col("start_ms") + max_ms, F.col("stop")).alias("end_ms"))
    numbered = scan(
        cuts, ["book_id"], ["start_ms"], [idiv(F.col("start_ms"), wide)],
        chunk_idx=total_before(F.lit(1).cast("bigint")),
    )
    return numbered.select("book_id", "chunk_idx", "start_ms", "end_ms")


def _buckets(low: Column, high: Column, width: int) -> Column:
    return F.sequence(idiv(low, width), idiv(high, width))


def silence_cuts(chunks: DataFrame, chapters: DataFrame, silences: DataFrame,
                 reach: int = SILENCE_REACH, least: int = SILENCE_LEAST) -> DataFrame:
    """Adds ``moved``: the midpoint of the silence nearest to a cut's end, clipped to its search window.
    Null for chapter marks, the last chunk, and where there is no silence of sufficient length. Cuts and
    silences meet in time buckets."""
    duration = chunks.groupBy("book_id").agg(F.max("end_ms").alias("duration_ms"))
    cuts = chunks.join(duration, "book_id")
    open_cuts = cuts.where("end_ms < duration_ms").join(
        chapters.select("book_id", F.col("boundary_ms").alias("end_ms")).distinct(), ["book_id", "end_ms"], "left_anti"
    )
    low = F.greatest(F.col("end_ms") - reach, F.lit(0))
    high = F.least(F.col("end_ms") + reach, F.col("duration_ms"))
    windows = open_cuts.select("book_id", "chunk_idx", "end_ms", low.alias("low"), high.alias("high"))
    windows = windows.withColumn("bucket", F.explode(_buckets(F.col("low"), F.col("high"), 2 * reach)))
    quiet = silences.where("until_ms > from_ms").select("book_id", "from_ms", "until_ms")
    quiet = quiet.withColumn("bucket", F.explode(_buckets(F.col("from_ms"), F.col("until_ms"), 2 * reach)))
    a, b = F.greatest("from_ms", "low"), F.least("until_ms", "high")
    near = (
        windows.join(quiet, ["book_id", "bucket"]).select("book_id", "chunk_idx", "end_ms", a.alias("a"), b.alias("b"))
        .where(F.col("b") - F.col("a") >= least)
        .withColumn("mid", F.col("a") + idiv(F.col("b") - F.col("a"), 2))
    )
    best = near.groupBy("book_id", "chunk_idx").agg(
        F.min(F.struct(F.abs(F.col("mid") - F.col("end_ms")).alias("far"), "a", "mid")).alias("best")
    )
    return cuts.join(best, ["book_id", "chunk_idx"], "left").select(
        *chunks.columns, "duration_ms", F.col("best.mid").alias("moved")
    )


def _accept(limit: int):
    """The end of a cut: where it was moved to if that keeps the order and the length limit on both sides."""

    def accept(previous: int, end: int, moved: int | None, later: int) -> tuple[int]:
        fits = moved is not None and previous < moved < later and moved - previous <= limit and later - moved <= limit
        return (moved if fits else end,)

    return accept


def refine_chunks(chunks: DataFrame, chapters: DataFrame, silences: DataFrame, reach: int = SILENCE_REACH,
                  least: int = SILENCE_LEAST, limit: int = CHUNK_LIMIT) -> DataFrame:
    """Move cuts that are not chapter marks into a nearby silence."""
    cuts = silence_cuts(chunks, chapters, silences, reach, least).withColumn("slab", idiv(F.col("chunk_idx"), 4096))
    cuts = scan(cuts, ["book_id"], ["chunk_idx"], [F.col("slab")], later=next_after(F.col("end_ms")))
    entries = cuts.groupBy("book_id", "slab").agg(F.min("start_ms").alias("entry"))
    moved = fold_slabs(
        cuts.select("book_id", "slab", "chunk_idx", "end_ms", "moved", F.coalesce("later", "end_ms").alias("later")),
        entries, ["book_id"], "chunk_idx", ["end_ms", "moved", "later"], _accept(limit), "",
    )
    timed = scan(
        moved.select("book_id", "chunk_idx", F.col("state").alias("end_ms")),
        ["book_id"], ["chunk_idx"], slabs_of(F.col("chunk_idx")), start_ms=last_before(F.col("end_ms")),
    )
    return timed.select("book_id", "chunk_idx", F.coalesce("start_ms", F.lit(0)).alias("start_ms"), "end_ms")


def audit_chunks(chunks: DataFrame, books: DataFrame, limit: int = CHUNK_LIMIT) -> DataFrame:
    """Chunks must start at 0, follow each other without gap, stay positive and short and cover the book."""
    ranked = scan(
        chunks, ["book_id"], ["start_ms", "chunk_idx"], [idiv(F.col("start_ms"), 10**8)],
        before=last_before(F.col("end_ms")), rank=total_before(F.lit(1).cast("bigint")),
    )
    rows = ranked.join(books.select("book_id", "duration_ms"), "book_id", "left")
    each = violations(
        rows, F.col("chunk_idx"),
        chunk_index=F.col("chunk_idx") != F.col("rank"),
        chunk_start=(F.col("rank") == 0) & (F.col("start_ms") != 0),
        chunk_gap=(F.col("rank") > 0) & (F.col("start_ms") != F.col("before")),
        chunk_empty=F.col("end_ms") <= F.col("start_ms"),
        chunk_long=F.col("end_ms") - F.col("start_ms") > limit,
        chunk_beyond=F.col("end_ms") > F.coalesce("duration_ms", F.lit(0)),
    )
    ends = chunks.groupBy("book_id").agg(F.max("end_ms").alias("covered"))
    whole = violations(
        books.join(ends, "book_id", "left"), F.col("duration_ms"),
        plan_missing=F.col("covered").isNull(),
        plan_short=F.col("covered") < F.col("duration_ms"),
    )
    return each.unionByName(whole)


def audit_coverage(rows: DataFrame, books: DataFrame, tolerance_ms: int = 2, least_ms: int = 10) -> DataFrame:
    """Continuous coverage with a tolerance: no gap or overlap beyond it, no row too short, no open end."""
    ranked = scan(
        rows, ["book_id"], ["start_ms", "end_ms"], [idiv(F.col("start_ms"), 10**8)],
        before=last_before(F.col("end_ms")),
    )
    each = violations(
        ranked, F.col("start_ms"),
        coverage_gap=F.col("start_ms") - F.coalesce("before", F.lit(0)) > tolerance_ms,
        coverage_overlap=F.coalesce("before", F.lit(0)) - F.col("start_ms") > tolerance_ms,
        row_short=F.col("end_ms") - F.col("start_ms") <= least_ms,
    )
    ends = rows.groupBy("book_id").agg(F.max("end_ms").alias("covered"))
    whole = violations(
        books.join(ends, "book_id", "left"), F.col("duration_ms"),
        coverage_end=F.abs(F.coalesce("covered", F.lit(0)) - F.col("duration_ms")) > tolerance_ms,
    )
    return each.unionByName(whole)


def refine_edges(edges: DataFrame, gaps: DataFrame, reach: int = 6000, low: int = 650, high: int = 8000) -> DataFrame:
    """Move an edge to the midpoint of the nearest pause of usable length close to it."""
    usable = (F.col("until_ms") - F.col("from_ms")).between(low, high)
    mids = gaps.where(usable).select("book_id", (F.col("from_ms") + idiv(F.col("until_ms") - F.col("from_ms"), 2)).alias("mid"))
    mids = mids.withColumn("bucket", idiv(F.col("mid"), reach))
    around = edges.withColumn("bucket", F.explode(_buckets(F.greatest(F.col("edge_ms") - reach, F.lit(0)), F.col("edge_ms") + reach, reach)))
    near = around.join(mids, ["book_id", "bucket"]).where(F.abs(F.col("mid") - F.col("edge_ms")) <= reach)
    best = near.groupBy("book_id", "edge_ms").agg(
        F.min(F.struct(F.abs(F.col("mid") - F.col("edge_ms")).alias("far"), "mid")).alias("best")
    )
    return edges.join(best, ["book_id", "edge_ms"], "left").select(
        *edges.columns, F.coalesce("best.mid", "edge_ms").alias("refined_ms")
    )


# ---------------------------------------------------------------- merge


def merge_chunks(chunks: DataFrame, parts: DataFrame) -> DataFrame:
    """Chunk-local segments (book_id, chunk_idx, pos, language, start_ms, end_ms, text) → the book's
    timeline, numbered in order, with the language of the first chunk that names one."""
    offsets = chunks.select("book_id", "chunk_idx", F.col("start_ms").alias("offset"))
    timed = parts.join(offsets, ["book_id", "chunk_idx"]).select(
        "book_id", "chunk_idx", "pos",
        (F.col("offset") + F.col("start_ms")).alias("start_ms"),
        (F.col("offset") + F.col("end_ms")).alias("end_ms"), "text",
    )
    numbered = scan(
        timed, ["book_id"], ["chunk_idx", "pos"], [idiv(F.col("chunk_idx"), 1024)],
        seg=total_before(F.lit(1).cast("bigint")),
    )
    language = parts.groupBy("book_id").agg(
        F.min_by("language", F.when(F.col("language").isNotNull(), F.struct("chunk_idx", "pos"))).alias("language")
    )
    return numbered.join(language, "book_id").select(
        "book_id", "seg", "chunk_idx", "start_ms", "end_ms", "text", "language"
    )


def audit_merge(chunks: DataFrame, parts: DataFrame) -> DataFrame:
    """Segments must end inside their chunk, belong to one, and not overlap the chunk before."""
    spans = chunks.select("book_id", "chunk_idx", F.col("start_ms").alias("offset"), F.col("end_ms").alias("stop"))
    rows = parts.join(spans, ["book_id", "chunk_idx"], "left").withColumn("at", F.col("offset") + F.col("start_ms"))
    rows = scan(
        rows, ["book_id"], ["chunk_idx", "pos"], [idiv(F.col("chunk_idx"), 1024)],
        before=last_before(F.col("offset") + F.col("end_ms")),
    )
    each = violations(
        rows, F.concat_ws("/", "chunk_idx", "pos"),
        segment_unplanned=F.col("offset").isNull(),
        segment_beyond_chunk=F.col("end_ms") > F.col("stop") - F.col("offset"),
        segment_overlap=F.col("at") < F.col("before"),
    )
    silent = chunks.select("book_id").distinct().join(parts.select("book_id").distinct(), "book_id", "left_anti")
    return each.unionByName(violations(silent, F.col("book_id"), transcript_empty=F.lit(True)))


def audit_segments(segments: DataFrame) -> DataFrame:
    """Blank text, non-positive duration, overlap or backward time."""
    rows = scan(
        segments, ["book_id"], ["seg"], slabs_of(F.col("seg")), before=last_before(F.col("end_ms"))
    )
    return violations(
        rows, F.col("seg"),
        text_blank=trim_space(F.col("text")) == "",
        duration=F.col("end_ms") <= F.col("start_ms"),
        overlap=F.col("start_ms") < F.col("before"),
    )


def transcript_summary(segments: DataFrame) -> DataFrame:
    return segments.groupBy("book_id").agg(
        F.count("*").alias("segments"), F.max("end_ms").alias("duration_ms")
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
