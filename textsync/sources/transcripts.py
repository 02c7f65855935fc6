"""Speech-recogniser results: word times and segment times as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textsync.functions.text import NOT_ALNUM, fold_case, trim_space
from textsync.session import stage

# The accepted language, silence markers, tail slack (ms) and chunk limit (ms).
LANGUAGE = "en"
SILENT = ["[BLANK_AUDIO]", "[Silence]", "[silence]"]
TAIL_SLACK, CHUNK_LIMIT = 10, 30000

WORD_JSON = "text string, language string, words array<struct<word:string,start:double,end:double,probability:double>>"
SEGMENT_JSON = (
    "params struct<language:string,translate:boolean>, result struct<language:string>, "
    "transcription array<struct<offsets:struct<`from`:bigint,`to`:bigint>,text:string>>"
)


def _quarantine(rows: DataFrame, reason, read: dict) -> tuple[DataFrame, DataFrame]:
    """What was ``read`` of accepted results, and the rejected ones. They are parsed and judged once and staged: a condition on parsed
    values would be moved before the parser, which then runs for every value that it names."""
    marked = rows.withColumn("reason", reason)
    good = F.col("reason").isNull()
    kept = {"json": F.when(~good, F.col("json"))} | {name: F.when(good, value) for name, value in read.items()}
    marked = stage(marked.select("book_id", "chunk_idx", "duration_ms", "reason", *[value.alias(name) for name, value in kept.items()]))
    return marked.where("reason is null"), marked.where("reason is not null").select("book_id", "chunk_idx", "reason", "json")


def read_word_json(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(book_id, chunk_idx, duration_ms, json) → timed words, and rejected results with a reason. Words
    must spell the whole text; a silent chunk has neither."""
    parsed = rows.withColumn("r", F.from_json("json", WORD_JSON))
    blank = trim_space(F.coalesce("r.text", F.lit(""))) == ""
    count = F.coalesce(F.size("r.words"), F.lit(0))
    language = trim_space(F.coalesce("r.language", F.lit("")))
    same = lambda c: F.regexp_replace(fold_case(c), NOT_ALNUM, "")
    spelled = F.array_join(F.transform("r.words", lambda w: w.word), "")
    reason = (
        F.when(~F.col("duration_ms").between(1, CHUNK_LIMIT), "duration")
        .when(F.col("r").isNull() | F.col("r.text").isNull() | F.col("r.words").isNull(), "not_json")
        .when(~language.isin("", LANGUAGE), "language")
        .when(blank & (count > 0), "words_without_text")
        .when(blank, F.lit(None))
        .when((language == "") | (count == 0), "text_without_words")
        # what differs in spaces alone needs no folding
        .when((F.replace("r.text", F.lit(" "), F.lit("")) != spelled) & (same(spelled) != same(F.col("r.text"))), "words_incomplete")
    )
    good, bad = _quarantine(parsed, reason, {"language": language, "words": F.col("r.words")})
    words = good.select("book_id", "chunk_idx", "duration_ms", "language", F.posexplode("words").alias("pos", "w"))
    return words.select("book_id", "chunk_idx", "pos", "w.word", "w.start", "w.end", "w.probability", "duration_ms", "language"), bad


def read_segment_json(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(book_id, chunk_idx, duration_ms, json) → chunk-local segments, and rejected results. Blank and
    silent segments are dropped, ends are clamped to the chunk."""
    parsed = rows.withColumn("r", F.from_json("json", SEGMENT_JSON))
    spoken = F.filter("r.transcription", lambda s: (trim_space(s.text) != "") & ~trim_space(s.text).isin(SILENT))
    parsed = parsed.withColumn("spoken", spoken)
    outside = F.exists("spoken", lambda s: (s.offsets["from"] >= F.col("duration_ms")) | (s.offsets["to"] > F.col("duration_ms") + TAIL_SLACK))
    other = (F.col("r.params.language") != LANGUAGE) | (F.col("r.result.language") != LANGUAGE) | F.col("r.params.translate")
    reason = (
        F.when(~F.col("duration_ms").between(1, CHUNK_LIMIT), "duration")
        .when(F.col("r").isNull() | F.col("r.transcription").isNull(), "not_json")
        .when(F.coalesce(other, F.lit(True)), "language")
        .when(outside, "outside_chunk")
    )
    good, bad = _quarantine(parsed, reason, {"spoken": F.col("spoken")})
    segs = good.select("book_id", "chunk_idx", "duration_ms", F.posexplode("spoken").alias("at", "s"))
    pos = F.row_number().over(Window.partitionBy("book_id", "chunk_idx").orderBy("at")) - 1
    return segs.select(
        "book_id", "chunk_idx", pos.alias("pos"), F.lit(LANGUAGE).alias("language"),
        F.col("s.offsets.from").alias("start_ms"), F.least("s.offsets.to", "duration_ms").alias("end_ms"),
        trim_space(F.col("s.text")).alias("text"),
    ), bad
