"""Line logs: silence intervals, chapter metadata and durations. Input rows are (book_id, line_no, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textsync.functions.text import trim_space
from textsync.operators.ordered import last_before, last_through, scan, slabs_of

SECONDS = r"\s*(\S+)"


def _ms(c: Column) -> Column:
    return F.round(c.try_cast("double") * 1000).cast("bigint")


def read_silence_log(lines: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """Pair each ``silence_start:`` with the next ``silence_end:``. Times before 0 count as 0. With ``durations``
    (book_id, duration_ms) no time is past the book's end, and a last open interval is closed there; without,
    it is dropped."""
    value = lambda name: F.regexp_extract("line", f"{name}:{SECONDS}", 1).try_cast("double")
    starts, ends = F.col("line").contains("silence_start:"), F.col("line").contains("silence_end:") & ~F.col("line").contains("silence_start:")
    marks = lines.where(starts | ends).select(
        "book_id", "line_no", starts.alias("opens"), F.when(starts, value("silence_start")).otherwise(value("silence_end")).alias("sec")
    )
    paired = scan(
        marks, ["book_id"], ["line_no"], slabs_of(F.col("line_no")), before=last_before(F.struct("opens", "sec"))
    )
    closed = paired.where(~F.col("opens") & F.col("before.opens")).select(
        "book_id", F.col("before.sec").alias("a"), F.col("sec").alias("b")
    )
    if durations is not None:
        last = marks.groupBy("book_id").agg(F.max_by(F.struct("opens", "sec"), "line_no").alias("m")).where("m.opens")
        tail = last.join(durations, "book_id").select("book_id", F.col("m.sec").alias("a"), (F.col("duration_ms") / 1000).alias("b"))
        closed = closed.unionByName(tail).join(durations.select("book_id", (F.col("duration_ms") / 1000).alias("top")), "book_id", "left")
        closed = closed.withColumn("a", F.least("a", "top")).withColumn("b", F.least("b", "top"))
    closed = closed.withColumn("a", F.greatest("a", F.lit(0.0))).withColumn("b", F.greatest("b", F.lit(0.0)))
    return closed.where("b > a").select("book_id", _ms(F.col("a")).alias("from_ms"), _ms(F.col("b")).alias("until_ms"))


def read_chapter_metadata(lines: DataFrame) -> DataFrame:
    """Chapter ends (book_id, boundary_ms) from ``[CHAPTER]`` blocks with their own time base."""
    text = trim_space(F.col("line"))
    rows = lines.select("book_id", "line_no", text.alias("line"))
    heads = scan(
        rows, ["book_id"], ["line_no"], slabs_of(F.col("line_no")),
        block=last_through(F.when(F.col("line").startswith("["), F.struct("line_no", "line"))),
    ).where("block.line = '[CHAPTER]'")
    base = lambda i: F.regexp_extract("line", r"^TIMEBASE=(\d+)/(\d+)$", i).try_cast("decimal(20,0)")
    end = F.when(F.col("line").startswith("END="), F.regexp_extract("line", r"^END=(\d+)$", 1).try_cast("decimal(20,0)"))
    is_base = base(1).isNotNull() & base(2).isNotNull()
    last = lambda value, when: F.max_by(value, F.when(when, F.col("line_no")))
    blocks = heads.groupBy("book_id", F.col("block.line_no").alias("block")).agg(
        last(base(1), is_base).alias("num"), last(base(2), is_base).alias("den"),
        last(end, F.col("line").startswith("END=")).alias("end"),
    )
    number = lambda c, d: F.coalesce(c, F.lit(d).cast("decimal(20,0)")).cast("decimal(38,0)")
    ms = F.floor(F.col("end").cast("decimal(38,0)") * number(F.col("num"), 1) * 1000 / F.nullif(number(F.col("den"), 1000), F.lit(0)))
    return blocks.where("end is not null").select("book_id", ms.cast("bigint").alias("boundary_ms")).where("boundary_ms is not null")


def clock_ms(c: Column) -> Column:
    """``h:m:s.f`` → ms, rounded; null when it is not a clock."""
    pattern = r"^\s*(\d+)\s*:\s*(\d+)\s*:\s*(\d+(?:\.\d*)?)\s*$"
    part = lambda i, t: F.regexp_extract(c, pattern, i).try_cast(t)
    seconds = part(1, "double") * 3600 + part(2, "double") * 60 + part(3, "double")
    return F.round(seconds * 1000).cast("bigint")


def read_durations(lines: DataFrame) -> DataFrame:
    """The first ``Duration:`` of each book's log."""
    value = F.regexp_extract("line", r"Duration:([^,]*)", 1)
    rows = lines.where(F.col("line").contains("Duration:")).groupBy("book_id").agg(F.min_by(value, F.col("line_no")).alias("clock"))
    return rows.select("book_id", clock_ms(F.col("clock")).alias("duration_ms"))
