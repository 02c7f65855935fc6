"""Sections → blocks → positioned tokens → n-grams.

Ordinals come from the position inside the section row plus a prefix total over sections, so numbering
a book never orders its tokens in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsync.functions.text import (
    JOINER,
    NOT_ALNUM,
    TOKEN,
    fold_case,
    token_array,
    trim_space,
)
from textsync.operators.ordered import scan, slabs_of, total_before
from textsync.session import stage

WHOLE = 1_000_000  # tokens of a book whose n-grams one task may count


def block_key(section_ord: Column, line_index: Column) -> Column:
    """One long that identifies a line inside a book and sorts in reading order."""
    return F.shiftleft(section_ord.cast("bigint"), 32) + line_index.cast("bigint")


def token_counts(sections: DataFrame) -> DataFrame:
    """(book_id, section_ord, n): how many tokens a section has."""
    n = F.size(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))
    return sections.select("book_id", "section_ord", n.alias("n"))


def section_offsets(counted: DataFrame) -> DataFrame:
    """(book_id, section_ord, n) → adds ``offset``, the total of all earlier sections."""
    return scan(
        counted,
        ["book_id"],
        ["section_ord"],
        slabs_of(F.col("section_ord")),
        offset=total_before(F.col("n")),
    ).select("book_id", "section_ord", "n", "offset")


def blocks_of(sections: DataFrame) -> DataFrame:
    """Non-empty trimmed lines with their original index, numbered in reading order."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.struct(i.alias("line_index"), trim_space(x).alias("text")),
    )
    packed = sections.select(
        "book_id", "section_ord", "href", F.filter(lines, lambda x: x.text != "").alias("lines")
    )
    # lines are counted once, though their sums are made in two steps
    offsets = section_offsets(stage(packed.select("book_id", "section_ord", F.size("lines").alias("n"))))
    return (
        packed.hint("merge").join(offsets, ["book_id", "section_ord"])
        .select("*", F.posexplode("lines").alias("pos", "line"))
        .select(
            "book_id",
            (F.col("offset") + F.col("pos")).cast("bigint").alias("block_ord"),
            "section_ord",
            "href",
            F.col("line.line_index").alias("line_index"),
            F.col("line.text").alias("text"),
        )
    )


def token_arrays(sections: DataFrame) -> DataFrame:
    """One row per section: its tokens as ``ARRAY<STRUCT<blk, norm>>``. No shuffle."""
    per_line = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.transform(
            token_array(line),
            lambda t: F.struct(block_key(F.col("section_ord"), i).alias("blk"), t.alias("norm")),
        ),
    )
    return sections.select("book_id", "section_ord", F.flatten(per_line).alias("toks"))


def section_tokens(sections: DataFrame) -> DataFrame:
    """One row per section: its tokens as ``ARRAY<STRUCT<blk, norm>>`` and its first token number."""
    return with_offsets(token_arrays(sections), token_counts(sections))


def with_offsets(packed: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Adds the first token number of each section; sections are merged with it, however small they are thought to be."""
    counted = packed.select("book_id", "section_ord", F.size("toks").alias("n")) if counted is None else counted
    return packed.hint("merge").join(section_offsets(counted).drop("n"), ["book_id", "section_ord"])


def tokenize(sections: DataFrame) -> DataFrame:
    """Every token with its number in the book and its character range in the section.

    A section is cut into tokens and the gaps between them; running sums over the pieces give offsets,
    line numbers and token numbers in one window per section.
    """
    pieces = F.regexp_extract_all("text", F.lit(f"(?s){TOKEN}|{NOT_ALNUM}+"), F.lit(0))
    exploded = sections.select("book_id", "section_ord", F.posexplode(pieces).alias("pos", "piece"))
    is_token = ~F.col("piece").rlike(f"^{NOT_ALNUM}")
    window = (
        Window.partitionBy("book_id", "section_ord").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    )
    breaks = F.length("piece") - F.length(F.replace("piece", F.lit("\n"), F.lit("")))
    before = lambda c: F.coalesce(F.sum(c).over(window), F.lit(0))
    return (
        exploded.withColumn("is_token", is_token)
        .withColumn("start_char", before(F.length("piece")).cast("int"))
        .withColumn("line_index", before(F.when(~F.col("is_token"), breaks)).cast("int"))
        .withColumn("nth", before(F.col("is_token").cast("bigint")))
        .where("is_token")
        .join(section_offsets(token_counts(sections)), ["book_id", "section_ord"])
        .select(
            "book_id",
            (F.col("offset") + F.col("nth")).cast("bigint").alias("tok"),
            "section_ord",
            "line_index",
            F.regexp_replace(fold_case(F.col("piece")), JOINER, "").alias("norm"),
            "start_char",
            (F.col("start_char") + F.length("piece")).cast("int").alias("end_char"),
        )
    )


def tokenize_segments(segments: DataFrame) -> DataFrame:
    """Tokens of free text, one row per token."""
    keys = [c for c in segments.columns if c in ("book_id", "seg", "item_id")]
    return segments.select(*keys, F.posexplode(token_array(F.col("text"))).alias("pos", "norm"))


def gram_array(toks: Column, n: int, norm=lambda x: x, same_block: bool = False) -> Column:
    """``ARRAY<STRUCT<gram, pos>>`` of the n-grams of a token array; inside one block if asked."""
    last = F.size(toks) - n
    at = lambda i, k: F.element_at(toks, i + k + 1)
    grams = F.transform(
        F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            F.concat_ws(" ", *[norm(at(i, k)) for k in range(n)]).alias("gram"),
            i.alias("pos"),
            *([(at(i, 0).blk == at(i, n - 1).blk).alias("whole")] if same_block else []),
        ),
    )
    return F.filter(grams, lambda g: g.whole) if same_block else grams


def coded(packed: DataFrame) -> DataFrame:
    """Section arrays with each token as a 64-bit hash: what joins and distances compare is whether tokens are equal."""
    return packed.withColumn("toks", F.transform("toks", lambda t: F.struct(t.blk.alias("blk"), F.xxhash64(t.norm).alias("code"))))


def gram_code(*codes: Column | str) -> Column:
    """One 64-bit number for consecutive token codes."""
    return F.xxhash64(*codes)


def coded_ngrams(packed: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(book_id, n, gram, tok) of :func:`coded` sections, ``gram`` a code; sizes above one stay inside a block. No shuffle.

    A token meets those after it through shifted arrays, so that grams are built by compiled expressions, not by lambdas."""
    part = lambda field, k: F.slice(F.col("toks")[field], k + 1, F.greatest(F.size("toks"), F.lit(1))).alias(f"{field}{k}")
    beside = F.arrays_zip(*[part(field, k) for k in range(max(sizes)) for field in ("blk", "code")])
    each = packed.where(F.size("toks") > 0).select("book_id", "offset", F.posexplode(beside).alias("pos", "t"))
    whole = lambda n: F.col(f"t.blk{n - 1}") == F.col("t.blk0")
    grams = [F.when(whole(n), F.struct(F.lit(n).alias("n"), gram_code(*[f"t.code{k}" for k in range(n)]).alias("gram"))) for n in sizes]
    found = each.select("book_id", (F.col("offset") + F.col("pos")).cast("bigint").alias("tok"), F.explode(F.array(*grams)).alias("g"))
    return found.where("g IS NOT NULL").select("book_id", "g.n", "g.gram", "tok")


def gram_counts(sections: DataFrame, sizes: tuple[int, ...], whole: int = WHOLE) -> DataFrame:
    """(book_id, n, gram, k): how often each n-gram occurs in its book.

    Of a book of at most ``whole`` tokens the sections' token codes are moved, 16 bytes a token, and its n-grams are made and
    counted where they arrive. N-grams of larger books are moved one by one, so that no task holds such a book."""
    packed = stage(coded(token_arrays(sections)).withColumn("offset", F.lit(0).cast("bigint")))
    large = packed.groupBy("book_id").agg(F.sum(F.size("toks")).alias("tokens")).where(F.col("tokens") > whole).select("book_id")
    large = stage(large)
    small = packed.join(large, "book_id", "left_anti").repartition("book_id")
    count = lambda rows: coded_ngrams(rows, sizes).groupBy("book_id", "n", "gram").agg(F.count("*").alias("k"))
    if large.isEmpty():
        return count(small)
    return count(small).unionByName(count(packed.join(large, "book_id", "left_semi")))


def coded_grams(codes: Column, n: int) -> Column:
    """``ARRAY<STRUCT<gram, pos>>`` of the n-grams of an array of token codes, as :func:`coded_ngrams` numbers them."""
    last = F.size(codes) - n
    at = lambda i, k: F.element_at(codes, i + k + 1)
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(gram_code(*[at(i, k) for k in range(n)]).alias("gram"), i.alias("pos")))


def ngrams(sections: DataFrame, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(book_id, n, gram, tok) for each n-gram size; sizes above one stay inside a block."""
    packed = section_tokens(sections)
    grams = F.concat(
        *[
            F.transform(
                gram_array(F.col("toks"), n, norm=lambda t: t.norm, same_block=True),
                lambda g: F.struct(F.lit(n).alias("n"), g.gram.alias("gram"), g.pos.alias("pos")),
            )
            for n in sizes
        ]
    )
    return packed.select("book_id", "offset", F.explode(grams).alias("g")).select(
        "book_id",
        F.col("g.n").alias("n"),
        F.col("g.gram").alias("gram"),
        (F.col("offset") + F.col("g.pos")).cast("bigint").alias("tok"),
    )


def corpus_summary(sections: DataFrame) -> DataFrame:
    """Sections and characters per book."""
    return sections.groupBy("book_id").agg(
        F.count("*").alias("sections"), F.sum(F.length("text")).cast("bigint").alias("characters")
    )
