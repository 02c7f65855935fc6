"""Column expressions on words, lines and scores. All stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode whitespace, alphanumerics and word joiners as regex classes.
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ALNUM = r"[\p{IsAlphabetic}\p{N}]"
NOT_ALNUM = r"[^\p{IsAlphabetic}\p{N}]"
JOINER = r"['’\-]"
TOKEN = f"{ALNUM}+(?:{JOINER}+{ALNUM}+)*"
SPACES = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
JOINERS = "'’-"

# The words too common to count as distinctive.
COMMON_WORDS = (
    "about after again also been before being could from have into just more most other over "
    "some such than that their them then there these they this those through very were what "
    "when where which while with would"
).split()

SENTENCE_END = r"[.!?][\"'”’)\]]*$"


def idiv(a: Column, b: Column | int) -> Column:
    """Truncating integer division."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def trim_space(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def squeeze_space(c: Column) -> Column:
    """Runs of whitespace become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def fold_case(c: Column) -> Column:
    """Lowercase letter by letter: a capital sigma never becomes the final form."""
    return F.translate(F.lower(c), "ς", "σ")


def word_seq(c: Column) -> Column:
    """Lowercased alphanumeric runs, in order."""
    return F.regexp_extract_all(fold_case(c), F.lit(f"{ALNUM}+"), F.lit(0))


def word_set(c: Column) -> Column:
    return F.array_distinct(word_seq(c))


def token_array(c: Column) -> Column:
    """Normal forms of the tokens of a text: joiners dropped, lowercased. They are folded as one string, after they are cut."""
    raw = F.array_join(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), "\n")
    return F.array_remove(F.split(F.translate(fold_case(raw), JOINERS, ""), "\n"), "")


def word_codes(c: Column) -> Column:
    """The word set as 64-bit hashes, for comparing sets."""
    return F.transform(word_set(c), lambda w: F.xxhash64(w))


def distinctive_words(words: Column) -> Column:
    common = F.array(*[F.lit(w) for w in COMMON_WORDS])
    return F.filter(words, lambda w: (F.length(w) >= 4) & ~F.array_contains(common, w))


def ratio_milli(n: Column, d: Column) -> Column:
    """Truncated thousandths, at most 1000; 0 for an empty denominator."""
    value = F.least(F.lit(1000), idiv(n * 1000, F.greatest(d, F.lit(1))))
    return F.when(d == 0, F.lit(0)).otherwise(value).cast("int")


def jaccard_milli(a: Column, b: Column) -> Column:
    """Overlap of two word sets in thousandths; 0 if either is empty."""
    shared, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, F.lit(0)).otherwise(idiv(shared * 1000, union)).cast("int")


def alnum_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, NOT_ALNUM, ""))


def ascii_fold(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def first_of_each(lines: Column) -> Column:
    """Drop ASCII-case-insensitive repeats, keep the first form and the order."""
    pair = lambda x: F.struct(x.alias("line"), F.transform(x, ascii_fold).alias("folded"))
    # bound one after the other, so neither list is computed again for every line
    bound = F.transform(F.transform(F.array(lines), pair), lambda p: F.filter(
        p.line, lambda x, i: F.array_position(p.folded, F.element_at(p.folded, i + 1)) == i + 1
    ))
    return F.element_at(bound, 1)


def evidence_lines(lines: Column, low: int = 2, high: int = 240) -> Column:
    """Normalized lines with ``low``..``high`` alphanumerics, repeats dropped."""
    flat = F.transform(lines, squeeze_space)
    kept = F.filter(flat, lambda x: alnum_count(x).between(low, high))
    return first_of_each(kept)


def hint_list(values: Column, cap: int = 512) -> Column:
    """Non-empty normalized hints of at most ``cap`` characters, repeats and nulls dropped."""
    flat = F.transform(F.filter(values, lambda x: x.isNotNull()), squeeze_space)
    return first_of_each(F.filter(flat, lambda x: F.length(x).between(1, cap)))


def ends_sentence(c: Column) -> Column:
    return c.rlike(SENTENCE_END)


def format_clock(ms: Column) -> Column:
    return F.format_string(
        "%d:%02d:%02d.%03d",
        idiv(ms, 3600000),
        idiv(ms % 3600000, 60000),
        idiv(ms % 60000, 1000),
        (ms % 1000).cast("bigint"),
    )


def parse_clock(c: Column) -> Column:
    """``h:mm:ss.fff`` → ms; null unless three parts, minutes and seconds under 60 and a fraction
    of at most three digits."""
    pattern = r"^(\d+):(\d+):(\d+)(?:\.(\d{1,3}))?$"
    part = lambda i: F.regexp_extract(c, pattern, i)
    hours, minutes, seconds = (part(i).try_cast("bigint") for i in (1, 2, 3))
    millis = F.rpad(part(4), 3, "0").try_cast("bigint")
    value = ((hours * 60 + minutes) * 60 + seconds) * 1000 + F.coalesce(millis, F.lit(0))
    return F.when(c.rlike(pattern) & (minutes < 60) & (seconds < 60), value)


def escape_xml(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def little_endian_8(c: Column) -> Column:
    """The eight little-endian bytes of a long."""
    digits = F.lpad(F.hex(c.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(8))]))


def review_id(seg: Column, start_ms: Column, end_ms: Column, text: Column) -> Column:
    """Stable identifier of a review item, from its position, times and text."""
    payload = F.concat(*[little_endian_8(c) for c in (seg, start_ms, end_ms)], F.encode(text, "UTF-8"))
    return F.concat(F.lit("review-"), F.sha2(payload, 256))
