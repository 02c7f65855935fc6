"""Archive paths and resource references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Audio extensions that may be copied, and the media types that may be published.
COPY_MEDIA_TYPES = {
    "mp3": "audio/mpeg",
    "m4a": "audio/mp4",
    "m4b": "audio/mp4",
    "mp4": "audio/mp4",
    "opus": "audio/ogg; codecs=opus",
}
ENCODED = {"opus": ("audio.opus", "audio/ogg; codecs=opus"), "aac": ("audio.m4a", "audio/mp4")}


def percent_decode(c: Column) -> Column:
    """Null on an incomplete or illegal escape, or when the bytes are not UTF-8."""
    legal = ~c.rlike(r"%(?![0-9A-Fa-f]{2})")
    return F.when(legal, F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))))


def _percent_encode(c: Column) -> Column:
    c = F.url_encode(c)
    for wrong, right in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return c


def encode_fragment(c: Column) -> Column:
    return _percent_encode(c)


def encode_path(c: Column) -> Column:
    return F.replace(_percent_encode(c), F.lit("%2F"), F.lit("/"))


def parent_path(c: Column) -> Column:
    return F.regexp_extract(c, r"(?s)^(.*)/[^/]*$", 1)


def join_path(base: Column, child: Column) -> Column:
    child = F.regexp_replace(child, "^/+", "")
    return F.when(base == "", child).otherwise(
        F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), child)
    )


def _parts(c: Column) -> Column:
    return F.filter(F.split(c, "/"), lambda p: p != "")


def normalize_path(c: Column) -> Column:
    """Collapse ``.`` and ``..``; null when absolute, empty or above the root."""
    c = F.replace(c, F.lit("\\"), F.lit("/"))
    empty = F.array().cast("array<string>")

    def step(stack: Column, part: Column) -> Column:
        # a null stack marks an escape above the root and stays null
        return (
            F.when((part == "") | (part == "."), stack)
            .when((part == "..") & (F.size(stack) > 0), F.slice(stack, 1, F.size(stack) - 1))
            .when(part == "..", F.lit(None).cast("array<string>"))
            .otherwise(F.concat(stack, F.array(part)))
        )

    stack = F.aggregate(F.split(c, "/"), empty, step)
    return F.when(~c.startswith("/") & (F.size(stack) > 0), F.array_join(stack, "/"))


def resolve_href(base: Column, href: Column, optional: bool = False) -> Column:
    """``STRUCT<path, reason>``: the archive path of a reference, or why there is none.

    The spine form reports every failure. The optional form, for images and links, treats blank,
    absolute and external references as simply not in the archive (both fields null).
    """
    bare = F.element_at(F.split(href, "[#?]", -1), 1)
    bare = F.trim(bare) if optional else bare
    external = bare.contains("://") | bare.startswith("data:")
    decoded = percent_decode(bare)
    combined = F.when(base == "", decoded).otherwise(F.concat(base, F.lit("/"), decoded))
    path = normalize_path(combined)
    absent = (bare == "") | bare.startswith("/") | external if optional else F.lit(False)
    reason = (
        F.when(absent, F.lit(None))
        .when(external, F.lit("external"))
        .when(decoded.isNull(), F.lit("bad_escape"))
        .when(path.isNull(), F.lit("bad_path"))
    )
    found = F.when(~absent & ~external, path)
    return F.struct(found.alias("path"), reason.cast("string").alias("reason"))


def relative_path(from_dir: Column, target: Column) -> Column:
    """Path of ``target`` as seen from a directory of the same archive."""
    a, b = _parts(from_dir), _parts(target)
    marks = F.transform(a, lambda x, i: F.when(x == F.get(b, i), F.lit(1)).otherwise(F.lit(0)))
    first_diff = F.array_position(marks, F.lit(0))
    common = F.when(first_diff == 0, F.size(a)).otherwise(first_diff - 1).cast("int")
    ups = F.array_repeat(F.lit(".."), F.size(a) - common)
    rest = F.slice(b, common + 1, F.greatest(F.size(b) - common, F.lit(0)))
    path = F.array_join(F.concat(ups, rest), "/")
    return F.when(path == "", F.lit(".")).otherwise(path)


def media_type_of(codec: Column, file_name: Column) -> Column:
    """``STRUCT<file_name, media_type>`` of published audio; null when it may not be published."""
    ext = F.lower(F.trim(F.regexp_extract(file_name, r"\.([^./\\]+)$", 1)))
    copied = F.create_map(*[F.lit(x) for kv in COPY_MEDIA_TYPES.items() for x in kv])
    fields = lambda name, kind: F.struct(name.alias("file_name"), kind.alias("media_type"))
    expr = F.when(
        (codec == "copy") & copied[ext].isNotNull(),
        fields(F.concat(F.lit("audio."), ext), copied[ext]),
    )
    for name, (out, kind) in ENCODED.items():
        expr = expr.when(codec == name, fields(F.lit(out), F.lit(kind)))
    return expr


def audio_descriptor_ok(file_name: Column, media_type: Column, codec: Column) -> Column:
    filled = (F.trim(file_name) != "") & (F.trim(media_type) != "") & (F.trim(codec) != "")
    allowed = [k for _, k in ENCODED.values()] + list(COPY_MEDIA_TYPES.values())
    return filled & media_type.isin(sorted(set(allowed)))
