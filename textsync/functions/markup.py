"""Markup → reading-order text and attribute lookups, as regular-expression columns."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from textsync.functions.text import SPACE

# Elements whose content is not read, and elements that end a line.
HIDDEN_TAGS = "head script style svg math noscript".split()
LINE_TAGS = (
    "address article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 "
    "header li main nav ol p pre section table td th tr ul"
).split()

# Named character references: the whole HTML table, as the standard library has it.
ENTITIES = {name: char for name, char in html5.items() if name.endswith(";")}

PREFIX = r"(?:[\w.\-]+:)?"
# Inside a tag: anything but its end, quoted values whole. The second form leaves a closing slash.
ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
INNER = r"""(?:[^>"'/]++|/(?!>)|"[^"]*+"|'[^']*+')*+"""


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unescape(c: Column) -> Column:
    """Decode character references in one pass, so that nothing decoded is read again. Unknown ones stay."""
    pieces = lambda x: F.regexp_extract_all(x, F.lit(r"&(?:#[xX]?[0-9A-Fa-f]+|[0-9A-Za-z]+);|&|[^&]+"), F.lit(0))
    names = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")

    def decode(piece: Column) -> Column:
        hexa = F.regexp_extract(piece, r"^&#[xX]([0-9A-Fa-f]{1,6});$", 1)
        deci = F.regexp_extract(piece, r"^&#([0-9]{1,7});$", 1)
        code = F.when(hexa != "", F.conv(hexa, 16, 10)).when(deci != "", deci).try_cast("bigint")
        legal = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        named = F.coalesce(F.try_element_at(names, F.substring(piece, 2, 40)), piece)
        return F.when(~piece.startswith("&") | (F.length(piece) < 3), piece).when(F.substring(piece, 2, 1) != "#", named).when(legal, char).otherwise(piece)

    decoded = lambda x: F.array_join(F.transform(pieces(x), decode), "")
    return _bind(c, lambda x: F.when(x.contains("&"), decoded(x)).otherwise(x))


def visible_markup(html: Column) -> Column:
    """Comments, declarations and hidden subtrees removed; CDATA kept as escaped text."""
    c = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    pieces = lambda x: F.regexp_extract_all(x, F.lit(r"(?s)<!\[CDATA\[.*?\]\]>|<|[^<]+"), F.lit(0))

    def escape(piece: Column) -> Column:
        body = F.regexp_replace(piece, r"^<!\[CDATA\[|\]\]>$", "")
        for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            body = F.replace(body, F.lit(raw), F.lit(safe))
        return F.when(piece.startswith("<![CDATA["), body).otherwise(piece)

    escaped = lambda x: F.array_join(F.transform(pieces(x), escape), "")
    c = _bind(c, lambda x: F.when(x.contains("<![CDATA["), escaped(x)).otherwise(x))
    c = F.regexp_replace(c, r"(?s)<\?.*?\?>|<![^>]*>", "")
    # a closing tag that is left over shows that a hidden subtree held another of its kind
    left = rf"</{PREFIX}(?:{'|'.join(HIDDEN_TAGS)})\s*>"
    return _bind(c, lambda x: _bind(_without_hidden(x), lambda y: F.when(y.rlike(left), _without_hidden(_without_nested(x))).otherwise(y)))


def _without_hidden(c: Column) -> Column:
    """Hidden elements removed up to the first closing tag of their kind."""
    for tag in HIDDEN_TAGS:
        name = f"{PREFIX}{tag}"
        c = F.regexp_replace(c, f"(?s)<{name}(?:\\s{INNER})?/>", "")
        c = F.regexp_replace(c, f"(?s)<{name}(?:\\s{ATTRS})?>.*?</{name}\\s*>", "")
    return c


def _without_nested(c: Column) -> Column:
    """Hidden subtrees removed whole: a fold over the tags of hidden elements counts the depth of the outermost one's kind.

    Tags of other hidden elements inside it do not count, nor do closing tags outside. An element that is never closed hides
    nothing. The fold keeps a list of the subtrees, not of the tags."""
    tag = rf"(?s)<(?:/{PREFIX}(?:{'|'.join(HIDDEN_TAGS)})\s*|{PREFIX}(?:{'|'.join(HIDDEN_TAGS)})(?:\s{INNER})?)>"
    tags, gaps = F.regexp_extract_all(c, F.lit(tag), F.lit(0)), F.split(c, tag, -1)
    kinds = F.transform(tags, lambda t, i: F.struct(i.alias("at"), t.startswith("</").alias("shuts"), F.regexp_extract(t, rf"^</?{PREFIX}(\w+)", 1).alias("name")))
    start = F.struct(
        F.lit("").alias("name"), F.lit(0).alias("depth"), F.lit(0).alias("since"), F.array().cast("array<struct<a:int,b:int>>").alias("spans")
    )

    def step(state: Column, t: Column) -> Column:
        inside, own = state["depth"] > 0, state["name"] == t["name"]
        depth = F.when(~inside & ~t["shuts"], 1).when(inside & own, state["depth"] + F.when(t["shuts"], -1).otherwise(1)).otherwise(state["depth"])
        closes = inside & own & t["shuts"] & (state["depth"] == 1)
        return F.struct(
            F.when(inside, state["name"]).otherwise(t["name"]).alias("name"), depth.cast("int").alias("depth"), F.when(inside, state["since"]).otherwise(t["at"]).alias("since"),
            F.when(closes, F.concat(state["spans"], F.array(F.struct(state["since"].alias("a"), t["at"].alias("b"))))).otherwise(state["spans"]).alias("spans"),
        )

    spans = F.aggregate(kinds, start, step, lambda state: state["spans"])

    def shown(all_spans: Column) -> Column:
        gap = lambda g, i: F.when(F.exists(all_spans, lambda s: (s["a"] < i) & (i <= s["b"])), "").otherwise(g)
        after = lambda i: F.when(F.exists(all_spans, lambda s: (s["a"] <= i) & (i <= s["b"])), "").otherwise(F.coalesce(F.get(tags, i), F.lit("")))
        return F.array_join(F.transform(gaps, lambda g, i: F.concat(gap(g, i), after(i))), "")

    return _bind(spans, shown)


def markup_to_text(html: Column) -> Column:
    """Visible text of a page: one line per block, whitespace runs squeezed, references decoded."""
    c = F.regexp_replace(visible_markup(html), f"{SPACE}+", " ")
    names = "|".join(LINE_TAGS)
    c = F.regexp_replace(c, f"</?{PREFIX}(?:{names})(?:\\s{INNER})?/?>", "\n")
    c = F.regexp_replace(c, f"<(?=[A-Za-z/!?]){ATTRS}>", "")
    c = F.regexp_replace(c, r"<[^>]*>", "")  # what is left of tags with an open quote
    c = unescape(c)
    inner = SPACE.replace(r"\t-\r", r"\t\x{0B}-\r")
    c = F.regexp_replace(c, f"{inner}+", " ")
    c = F.regexp_replace(c, r" *\n[ \n]*", "\n")
    return F.regexp_replace(c, r"^[ \n]+|[ \n]+$", "")


def tag_attr(tag: Column, name: str) -> Column:
    """Unescaped value of an attribute of one start tag by local name; null when absent."""
    pattern = rf"""\s{PREFIX}{name}\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    value = F.concat(F.regexp_extract(tag, pattern, 1), F.regexp_extract(tag, pattern, 2))
    return F.when(tag.rlike(pattern), unescape(value))
