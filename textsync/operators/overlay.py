"""Cue timelines, anchors, supplemental pages and the tables of a synchronized book."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsync.functions.markup import ATTRS, LINE_TAGS, PREFIX, tag_attr, unescape, visible_markup
from textsync.functions.paths import encode_fragment
from textsync.functions.text import SPACE, escape_xml, format_clock, idiv, trim_space
from textsync.operators.ordered import scan, slabs_of, total_before, total_through
from textsync.operators.review import matched
from textsync.operators.timeline import violations

# Prefix of generated ids, and the media types of a synchronized page.
ID_PREFIX = "stl"
PAGE_TYPE, OVERLAY_TYPE = "application/xhtml+xml", "application/smil+xml"
ANCHOR_TAGS = ["body"] + [t for t in LINE_TAGS if t != "br"]
SIDES = {"introduction": ("Introduction", "frontmatter"), "credits": ("Credits", "backmatter")}


def reading_order(spine: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages in reading order: linear spine entries that are markup and not navigation."""
    linear = spine.where("linear is null or lower(linear) <> 'no'")
    rows = linear.join(manifest.withColumnRenamed("id", "idref"), ["book_id", "idref"], "left")
    navigation = F.array_contains(F.split(F.coalesce("properties", F.lit("")), f"{SPACE}+"), "nav")
    pages = rows.where((F.col("media_type") == PAGE_TYPE) & ~navigation)
    numbered = scan(
        pages, ["book_id"], ["spine_ord"], slabs_of(F.col("spine_ord")),
        section_ord=total_before(F.lit(1).cast("bigint")),
    )
    return numbered, violations(rows, F.col("idref"), idref_missing=F.col("href").isNull())


def sync_documents(effective: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages that carry matched segments, and matched segments that cannot be synchronized."""
    hits = effective.where(matched())
    crosses = (F.col("book_start.href") != F.col("book_end.href")) | (
        F.col("book_start.line_index") != F.col("book_end.line_index")
    )
    broken = violations(
        hits, F.col("seg"),
        position_missing=F.col("book_start").isNull() | F.col("book_end").isNull(),
        crosses_block=crosses,
        time_range=F.col("end_ms") <= F.col("start_ms"),
    )
    pages = hits.groupBy("book_id", F.col("book_start.href").alias("href")).agg(F.count("*").alias("segments"))
    return pages, broken


def resource_readouts(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items assigned to a resource; class and target kind must agree and no target repeat."""
    given = items.where("decision.state = 'assigned'")
    image = F.col("decision.image_href").isNotNull()
    graphic = F.coalesce(F.col("decision.classification") == "graphic_readout", F.lit(False))
    rows = given.where(image).select(
        "book_id", "seg", "start_ms", "end_ms", F.col("decision.href").alias("href"),
        F.col("decision.image_href").alias("image_href"),
    )
    twice = rows.groupBy("book_id", "href", "image_href").count().where("count > 1")
    broken = violations(
        given, F.col("seg"),
        readout_without_image=graphic & ~image,
        image_without_readout=image & ~graphic,
        mixed_target=image & (F.col("decision.line_index").isNotNull() | F.col("decision.supplemental").isNotNull()),
        time_range=image & (F.col("end_ms") <= F.col("start_ms")),
    ).unionByName(violations(twice, F.concat_ws("#", "href", "image_href"), target_repeated=F.lit(True)))
    return rows, broken


# ---------------------------------------------------------------- anchors


def page_events(pages: DataFrame, html: str = "html") -> DataFrame:
    """Tags and text pieces of each page in order, with the container depth after each piece."""
    rest = [c for c in pages.columns if c != html]
    pieces = F.regexp_extract_all(visible_markup(F.col(html)), F.lit(f"(?s)<{ATTRS}>|[^<]+"), F.lit(0))
    rows = pages.select(*rest, F.posexplode(pieces).alias("pos", "piece"))
    is_tag = F.col("piece").startswith("<")
    rows = rows.withColumn("name", F.when(is_tag, F.regexp_extract("piece", rf"^</?{PREFIX}([\w\-]+)", 1)))
    closing, empty = F.col("piece").startswith("</"), F.col("piece").endswith("/>")
    container = F.col("name").isin(ANCHOR_TAGS) & ~empty
    return rows.withColumns({
        "opens": F.coalesce(container & ~closing, F.lit(False)),
        "closes": F.coalesce(container & closing, F.lit(False)),
        "breaks": F.coalesce(F.col("name").isin(LINE_TAGS), F.lit(False)),
        "says": ~is_tag & (trim_space(unescape(F.col("piece"))) != ""),
    })


def line_anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """(…, line_index, anchor, generated): the fragment each visible line can be addressed by — the id of
    the innermost container open at its first text, or a generated id unique in the page."""
    rest = [c for c in pages.columns if c != html]
    page = Window.partitionBy(*rest).orderBy("pos")
    events = page_events(pages, html)
    step = F.when(F.col("opens"), 1).when(F.col("closes"), -1).otherwise(0)
    events = events.withColumns({
        "depth": F.sum(step).over(page),
        "line": F.sum(F.col("breaks").cast("int")).over(page),
        "ordinal": F.sum(F.col("opens").cast("int")).over(page) - 1,
    })
    own = F.when(F.col("opens"), F.struct("ordinal", tag_attr(F.col("piece"), "id").alias("id")))
    inside = F.last(own, ignorenulls=True).over(Window.partitionBy(*rest, "depth").orderBy("pos"))
    spoken = events.withColumn("owner", F.when(F.col("depth") > 0, inside)).where("says")
    lines = spoken.groupBy(*rest, "line").agg(
        F.min_by("owner", F.when(F.col("owner").isNotNull(), F.col("pos"))).alias("owner")
    )
    order = F.row_number().over(Window.partitionBy(*rest).orderBy("line")) - 1
    named = trim_space(F.coalesce("owner.id", F.lit(""))) != ""
    base = F.concat(F.lit(f"{ID_PREFIX}-mo-s"), F.col("section_ord") + 1, F.lit("-b"), F.col("owner.ordinal") + 1)
    lines = lines.withColumn("line_index", order).withColumn("base", F.when(F.col("owner").isNotNull() & ~named, base))
    used = events.where("opens").select(*rest, tag_attr(F.col("piece"), "id").alias("name")).where("name is not null")
    asked = lines.where("base is not null").select(*rest, "base").distinct().withColumn("ord", F.lit(0))
    made = unique_names(asked, used, rest)
    return lines.join(made.drop("ord"), [*rest, "base"], "left").select(
        *rest, "line_index",
        F.when(F.col("base").isNull(), F.col("owner.id")).otherwise(F.col("name")).alias("anchor"),
        F.col("base").isNotNull().alias("generated"),
    )


def resource_anchors(refs: DataFrame, wanted: DataFrame, used: DataFrame) -> DataFrame:
    """First element of each wanted resource in a page gets its own id or a generated unique one.
    ``refs`` carry (book_id, href, image_href, image_ordinal, element_id, section_ord)."""
    first = refs.groupBy("book_id", "href", "image_href").agg(
        F.min(F.struct("image_ordinal", "element_id", "section_ord")).alias("e")
    )
    rows = wanted.join(first, ["book_id", "href", "image_href"], "left")
    named = trim_space(F.coalesce("e.element_id", F.lit(""))) != ""
    base = F.concat(F.lit(f"{ID_PREFIX}-graphic-s"), F.col("e.section_ord") + 1, F.lit("-r"), F.col("review_ord") + 1)
    rows = rows.withColumn("base", F.when(F.col("e").isNotNull() & ~named, base))
    made = unique_names(
        rows.where("base is not null").select("book_id", "href", "base", F.col("review_ord").alias("ord")), used, ["book_id", "href"]
    )
    return rows.join(made.drop("ord"), ["book_id", "href", "base"], "left").select(
        *wanted.columns, F.coalesce("name", "e.element_id").alias("anchor")
    )


def _free_numbers(asked: DataFrame, taken: DataFrame, by: list[str]) -> DataFrame:
    """``asked`` with ``k``, for its ``nth`` (from 0) the number of that place among the numbers from 1 that ``taken(by…, k)`` leaves free.

    The i-th taken number k stands after k - i free ones, so the m-th free number is m plus the taken ones with fewer
    than m free numbers before them. Requests and taken numbers are put in one order and counted through it."""
    runs = scan(taken.distinct(), by, ["k"], slabs_of(F.col("k")), i=total_through(F.lit(1).cast("bigint")))
    held = runs.select(*by, ((F.col("k") - F.col("i")) * 2 + 1).alias("place"), F.lit(1).cast("bigint").alias("used"), F.lit(None).cast("bigint").alias("nth"))
    wanted = asked.select(*by, ((F.col("nth") + 1) * 2).alias("place"), F.lit(0).cast("bigint").alias("used"), F.col("nth").cast("bigint").alias("nth"))
    met = scan(held.unionByName(wanted), by, ["place"], slabs_of(F.col("place")), before=total_before(F.col("used")))
    found = met.where("used = 0").select(*by, "nth", (F.col("nth") + 1 + F.col("before")).alias("k"))
    return asked.join(found, [*by, "nth"])


def _names_in_turn(scope: list[str]):
    def assign(asked: pd.DataFrame, used: pd.DataFrame) -> pd.DataFrame:
        taken, names = set(used["name"]), []
        for base in (asked := asked.sort_values("ord"))["base"]:
            name, n = base, 2
            while name in taken:
                name, n = f"{base}-{n}", n + 1
            taken.add(name)
            names.append(name)
        return asked[[*scope, "base", "ord"]].assign(name=names)

    return assign


def unique_names(asked: DataFrame, used: DataFrame, scope: list[str]) -> DataFrame:
    """Names for (scope…, base, ord) in order: base, base-2, base-3 …, avoiding ``used`` (scope…, name).

    Requests for one base are numbered and mapped to its free suffixes without visiting each other. Only
    where one base is another plus a number can requests meet; those few families take turns.
    """
    family = lambda c: F.regexp_replace(c, r"(-\d+)+$", "")
    asked = asked.select(*scope, "base", F.col("ord").cast("bigint").alias("ord")).withColumn("family", family(F.col("base")))
    mixed = asked.groupBy(*scope, "family").agg((F.min("base") != F.max("base")).alias("mixed"))
    asked = asked.join(mixed, [*scope, "family"])
    lone = asked.where("not mixed").drop("mixed", "family")
    numbered = scan(lone, [*scope, "base"], ["ord"], slabs_of(F.col("ord")), nth=total_before(F.lit(1).cast("bigint")))
    suffix = F.regexp_extract("name", r"^(.*)-([2-9]|[1-9]\d+)$", 2)
    stem = F.regexp_extract("name", r"^(.*)-([2-9]|[1-9]\d+)$", 1)
    whole = used.select(*scope, F.col("name").alias("base"), F.lit(1).cast("bigint").alias("k"))
    tailed = used.where(suffix != "").select(*scope, stem.alias("base"), suffix.try_cast("bigint").alias("k"))
    taken = whole.unionByName(tailed).join(lone.select(*scope, "base").distinct(), [*scope, "base"], "left_semi")
    plain = _free_numbers(numbered, taken, [*scope, "base"]).select(
        *scope, "base", "ord",
        F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("k"))).alias("name"),
    )
    turn = asked.where("mixed").drop("mixed")
    near = used.select(*scope, "name").withColumn("family", family(F.col("name"))).join(
        turn.select(*scope, "family").distinct(), [*scope, "family"], "left_semi"
    )
    # fresh columns: both sides of the cogroup descend from the same tables
    near = near.select(*[F.col(c).alias(c) for c in near.columns])
    turn = turn.select(*[F.col(c).alias(c) for c in turn.columns])
    fields = plain.schema
    by = [*scope, "family"]
    taken_turns = turn.groupBy(*by).cogroup(near.groupBy(*by)).applyInPandas(_names_in_turn(scope), fields)
    return plain.unionByName(taken_turns)


# ---------------------------------------------------------------- cues


def cues(effective: DataFrame, sections: DataFrame, anchors: DataFrame, readouts: DataFrame | None = None) -> DataFrame:
    """One cue per matched segment and per resource readout (book_id, section_ord, start_ms, end_ms,
    cue_id, anchor, kind). ``anchors`` (book_id, section_ord, line_index, anchor); ``readouts``
    (book_id, href, review_ord, start_ms, end_ms, anchor)."""
    place = sections.select("book_id", "href", "section_ord")
    name = lambda kind, n: F.concat(F.lit(f"{ID_PREFIX}-{kind}-"), F.col("section_ord") + 1, F.lit("-"), F.col(n) + 1)
    text = (
        effective.where(matched())
        .select("book_id", "seg", "start_ms", "end_ms", F.col("book_start.href").alias("href"), F.col("book_start.line_index").alias("line_index"))
        .join(place, ["book_id", "href"])
        .join(anchors.select("book_id", "section_ord", "line_index", "anchor"), ["book_id", "section_ord", "line_index"], "left")
        .select("book_id", "section_ord", "start_ms", "end_ms", name("par", "seg").alias("cue_id"), "anchor", F.lit("text").alias("kind"))
    )
    if readouts is None:
        return text
    images = readouts.join(place, ["book_id", "href"]).select(
        "book_id", "section_ord", "start_ms", "end_ms", name("graphic-par", "review_ord").alias("cue_id"), "anchor",
        F.lit("resource").alias("kind"),
    )
    return text.unionByName(images)


CUE_ORDER = ["start_ms", "end_ms", "cue_id"]


def audit_cue_order(cues: DataFrame) -> DataFrame:
    """Cues of a page must have an anchor and a positive range and must not overlap in time."""
    page = Window.partitionBy("book_id", "section_ord").orderBy(*CUE_ORDER)
    rows = cues.withColumn("before", F.lag("end_ms").over(page))
    return violations(
        rows, F.col("cue_id"),
        anchor_missing=F.coalesce(F.col("anchor"), F.lit("")) == "",
        time_range=F.col("end_ms") <= F.col("start_ms"),
        overlap=F.col("start_ms") < F.col("before"),
    )


def overlay_pages(cues: DataFrame) -> DataFrame:
    """Cues and audio time of each page."""
    return cues.groupBy("book_id", "section_ord").agg(
        F.count("*").alias("cues"), F.sum(F.col("end_ms") - F.col("start_ms")).cast("bigint").alias("duration_ms")
    )


def durations(pages: DataFrame) -> DataFrame:
    """Declared durations: one row per page and one (null ``section_ord``) for the whole book."""
    return (
        pages.rollup("book_id", "section_ord").agg(F.sum("duration_ms").cast("bigint").alias("duration_ms"))
        .where("book_id is not null").withColumn("clock", format_clock(F.col("duration_ms")))
    )


def overlay_documents(cues: DataFrame, hrefs: DataFrame) -> DataFrame:
    """The cue document of each page, from (book_id, section_ord, text_href, audio_href)."""
    rows = cues.join(hrefs, ["book_id", "section_ord"])
    par = F.concat(
        F.lit('<par id="'), escape_xml(F.col("cue_id")), F.lit('"><text src="'), escape_xml(F.col("text_href")),
        F.lit("#"), escape_xml(encode_fragment(F.col("anchor"))), F.lit('"/><audio src="'), escape_xml(F.col("audio_href")),
        F.lit('" clipBegin="'), format_clock(F.col("start_ms")), F.lit('" clipEnd="'), format_clock(F.col("end_ms")), F.lit('"/></par>'),
    )
    head = (
        '<?xml version="1.0" encoding="UTF-8"?>\n<smil xmlns="http://www.w3.org/ns/SMIL" '
        'xmlns:epub="http://www.idpf.org/2007/ops" version="3.0"><body><seq epub:textref="'
    )
    listed = rows.select("book_id", "section_ord", "text_href", F.struct(*CUE_ORDER, par.alias("par")).alias("c"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.par), "")
    return listed.groupBy("book_id", "section_ord", "text_href").agg(body.alias("body")).select(
        "book_id", "section_ord",
        F.concat(F.lit(head), escape_xml(F.col("text_href")), F.lit('">'), F.col("body"), F.lit("</seq></body></smil>")).alias("document"),
    )


def overlay_manifest(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """Manifest of the synchronized book: pages point to their overlay, one overlay item per page.
    ``pages`` (book_id, idref, section_ord, overlay_id, overlay_href)."""
    linked = pages.select("book_id", F.col("idref").alias("id"), F.col("overlay_id").alias("media_overlay"))
    kept = manifest.drop("media_overlay").join(linked, ["book_id", "id"], "left")
    added = pages.select(
        "book_id", F.col("overlay_id").alias("id"), F.col("overlay_href").alias("href"), F.lit(OVERLAY_TYPE).alias("media_type")
    )
    return kept.unionByName(added, allowMissingColumns=True)


def build_summary(cues: DataFrame) -> DataFrame:
    """Pages, cues and synchronized time of each book."""
    return overlay_pages(cues).groupBy("book_id").agg(
        F.count("*").alias("pages"), F.sum("cues").cast("bigint").alias("segments"),
        F.sum("duration_ms").cast("bigint").alias("duration_ms"),
    )


# ---------------------------------------------------------------- supplemental pages


def supplemental_pages(items: DataFrame) -> DataFrame:
    """The page and cue of each item kept as introduction or credits. ``review_ord`` numbers the items."""
    rows = items.where("decision.state = 'assigned' and decision.supplemental is not null")
    kind = F.col("decision.classification")
    pick = lambda i: F.when(kind == "introduction", SIDES["introduction"][i]).when(kind == "credits", SIDES["credits"][i])
    number = F.format_string("%04d", F.col("review_ord") + 1)
    anchor = F.concat(F.lit(f"{ID_PREFIX}-extra-text-"), F.col("review_ord") + 1)
    xhtml = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" '
              'xmlns:epub="http://www.idpf.org/2007/ops" lang="en"><head><title>'),
        pick(0), F.lit('</title><meta charset="utf-8"/></head><body epub:type="'), pick(1), F.lit('"><section><h1>'), pick(0),
        F.lit('</h1><p id="'), anchor, F.lit('">'), escape_xml(trim_space(F.col("text"))), F.lit("</p></section></body></html>"),
    )
    return rows.select(
        "book_id", "seg", "review_ord", kind.alias("classification"), F.col("decision.supplemental").alias("placement"),
        F.col("decision.href").alias("anchor_href"), F.concat(F.lit(f"{ID_PREFIX}-extra-page-"), number).alias("page_id"),
        F.concat(F.lit("text/"), kind, F.lit("-"), number, F.lit(".xhtml")).alias("href"), anchor.alias("anchor"),
        "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), xhtml.alias("xhtml"),
    )


def extended_spine(spine: DataFrame, supplemental: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reading order with supplemental pages placed around their anchor page, renumbered; and pages whose
    anchor is not in the reading order."""
    place = spine.select("book_id", F.col("href").alias("anchor_href"), F.col("spine_ord").alias("at"))
    extra = supplemental.join(place, ["book_id", "anchor_href"], "left")
    side = F.when(F.col("placement") == "before_anchor", -1).otherwise(1)
    rows = spine.select("book_id", "href", F.col("spine_ord").alias("at"), F.lit(0).alias("side"), F.lit(0).cast("bigint").alias("turn"))
    rows = rows.unionByName(extra.where("at is not null").select(
        "book_id", "href", "at", side.alias("side"), F.col("review_ord").cast("bigint").alias("turn")
    ))
    numbered = scan(
        rows, ["book_id"], ["at", "side", "turn"], [idiv(F.col("at"), 1024)], spine_ord=total_before(F.lit(1).cast("bigint"))
    )
    lost = violations(extra, F.col("page_id"), anchor_missing=F.col("at").isNull())
    return numbered.select("book_id", "spine_ord", "href", (F.col("side") != 0).alias("supplemental")), lost
