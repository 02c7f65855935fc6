"""Referenced resources: extraction with hints, bounded candidates, scoring and assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsync.functions.markup import ATTRS, PREFIX, markup_to_text, tag_attr, unescape
from textsync.functions.paths import parent_path, resolve_href
from textsync.functions.text import (
    distinctive_words,
    evidence_lines,
    hint_list,
    idiv,
    ratio_milli,
    word_codes,
    word_seq,
)
from textsync.operators.ordered import last_before, next_after, scan, slabs_of
from textsync.operators.review import decision, matched

# Candidate limits, evidence sizes and score thresholds.
DOCUMENTS, CANDIDATES, MAX_BYTES = 12, 24, 25 * 1024 * 1024
EVIDENCE_WORDS, SHORT_WORDS = (5, 120), 12
COVERAGE, SCORE_SHORT, SCORE_LONG, DISTINCTIVE, MARGIN = 360, 770, 690, 2, 80


def resource_refs(docs: DataFrame, html: str = "html") -> DataFrame:
    """Images of a page in document order: ``img`` with its own hints, and ``image`` inside the innermost
    ``svg`` with that svg's title, desc and text. Adds (image_ordinal, href, hints) to the other columns."""
    rest = [c for c in docs.columns if c != html]
    tags = F.lit(rf"(?s)<{PREFIX}svg\b{ATTRS}>|</{PREFIX}svg\s*>|<{PREFIX}(?:img|image)\b{ATTRS}>|<{PREFIX}(title|desc|text)\b{ATTRS}(?<!/)>.*?</{PREFIX}\1\s*>")
    clean = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    pieces = docs.select(*rest, F.posexplode(F.regexp_extract_all(clean, tags, F.lit(0))).alias("pos", "tag"))
    kind = F.lower(F.regexp_extract("tag", rf"^</?{PREFIX}(\w+)", 1))
    closing = F.col("tag").startswith("</")
    empty = F.col("tag").endswith("/>")
    page = Window.partitionBy(*rest).orderBy("pos")
    opened = (F.col("kind") == "svg") & ~closing & ~empty
    shut = (F.col("kind") == "svg") & closing
    depth = F.sum(F.when(opened, 1).when(shut, -1).otherwise(0)).over(page)
    marked = pieces.withColumn("kind", kind).withColumn("depth", depth)
    # the innermost open svg is the latest one opened at the current depth
    deep = Window.partitionBy(*rest, "depth").orderBy("pos")
    owner = F.last(F.when(opened, F.col("pos")), ignorenulls=True).over(deep)
    marked = marked.withColumn("svg", F.when(F.col("depth") > 0, owner))
    is_img = F.col("kind") == "img"
    is_image = (F.col("kind") == "image") & (F.col("depth") > 0)
    href = F.when(is_img, tag_attr(F.col("tag"), "src")).when(is_image, tag_attr(F.col("tag"), "href"))
    found = marked.withColumn("href", href)
    own = F.array(F.when(is_img, tag_attr(F.col("tag"), "alt")), tag_attr(F.col("tag"), "title"))
    images = found.where("href is not null").select(
        *rest, "svg", "href", own.alias("own"), (F.row_number().over(page) - 1).alias("image_ordinal")
    ).withColumn("svg", F.coalesce("svg", F.lit(-1)))
    inner = F.split(F.regexp_replace("tag", rf"(?s)<{ATTRS}>", "\u0001"), "\u0001")
    said = found.where("svg is not null and kind in ('title', 'desc', 'text')").groupBy(*rest, "svg").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", inner.alias("said")))), lambda s: s.said)).alias("said")
    )
    hints = F.concat("own", F.coalesce(F.transform("said", unescape), F.array().cast("array<string>")))
    return images.join(said, [*rest, "svg"], "left").select(*rest, "image_ordinal", "href", hint_list(hints).alias("hints"))


def link_refs(docs: DataFrame, html: str = "html") -> DataFrame:
    """The same for links: ``a@href`` in document order, hinted by title and link text."""
    rest = [c for c in docs.columns if c != html]
    clean = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    links = F.regexp_extract_all(clean, F.lit(rf"(?s)<a\s{ATTRS}>.*?</a>"), F.lit(0))
    rows = docs.select(*rest, F.posexplode(links).alias("image_ordinal", "link"))
    tag = F.regexp_extract("link", rf"^<a\s{ATTRS}>", 0)
    return rows.select(
        *rest, "image_ordinal", tag_attr(tag, "href").alias("href"),
        hint_list(F.array(tag_attr(tag, "title"), markup_to_text(F.col("link")))).alias("hints"),
    ).where("href is not null")


def resolve_refs(refs: DataFrame, document: str = "document_href") -> DataFrame:
    """Adds ``image_href``, the archive path of each reference; external ones are dropped."""
    target = resolve_href(parent_path(F.col(document)), F.col("href"), optional=True)
    return refs.withColumn("image_href", target["path"]).where("image_href is not null")


def resource_windows(items: DataFrame, alignment: DataFrame, spine: DataFrame) -> DataFrame:
    """For each item the spine range its resources may come from, and the page it most likely belongs to:
    interpolated between the neighbouring matches by segment number."""
    place = spine.select("book_id", F.col("document_href").alias("href"), "spine_ord")
    near = alignment.select("book_id", "seg", "status",
                            F.when(matched(), F.col("book_start.href")).alias("a"), F.when(matched(), F.col("book_end.href")).alias("b"))
    for side in ("a", "b"):
        near = near.join(place.withColumnsRenamed({"href": side, "spine_ord": f"{side}_ord"}), ["book_id", side], "left")
    near = scan(
        near, ["book_id"], ["seg"], slabs_of(F.col("seg")),
        prev=last_before(F.when(matched(), F.struct("seg", F.col("b_ord").alias("ord")))),
        next=next_after(F.when(matched(), F.struct("seg", F.col("a_ord").alias("ord")))),
    )
    last = spine.groupBy("book_id").agg(F.max("spine_ord").alias("last"))
    rows = items.select("book_id", "seg").join(near.select("book_id", "seg", "prev", "next"), ["book_id", "seg"]).join(last, "book_id")
    span = F.greatest(F.col("next.seg") - F.col("prev.seg"), F.lit(1))
    middle = F.col("prev.ord") + idiv((F.col("next.ord") - F.col("prev.ord")) * (F.col("seg") - F.col("prev.seg")), span)
    return rows.select(
        "book_id", "seg",
        F.coalesce("prev.ord", F.lit(0)).cast("bigint").alias("lo"),
        F.coalesce("next.ord", "last").cast("bigint").alias("hi"),
        F.coalesce(middle, "prev.ord", "next.ord", F.lit(0)).cast("bigint").alias("focus"),
    )


def resource_candidates(items: DataFrame, alignment: DataFrame, spine: DataFrame, refs: DataFrame,
                        manifest: DataFrame, docs: int = DOCUMENTS, k: int = CANDIDATES, hints: bool = True) -> DataFrame:
    """Resources of the pages nearest the focus, declared in the manifest and of legal size.

    Candidates are ranked on keys and numbers; the texts in ``hints`` are joined to those that are left, unless not asked for.

    ``spine`` (book_id, spine_ord, document_href) is dense, so the pages nearest to a focus are known by
    number: at most ``2·docs`` are listed per item and no range join is needed.
    """
    windows = resource_windows(items, alignment, spine).where("lo <= hi")
    near = F.sequence(F.greatest("lo", F.col("focus") - docs), F.least("hi", F.col("focus") + docs))
    ranked = F.slice(F.array_sort(F.transform(near, lambda o: F.struct(F.abs(o - F.col("focus")).alias("far"), o.alias("ord")))), 1, docs)
    pages = windows.withColumn("p", F.explode(ranked)).select(
        "book_id", "seg", F.col("p.far").alias("far"), F.col("p.ord").alias("spine_ord")
    )
    images = manifest.where(F.lower("media_type").startswith("image/"))
    declared = images.where(F.col("size").between(1, MAX_BYTES)).select("book_id", F.col("href").alias("image_href"), "media_type", "size")
    key = ["book_id", "document_href", "image_href"]
    once = resource_images(refs)
    rows = pages.join(spine, ["book_id", "spine_ord"]).join(once.drop("hints"), ["book_id", "document_href"]).join(declared, ["book_id", "image_href"])
    rank = F.row_number().over(Window.partitionBy("book_id", "seg").orderBy("far", "spine_ord", "image_ordinal"))
    best = rows.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "book_id", "seg", "rank", "spine_ord", "document_href", "image_ordinal", "image_href", "media_type", "size"
    )
    return best.join(once.select(*key, "hints"), key).select(*best.columns, "hints") if hints else best


def resource_images(refs: DataFrame) -> DataFrame:
    """Each image of a page once, by its first reference: (book_id, document_href, image_href, image_ordinal, hints)."""
    return refs.groupBy("book_id", "document_href", "image_href").agg(
        F.min(F.struct("image_ordinal", "hints")).alias("r")
    ).select("book_id", "document_href", "image_href", "r.image_ordinal", "r.hints")


def choose_evidence(candidates: DataFrame, ocr: DataFrame | None = None) -> DataFrame:
    """Text known about each candidate, or about each image of :func:`resource_images`: its own hints, else recognised text if
    there is any."""
    own = candidates.withColumn("lines", evidence_lines(F.col("hints"))).withColumn("from_ocr", F.lit(False))
    if ocr is None:
        return own.where(F.size("lines") > 0)
    read = ocr.select("book_id", "image_href", F.col("lines").alias("ocr_lines"))
    rows = own.join(read, ["book_id", "image_href"], "left")
    use = (F.size("lines") == 0) & F.col("ocr_lines").isNotNull()
    rows = rows.withColumn("from_ocr", use).withColumn("lines", F.when(use, F.col("ocr_lines")).otherwise(F.col("lines")))
    return rows.drop("ocr_lines").where(F.size("lines") > 0)


def evidence_words(evidence: DataFrame) -> DataFrame:
    """Evidence lines → what scores need of them, for evidence of a legal size: the number of words, the set of words and the
    distinctive ones among them, both as hashes."""
    codes = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    rows = evidence.withColumn("seq", word_seq(F.array_join("lines", " "))).where(F.size("seq").between(*EVIDENCE_WORDS))
    rows = rows.withColumn("evidence_words", F.size("seq")).withColumn("words", F.array_distinct("seq"))
    return rows.withColumns({"words": codes(F.col("words")), "telling": codes(distinctive_words(F.col("words")))}).drop("seq", "lines")


def score_resources(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """Word overlap of each item with the evidence of its candidates, and whether it is strong enough. The evidence comes as lines
    or, made once an image, as :func:`evidence_words`."""
    said = items.select("book_id", "seg", word_codes(F.col("text")).alias("said")).where(F.size("said") > 0)
    rows = (evidence if "telling" in evidence.columns else evidence_words(evidence)).join(said, ["book_id", "seg"])
    rows = rows.withColumn("hits", F.size(F.array_intersect("words", "said")))
    rows = rows.withColumns({
        "coverage_milli": ratio_milli(F.col("hits"), F.size("words")),
        "similarity_milli": ratio_milli(F.col("hits"), F.least(F.size("words"), F.size("said"))),
        "distinctive": F.size(F.array_intersect("telling", "said")),
    }).withColumn("score_milli", idiv(F.col("coverage_milli") * 2 + F.col("similarity_milli"), 3).cast("int"))
    least = F.when(F.col("evidence_words") <= SHORT_WORDS, SCORE_SHORT).otherwise(SCORE_LONG)
    good = (F.col("coverage_milli") >= COVERAGE) & (F.col("score_milli") >= least) & (F.col("distinctive") >= DISTINCTIVE)
    return rows.withColumn("qualifies", good).drop("words", "telling", "said", "hits")


def _order() -> list[Column]:
    return [F.desc("qualifies"), F.desc("score_milli"), F.desc("coverage_milli"), "from_ocr", "spine_ord", "image_ordinal", "image_href"]


def _winners(scored: DataFrame) -> DataFrame:
    """Rank the candidates of each item; the first is recommended if strong and clearly ahead."""
    w = Window.partitionBy("book_id", "seg").orderBy(*_order())
    ranked = scored.withColumn("place", F.row_number().over(w)).withColumn("second", F.lead("score_milli").over(w))
    clear = F.col("second").isNull() | (F.col("score_milli") - F.col("second") >= MARGIN)
    return ranked.withColumn("recommended", (F.col("place") == 1) & F.col("qualifies") & clear).drop("second")


def recommend_resource(scored: DataFrame) -> DataFrame:
    """Ranked candidates with the recommendation. Recognised text counts only for items whose embedded
    text alone gives no winner."""
    embedded = _winners(scored.where("not from_ocr"))
    won = embedded.where("recommended").select("book_id", "seg")
    rest = _winners(scored.join(won, ["book_id", "seg"], "left_anti"))
    return embedded.join(won, ["book_id", "seg"], "left_semi").unionByName(rest)


def assign_resources(items: DataFrame, ranked: DataFrame) -> DataFrame:
    """Give recommended resources to pending items that are not at an edge: one item per resource, the
    earliest wins, targets already assigned stay closed. A refused item gets no second choice."""
    used = items.where("decision.image_href is not null").select(
        "book_id", F.col("decision.href").alias("document_href"), F.col("decision.image_href").alias("image_href")
    ).distinct()
    free = items.where("decision.state = 'pending' and edge is null").select("book_id", "seg")
    asked = ranked.where("recommended").join(free, ["book_id", "seg"], "left_semi").join(
        used, ["book_id", "document_href", "image_href"], "left_anti"
    )
    taken = asked.groupBy("book_id", "document_href", "image_href").agg(F.min("seg").alias("seg"))
    given = decision("assigned", href=F.col("document_href"), image_href=F.col("image_href"),
                     classification="graphic_readout", source="automatic")
    taken = taken.withColumn("given", given).drop("document_href", "image_href")
    return items.join(taken, ["book_id", "seg"], "left").select(
        *[c for c in items.columns if c != "decision"], F.coalesce("given", "decision").alias("decision")
    )


def check_manual_assignments(items: DataFrame, wanted: DataFrame, candidates: DataFrame) -> DataFrame:
    """``wanted`` (book_id, seg, document_href, image_href) with the reason it is refused, or null."""
    known = items.select("book_id", "seg", "edge", F.lit(True).alias("known"))
    used = items.where("decision.state = 'assigned' and decision.image_href is not null").select(
        "book_id", F.col("decision.href").alias("document_href"), F.col("decision.image_href").alias("image_href"), "seg"
    )
    # another item holds the target if the least or the greatest holder is not this item
    holders = used.groupBy("book_id", "document_href", "image_href").agg(F.min("seg").alias("a"), F.max("seg").alias("b"))
    current = candidates.select("book_id", "seg", "document_href", "image_href").distinct().withColumn("current", F.lit(True))
    rows = (
        wanted.join(known, ["book_id", "seg"], "left")
        .join(holders, ["book_id", "document_href", "image_href"], "left")
        .join(current, ["book_id", "seg", "document_href", "image_href"], "left")
    )
    reason = (
        F.when(F.col("known").isNull(), "unknown_item")
        .when(F.col("edge").isNotNull(), "edge_item")
        .when((F.col("a") != F.col("seg")) | (F.col("b") != F.col("seg")), "target_used")
        .when(F.col("current").isNull(), "not_a_candidate")
    )
    return rows.select(*wanted.columns, reason.alias("reason"))


def ocr_evidence(rows: DataFrame, keys: list[str], least_mean: float = 20.0) -> DataFrame:
    """Recognised words (page_num, block_num, par_num, line_num, word_num, conf, text) → evidence lines
    and mean confidence of each image."""
    from textsync.functions.text import alnum_count, squeeze_space

    index = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(0)).alias(c)
    words = rows.withColumn("conf", F.trim(F.col("conf").cast("string")).try_cast("float")).withColumn("word", squeeze_space(F.col("text")))
    words = words.where("conf >= 0 and word <> ''").select(
        *keys, *[index(c) for c in ("page_num", "block_num", "par_num", "line_num")], "word_num", "conf", "word"
    )
    line = words.groupBy(*keys, "page_num", "block_num", "par_num", "line_num").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_num", "word"))), lambda w: w.word), " ").alias("line"),
        F.sum("conf").alias("conf"), F.count("*").alias("n"),
    )
    image = line.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("page_num", "block_num", "par_num", "line_num", "line"))), lambda x: x.line).alias("all"),
        (F.sum("conf") / F.sum("n")).alias("mean"),
    ).withColumn("lines", evidence_lines(F.col("all")))
    letters = alnum_count(F.array_join("lines", ""))
    percent = F.round(F.least(F.greatest("mean", F.lit(0.0)), F.lit(100.0))).cast("int")
    return image.where((F.col("mean") >= least_mean) & (letters >= 2)).select(*keys, "lines", percent.alias("confidence_percent"))
