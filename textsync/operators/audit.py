"""Audits of a finished book. Each returns rows (book_id, rule, entity); no rows means fit to publish."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsync.functions.markup import ATTRS, PREFIX, tag_attr
from textsync.functions.paths import parent_path, percent_decode, resolve_href
from textsync.functions.text import parse_clock
from textsync.operators.overlay import OVERLAY_TYPE, PAGE_TYPE
from textsync.operators.timeline import union_all, violations

MIMETYPE = "application/epub+zip"  # fixed value


def audit_archives(entries: DataFrame) -> DataFrame:
    """First entry is the stored mimetype with its exact value; names are unique; files are not empty."""
    first = F.col("entry_ord") == 0
    each = violations(
        entries, F.col("path"),
        first_name=first & (F.col("path") != "mimetype"),
        first_compressed=first & ~F.col("stored"),
        first_value=first & (F.coalesce(F.col("bytes").cast("string"), F.lit("")) != MIMETYPE),
        resource_empty=~F.col("is_dir") & (F.col("size") == 0),
        oversize=F.coalesce(F.col("oversize"), F.lit(False)),
    )
    twice = entries.groupBy("book_id", "path").count().where("count > 1")
    return each.unionByName(violations(twice, F.col("path"), name_repeated=F.lit(True)))


def audit_packages(manifest: DataFrame, declared: DataFrame, versions: DataFrame) -> DataFrame:
    """Unique item ids, one duration per overlay and one in total, version 3. ``declared`` (book_id,
    refines, duration_ms) with a null ``refines`` for the total; ``versions`` (book_id, version)."""
    ids = manifest.groupBy("book_id", "id").count().where("count > 1")
    refined = declared.where("refines is not null").groupBy("book_id", "refines").count().where("count > 1")
    totals = declared.groupBy("book_id").agg(F.count(F.when(F.col("refines").isNull(), 1)).alias("n"))
    books = versions.join(totals, "book_id", "left").join(
        manifest.groupBy("book_id").agg(F.count("*").alias("items")), "book_id", "left"
    )
    return union_all([
        violations(ids, F.col("id"), id_repeated=F.lit(True)),
        violations(refined, F.col("refines"), duration_repeated=F.lit(True)),
        violations(
            books, F.col("version"),
            version=~F.coalesce(F.col("version"), F.lit("")).rlike("^3(\\.|$)"),
            total_missing=F.coalesce("n", F.lit(0)) == 0,
            total_repeated=F.coalesce("n", F.lit(0)) > 1,
            manifest_empty=F.col("items").isNull(),
        ),
        violations(
            manifest, F.col("id"),
            item_incomplete=F.col("href").isNull() | F.col("media_type").isNull() | F.col("id").isNull(),
        ),
    ])


def audit_overlays(manifest: DataFrame, cue_counts: DataFrame) -> DataFrame:
    """Each synchronized page's overlay exists, is used once, has the right type and at least one cue;
    the book declares audio. ``cue_counts`` (book_id, overlay_id, cues)."""
    pages = manifest.where((F.col("media_type") == PAGE_TYPE) & F.col("media_overlay").isNotNull()).select(
        "book_id", F.col("id").alias("page"), F.col("media_overlay").alias("overlay_id")
    )
    items = manifest.select("book_id", F.col("id").alias("overlay_id"), F.col("media_type").alias("kind"))
    rows = pages.join(items, ["book_id", "overlay_id"], "left").join(cue_counts, ["book_id", "overlay_id"], "left")
    shared = pages.groupBy("book_id", "overlay_id").count().where("count > 1")
    books = manifest.groupBy("book_id").agg(
        F.count(F.when(F.col("media_type").startswith("audio/"), 1)).alias("audio"),
        F.count(F.when((F.col("media_type") == PAGE_TYPE) & F.col("media_overlay").isNotNull(), 1)).alias("synced"),
    )
    return union_all([
        violations(
            rows, F.col("overlay_id"),
            overlay_missing=F.col("kind").isNull(),
            overlay_type=F.col("kind") != OVERLAY_TYPE,
            overlay_without_cues=F.coalesce("cues", F.lit(0)) == 0,
        ),
        violations(shared, F.col("overlay_id"), overlay_shared=F.lit(True)),
        violations(books, F.col("book_id"), audio_missing=F.col("audio") == 0, no_synced_page=F.col("synced") == 0),
    ])


def audit_cues(cues: DataFrame, ids: DataFrame, audio: DataFrame | None = None) -> DataFrame:
    """Cues are complete, positive, and point to an id that exists in their own page and to declared
    audio. ``ids`` (book_id, section_ord, id); ``audio`` (book_id, audio_href)."""
    known = ids.select("book_id", "section_ord", F.col("id").alias("anchor")).distinct()
    dangling = cues.where("anchor is not null and anchor <> ''").join(known, ["book_id", "section_ord", "anchor"], "left_anti")
    found = [
        violations(
            cues, F.col("cue_id"),
            text_missing=F.coalesce("anchor", F.lit("")) == "",
            clip_missing=F.col("start_ms").isNull() | F.col("end_ms").isNull(),
            clip_range=F.col("end_ms") <= F.col("start_ms"),
        ),
        violations(dangling, F.col("cue_id"), fragment_missing=F.lit(True)),
    ]
    if audio is not None:
        silent = cues.join(audio.select("book_id", "audio_href").distinct(), ["book_id", "audio_href"], "left_anti")
        found.append(violations(silent, F.col("cue_id"), audio_undeclared=F.lit(True)))
    return union_all(found)


def overlay_elements(overlays: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Synchronised pairs and sequences of overlay documents ``(book_id, path, page_path, xml)``.

    Pairs: ``(…, nth, text_src, audio_src, clip_begin, clip_end, start_ms, end_ms, nested)``, where of several texts or audios in
    a pair the last counts; a pair that is never closed reaches the end. Sequences: ``(…, nth, textref)``."""
    keys = ["book_id", "path", "page_path"]
    clean = F.regexp_replace("xml", r"(?s)<!--.*?-->", "")
    tag = lambda name: rf"<{PREFIX}{name}\b{ATTRS}>"
    pair = rf"(?s){tag('par')}(?:(?!</{PREFIX}par\s*>).)*+(?:</{PREFIX}par\s*>|$)"
    pairs = overlays.select(*keys, F.posexplode(F.regexp_extract_all(clean, F.lit(pair), F.lit(0))).alias("nth", "par"))
    last = lambda name: F.try_element_at(F.regexp_extract_all("par", F.lit(f"(?s){tag(name)}"), F.lit(0)), F.lit(-1))
    pairs = pairs.withColumns({"text": last("text"), "audio": last("audio")})
    begin, end = (tag_attr(F.col("audio"), name) for name in ("clipBegin", "clipEnd"))
    pairs = pairs.select(
        *keys, "nth", tag_attr(F.col("text"), "src").alias("text_src"), tag_attr(F.col("audio"), "src").alias("audio_src"),
        begin.alias("clip_begin"), end.alias("clip_end"), parse_clock(begin).alias("start_ms"), parse_clock(end).alias("end_ms"),
        (F.size(F.regexp_extract_all("par", F.lit(tag("par")), F.lit(0))) > 1).alias("nested"), (~F.col("par").rlike(rf"</{PREFIX}par\s*>$")).alias("open"),
    )
    sequences = overlays.select(*keys, F.posexplode(F.regexp_extract_all(clean, F.lit(f"(?s){tag('seq')}"), F.lit(0))).alias("nth", "seq"))
    return pairs, sequences.select(*keys, "nth", tag_attr(F.col("seq"), "textref").alias("textref"))


def audit_overlay_documents(overlays: DataFrame, ids: DataFrame, audio: DataFrame) -> DataFrame:
    """Overlay documents ``(book_id, path, page_path, xml)`` against the ids of pages, ``ids(book_id, path, id)``, and the audio that
    packages declare, ``audio(book_id, path, size)``: every pair is whole and positive, its text is an existing id of the one page
    that the overlay belongs to, its audio is declared and not empty; every sequence refers to that page."""
    pairs, sequences = overlay_elements(overlays)
    folder = parent_path(F.col("path"))
    mark = lambda c: F.instr(c, "#") > 0
    fragment = lambda c: percent_decode(F.regexp_extract(c, "#(.*)$", 1))
    said = lambda kind: F.concat_ws(" ", "path", F.concat(F.lit(f"{kind} "), F.col("nth").cast("string")))
    targets = pairs.where("text_src IS NOT NULL").select("book_id", "path", "page_path", said("par").alias("entity"), F.col("text_src").alias("src")).unionByName(
        sequences.where("textref IS NOT NULL").select("book_id", "path", "page_path", said("seq").alias("entity"), F.col("textref").alias("src"))
    )
    targets = targets.withColumns({"target": resolve_href(folder, F.col("src"))["path"], "id": F.when(mark(F.col("src")), fragment("src"))})
    held = ids.select("book_id", F.col("path").alias("target"), "id", F.lit(True).alias("there")).distinct()
    targets = targets.join(held, ["book_id", "target", "id"], "left")
    here, blank = F.col("target").eqNullSafe(F.col("page_path")), F.trim(F.coalesce("id", F.lit(""))) == ""
    sounds = pairs.where("audio_src IS NOT NULL").withColumn("target", resolve_href(folder, F.col("audio_src"))["path"])
    declared = audio.groupBy("book_id", F.col("path").alias("target")).agg(F.max("size").alias("size"))
    sounds = sounds.join(declared, ["book_id", "target"], "left")
    of_par = F.col("entity").contains(" par ")
    return union_all([
        violations(
            pairs, said("par"),
            nested_pair=F.col("nested"), open_pair=F.col("open"), text_missing=F.col("text_src").isNull(), audio_missing=F.col("audio_src").isNull(),
            clip_begin_missing=F.col("clip_begin").isNull(), clip_end_missing=F.col("clip_end").isNull(),
            clock_invalid=(F.col("clip_begin").isNotNull() & F.col("start_ms").isNull()) | (F.col("clip_end").isNotNull() & F.col("end_ms").isNull()),
            clip_range=F.col("end_ms") <= F.col("start_ms"),
        ),
        violations(sequences, said("seq"), textref_missing=F.col("textref").isNull()),
        violations(
            targets, F.col("entity"),
            fragment_missing=of_par & ~mark(F.col("src")), target_other_page=~here, fragment_blank=here & mark(F.col("src")) & blank,
            target_missing=here & mark(F.col("src")) & ~blank & F.col("there").isNull(),
        ),
        violations(sounds, said("par"), audio_undeclared=F.col("size").isNull(), audio_empty=F.col("size") == 0),
    ])


def audit_source_packages(packages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Packages ``(book_id, package_path, xml)`` a synchronised book may be built from: version 3, metadata and manifest present, no
    overlay from an earlier build, and none of the pages to synchronise, ``wanted(book_id, href)``, tied to one."""
    clean = F.regexp_replace("xml", r"(?s)<!--.*?-->", "")
    tags = lambda name: F.regexp_extract_all(clean, F.lit(rf"(?s)<{PREFIX}{name}\b{ATTRS}>"), F.lit(0))
    attr = lambda t, name: tag_attr(t, name)
    rows = packages.select("book_id", "package_path", attr(F.get(tags("package"), F.lit(0)), "version").alias("version"), tags("manifest").alias("manifest"), tags("metadata").alias("metadata"), tags("item").alias("items"), tags("meta").alias("metas"))
    tied = lambda t: attr(t, "id").isNotNull() & ((F.coalesce(attr(t, "media-type"), F.lit("")) == OVERLAY_TYPE) | attr(t, "media-overlay").isNotNull())
    timed = lambda t: F.coalesce(attr(t, "property") == "media:duration", F.lit(False))
    items = rows.select("book_id", parent_path(F.col("package_path")).alias("dir"), F.explode("items").alias("t"))
    pages = items.where((attr(F.col("t"), "media-type") == PAGE_TYPE) & attr(F.col("t"), "id").isNotNull() & attr(F.col("t"), "media-overlay").isNotNull())
    pages = pages.select("book_id", resolve_href(F.col("dir"), attr(F.col("t"), "href"))["path"].alias("href")).distinct()
    return union_all([
        violations(
            rows, F.coalesce("version", F.lit("")),
            version_missing=F.col("version").isNull(), version_unsupported=~F.col("version").startswith("3"),
            manifest_missing=F.size("manifest") == 0, metadata_missing=F.size("metadata") == 0,
            earlier_overlay=F.exists("items", tied) | F.exists("metas", timed),
        ),
        violations(pages.join(wanted.select("book_id", "href").distinct(), ["book_id", "href"]), F.col("href"), page_overlaid=F.lit(True)),
    ])


def audit_ids(ids: DataFrame) -> DataFrame:
    """Ids used more than once in a page."""
    twice = ids.groupBy("book_id", "section_ord", "id").count().where("count > 1")
    return violations(twice, F.concat_ws("#", "section_ord", "id"), id_repeated=F.lit(True))


def audit_durations(declared: DataFrame, pages: DataFrame) -> DataFrame:
    """Declared page durations equal the sum of their clips, and the total the sum of all pages.
    ``declared`` (book_id, section_ord, duration_ms), null ``section_ord`` for the total."""
    each = declared.where("section_ord is not null").withColumnRenamed("duration_ms", "said").join(
        pages.select("book_id", "section_ord", F.col("duration_ms").alias("sum")), ["book_id", "section_ord"], "full"
    )
    total = declared.where("section_ord is null").select("book_id", F.col("duration_ms").alias("said")).join(
        pages.groupBy("book_id").agg(F.sum("duration_ms").alias("sum")), "book_id", "full"
    )
    return union_all([
        violations(
            each, F.col("section_ord"),
            duration_missing=F.col("said").isNull(),
            page_missing=F.col("sum").isNull(),
            duration_differs=F.col("said") != F.col("sum"),
        ),
        violations(total, F.col("book_id"), total_missing=F.col("said").isNull(), total_differs=F.col("said") != F.col("sum")),
    ])
