"""Archive scans and package documents."""

from __future__ import annotations

import io
import zipfile
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textsync.functions.markup import ATTRS, PREFIX, markup_to_text, tag_attr
from textsync.functions.paths import parent_path, resolve_href
from textsync.functions.text import parse_clock, trim_space
from textsync.operators.overlay import reading_order
from textsync.operators.timeline import violations

# Bytes allowed per container, package and page entry, and of text per book.
MIB = 1024 * 1024
CONTAINER_BYTES, PACKAGE_BYTES, PAGE_BYTES, BOOK_BYTES = MIB, 8 * MIB, 32 * MIB, 128 * MIB

ENTRIES = (
    "archive string, entry_ord int, path string, bytes binary, size bigint, stored boolean, "
    "is_dir boolean, oversize boolean, error string"
)


def _read_entries(batches):
    columns = [part.split()[0] for part in ENTRIES.split(", ")]
    for batch in batches:
        for archive, content in zip(batch["path"], batch["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for i, info in enumerate(z.infolist()):
                        big = info.file_size > PAGE_BYTES
                        body = None if big or info.is_dir() else z.read(info)
                        row = (archive, i, info.filename, body, info.file_size,
                               info.compress_type == zipfile.ZIP_STORED, info.is_dir(), big, None)
                        yield pd.DataFrame([row], columns=columns)
            except (zipfile.BadZipFile, RuntimeError, NotImplementedError) as broken:
                row = (archive, 0, "", None, 0, False, False, False, str(broken))
                yield pd.DataFrame([row], columns=columns)


def scan_archives(spark: SparkSession, path: str, max_bytes: int = 1 << 30) -> DataFrame:
    """Entries of every zip archive under ``path``, one task per file. Archives over ``max_bytes`` are
    skipped by their length, before their content is read; list them with ``audit_archive_sizes``."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= max_bytes)
    return entries_of(files)


def entries_of(files: DataFrame) -> DataFrame:
    """Entries of the archives in ``files(path, content)``; an archive that cannot be read is one row with its error."""
    return files.select("path", "content").mapInPandas(_read_entries, ENTRIES)


def audit_archive_sizes(spark: SparkSession, path: str, max_bytes: int = 1 << 30) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.where(F.col("length") > max_bytes).select(F.col("path").alias("entity"), F.lit("archive_large").alias("rule"))


def _tags(xml: Column, name: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<{PREFIX}{name}\b{ATTRS}>"), F.lit(0))


def _body(xml: Column, name: str) -> Column:
    return F.regexp_extract(xml, rf"(?s)<{PREFIX}{name}\b{ATTRS}>(.*?)</{PREFIX}{name}\s*>", 1)


def package_paths(entries: DataFrame) -> DataFrame:
    """(book_id, package_path) named by the container document of each archive."""
    container = entries.where((F.col("path") == "META-INF/container.xml") & (F.col("size") <= CONTAINER_BYTES))
    root = F.get(F.filter(_tags(F.col("bytes").cast("string"), "rootfile"), lambda t: tag_attr(t, "full-path").isNotNull()), F.lit(0))
    return container.select("book_id", tag_attr(root, "full-path").alias("package_path")).where("package_path is not null")


def read_packages(packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(book_id, package_path, xml) → manifest and spine tables. Items without id or href are skipped;
    of two items with one id the later counts, as it does for the reader of a package."""
    clean = F.regexp_replace("xml", r"(?s)<!--.*?-->", "")
    base = packages.withColumns({"m": _body(clean, "manifest"), "s": _body(clean, "spine"), "dir": parent_path(F.col("package_path"))})
    items = base.select("book_id", "dir", F.posexplode(_tags(F.col("m"), "item")).alias("pos", "tag"))
    attr = lambda n: tag_attr(F.col("tag"), n)
    manifest = items.select(
        "book_id", "pos", attr("id").alias("id"), attr("href").alias("raw"), attr("media-type").alias("media_type"),
        attr("properties").alias("properties"), attr("media-overlay").alias("media_overlay"), "dir",
    ).where("id is not null and raw is not null")
    manifest = manifest.withColumn("href", resolve_href(F.col("dir"), F.col("raw"))["path"])
    cells = F.struct("href", "media_type", "properties", "media_overlay")
    manifest = manifest.groupBy("book_id", "id").agg(F.max_by(cells, "pos").alias("c")).select("book_id", "id", "c.*")
    refs = base.select("book_id", F.posexplode(_tags(F.col("s"), "itemref")).alias("spine_ord", "tag"))
    spine = refs.select("book_id", "spine_ord", attr("idref").alias("idref"), attr("linear").alias("linear")).where("idref is not null")
    return manifest, spine


def package_durations(packages: DataFrame) -> DataFrame:
    """Declared durations (book_id, refines, duration_ms); null ``refines`` for the total."""
    metas = F.regexp_extract_all("xml", F.lit(rf"(?s)<{PREFIX}meta\b{ATTRS}>[^<]*"), F.lit(0))
    rows = packages.select("book_id", F.explode(metas).alias("piece"))
    tag = F.regexp_extract("piece", f"(?s)^<{ATTRS}>", 0)
    rows = rows.where(tag_attr(tag, "property") == "media:duration")
    return rows.select(
        "book_id", F.regexp_replace(tag_attr(tag, "refines"), "^#+", "").alias("refines"),
        parse_clock(trim_space(F.regexp_extract("piece", r"(?s)>([^<]*)$", 1))).alias("duration_ms"),
    )


def extract_corpus(pages: DataFrame) -> DataFrame:
    """Marked-up pages (book_id, section_ord, href, html) → sections; pages without text are left out
    and the rest keep their order."""
    return pages.select("book_id", "section_ord", "href", markup_to_text(F.col("html")).alias("text")).where("text <> ''")


def corpus_of_archives(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of many archives → sections of their reading order, and what is wrong with them: books that cannot be opened,
    lack a container or package document or have one over its limit, miss pages, or are too large."""
    roots = package_paths(entries).groupBy("book_id").agg(F.min("package_path").alias("package_path"))
    container = F.when(F.col("path") == "META-INF/container.xml", F.col("size"))
    books = entries.groupBy("book_id").agg(F.max("error").alias("error"), F.max(container).alias("container"))
    sizes = entries.select("book_id", F.col("path").alias("package_path"), F.col("size").alias("package"))
    books = books.join(roots, "book_id", "left").join(sizes, ["book_id", "package_path"], "left")
    opened, small = F.col("error").isNull(), F.coalesce(F.col("container") <= CONTAINER_BYTES, F.lit(False))
    unopened = violations(
        books, F.coalesce("package_path", F.lit("")),
        archive_broken=~opened,
        container_missing=opened & F.col("container").isNull(),
        container_large=F.col("container") > CONTAINER_BYTES,
        package_missing=small & F.col("package").isNull(),
        package_large=F.col("package") > PACKAGE_BYTES,
    )
    packages = roots.join(entries.withColumnRenamed("path", "package_path"), ["book_id", "package_path"]).where(
        F.col("size") <= PACKAGE_BYTES
    ).select("book_id", "package_path", F.col("bytes").cast("string").alias("xml"))
    manifest, spine = read_packages(packages)
    pages, broken = reading_order(spine, manifest)
    bodies = entries.select("book_id", F.col("path").alias("href"), F.col("bytes").cast("string").alias("html"), "size")
    found = pages.join(bodies, ["book_id", "href"], "left")
    sections = extract_corpus(found.where("html is not null"))
    size = sections.groupBy("book_id").agg(F.sum(F.octet_length("text")).alias("n"))
    rules = [
        broken,
        violations(found, F.col("href"), page_missing=F.col("html").isNull() & F.col("size").isNull(), page_large=F.col("size") > PAGE_BYTES),
        violations(size, F.col("n"), corpus_large=F.col("n") > BOOK_BYTES),
        unopened,
    ]
    return sections, reduce(DataFrame.unionByName, rules)
