"""Queries through files: books packed into archives and read back, documents written and published."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsync.functions.text import idiv
from textsync.plans import fixtures as fx
from textsync.session import new_folder, stage
from textsync.sources import archives, sinks
from textsync.streaming import merge

PAGE = "application/xhtml+xml"


def _pack(frames):
    """One archive a book: a navigation page, the pages of the book, some left out, some packages without a part."""
    for frame in frames:
        rows = []
        for book, pages in zip(frame["book_id"], frame["pages"]):
            body, kind = io.BytesIO(), book % 13
            with zipfile.ZipFile(body, "w") as z:
                z.writestr("mimetype", "application/epub+zip")
                if kind != 1:
                    root = "" if kind == 2 else '<rootfile full-path="OPS/book.opf"/>'
                    z.writestr("META-INF/container.xml", f"<container><rootfiles>{root}</rootfiles></container>")
                items = "".join(f'<item id="p{p["page_id"]}" href="p{p["page_id"]}.xhtml" media-type="{PAGE}"/>' for p in pages)
                refs = "".join(f'<itemref idref="p{p["page_id"]}"{" linear=" + chr(34) + "no" + chr(34) if p["page_id"] % 9 == 4 else ""}/>' for p in pages)
                lost = '<itemref idref="lost"/>' if book % 6 == 2 else ""
                if kind != 3:
                    z.writestr("OPS/book.opf", f'<package><manifest><item id="nav" href="nav.xhtml" media-type="{PAGE}" properties="nav"/>{items}</manifest><spine><itemref idref="nav"/>{refs}{lost}</spine></package>')
                z.writestr("OPS/nav.xhtml", "<p>contents</p>")
                for p in pages:
                    if p["page_id"] % 11 != 3:
                        z.writestr(f'OPS/p{p["page_id"]}.xhtml', p["html"] or "")
            rows.append((f"book-{book}", b"no archive" if kind == 4 else body.getvalue()))
        yield pd.DataFrame(rows, columns=["path", "content"])


def archive_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Five consecutive pages make a book; it is packed, read back, and its text or what is wrong with it returned."""
    pages = fx.table(spark, d, "pages").select(idiv(F.col("page_id"), 5).alias("book_id"), F.struct("page_id", "html").alias("page"))
    books = pages.groupBy("book_id").agg(F.array_sort(F.collect_list("page")).alias("pages"))
    files = books.mapInPandas(_pack, "path string, content binary")
    entries = stage(archives.entries_of(files).withColumn("book_id", F.substring("archive", 6, 20).cast("bigint")))
    sections, broken = archives.corpus_of_archives(entries)
    said = sections.select("book_id", F.lit("section").alias("rule"), F.concat_ws(" ", F.col("section_ord").cast("string"), "href", F.sha2("text", 256)).alias("entity"))
    return said.unionByName(broken.select("book_id", "rule", F.col("entity").cast("string").alias("entity")))


def documents_written(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each book as JSON in parts of two sections."""
    rows = fx.sections(spark, d).select("book_id", "section_ord", "href", F.length("text").alias("n"))
    return sinks.book_documents(rows, ["section_ord"], rows_per_part=2).select("book_id", "part", F.sha2("json", 256).alias("digest"))


def documents_published(spark: SparkSession, d: str) -> DataFrame:
    """A table published, published once more, and read back from where it was put."""
    rows = fx.table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    place = new_folder(spark, "publication")
    first = sinks.publish_table(rows, f"{place}/table", f"{place}/intents")
    again = sinks.publish_table(rows.repartition(3), f"{place}/table", f"{place}/intents")
    back = sinks.content_digest(spark.read.parquet(f"{place}/table"))
    return first.select("rows", "digest").unionByName(again.select("rows", "digest")).unionByName(back)


def stream_alignment(spark: SparkSession, d: str) -> DataFrame:
    """The reading of every book as a file stream of chunk results, merged in order, aligned when complete; the last epoch is
    replayed, which the ledger stops."""
    segments = stage(fx.segments(spark, d)).withColumn("chunk_idx", idiv(F.col("seg"), 50))
    plans = stage(segments.groupBy("book_id", "chunk_idx").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")))
    placed = segments.join(plans.select("book_id", "chunk_idx", F.col("start_ms").alias("zero")), ["book_id", "chunk_idx"])
    one = F.struct("seg", (F.col("start_ms") - F.col("zero")).alias("start_ms"), (F.col("end_ms") - F.col("zero")).alias("end_ms"), "text")
    results = placed.groupBy("book_id", "chunk_idx").agg(F.array_sort(F.collect_list(one)).alias("rows")).select(
        "book_id", "chunk_idx", F.lit(True).alias("ok"), F.col("rows").cast("array<struct<seg:bigint,start_ms:bigint,end_ms:bigint,text:string>>").alias("rows")
    )
    results = results.withColumn("segments", F.transform("rows", lambda r: F.struct(r["start_ms"].alias("start_ms"), r["end_ms"].alias("end_ms"), r["text"].alias("text")))).drop("rows")
    place = new_folder(spark, "stream")
    results.repartition(6, "chunk_idx").write.parquet(f"{place}/in")
    kind = "book_id bigint, chunk_idx bigint, ok boolean, segments array<struct<start_ms:bigint,end_ms:bigint,text:string>>"
    chunks = spark.readStream.schema(kind).option("maxFilesPerTrigger", 3).parquet(f"{place}/in")
    merged = merge.stream_merge_chunks(chunks, plans, timeout_ms=None)
    writer = merge.stream_align(merged, fx.sections(spark, d), f"{place}/segments", f"{place}/alignment", f"{place}/ledger", f"{place}/state")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.read.parquet(f"{place}/ledger").agg(F.max("epoch").alias("epoch")).first()["epoch"]
    books = spark.read.parquet(f"{place}/ledger").where(F.col("epoch") == last).select("book_id").distinct()
    ended = books.select("book_id", *[F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in merge.OUT.split(", ")[1:-1])], F.lit("complete").alias("status"))
    writer.each(ended, last + 1)  # the same books, unchanged, in another epoch
    found = spark.read.parquet(f"{place}/alignment")
    return found.select("book_id", "seg", "status", F.round("match_percent", 6).alias("match_percent"))


QUERIES = {f.__name__: f for f in (archive_corpus, documents_written, documents_published, stream_alignment)}
