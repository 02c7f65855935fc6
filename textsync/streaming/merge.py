"""Chunk results arriving in any order → the in-order timeline of each book, as a stream."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textsync.operators.align import align_segments
from textsync.session import stage
from textsync.sources.sinks import exists

OUT = "book_id bigint, seg bigint, chunk_idx bigint, start_ms bigint, end_ms bigint, text string, status string"
BUCKETS = 64
STATE = "next_chunk bigint, next_seg bigint, last_end bigint, waiting string, failed boolean"


def chunk_results(chunks: DataFrame, plans: DataFrame) -> DataFrame:
    """Attach plan data to results (book_id, chunk_idx, ok, segments ARRAY<STRUCT<start_ms, end_ms, text>>). Results
    of chunks that no plan has keep a null offset; the merge reports them as ``unplanned``."""
    counts = plans.groupBy("book_id").agg(F.count("*").alias("n_chunks"))
    plan = plans.select("book_id", "chunk_idx", F.col("start_ms").alias("offset"), (F.col("end_ms") - F.col("start_ms")).alias("span"))
    joined = chunks.join(plan, ["book_id", "chunk_idx"], "left").join(counts, "book_id", "left")
    return joined.select(
        "book_id", "chunk_idx", "offset", "span", "n_chunks", "ok", F.to_json("segments").alias("segments")
    )


def _merge(timeout_ms: int | None):
    def merge(key, batches, state: GroupState):
        columns = [part.split()[0] for part in OUT.split(", ")]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], None, None, None, None, None, "abandoned")], columns=columns)
            return
        at, seg, last, waiting, failed = state.get if state.exists else (0, 0, 0, "{}", False)
        held, total, rows = json.loads(waiting), None, []
        for batch in batches:
            for r in batch.itertuples(index=False):
                if pd.isna(r.offset):
                    rows.append((key[0], None, int(r.chunk_idx), None, None, None, "unplanned"))
                    continue
                total = int(r.n_chunks)
                if int(r.chunk_idx) >= at and str(r.chunk_idx) not in held:
                    held[str(r.chunk_idx)] = [int(r.offset), int(r.span), bool(r.ok), r.segments, total]
        while not failed and str(at) in held:
            offset, span, ok, segments, total = held.pop(str(at))
            for s in json.loads(segments or "[]") if ok else []:
                start, end = offset + s["start_ms"], offset + s["end_ms"]
                if s["end_ms"] > span or (seg and start < last):
                    ok = False
                    break
                rows.append((key[0], seg, at, start, end, s["text"], "segment"))
                seg, last = seg + 1, end
            if not ok:
                failed = True
                rows.append((key[0], None, at, None, None, None, "failed"))
            at += 1
        if failed or (total is not None and at >= total):
            if not failed:
                rows.append((key[0], None, None, None, last, None, "complete"))
            held = {}
        state.update((at, seg, last, json.dumps(held), failed))
        done = failed or (total is not None and at >= total)
        if not done and timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        if rows:
            whole = ("seg", "chunk_idx", "start_ms", "end_ms")
            yield pd.DataFrame({c: pd.array(values, "Int64") if c in whole else list(values) for c, values in zip(columns, zip(*rows))})

    return merge


def stream_merge_chunks(chunk_stream: DataFrame, plans: DataFrame, timeout_ms: int | None = 24 * 3600 * 1000) -> DataFrame:
    """Emit each book's contiguous prefix of chunks as soon as it is there.

    State per book: next chunk, next segment number, last end, and results still waiting for an earlier
    one. A repeated chunk is ignored, a failed one fails its book only, and a book that never completes is
    reported as ``abandoned`` by a processing-time timer and not as complete. A ``complete`` row closes a book.
    Give ``timeout_ms=None`` for a bounded run (``availableNow``), which a timer would keep open.
    """
    rows = chunk_results(chunk_stream, plans)
    timer = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy("book_id").applyInPandasWithState(_merge(timeout_ms), OUT, STATE, "append", timer)


def book_fingerprints(segments: DataFrame, sections: DataFrame) -> DataFrame:
    """(book_id, fingerprint): what the alignment of a book depends on, whatever order its rows are in."""
    parts = segments.select("book_id", F.xxhash64(F.lit("segment"), "seg", "start_ms", "end_ms", "text").alias("part")).unionByName(
        sections.select("book_id", F.xxhash64(F.lit("section"), "section_ord", "href", "text").alias("part"))
    )
    total = F.sum(F.col("part").cast("decimal(38,0)")).cast("string")
    return parts.groupBy("book_id").agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), total), 256).alias("fingerprint"))


def stream_align(merged: DataFrame, sections: DataFrame, segments_path: str, alignment_path: str, ledger_path: str, checkpoint: str):
    """Write merged segments as they come, in buckets of books, and align each book in the batch that completes
    it. Only the buckets of finished books are read again.

    The ledger (book_id, fingerprint), one folder an epoch, is written after the alignment it stands for. A book whose fingerprint
    it has is not aligned again: a replayed epoch and an unchanged book do nothing, and an epoch that died before its ledger was written
    replaces what it had left. Of a book with several entries the alignment of the latest epoch counts."""
    spark, bucket = sections.sparkSession, F.pmod(F.hash("book_id"), F.lit(BUCKETS)).cast("int")

    def each(batch: DataFrame, epoch: int) -> None:
        batch = stage(batch)
        placed = batch.where("status = 'segment'").drop("status").withColumn("bucket", bucket)
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{segments_path}/epoch={epoch}")
        finished = batch.where("status = 'complete'").select("book_id").distinct()
        if finished.isEmpty():
            return
        wanted = [r.bucket for r in finished.select(bucket.alias("bucket")).distinct().collect()]  # BUCKETS values at most
        schema = ", ".join([*OUT.split(", ")[:-1], "epoch bigint", "bucket int"])
        known = spark.read.schema(schema).parquet(segments_path).where(F.col("bucket").isin(wanted))
        ready = stage(known.join(finished, "book_id", "left_semi").select("book_id", "seg", "start_ms", "end_ms", "text"))
        books = stage(sections.join(finished, "book_id", "left_semi"))
        due = prints = stage(book_fingerprints(ready, books))
        if exists(spark, ledger_path):
            held = spark.read.schema("book_id bigint, fingerprint string, epoch bigint").parquet(ledger_path)
            due = stage(prints.join(held.select("book_id", "fingerprint").distinct(), ["book_id", "fingerprint"], "left_anti"))
        number = due.count()
        if not number:
            return
        if number < prints.count():  # else texts stay where they are
            fresh = lambda rows: stage(rows.join(due.select("book_id"), "book_id", "left_semi"))
            ready, books = fresh(ready), fresh(books)
        align_segments(ready, books).write.mode("overwrite").parquet(f"{alignment_path}/epoch={epoch}")
        due.write.mode("overwrite").parquet(f"{ledger_path}/epoch={epoch}")

    query = merged.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append")
    query.each = each  # the batch function, to replay an epoch
    return query
