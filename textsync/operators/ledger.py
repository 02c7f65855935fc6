"""Fingerprints, incremental recompute and progress roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textsync.functions.text import idiv

# Stages in order, their labels and their weights in the overall percentage.
STAGES = ["prepare", "analyze", "align", "review_audio", "encode", "build_epub", "validate"]
LABELS = ["Prepare", "Analyze", "Align", "Review Audio", "Encode", "Build EPUB", "Validate"]
WEIGHTS = [5, 35, 25, 10, 8, 12, 5]

# Which inputs can change a stage, after the two sources that can change all of them.
_SPEECH = ["language", "model"]
_BOOK = ["encoding", "alignment_backend", "audio_backend"]
STAGE_INPUTS = {
    "prepare": [],
    "analyze": ["transcription_backend", *_SPEECH],
    "align": ["transcription_backend", "alignment_backend", *_SPEECH],
    "review_audio": ["transcription_backend", "alignment_backend", "ocr_backend", *_SPEECH, "policy"],
    "encode": _BOOK,
    "build_epub": [*_BOOK, "ocr_backend", "epub_backend"],
    "validate": [*_BOOK, "ocr_backend", "epub_backend"],
}
_LINES = {"policy": "review-policy:", "encoding": "audio-settings:"}


def stage_ord(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STAGES]), c) - 1


def file_fingerprints(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of binary files (path, length, content); empty sources are refused."""
    mark = F.concat(F.lit("sha256:"), F.sha2("content", 256))
    return (
        files.where("length > 0").select("path", mark.alias("fingerprint")),
        files.where("length = 0").select("path", F.lit("source_empty").alias("reason")),
    )


def fingerprints(df: DataFrame, keys: list[str]) -> DataFrame:
    """Fingerprint of each row of a table."""
    body = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return df.select(*keys, F.concat(F.lit("sha256:"), F.sha2(body, 256)).alias("fingerprint"))


def stage_fingerprints(inputs: DataFrame) -> DataFrame:
    """(book_id, stage, fingerprint): a hash over exactly the inputs that can change the stage."""

    value = lambda field: F.coalesce(F.col(field), F.lit("\u0000null"))  # an unknown input is a value of its own

    def payload(stage: str, label: str) -> Column:
        parts = [F.lit(f"stage:{label}\nepub:"), value("epub_source"), F.lit("\naudio:"), value("audiobook_source"), F.lit("\n")]
        for field in STAGE_INPUTS[stage]:
            lead = _LINES.get(field)
            parts += [F.lit(lead), value(field), F.lit("\n")] if lead else [value(field)]
        return F.concat(F.lit("sha256:"), F.sha2(F.concat(*parts), 256))

    rows = F.array(*[
        F.struct(F.lit(s).alias("stage"), payload(s, l).alias("fingerprint")) for s, l in zip(STAGES, LABELS)
    ])
    return inputs.select("book_id", F.explode(rows).alias("r")).select("book_id", "r.stage", "r.fingerprint")


def recompute_plan(ledger: DataFrame, current: DataFrame) -> DataFrame:
    """(book_id, stage, reuse): stages are reusable in order up to the first that changed or is missing."""
    saved = ledger.select("book_id", "stage", F.col("fingerprint").alias("saved"))
    rows = current.join(saved, ["book_id", "stage"], "left").withColumn("ord", stage_ord(F.col("stage")))
    stale = F.when(F.coalesce(F.col("saved") != F.col("fingerprint"), F.lit(True)), F.col("ord"))
    first = rows.groupBy("book_id").agg(F.min(stale).alias("first_stale"))
    return rows.join(first, "book_id").select(
        "book_id", "stage", (F.col("ord") < F.coalesce("first_stale", F.lit(len(STAGES)))).alias("reuse")
    )


def artifact_diff(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """Artifacts that are missing, changed or not sealed (book_id, stage, path, change)."""
    keys = ["book_id", "stage", "path"]
    old = manifest.select(*keys, F.col("bytes").alias("old_bytes"), F.col("sha256").alias("old_hash"))
    new = current.select(*keys, F.col("bytes").alias("new_bytes"), F.col("sha256").alias("new_hash"))
    change = (
        F.when(F.col("new_hash").isNull(), "missing")
        .when(F.col("old_hash").isNull(), "unsealed")
        .when((F.col("old_bytes") != F.col("new_bytes")) | (F.col("old_hash") != F.col("new_hash")), "changed")
    )
    return old.join(new, keys, "full").select(*keys, change.alias("change")).where("change is not null")


def reusable_prefix(plan: DataFrame, diff: DataFrame) -> DataFrame:
    """Recompute plan after the artifact check: a bad artifact ends the prefix at its stage, and the last
    stage is always checked again."""
    bad = diff.where("change <> 'unsealed'").groupBy("book_id").agg(F.min(stage_ord(F.col("stage"))).alias("bad"))
    keep = F.col("reuse") & (stage_ord(F.col("stage")) < F.coalesce("bad", F.lit(len(STAGES) - 1)))
    keep = keep & (F.col("stage") != STAGES[-1])
    return plan.join(bad, "book_id", "left").select("book_id", "stage", keep.alias("reuse"))


def run_progress(runs: DataFrame) -> DataFrame:
    """Weighted overall percentage of each book from (book_id, stage, status, percent)."""
    weights = F.create_map(*[x for s, w in zip(STAGES, WEIGHTS) for x in (F.lit(s), F.lit(w))])
    done = (
        F.when(F.col("status").isin("completed", "cached", "skipped"), F.lit(100))
        .when(F.col("status").isin("running", "failed"), F.col("percent")).otherwise(F.lit(0))
    )
    total = F.sum(weights[F.col("stage")] * done)
    return runs.groupBy("book_id").agg(F.least(idiv(total.cast("bigint"), 100), F.lit(100)).cast("int").alias("percent"))


def chunk_progress(chunks: DataFrame) -> DataFrame:
    """Progress by audio time from (book_id, start_ms, end_ms, done)."""
    span = F.col("end_ms") - F.col("start_ms")
    return chunks.groupBy("book_id").agg(
        F.count(F.when(F.col("done"), 1)).alias("completed_chunks"),
        F.count("*").alias("total_chunks"),
        F.least(idiv(F.sum(F.when(F.col("done"), span).otherwise(0)) * 100, F.greatest(F.sum(span), F.lit(1))), F.lit(100)).cast("int").alias("percent"),
    )
