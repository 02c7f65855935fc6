"""Registered queries over the whole tables; each derives its digest columns from its operator's output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsync.llm import bpe, crosstok, labelled, language, mixing, nearcopies, oracle, pii, positional, quality, substrings, topk, toxicity, variants, warc
from textsync.session import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_strings(table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)


def op2_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_copies(table(spark, sf_dir, "documents"), words=2, percent=80)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = stage(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")))
    return mixing.mix(sized, size=F.col("size")).select("doc_id", "size", "source_size", "target", "taken")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = language.train(docs)
    told = language.identify(docs.select("doc_id", "text"), network)
    return told.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ordered = quality.plan(docs)
    judged = quality.cascade(docs, ordered, report=quality.REPORTED).drop("text")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select("doc_id", *quality.REPORTED, base.alias("base_failed"), (~base & F.col("rejected_by").isNull()).alias("kept"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    packages = stage(warc.write_packages(warc.with_references(pages), warc.package_folder(spark)))
    return warc.read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN).select("doc_id", "ids")
    return bpe.decode(ids, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = stage(pii.per_document(docs).select("doc_id", "spans"))
    base = F.filter("spans", lambda s: s["kind"] != pii.CONTEXT)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):  # a lambda of two arguments would get the place as its second
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    vectors = rows.select(F.col("vec_id").cast("long").alias("id"), topk.quantised(F.col("embedding")).alias("v"))
    return topk.top_k(vectors, vectors.where("id % 20 = 0"), k=20)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(variants.words(table(spark, sf_dir, "documents"), least_length=6, least_count=5, damaged=199), ratio=5)


def op12_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = positional.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), words=10)
    return told.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op13_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return crosstok.align(table(spark, sf_dir, "documents"), *files, public_tokenizers.PATTERN)


QUERIES = {
    "op1_repeated_strings": op1_repeated_strings,
    "op2_near_copies": op2_near_copies,
    "op3_mixing": op3_mixing,
    "op4_language": op4_language,
    "op5_quality": op5_quality,
    "op6_warc": op6_warc,
    "op7_bpe": op7_bpe,
    "op8_pii": op8_pii,
    "op9_toxicity": op9_toxicity,
    "op10_topk": op10_topk,
    "op11_spelling": op11_spelling,
    "op12_contamination": op12_contamination,
    "op13_token_links": op13_token_links,
}
ORACLE = oracle.ORACLE
