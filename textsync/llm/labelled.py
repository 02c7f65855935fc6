"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from textsync.session import stage


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept for testing: crc32 of its id as text, modulo 4, is 2. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def labelled_texts(docs: DataFrame, labels: DataFrame, per_label: int, longest: int, most_labels: int = 200) -> list[tuple[str, object]]:
    """Texts and labels to learn from, on the driver: at most ``per_label`` documents a label, of at most
    ``longest`` characters, for the ``most_labels`` most frequent labels.

    ``labels(doc_id, label)`` names the label of some documents; held-out documents are never taken. The
    choice is by a hash of the id, the same in every run. Ids are chosen first: at most
    ``per_label * most_labels`` of them, so the join with the texts broadcasts a table of proven size.
    """
    known = labels.where(~held_out(F.col("doc_id"))).where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    order = W.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    frequent = known.groupBy("label").count().orderBy(F.desc("count"), "label").limit(most_labels).select("label")
    chosen = known.join(F.broadcast(frequent), "label").withColumn("_turn", F.row_number().over(order)).where(f"_turn <= {int(per_label)}")
    chosen = stage(chosen.select("doc_id", "label"))
    texts = docs.where(f"text IS NOT NULL AND length(text) <= {int(longest)}").select("doc_id", "text")
    rows = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).collect()
    return [(r["text"], r["label"]) for r in sorted(rows, key=lambda r: r["doc_id"])]
