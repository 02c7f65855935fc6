"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from textsync.session import stage

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of one source and one size ranked by one task at most.
SPLIT = 20_000


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets per source: ``totals(source, source_size)`` -> ``(source, source_size, target)``.

    Sources in code-point order, null last, take ``weights`` in turn and divide ``share`` of the total
    size by weight. No target exceeds ``cap`` times its source's size; the excess is divided among the
    others by weight until none is above. That end state is a water level: a source is at its cap if
    cap / weight lies below the level. The level is found from running sums in the order of
    cap / weight, without iterating. One row a source goes through these two windows, not documents.
    """
    turn = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    t = totals.withColumn("_weight", weight).withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
    t = t.withColumn("_turn", turn).withColumn("_bound", F.col("_cap") / F.col("_weight"))
    order = W.orderBy("_bound", "_turn")
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("_weight").over(order.rowsBetween(0, W.unboundedFollowing))
    whole = F.sum("source_size").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    t = t.withColumn("_level", (F.lit(float(share)) * whole - before) / after)
    free = F.col("_level") <= F.col("_bound")
    level = F.min_by(F.when(free, F.col("_level")), F.when(free, F.struct("_bound", "_turn")))
    t = t.withColumn("_at", level.over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.when(F.col("_at").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_at") * F.col("_weight")))
    return t.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, size: Column | None = None, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix",
) -> DataFrame:
    """Add ``size, source_size, target, copies, taken`` to every row of ``docs(doc_id, source, text, ...)``.

    Systematic sampling: within its source every document expects target / source_size copies. A prefix
    sum of these plus one offset per source runs through the documents; a document is emitted once per
    whole number that the sum crosses while passing it. Documents are passed in the order of size, so the
    sampled words stay within about one document of the target. The offset is a hash of ``seed`` and the
    source: reruns agree.

    The prefix sum needs the rank of a document in its source, and one source may hold a third of all
    rows. Ranks come from counts per (source, size), prefix-summed over the distinct sizes, plus a rank
    inside (source, size, salt), where groups of more than ``SPLIT`` documents get several salts.

    Null text has size 0, a null source is a source of its own. Documents of size 0 keep their turn and
    take 0 words. Repeated rows are separate documents. Columns of the same names are replaced.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    size = word_count(F.col("text")) if size is None else size
    rated = docs.select(row.alias("_row"), F.col("source").alias("_source"), F.col("doc_id").alias("_id"), size.cast("long").alias("_size"))
    sizes = stage(rated.groupBy("_source", "_size").agg(F.count(F.lit(1)).alias("_n")))
    totals = sizes.groupBy(F.col("_source").alias("source")).agg(F.sum(F.col("_size") * F.col("_n")).alias("source_size"))
    targets = stage(source_targets(totals, weights, share, cap))
    running = W.partitionBy("_source").orderBy("_size").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0)))
    sizes = sizes.withColumn("_salts", F.ceil(F.col("_n") / SPLIT))
    big = stage(sizes)
    rated = _by_group(rated, big, ["_source", "_size"])
    rated = rated.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.col("_salts")))
    split = big.where("_salts > 1").select("_source", "_size")
    salts = _by_group(rated, split, ["_source", "_size"], "left_semi").groupBy("_source", "_size", "_salt").agg(F.count(F.lit(1)).alias("_m"))
    ahead = W.partitionBy("_source", "_size").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    salts = stage(salts.select("_source", "_size", "_salt", F.coalesce(F.sum("_m").over(ahead), F.lit(0)).alias("_ahead")))
    rated = _by_group(rated, salts, ["_source", "_size", "_salt"], "left")
    rated = _by_group(rated, targets.withColumnRenamed("source", "_source"), ["_source"])
    within = F.row_number().over(W.partitionBy("_source", "_size", "_salt").orderBy("_id"))
    rated = rated.withColumn("_rank", F.col("_before") + F.coalesce("_ahead", F.lit(0)) + within)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce("_source", F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(offset + F.col("_rank") * rate) - F.floor(offset + (F.col("_rank") - 1) * rate)
    copies = crossed.cast("int")
    new = {"size": F.col("_size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": copies, "taken": F.col("_size") * copies}
    kept = [F.col(f"_row.`{c}`") for c in docs.columns if c not in new]
    return rated.select(*kept, *[c.alias(n) for n, c in new.items()])


def _by_group(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join staged group figures to rows on keys that may be null. The groups' files tell the planner their
    size: below its threshold they are broadcast, beyond it hot keys are split by adaptive execution."""
    renamed = groups.select(*[F.col(c).alias(f"{c}__g" if c in keys else c) for c in groups.columns])
    on = [F.col(k).eqNullSafe(F.col(f"{k}__g")) for k in keys]
    return rows.join(renamed, on, how).drop(*[f"{k}__g" for k in keys])


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as :func:`mix` emits it, with the columns of ``docs``.

    Ids, sources and sizes alone are mixed, and the rows meet what was dealt to their id and a hash of the whole row, so that texts
    are moved once at most. What was dealt to equal rows is emitted from one of them."""
    keyed = docs.withColumn("_own", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    narrow = keyed.select("doc_id", "source", "_own", word_count(F.col("text")).alias("_words"))
    counted = mix(narrow, size=F.col("_words"), **options).groupBy(F.col("doc_id").alias("_id"), F.col("_own").alias("_hash"))
    dealt = stage(counted.agg(F.sum("copies").cast("int").alias("_copies"), F.count(F.lit(1)).alias("_rows")).where("_copies > 0"))
    held = lambda some: keyed.join(dealt.where(some), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")))
    found = held("_rows = 1")
    if not dealt.where("_rows > 1").isEmpty():
        found = found.unionByName(held("_rows > 1").dropDuplicates(["doc_id", "_own"]))
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(docs.columns)
