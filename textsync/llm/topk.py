"""Exact top-k search by tiled matrix products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textsync.session import stage

#: Queries and candidates of one tile; rows of a tile multiplied at once; lists merged by one task.
QUERIES, SHARD, ROWS, FAN = 2048, 4096, 256, 8
LISTS = "block int, shard int, query_id long, scores array<long>, ids array<long>"


def quantised(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component, x as double; null for vectors with a null or non-finite component."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(sound, F.transform(wide, lambda x: F.floor(F.lit(scale) * x).cast("long")))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of int64; shorter ones are filled with zeros, which add nothing to a product."""
    column = column.combine_chunks()
    length = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(length), width), np.int64)
    out[np.arange(width) < length[:, None]] = np.asarray(column.flatten(), np.int64)
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of one list, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _lists(block: int, shard: int, queries: list, scores: list, ids: list) -> pa.Table:
    kind = pa.list_(pa.int64())
    return pa.table({
        "block": pa.array([block] * len(queries), pa.int32()), "shard": pa.array([shard] * len(queries), pa.int32()),
        "query_id": pa.array(queries, pa.int64()), "scores": pa.array(scores, kind), "ids": pa.array(ids, kind),
    })


def _tile(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return _lists(0, 0, [], [], [])
        width = max(int(np.diff(np.asarray(v.combine_chunks().offsets)).max()) for v in (queries["v"], rows["row_v"]))
        q, c = _matrix(queries["v"], width), _matrix(rows["row_v"], width)
        bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * width
        if bound < 2.0**53:  # exact in floating point, where the product is fast
            q, c = q.astype(np.float64), c.astype(np.float64)
        qid, cid = np.asarray(queries["id"]), np.asarray(rows["row_id"])
        shown, scores, ids = [], [], []
        for at in range(0, len(q), ROWS):
            product = (q[at : at + ROWS] @ c.T).astype(np.int64)
            for i, line in enumerate(product):
                own = cid != qid[at + i]
                best = _best(line[own], cid[own], k) if not own.all() else _best(line, cid, k)
                kept = np.flatnonzero(own)[best] if not own.all() else best
                shown.append(qid[at + i])
                scores.append(line[kept])
                ids.append(cid[kept])
        return _lists(queries["block"][0].as_py(), rows["row_shard"][0].as_py(), shown, scores, ids)

    return run


def _merge(k: int):
    def run(lists: pa.Table) -> pa.Table:
        query = np.asarray(lists["query_id"])
        parts_s, parts_i = lists["scores"].combine_chunks(), lists["ids"].combine_chunks()
        length = np.diff(np.asarray(parts_s.offsets))
        flat_q, flat_s, flat_i = np.repeat(query, length), np.asarray(parts_s.flatten()), np.asarray(parts_i.flatten())
        order = np.lexsort((flat_i, -flat_s, flat_q))
        flat_q, flat_s, flat_i = flat_q[order], flat_s[order], flat_i[order]
        names = np.unique(query)
        begin, end = np.searchsorted(flat_q, names), np.searchsorted(flat_q, names, "right")
        cut = np.minimum(end, begin + k)
        return _lists(
            lists["block"][0].as_py(), lists["shard"][0].as_py() // FAN, names,
            [flat_s[a:b] for a, b in zip(begin, cut)], [flat_i[a:b] for a, b in zip(begin, cut)],
        )

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` highest integer inner products of each query: ``(query_id, rank, vec_id, score)``.

    ``vectors`` and ``queries`` hold ``(id long, v array<long>)``. Both are cut in blocks by a hash of the
    id; a tile is one block of queries against one shard of rows, multiplied in one task, which keeps the
    top list of each query. Lists of a block are then merged ``FAN`` shards at a time, level by level, so no
    task sees more than ``FAN`` lists a query. Nothing is broadcast. A tile's memory is bounded by
    ``QUERIES``, ``SHARD`` and the width.

    Rows with a null id or vector take no part. A query never meets rows of its own id. Ties go to the
    smaller id; repeated rows count each; fewer rows than ``k`` give fewer ranks; an empty table gives none.
    Vectors of unequal length are compared as if filled with zeros. Products beyond 64 bits wrap around.
    """
    vectors = vectors.where("id IS NOT NULL AND v IS NOT NULL").select("id", "v")
    queries = queries.where("id IS NOT NULL AND v IS NOT NULL").select("id", "v")
    blocks = -(-max(queries.count(), 1) // QUERIES)
    shards = -(-max(vectors.count(), 1) // SHARD)

    def part(n: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    q = queries.withColumn("block", part(blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # new names for all columns of one side: two sides of one origin share attributes, and the planner prunes those of one
    c = vectors.select(F.col("id").alias("row_id"), F.col("v").alias("row_v"), part(shards).alias("row_shard"))
    c = c.withColumn("row_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    lists = q.groupBy("block", "shard").cogroup(c.groupBy("row_block", "row_shard")).applyInArrow(_tile(k), LISTS)
    while shards > 1:
        lists = lists.groupBy("block", F.expr(f"shard div {FAN}")).applyInArrow(_merge(k), LISTS)
        shards = -(-shards // FAN)
    lists = stage(lists)
    ranked = lists.select("query_id", F.posexplode(F.arrays_zip("scores", "ids")).alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score"))
