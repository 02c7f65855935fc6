"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsync.session import stage


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over each batch of links: every node with the smallest node it is joined to."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(up, up)
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        roots = [find(x) for x in nodes]
        apart = [i for i, (x, r) in enumerate(zip(nodes, roots)) if x != r]
        yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in apart], pa.int64()), pa.array([roots[i] for i in apart], pa.int64())], ["u", "v"])


#: Narrow rows that one task handles; fewer tasks follow a shuffle if there are not enough rows for more.
ROWS = 50_000


def fitted(df: DataFrame, rows: int, each: int = ROWS) -> DataFrame:
    """``df`` in no more partitions than ``rows`` rows fill. Shuffle partitions are merged, nothing is moved."""
    return df.coalesce(max(1, -(-rows // each)))


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(node, component)`` for every node with a link; the component is its smallest node.

    Union-find inside batches first shrinks the links to a forest. Then all nodes join a star round by
    round: a node's larger neighbours move to its smallest neighbour, then its smaller neighbours do. The
    number of rounds grows with the logarithm of the graph. A node with very many neighbours is only ever
    the skewed side of a join with one row a node, which adaptive execution splits; nothing is collected
    but a count and a checksum a round. Null ends and loops are left out.
    """
    clean = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    edges = stage(clean.mapInArrow(forest, "u long, v long"))
    rows = edges.count()
    edges = stage(fitted(edges.distinct(), rows))
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = fitted(both.groupBy("u").agg(F.min("v").alias("m")), rows).select("u", F.least("u", "m").alias("m"))
        # an edge may come twice: both ends are in order, so the next distinct sorts it out
        large = stage(fitted(both.where("v > u").join(least, "u"), rows).select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = stage(fitted(large.groupBy("u").agg(F.min("v").alias("m")), rows))
        moved = fitted(large.join(least, "u"), rows).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(fitted(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), rows))
        before, state = state, _state(edges)
        if state == before:
            break
    roots = fitted(edges.select(F.col("v").alias("node")).distinct(), rows).withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
