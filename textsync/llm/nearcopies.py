"""Near-copies of documents: SuperMinHash signatures, banding, verification, union-find grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsync.llm.flat import STEP, Spans, flatten, mixed, slices, windows, word_spans
from textsync.llm.graph import components, fitted, forest
from textsync.session import stage

#: Bands and the signature places of each. A pair at similarity 0.8 shares no band with probability
#: (1 - 0.8 ** 6) ** 42 = 3e-6, a pair at 0.1 shares one with probability 4e-5.
BANDS, PLACES = 42, 6
#: Text bytes turned into shingles together; shingles permuted together.
CHUNK, TOGETHER = 1 << 20, 1 << 14
#: Documents of one side of a block comparison; shingles of a block that are counted together.
BLOCK, COLUMNS = 512, 4096
#: Pairs of full sets that one task compares at least, unless these sets have more shingles.
PAIRS, SHINGLES = 2_000, 1_000_000
#: Bits of the map of ids that full sets are wanted of.
MAP = 1 << 25


def shingle_sets(cells: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: runs of ``words`` words, or all words if there are fewer."""
    data, offsets = flatten(cells)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    start, end, text = word_spans(data, offsets)
    count = np.bincount(text, minlength=len(cells)).astype(np.int64)
    first = np.cumsum(count) - count
    content = Spans(data).hashes(start, end)
    runs, at = windows(content, first, count, words)
    own = np.searchsorted(at, first), np.searchsorted(at, first + count)
    sets = [np.unique(runs[a:b]) for a, b in zip(*own)]
    for i in np.flatnonzero((count > 0) & (count < words)):
        whole = np.full(1, count[i], np.uint64)
        for word in content[first[i] : first[i] + count[i]]:
            whole = mixed(whole * STEP + word)
        sets[i] = whole
    return sets


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures, one row of ``m`` places a set (all ones for an empty set).

    Every element walks the places in an order of its own, a random permutation drawn step by step; at
    step j it offers j plus a random fraction. A place keeps the least offer, so one element's offers are
    correlated and spread over all places, which lowers the variance. A set is finished once no place
    holds more than the next step could offer; all unfinished sets take a step together.
    """
    out = np.full((len(sets), m), np.uint64(2**64 - 1))
    size = np.array([len(s) for s in sets], np.int64)
    at = 0
    while at < len(sets):
        end = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), TOGETHER, "right")) + at)
        _offer(sets[at:end], out[at:end], m)
        at = end
    return out


def _offer(sets: list[np.ndarray], out: np.ndarray, m: int) -> None:
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat, order = out.reshape(-1), None
    with np.errstate(over="ignore"):
        for j in range(m):
            if not len(element):
                return
            drawn = mixed(element + np.uint64(j + 1) * STEP)
            k = j + ((drawn >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
            if order is None:
                place = k
            else:
                row = np.arange(len(element))
                place = order[row, k].astype(np.int64)
                order[row, k] = order[row, j]
                order[row, j] = place
            offer = np.uint64(j << 32) | (drawn & np.uint64(2**32 - 1))
            np.minimum.at(flat, owner * m + place, offer)
            left = (out.max(1) >> np.uint64(32)) > j
            stay = left[owner]
            if order is None:
                first_k, element, owner = k[stay], element[stay], owner[stay]
                order = np.tile(np.arange(m, dtype=np.uint16), (len(element), 1))
                order[np.arange(len(element)), first_k] = 0
                order[:, 0] = first_k
            elif not stay.all():
                element, owner, order = element[stay], owner[stay], order[stay]


def _signed(words: int, bands: int, places: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                sets = shingle_sets(part.column(1), words)
                size = np.array([len(s) for s in sets], np.int64)
                signature = super_minhash(sets, bands * places).reshape(len(sets), bands, places)
                with np.errstate(over="ignore"):
                    key = np.tile(np.arange(bands, dtype=np.uint64), (len(sets), 1))
                    for i in range(places):
                        key = mixed(key * STEP + signature[:, :, i])
                ends = np.arange(len(sets) + 1, dtype=np.int32) * bands
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size), *_identity(sets), pa.ListArray.from_arrays(pa.array(ends), pa.array(key.reshape(-1).view(np.int64)))],
                    ["doc_id", "n_shingles", "one", "two", "bands"],
                )

    return run


def _identity(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two 64-bit hashes of each whole set."""
    one = np.array([mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64)
    two = np.array([np.bitwise_xor.reduce(mixed(s ^ STEP)) if len(s) else 0 for s in sets], np.uint64)
    return [pa.array(one.view(np.int64)), pa.array(two.view(np.int64))]


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                sets = shingle_sets(part.column(1), words)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
                size = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, *_identity(sets), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["doc_id", "n_shingles", "one", "two", "shingles"])

    return run


def near_copies(docs: DataFrame, words: int = 2, percent: int = 80, bands: int = BANDS, places: int = PLACES) -> DataFrame:
    """Group ``docs(doc_id, text)``: ``(doc_id, n_shingles, component_id, kept)``, one row a document.

    Documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of ``words``-word shingles;
    a component is named by its smallest id, and that document is kept.

    1. Documents with equal sets form a class; only its smallest document goes on.
    2. Bands of the signature put classes in buckets. In a bucket all members are compared with a hub, its
       smallest member, on full sets: as many pairs as members. Links are grouped by union-find.
    3. What buckets leave open is settled exactly (:func:`_open`, :func:`_peeled`, :func:`_blocks`), comparing
       full sets block by block inside tasks. Nothing is compared inside one group, and only links leave a task.
       So no candidate is lost, and no list of pairs is made.

    Null and empty texts, and texts of white space, have no shingles, are linked with nothing and kept.
    Rows with a null id are left out; repeated rows of one id count as one document, the row with the
    most shingles (of these the one with the highest hashes of its set). Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    signed = stage(texts.mapInArrow(_signed(words, bands, places), "doc_id long, n_shingles long, one long, two long, bands array<long>"))
    row = F.struct("n_shingles", "one", "two")
    several = stage(signed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.max(row).alias("best")).where("k > 1").select("doc_id", "best"))

    def settled(rows: DataFrame) -> DataFrame:
        """One row an id: of several, the one with the most shingles, of these the one with the highest hashes of its set."""
        of_several = rows.join(several, "doc_id").where(row == F.col("best")).select(rows.columns).dropDuplicates(["doc_id"])
        return rows.join(several, "doc_id", "left_anti").unionByName(of_several)

    signed = settled(signed)
    filled = signed.where("n_shingles > 0")
    classes = filled.groupBy("one", "two", "n_shingles").agg(F.min("doc_id").alias("rep"))
    member = stage(filled.drop("bands").join(classes, ["one", "two", "n_shingles"]).select("doc_id", "n_shingles", "rep"))
    first = filled.join(classes.select(F.col("rep").alias("doc_id"), "one", "two"), ["doc_id", "one", "two"])
    keyed = stage(first.select("doc_id", "n_shingles", "bands")).select("doc_id", F.explode(F.array_distinct("bands")).alias("key"))
    hubs = stage(keyed.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1"))
    buckets = stage(keyed.join(hubs, "key").where("m > 2 OR doc_id <> hub").select("key", "doc_id", "hub", "m"))
    met = buckets.where("doc_id <> hub").groupBy(F.col("doc_id").alias("a"), F.col("hub").alias("b")).agg(F.max("m").alias("m"))
    pairs = stage(fitted(met, buckets.count()))
    wanted = fitted(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), 2 * pairs.count())
    wanted = stage(wanted)
    listed = _likely(texts, wanted).join(wanted, "doc_id", "left_semi").mapInArrow(_sets(words), "doc_id long, n_shingles long, one long, two long, shingles array<long>")
    sets = stage(settled(listed).select("doc_id", "shingles"))
    tested = _compare(pairs, sets)
    near = tested.where(f"100 * common >= {percent} * (na + nb - common)").select("a", "b")
    groups = stage(components(near))
    scope = _open(buckets.where("m > 2"), tested.where("m > 2"), groups, percent)
    if not scope.isEmpty():
        scope = _peeled(scope, sets, percent)
        groups = stage(components(near.unionByName(_blocks(scope, sets, percent))))
    grouped = member.join(groups, member["rep"] == groups["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    empty = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    every = grouped.unionByName(empty).groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    return every.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _likely(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts whose id's bit is set in a bit map of the wanted ids: all wanted ones and a few others.

    It spares the exact join that follows most of the text. The map has ``MAP`` bits in words of 64, so at
    most ``MAP`` / 64 rows are broadcast, 12 MB; with many more ids than bits it only stops sparing."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(MAP))
    mask = F.expr("shiftleft(1L, cast(_bit & 63 as int))")
    words = wanted.select(bit.alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_word")).agg(F.bit_or(mask).alias("_bits"))
    placed = texts.withColumn("_bit", bit).withColumn("_word", F.shiftright("_bit", 6))
    return placed.join(F.broadcast(words), "_word").where(F.col("_bits").bitwiseAND(mask) != 0).select(texts.columns)


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Sizes of both full sets and of what they share."""
    a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    rows, shingles, held = pairs.count(), *sets.agg(F.sum(F.size("shingles")), F.count(F.lit(1))).first()
    each = max(1, min(PAIRS, SHINGLES * held // max(1, shingles or 0)))
    both = fitted(fitted(pairs.join(a, "a"), rows, each).join(b, "b"), rows, each)
    return stage(both.select("a", "b", "m", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common")))


def _grouped(rows: DataFrame, groups: DataFrame, column: str, name: str) -> DataFrame:
    own = groups.select(F.col("node").alias(column), F.col("component").alias(name))
    return rows.join(own, column, "left").withColumn(name, F.coalesce(name, column))


def _open(buckets: DataFrame, tested: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Documents that may have a link which is not known yet: ``(doc_id, component, cluster)``.

    Such a link joins two groups inside one bucket, and one end at least is not in the group of the hub. Jaccard
    distance is a metric: two members can only be linked if their distances to the hub differ by no more
    than a link allows. So members are put in bins of that width by their distance, and a bin is open if it
    and its neighbours hold more than one group. Clusters join the documents of open bins."""
    pairs, members = tested.count(), buckets.count()
    apart = fitted(_grouped(_grouped(tested.select("a", "b"), groups, "a", "ga"), groups, "b", "gb"), pairs).where("ga <> gb")
    apart = stage(apart.select(F.col("a").alias("doc_id"), F.col("b").alias("hub")))
    keys = stage(fitted(buckets.join(apart, ["doc_id", "hub"], "left_semi").select("key").distinct(), members))
    rows = stage(fitted(buckets.join(keys, "key", "left_semi"), members).select("key", "doc_id", "hub"))
    held_rows = rows.count()
    far = tested.select(F.col("a").alias("doc_id"), F.col("b").alias("hub"), (1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("far"))
    width = (100 - percent) / 100 + 1e-9
    bins = F.floor(F.coalesce("far", F.lit(0.0)) / F.lit(width)).cast("int")  # the hub is at no distance
    rows = fitted(rows.join(far, ["doc_id", "hub"], "left"), held_rows).select("key", "doc_id", bins.alias("bin"))
    rows = stage(fitted(_grouped(rows, groups, "doc_id", "component"), held_rows))
    sums = fitted(rows.groupBy("key", "bin").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("doc_id").alias("least")), held_rows)
    spread = sums.select("key", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"), "low", "high", "least")
    open_ = spread.groupBy("key", "bin").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("least").alias("least")).where("low <> high")
    open_ = stage(fitted(open_.select("key", "bin", "least"), held_rows))
    held = stage(fitted(rows.join(open_, ["key", "bin"]), held_rows).select("key", "bin", "doc_id", "component"))
    # all that an open bin and those beside it hold meets the least document there, so any two of them are in one cluster
    beside = held.select("key", "doc_id", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    clusters = components(fitted(beside.join(open_, ["key", "bin"]), 3 * held_rows).select(F.col("doc_id").alias("a"), F.col("least").alias("b")))
    scope = fitted(held.select("doc_id", "component").distinct(), held_rows)
    return stage(fitted(_grouped(scope, clusters, "doc_id", "cluster"), held_rows))


def _peeled(scope: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Leave out documents with too many shingles that no other document of the scope has: they are linked
    with none of it. Then leave out clusters of one group."""
    shingle = sets.join(scope.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    alone = shingle.groupBy("s").agg(F.count(F.lit(1)).alias("df"), F.min("doc_id").alias("doc_id"), F.min("n").alias("n")).where("df = 1")
    docs = scope.count()
    lone = fitted(alone.groupBy("doc_id").agg(F.count(F.lit(1)).alias("u"), F.min("n").alias("n")), docs).where(f"100 * (n - u) < {percent} * n").select("doc_id")
    left = stage(fitted(scope.join(lone, "doc_id", "left_anti"), docs))
    mixed_ = left.groupBy("cluster").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high")
    return stage(fitted(left.join(fitted(mixed_.select("cluster", "size"), docs), "cluster"), docs))


def _links(percent: int):
    """Links between documents of different groups in one block, or across two."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        doc, group, side = (np.asarray(rows[c]) for c in ("doc_id", "component", "block"))
        cells = rows["shingles"].chunk(0)
        size = np.diff(np.asarray(cells.offsets))
        owner = np.repeat(np.arange(len(doc)), size)
        _, column, count = np.unique(np.asarray(cells.flatten()), return_inverse=True, return_counts=True)
        owner, column = owner[count[column] > 1], column[count[column] > 1]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], np.unique(column[order], return_inverse=True)[1]
        x, y = rows["x"][0].as_py(), rows["y"][0].as_py()
        left, right = np.flatnonzero(side == x), np.flatnonzero(side == y)
        common = np.zeros((len(left), len(right)))
        place = np.zeros((2, len(doc)), np.int64)
        place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
        edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + COLUMNS + 1, COLUMNS))
        for number, (begin, end) in enumerate(zip(edges[:-1], edges[1:])):
            own, at = owner[begin:end], column[begin:end] - number * COLUMNS
            parts = []
            for k, value, total in ((0, x, len(left)), (1, y, len(right))):
                some = side[own] == value
                part = np.zeros((total, COLUMNS), np.float32)
                part[place[k, own[some]], at[some]] = 1
                parts.append(part)
            common += parts[0] @ parts[1].T
        both = size[left][:, None] + size[right][None, :] - common
        i, j = np.nonzero((100 * common >= percent * both) & (group[left][:, None] != group[right][None, :]))
        return pa.table({"a": pa.array(doc[left[i]], pa.int64()), "b": pa.array(doc[right[j]], pa.int64())})

    return run


def _blocks(scope: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different groups of each cluster. A cluster is cut in blocks of about ``BLOCK`` documents by a
    hash of the id; a task has two blocks and counts shared shingles by matrix products in bounded pieces."""
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = scope.withColumn("parts", parts).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    rows = rows.join(sets, "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    found = rows.select("cluster", "x", "y", "doc_id", "component", "block", "shingles").groupBy("cluster", "x", "y").applyInArrow(_links(percent), "a long, b long")
    return stage(found.mapInArrow(forest, "u long, v long")).select(F.col("u").alias("a"), F.col("v").alias("b"))
