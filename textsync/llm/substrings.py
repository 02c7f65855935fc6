"""Exact removal of repeated byte strings: anchored suffixes, deep-shallow sorting."""

from __future__ import annotations

import atexit
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsync.llm.flat import Spans, flatten, slices
from textsync.llm.pii import _among
from textsync.session import stage

#: Bytes of an anchor; bytes compared by the shallow sort; text bytes anchored and suffixes sorted together.
ANCHOR, SHALLOW, CHUNK, TOGETHER = 32, 24, 1 << 19, 250_000
#: Anchors of one key beyond which its strings are counted by their hashes, with partial sums.
HOT = 50_000


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of strings of ``length`` bytes with one anchor: document, first and last start, place and hash of the anchor.

    A string's anchor is the leftmost of its ``ANCHOR``-byte pieces with the least hash. It depends on the
    string's bytes alone, so equal strings have equal anchors at equal distances.
    """
    wide = length - ANCHOR + 1
    n = len(data) - ANCHOR + 1
    if n < wide:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    spans = Spans(data)
    at = np.arange(n)
    hashes = spans.hashes(at, at + ANCHOR)
    mark = (hashes & ~np.uint64((1 << 24) - 1)) | at.astype(np.uint64)
    rows = -(-n // wide)
    block = np.full(rows * wide, np.uint64(2**64 - 1))
    block[:n] = mark
    block = block.reshape(rows, wide)
    ahead = np.minimum.accumulate(block, 1).reshape(-1)
    behind = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].reshape(-1)
    starts = n - wide + 1
    place = (np.minimum(behind[:starts], ahead[wide - 1 : wide - 1 + starts]) & np.uint64((1 << 24) - 1)).astype(np.int64)
    room = np.zeros(len(data) + 1, np.int64)
    size = np.diff(offsets)
    np.add.at(room, offsets[:-1][size >= length], 1)
    np.add.at(room, (offsets[1:] - length + 1)[size >= length], -1)
    inside = np.cumsum(room)[:starts] > 0
    fresh = np.ones(starts, bool)
    fresh[1:] = (place[1:] != place[:-1]) | ~inside[:-1]
    edge = np.zeros(starts, bool)
    edge[np.minimum(offsets[:-1], starts - 1)] = offsets[:-1] < starts
    first = np.flatnonzero(inside & (fresh | edge))
    stop = np.ones(starts, bool)
    stop[:-1] = fresh[1:] | edge[1:] | ~inside[1:]
    last = np.flatnonzero(inside & stop)
    return np.searchsorted(offsets, first, "right") - 1, first, last, place[first], hashes[place[first]]


def _words(data: np.ndarray) -> np.ndarray:
    """At every place the next eight bytes as one big-endian number: a character of the multikey sort."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for i in range(8):
        out = out << np.uint64(8) | padded[i : i + len(data)]
    return out


def deep_shallow(data: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of (group, first ``length`` bytes), and which of them equal their predecessor.

    Shallow: multikey quicksort with eight bytes as a character splits all segments of ties at once, down to
    ``SHALLOW`` bytes. Deep: what still ties shares a long prefix and goes into blind tries, one a segment. A
    trie's spine is one suffix; every other one is compared with the spine from the depth it is known to
    share, and branches off where it first differs. Branches at the same depth with the same next byte are
    a segment of their own, with a new spine, in the next round. Only branching bytes are looked at to order
    the branches of a spine.
    """
    words = _words(data)
    order = np.lexsort((words[start], group))
    same = np.zeros(len(order), bool)
    same[1:] = (group[order][1:] == group[order][:-1]) & (words[start[order]][1:] == words[start[order]][:-1])
    for depth in range(8, SHALLOW, 8):
        where = np.flatnonzero(_tied(same))
        if not len(where):
            return order, same
        segment = np.cumsum(~same[where])
        item = order[where]
        word = words[start[item] + depth]
        turn = np.lexsort((word, segment))
        order[where] = item[turn]
        word, moved = word[turn], segment[turn]
        same[where[1:]] &= word[1:] == word[:-1]
        same[where[0]] = False
        same[where[1:][moved[1:] != moved[:-1]]] = False
    known = np.full(len(order), SHALLOW)
    where = np.flatnonzero(_tied(same))
    equal = np.zeros(len(order), bool)
    while len(where):
        item = order[where]
        head = ~same[where]
        segment = np.cumsum(head) - 1
        spine = item[head][segment]
        shared = _common(data, words, start[item], start[spine], known[where], length)
        whole = shared >= length
        inner = np.minimum(shared, length - 1)
        own, other = data[start[item] + inner].astype(np.int64), data[start[spine] + inner].astype(np.int64)
        side = np.where(whole, 1, np.where(own < other, 0, 2))
        rank = np.where(side == 0, shared, np.where(side == 2, length - shared, 0))
        turn = np.lexsort((np.where(whole, 0, own), rank, side, segment))
        order[where] = item[turn]
        shared, own, side, whole, moved = shared[turn], own[turn], side[turn], whole[turn], segment[turn]
        joined = np.zeros(len(where), bool)
        joined[1:] = (moved[1:] == moved[:-1]) & (side[1:] == side[:-1]) & (whole[1:] | (shared[1:] == shared[:-1]) & (own[1:] == own[:-1]))
        equal[where] = joined & whole
        same[where] = joined & ~whole
        known[where] = shared + 1
        rest = ~whole
        tied = np.zeros(len(where), bool)
        tied[rest] = _tied(same[where])[rest]
        where = where[tied]
    return order, equal


def _tied(same: np.ndarray) -> np.ndarray:
    """Members of segments of two and more."""
    out = same.copy()
    out[:-1] |= same[1:]
    return out


def _common(data: np.ndarray, words: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, length: int) -> np.ndarray:
    """Length of the common prefix, of which ``known`` bytes are given."""
    shared = known.copy()
    left = np.flatnonzero(shared < length)
    while len(left):
        x, y = a[left] + shared[left], b[left] + shared[left]
        differ = words[x] ^ words[y]
        zeros = np.full(len(left), 8)
        some = differ != 0
        if some.any():
            top = np.frexp(differ[some].astype(np.float64))[1]  # may round up past the byte: settled below
            byte = 8 - (top + 7) // 8
            d = differ[some]
            high = (d >> (np.uint64(56) - np.minimum(byte, 7).astype(np.uint64) * np.uint64(8))) & np.uint64(255)
            zeros[some] = np.where(high == 0, byte + 1, byte)
        shared[left] = np.minimum(shared[left] + zeros, length)
        left = left[(zeros == 8) & (shared[left] < length)]
    return shared


def _anchored(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                data, offsets = flatten(part.column(2))
                if len(data) >= 1 << 24:
                    found = _long(data, length)
                else:
                    text, first, last, place, key = anchors(data, offsets, length)
                    found = text, first - offsets[text], last - first, place - first, key
                text, first, run_, ahead, key = found
                ids = [np.asarray(part.column(i))[text] for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, ids), pa.array(key.view(np.int64)), pa.array(first.astype(np.int64) << 16 | run_ << 8 | ahead)], ["one", "two", "key", "run"]
                )

    return run


def _long(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of one very long text, in pieces that overlap by a string less one byte."""
    parts, step = [], 1 << 23
    for at in range(0, len(data) - length + 1, step):
        piece = data[at : at + step + length - 1]
        _, first, last, place, key = anchors(piece, np.array([0, len(piece)]), length)
        parts.append((np.zeros(len(first), np.int64), first + at, last - first, place - first, key))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _contents(length: int):
    """For each text and its runs with repeated anchors, the bytes of the runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column(2)[row].as_buffer()
                runs = batch.column(3)[row].values
                code, key = np.asarray(runs.field("run")), np.asarray(runs.field("key"))
                first, more = code >> 16, code >> 8 & 255
                raw = memoryview(text)
                for at in range(0, len(code), 4096):
                    some = slice(at, at + 4096)
                    n = len(code[some])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(key[some]), pa.array([batch.column(0)[row].as_py()] * n, pa.int64()), pa.array([batch.column(1)[row].as_py()] * n, pa.int64()),
                        pa.array(code[some]), pa.array([raw[a : a + m + length].tobytes() for a, m in zip(first[some].tolist(), more[some].tolist())], pa.binary()),
                    ], ["key", "one", "two", "run", "content"])

    return run


def _settled(rows: list[pa.RecordBatch], length: int) -> pa.RecordBatch:
    """Covered intervals of the runs of some whole keys."""
    table = pa.Table.from_batches(rows).combine_chunks()
    data, offsets = flatten(table["content"].chunk(0))
    key, code = np.asarray(table["key"]), np.asarray(table["run"])
    _, group = np.unique(key, return_inverse=True)
    # runs of equal bytes repeat as a whole; one of them stands for all in the sort
    whole = Spans(data).hashes(offsets[:-1], offsets[1:]) ^ key.view(np.uint64)
    _, first, back, count = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
    windows = (code[first] >> 8 & 255) + 1
    run = np.repeat(np.arange(len(first)), windows)
    step = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
    order, equal = deep_shallow(data, offsets[:-1][first][run] + step, group[first][run], length)
    hit = np.zeros(len(run), bool)
    hit[order[_tied(equal)]] = True
    hit |= count[run] > 1
    edge = np.ones(len(run), bool)
    edge[1:] = (hit[1:] != hit[:-1]) | (run[1:] != run[:-1])
    begin = np.flatnonzero(edge & hit)
    stop = np.concatenate([np.flatnonzero(edge)[1:], [len(run)]])[np.searchsorted(np.flatnonzero(edge), begin)]
    own = run[begin]  # interval -> distinct run; every run of the same bytes gets it
    left, right = np.searchsorted(own, back), np.searchsorted(own, back, "right")
    many = right - left
    row = np.repeat(np.arange(len(back)), many)
    which = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(left, many)
    base = code[row] >> 16
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(table["one"])[row]), pa.array(np.asarray(table["two"])[row]), pa.array(base + step[begin][which]), pa.array(base + step[stop - 1][which] + length)],
        ["one", "two", "begin", "stop"],
    )


def _sorted_keys(length: int):
    """Settle the keys of a partition sorted by key, some whole keys at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        load = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, weight = np.asarray(batch.column(0)), np.cumsum((np.asarray(batch.column(3)) >> 8 & 255) + 1)
            fresh = np.flatnonzero(np.concatenate([[not held or held[-1].column(0)[-1].as_py() != key[0]], key[1:] != key[:-1]]))
            at = 0
            for cut in fresh.tolist():
                if load + (weight[cut - 1] if cut else 0) - (weight[at - 1] if at else 0) >= TOGETHER:
                    yield _settled([*held, batch.slice(at, cut - at)], length)
                    held, load, at = [], 0, cut
            held.append(batch.slice(at))
            load += int(weight[-1] - (weight[at - 1] if at else 0))
        if held:
            yield _settled(held, length)

    return run


def _hashed(length: int):
    """For runs under hot keys, a 128-bit hash of each string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for one, two, code, content in zip(*[batch.column(i).to_pylist() for i in range(1, 5)]):
                for i in range((code >> 8 & 255) + 1):
                    rows.append((hashlib.blake2b(content[i : i + length], digest_size=16).digest(), one, two, (code >> 16) + i))
                if len(rows) > 20_000:
                    yield _rows(rows)
                    rows = []
            yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["string", "one", "two", "begin"])

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without its intervals."""
    for batch in batches:
        out = []
        for row in range(batch.num_rows):
            raw = memoryview(batch.column(2)[row].as_buffer())
            gone, runs, at, digest = 0, 0, 0, hashlib.sha256()
            cells = batch.column(3)[row]
            for begin, stop in sorted((c["begin"], c["stop"]) for c in cells.as_py()) if cells.is_valid else []:
                if begin > at or not runs:
                    digest.update(raw[at:begin])
                    runs += 1
                    at = begin
                gone += max(0, stop - at)
                at = max(at, stop)
            digest.update(raw[at:])
            out.append((len(raw), gone, runs, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *[pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]],
            ["one", "two", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _bucketed(texts: DataFrame, name: str, buckets: int) -> DataFrame:
    """Write by the texts' hashes once, so that the later joins by text move no text.

    ``texts`` come from an aggregation by these hashes, which deals rows out as the buckets do: nothing moves again."""
    spark = texts.sparkSession
    texts.write.option("compression", "zstd").bucketBy(buckets, "one", "two").format("parquet").saveAsTable(name)
    atexit.register(_drop, spark, name)
    return spark.table(name)


def _drop(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # noqa: BLE001  the session has ended: the cluster clears its warehouse
        return


def repeated_strings(docs: DataFrame, length: int = 200) -> DataFrame:
    """What is left of ``docs(doc_id, text)`` without repeated strings:
    ``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``, one row a document.

    Texts are UTF-8 bytes. Each byte is removed that lies in a string of ``length`` bytes which also starts
    elsewhere, in the same document or another, overlaps included, judged on the input.

    1. Equal texts are one text with a count, written once in buckets of the text's hash. If the count is
       over one, the text is repeated as a whole, if it is long enough.
    2. Every string has an anchor (:func:`anchors`); strings come in runs of one anchor, one for some 85
       bytes. Only anchors found at two places go on: equal strings have equal anchors.
    3. The runs' bytes meet by anchor, and the suffixes that begin in a run are sorted (:func:`deep_shallow`);
       equal neighbours are repeated strings. A task sorts some whole anchors at a time. An anchor found
       more than ``HOT`` times has its strings counted by 128-bit hashes instead, with partial sums.
    4. Intervals meet their text by its hash.

    Null is an empty text. Texts under ``length`` bytes lose nothing. Rows of one id are documents of their own.
    """
    spark = docs.sparkSession
    if length < 2 * ANCHOR or length - ANCHOR > 250:
        raise ValueError(f"length must be from {2 * ANCHOR} to {250 + ANCHOR}")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    one, two = F.xxhash64("text"), F.xxhash64(F.lit(7), "text")
    ids = docs.select("doc_id", text.alias("text")).select("doc_id", one.alias("one"), two.alias("two"))
    whole = docs.select(text.alias("text")).select(one.alias("one"), two.alias("two"), "text")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = whole.groupBy("one", "two").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    texts = _bucketed(distinct, f"texts_{uuid.uuid4().hex}", buckets)
    found = stage(texts.where(F.octet_length("text") >= length).select("one", "two", "text").mapInArrow(_anchored(length), "one long, two long, key long, run long"))
    where = F.xxhash64("one", "two", F.shiftright("run", 16))
    keys = found.groupBy("key").agg(F.min(where).alias("low"), F.max(where).alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high")
    keys = stage(keys.select("key", "n"))
    runs = _among(found, "key", keys).join(keys, "key").groupBy("one", "two").agg(F.collect_list(F.struct("run", "key", "n")).alias("runs"))
    held = texts.select("one", "two", "text").join(runs, ["one", "two"])

    def contents(which: str) -> DataFrame:
        some = held.withColumn("runs", F.filter("runs", lambda r: r["n"] > HOT if which == "hot" else r["n"] <= HOT)).where(F.size("runs") > 0)
        return some.mapInArrow(_contents(length), "key long, one long, two long, run long, content binary")

    sorted_ = contents("cold").repartition("key").sortWithinPartitions("key")
    covered = stage(sorted_.mapInArrow(_sorted_keys(length), "one long, two long, begin long, stop long"))
    if not keys.where(f"n > {HOT}").isEmpty():
        strings = stage(contents("hot").mapInArrow(_hashed(length), "string binary, one long, two long, begin long"))
        at = F.xxhash64("one", "two", "begin")
        twice = strings.groupBy("string").agg(F.min(at).alias("low"), F.max(at).alias("high")).where("low <> high").select("string")
        hot = strings.join(twice, "string", "left_semi").select("one", "two", "begin", (F.col("begin") + length).alias("stop"))
        covered = covered.unionByName(hot)
    copied = texts.where(f"copies > 1 AND octet_length(text) >= {length}").select("one", "two", F.lit(0).cast("long").alias("begin"), F.octet_length("text").cast("long").alias("stop"))
    lists = covered.unionByName(copied).groupBy("one", "two").agg(F.collect_list(F.struct("begin", "stop")).alias("gone"))
    left = texts.select("one", "two", "text").join(lists, ["one", "two"], "left")
    result = stage(left.mapInArrow(_kept, "one long, two long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
    return ids.join(result, ["one", "two"]).drop("one", "two")
