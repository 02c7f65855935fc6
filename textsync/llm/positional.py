"""A positional inverted index of documents, and exact and proximate phrases found through it.

The index is kept in segments: a segment covers a few megabytes of whole documents, numbers their words one after the
other with a gap between documents, and lists for each term the places where it stands. So the list of a frequent term
is spread over all segments, and every step below works on one segment's lists at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from textsync.llm.flat import Spans, flatten, slices, word_spans
from textsync.session import stage

#: Bytes of text in a segment; candidate places looked up at once.
SEGMENT, AT_ONCE = 4 << 20, 1 << 20
#: Words are runs of digits, letters a-z and code points from U+0080 on; A-Z count as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False

#: A row with a term lists its places; the row without one lists a segment's documents, where each begins and how many words it has.
INDEX = "shard long, term long, n int, places array<int>, docs array<long>, words array<int>"
SLOTS = "array<struct<n: bigint, at: int, term: bigint>>"


def words_of(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts one after the other, and the text of each."""
    data, offsets = flatten(cells)
    data = LOWER[data]
    start, end, text = word_spans(data, offsets, BETWEEN)
    return Spans(data).hashes(start, end).view(np.int64), text


def _lists(values: np.ndarray, begin: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(begin, len(values)), pa.int32()), pa.array(values, kind))


def index(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """The index of ``column`` over all rows, as a table in the shared folder that any number of searches can use.

    One narrow pass, no shuffle. Each row is a document of its own, also where ids repeat or are null; null and empty
    texts are documents without words. Other columns are not read. An empty table gives an index without segments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", SEGMENT):
                words, text = words_of(part.column(1))
                places = np.arange(len(words)) + text
                order = np.argsort(words, kind="stable")
                terms = words[order]
                begin = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, np.int64)
                n = np.diff(np.append(begin, len(terms)))
                none = pa.nulls(len(begin), pa.list_(pa.int64())), pa.nulls(len(begin), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(begin), shard)), pa.array(terms[begin]), pa.array(n, pa.int32()), _lists(places[order], begin, pa.int32()), *none],
                    ["shard", "term", "n", "places", "docs", "words"],
                )
                own = np.bincount(text, minlength=len(part))
                first = np.cumsum(own) - own + np.arange(len(part))
                ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(0))
                one = [pa.array([shard]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), _lists(first, np.zeros(1, int), pa.int32()), ids, _lists(own, np.zeros(1, int), pa.int32())]
                yield pa.RecordBatch.from_arrays(one, ["shard", "term", "n", "places", "docs", "words"])
                shard += 1

    return stage(docs.select(F.col(key).cast("long").alias("key"), F.col(column).alias("text")).mapInArrow(run, INDEX))


def documents(index: DataFrame) -> DataFrame:
    """``(shard, slot, doc_id, n_words)`` of every indexed row."""
    zipped = F.posexplode(F.arrays_zip("docs", "words")).alias("slot", "doc")
    listed = index.where("term IS NULL").select("shard", zipped)
    return listed.select("shard", "slot", F.col("doc.docs").alias("doc_id"), F.col("doc.words").cast("long").alias("n_words"))


def phrases(items: DataFrame, key: str, words: int, column: str = "text") -> DataFrame:
    """``(item, phrase, terms)``: all runs of ``words`` words of each item, or all its words if it has fewer.

    ``phrase`` is a hash of the terms, so equal runs of any items are one phrase. Items without words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SEGMENT // 8):
                found, text = words_of(part.column(1))
                own = np.bincount(text, minlength=len(part))
                length = np.minimum(own, words)
                runs = np.where(length > 0, own - length + 1, 0)
                item = np.repeat(np.arange(len(part)), runs)
                start = _spread(np.cumsum(own) - own, runs)
                begin = np.cumsum(length[item]) - length[item]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(item)), _lists(found[_spread(start, length[item])], begin, pa.int64())], ["item", "terms"])

    kind = items.schema[key].dataType.simpleString()
    cut = items.select(F.col(key).alias("item"), F.col(column).alias("text")).mapInArrow(run, f"item {kind}, terms array<long>")
    return stage(cut.select("item", F.xxhash64("terms").alias("phrase"), "terms").distinct())


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers begin .. begin + count of every pair, one run after the other."""
    return np.arange(int(count.sum())) + np.repeat(begin - (np.cumsum(count) - count), count)


def ranked(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(phrase, slots)``: the terms of each phrase with their offsets, rarest in the index first.

    Phrases with a term that the index lacks occur nowhere and are left out."""
    each = wanted.select("phrase", "terms").dropDuplicates(["phrase"])
    slots = stage(each.select("phrase", F.posexplode("terms").alias("at", "term")))
    terms = stage(slots.select("term").distinct())
    counts = stage(index.where("term IS NOT NULL").select("term", "n").join(terms, "term").groupBy("term").agg(F.sum("n").alias("n")))
    placed = slots.join(counts, "term").groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("n", "at", "term"))).alias("slots"))
    whole = each.select("phrase", F.size("terms").alias("length"))
    return stage(whole.join(placed, "phrase").where("size(slots) = length").select("phrase", "slots"))


class _Segment:
    """One segment's lists of the terms wanted, and its documents, on numpy arrays."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        named = rows.filter(rows["term"].is_valid())
        terms = named["term"].to_numpy()
        order = np.argsort(terms, kind="stable")
        places = named["places"].combine_chunks()
        begin, count = np.asarray(places.offsets)[:-1].astype(np.int64), np.asarray(places.value_lengths()).astype(np.int64)
        self.terms, self.count = terms[order], count[order]
        self.begin = np.cumsum(self.count) - self.count
        self.places = np.asarray(places.values)[_spread(begin[order], self.count)].astype(np.int64)
        self.keys = np.repeat(np.arange(len(terms)), self.count) << 32 | self.places
        listed = rows.filter(rows["term"].is_null())
        self.first = np.asarray(listed["places"].combine_chunks().flatten()).astype(np.int64)
        self.ids = listed["docs"].combine_chunks().flatten()

    def rank(self, terms: np.ndarray) -> np.ndarray:
        """The number of each term, or -1 where the segment lacks it."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def hold(self, rank: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each term stands at the place given with it."""
        key = (rank << 32) + place
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (rank >= 0) & (place >= 0) & (self.keys[at] == key) if len(self.keys) else np.zeros(len(key), bool)


def _exact(low: int, high: int):
    """Narrow each candidate phrase of a segment to the starts where its terms of rank ``low`` .. ``high`` stand."""

    def run(cands: pa.Table, rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, _Segment]]:
        segment = _Segment(rows)
        slots = cands["slots"].combine_chunks()
        begin, length = np.asarray(slots.offsets)[:-1].astype(np.int64), np.asarray(slots.value_lengths()).astype(np.int64)
        at, term = np.asarray(slots.values.field("at")).astype(np.int64), np.asarray(slots.values.field("term"))
        if low == 0:
            rank = segment.rank(term[begin])
            count = np.where(rank >= 0, segment.count[rank], 0) if len(segment.terms) else np.zeros(len(rank), np.int64)
            source, values = segment.begin[rank] if len(segment.terms) else rank, segment.places
        else:
            starts = cands["starts"].combine_chunks()
            source, count, values = np.asarray(starts.offsets)[:-1].astype(np.int64), np.asarray(starts.value_lengths()).astype(np.int64), np.asarray(starts.values).astype(np.int64)
        total = np.cumsum(count)
        a = 0
        while a < len(cands):  # so many candidates at once that their lists stay small
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + AT_ONCE, "right")))
            who = np.repeat(np.arange(a, b), count[a:b])
            start = values[_spread(source[a:b], count[a:b])]
            if low == 0:
                start = start - at[begin[who]]
            for r in range(max(low, 1), high):
                due = length[who] > r
                slot = begin[who] + np.where(due, r, 0)
                stays = ~due | segment.hold(segment.rank(term[slot]), start + at[slot])
                who, start = who[stays], start[stays]
            yield who, start, length, segment
            a = b

    return run


def _narrowed(cands: pa.Table, rows: pa.Table, low: int, high: int) -> Iterator[pa.RecordBatch]:
    for who, start, _, _ in _exact(low, high)(cands, rows):
        kept, begin = np.unique(who, return_index=True)
        left = cands.select(["shard", "phrase", "slots"]).take(pa.array(kept))
        yield from left.append_column("starts", _lists(start, begin, pa.int32())).to_batches()


def _matched(segment: _Segment, phrase: pa.Array, shard: int, who: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """One row a document and phrase, with the word numbers inside the document."""
    slot = np.searchsorted(segment.first, start, "right") - 1
    order = np.lexsort((start, who, slot))
    slot, who, start, end = slot[order], who[order], start[order], end[order]
    begin = np.flatnonzero(np.append(True, (slot[1:] != slot[:-1]) | (who[1:] != who[:-1]))) if len(slot) else np.zeros(0, np.int64)
    base = segment.first[slot]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(begin), shard)), pa.array(slot[begin], pa.int32()), segment.ids.take(pa.array(slot[begin])), phrase.take(pa.array(who[begin])),
            _lists(start - base, begin, pa.int32()), _lists(end - base, begin, pa.int32()),
        ],
        ["shard", "slot", "doc_id", "phrase", "starts", "ends"],
    )


def nearest(lists: list[np.ndarray], widest: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and last place of all shortest ranges that hold a place of every list and span at most ``widest`` places."""
    rare = lists[0]
    kept = []
    for places in lists:  # only what lies near a place of the rarest term can take part
        at = np.searchsorted(rare, places)
        before, after = rare[np.maximum(at - 1, 0)], rare[np.minimum(at, len(rare) - 1)]
        kept.append(places[np.minimum(np.abs(places - before), np.abs(after - places)) < widest])
    place, label = np.concatenate(kept), np.repeat(np.arange(len(kept)), [len(k) for k in kept])
    order = np.argsort(place, kind="stable")
    place, label = place[order].tolist(), label[order].tolist()
    held, missing, left, starts, ends = [0] * len(lists), len(lists), 0, [], []
    for right, kind in enumerate(label):
        missing -= not held[kind]
        held[kind] += 1
        while held[label[left]] > 1:
            held[label[left]] -= 1
            left += 1
        # a range is shortest if it cannot begin later, and no range that began as late ended sooner
        if not missing and place[right] - place[left] < widest and (not starts or starts[-1] != place[left]):
            starts.append(place[left])
            ends.append(place[right])
    return np.array(starts, np.int64), np.array(ends, np.int64)


MATCHES = "shard long, slot int, doc_id long, phrase long, starts array<int>, ends array<int>"


def search(index: DataFrame, wanted: DataFrame, slop: int = 0) -> DataFrame:
    """``(shard, slot, doc_id, phrase, starts, ends)``: where each phrase occurs, one row a document and phrase.

    ``wanted(phrase, terms)`` are phrases as :func:`phrases` gives them. Starts and ends (exclusive) are word numbers in
    the document. Without slop the terms stand one after the other: lists shifted by their offsets are intersected from the
    rarest term on, the three rarest first, the others only in segments where these meet. With slop a match is a shortest
    range of words that holds every term of the phrase, in any order, in at most ``slop`` words more than the phrase has.
    Lists meet candidates segment by segment; what a task holds is one segment's lists, whatever the frequency of a term.
    """
    order = ranked(index, wanted)
    listed = index.where("term IS NOT NULL").select(F.col("shard").alias("shard"), F.col("term").alias("term"))  # columns of their own: the index comes again below
    rarest = order.select("phrase", "slots", F.col("slots")[0]["term"].alias("term"))
    cands = listed.join(rarest, "term").select("shard", "phrase", "slots", F.lit(None).cast("array<int>").alias("starts"))

    def lists(cands: DataFrame, ranks, shards: DataFrame | None = None) -> DataFrame:
        due = F.explode(F.transform(ranks(F.col("slots")), lambda s: s["term"])).alias("term")
        terms = stage(cands.select(due).distinct())
        rows = index.where("term IS NOT NULL").join(terms, "term", "left_semi").unionByName(index.where("term IS NULL"))
        rows = rows if shards is None else rows.join(shards, "shard", "left_semi")
        return rows.select("shard", "term", "places", "docs")

    def joined(cands: DataFrame, rows: DataFrame, function, schema: str) -> DataFrame:
        kind = to_arrow_schema(StructType.fromDDL(schema))

        def one(left: pa.Table, right: pa.Table) -> pa.Table:
            return pa.Table.from_batches([b.cast(kind) for b in function(left, right)] if len(left) else [], kind)

        return cands.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(one, schema)

    if slop:

        def around(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
            segment, shard, phrase = _Segment(right), left["shard"][0].as_py(), left["phrase"].combine_chunks()
            for who, slots in enumerate(left["slots"].to_pylist()):
                rank = segment.rank(np.array(list(dict.fromkeys(s["term"] for s in slots))))
                if (rank < 0).any():
                    continue
                start, last = nearest([segment.places[segment.begin[r] : segment.begin[r] + segment.count[r]] for r in rank], len(slots) + slop)
                inside = np.searchsorted(segment.first, start, "right") == np.searchsorted(segment.first, last, "right")
                start, last = start[inside], last[inside]
                yield _matched(segment, phrase, shard, np.full(len(start), who), start, last + 1)

        return joined(cands, lists(order, lambda s: s), around, MATCHES)

    first = stage(joined(cands, lists(order, lambda s: F.slice(s, 1, 3)), lambda left, right: _narrowed(left, right, 0, 3), f"shard long, phrase long, slots {SLOTS}, starts array<int>"))

    def settled(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        shard, phrase = left["shard"][0].as_py(), left["phrase"].combine_chunks()
        for who, start, length, segment in _exact(3, max(3, int(np.asarray(left["slots"].combine_chunks().value_lengths()).max())))(left, right):
            yield _matched(segment, phrase, shard, who, start, start + length[who])

    shards = stage(first.select("shard").distinct())
    return joined(first, lists(first, lambda s: F.slice(s, 4, F.greatest(F.size(s) - 3, F.lit(0))), shards), settled, MATCHES)


def contamination(docs: DataFrame, items: DataFrame, words: int = 10) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, item_ids, contaminated)`` of every row of ``docs(doc_id, text)``.

    ``items(item_id, text)`` is cut into all runs of ``words`` words (a shorter item is one run); a document word is hit if
    it lies in any occurrence of a run. ``item_ids`` lists the items with an occurring run as strings in order, each once.
    Rows of one id stay apart; null and empty texts have no words; items without words, and the ids of items that are
    null, name nothing (a null item's runs still hit). Empty tables give no rows, or documents without hits. Columns of
    other names are not read.
    """
    held, wanted = index(docs), phrases(items, "item_id", words)
    found = stage(search(held, wanted))
    span = F.explode(F.arrays_zip("starts", "ends")).alias("span")
    spans = found.select("shard", "slot", span).groupBy("shard", "slot", F.col("span.starts").alias("start")).agg(F.max("span.ends").alias("end"))
    past = F.max("end").over(W.partitionBy("shard", "slot").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    fresh = spans.select("shard", "slot", (F.col("end") - F.greatest("start", F.coalesce(past, F.lit(0)))).alias("fresh"))
    hits = fresh.where("fresh > 0").groupBy("shard", "slot").agg(F.sum("fresh").cast("long").alias("n_hit"))
    named = wanted.where("item IS NOT NULL").select("phrase", F.col("item").cast("string").alias("item"))
    met = found.select("shard", "slot", "phrase").join(named, "phrase").select("shard", "slot", "item").distinct()
    listed = met.groupBy("shard", "slot").agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    out = documents(held).join(hits, ["shard", "slot"], "left").join(listed, ["shard", "slot"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (n_hit > 0).alias("contaminated"))
