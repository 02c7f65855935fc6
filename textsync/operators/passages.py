"""Locating many passages in many documents: the one-segment case of the alignment, cursor at 0."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textsync.operators.align import CELLS, FUZZ, TOP, WHOLE, _book_windows, _lists, score_windows, segment_tokens, strides_of, token_pages
from textsync.operators.tokens import block_key, coded, coded_grams, coded_ngrams
from textsync.functions.text import token_array
from textsync.session import stage

SHARE = 2_000_000  # characters of the documents that one task takes at once
RUN = 65536  # words of documents that meet passages in one step
FOUND = "item_id bigint, doc_id bigint, start bigint, end bigint, score_milli int"


def _votes(book: DataFrame, items: DataFrame, n: int, ahead: int | None) -> DataFrame:
    """(item_id, book_id, start, votes) of shared n-grams. A document that repeats an n-gram meets each
    passage holding it, so the join is keyed by the n-gram alone and its skew is left to the runtime."""
    grams = items.where(F.col("len") >= n).withColumn("grams", coded_grams(F.col("toks"), n))
    grams = grams.select("item_id", F.explode("grams").alias("g")).select("item_id", F.col("g.gram").alias("gram"), F.col("g.pos").alias("off"))
    # only n-grams some passage holds take part
    known = coded_ngrams(book, (n,)).join(grams.select("gram").distinct(), "gram", "left_semi")
    hits = known.join(grams, "gram").select("item_id", "book_id", (F.col("tok") - F.col("off")).alias("start"))
    hits = hits.where("start >= 0" if ahead is None else f"start between 0 and {ahead}")
    return hits.groupBy("item_id", "book_id", "start").agg(F.count("*").cast("int").alias("votes")).withColumn("n", F.lit(n))


def _top(votes: DataFrame, top: int) -> DataFrame:
    """The ``top`` candidates worth measuring: most votes, then nearest to the beginning."""
    rank = F.row_number().over(Window.partitionBy("item_id", "book_id").orderBy(F.desc("votes"), "start"))
    return votes.withColumn("rank", rank).where(F.col("rank") <= top)


def _spread(items: DataFrame, documents: DataFrame, ahead: int | None, top: int) -> DataFrame:
    """What :func:`locate_passages` finds, by joins, for documents and passages that no task should hold."""
    items = stage(items)
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.transform(
            token_array(line), lambda t: F.struct(block_key(F.lit(0), i).alias("blk"), t.alias("norm"))
        ),
    )
    packed = stage(coded(documents.select(
        F.col("doc_id").alias("book_id"), F.lit(0).alias("section_ord"), F.flatten(lines).alias("toks"), F.lit(0).cast("bigint").alias("offset")
    )))
    strides = strides_of(items)
    if not strides:
        return documents.sparkSession.createDataFrame([], FOUND)
    pair = ["item_id", "book_id"]
    votes = stage(_votes(packed, items, 3, ahead))
    met = votes.select(*pair).distinct()
    votes2 = stage(_votes(packed, items, 2, ahead).join(met, pair, "left_anti"))
    found = _top(votes, top).unionByName(_top(votes2, top))
    pairs = items.where("len = 2")
    short = _votes(packed, pairs, 1, ahead).join(met.unionByName(votes2.select(*pair).distinct()), pair, "left_anti")
    found = found.unionByName(_top(short, top))
    scored = score_windows(found, items, token_pages(packed, strides), on=("item_id",), keep=("book_id", "rank"))
    near = scored.select("item_id", "book_id", "rank", F.posexplode("best").alias("at", "b"))
    if ahead is not None:
        near = near.where(F.col("b.start") <= ahead)
    # the best score wins; among equal scores the better ranked candidate, then the earlier start
    best = near.groupBy("item_id", "book_id").agg(
        F.min(F.struct((-F.col("b.score")).alias("worse"), "rank", "at", F.col("b.start").alias("start"), F.col("b.len").alias("len"))).alias("w")
    )
    return best.select(
        "item_id", F.col("book_id").alias("doc_id"), F.col("w.start").alias("start"), (F.col("w.start") + F.col("w.len")).alias("end"),
        F.floor(-F.col("w.worse") * 1000 + 1e-6).cast("int").alias("score_milli"),
    )


class _Passages:
    """Passages of one share: their words, numbered from 1 by the sorted codes that they hold, one passage after the other."""

    def __init__(self, items: pa.Table) -> None:
        words, self.size = _lists(items.column("toks"))
        self.codes, numbers = np.unique(words, return_inverse=True)
        self.words, self.kinds = numbers + 1, len(self.codes) + 1
        self.ids, self.need = items.column("item_id").to_numpy(), items.column("need").to_numpy()
        self.owner = np.repeat(np.arange(len(self.size)), self.size)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        self.left = self.begin[1:][self.owner] - np.arange(len(self.words))
        # sorted n-grams and where they begin; a single word only votes for passages of two
        self.grams = {}
        for n in (3, 2, 1):
            at = np.flatnonzero((self.left >= n) & ((n > 1) | (self.size[self.owner] == 2)))
            keys = self.gram(self.words, at, n)
            order = np.argsort(keys, kind="stable")
            self.grams[n] = keys[order], at[order]

    def gram(self, words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        return sum(words[at + k].astype(np.int64) * self.kinds ** (n - 1 - k) for k in range(n))

    def numbered(self, codes: np.ndarray) -> np.ndarray:
        """Document words by these numbers, 0 for words that no passage holds."""
        at = np.minimum(np.searchsorted(self.codes, codes), max(len(self.codes) - 1, 0))
        return np.where(self.codes[at] == codes, at + 1, 0) if len(self.codes) else np.zeros(len(codes), np.int64)


def _starts(items: _Passages, words: np.ndarray, blocks: np.ndarray, doc: np.ndarray, first: np.ndarray, ahead: int | None, top: int):
    """(passage, start, rank) of the ``top`` starts with most votes of each passage and document, ``doc`` of each word and ``first`` word
    of each document given. Shorter n-grams count for pairs without any start by longer ones. Votes are counted in runs of passages
    with at most about ``CELLS`` meetings."""
    span, docs = len(words) + 1, len(first)
    hits = {}
    for n in (3, 2, 1):
        keys, at = items.grams[n]
        tok = np.arange(max(len(words) - n + 1, 0))
        tok = tok[blocks[tok] == blocks[tok + n - 1]]
        for k in range(n):
            tok = tok[words[tok + k] > 0]
        gram = items.gram(words, tok, n)
        order = np.argsort(gram, kind="stable")
        gram, tok = gram[order], tok[order]
        low = np.searchsorted(gram, keys)
        many = np.searchsorted(gram, keys, "right") - low
        keep = np.flatnonzero(many)
        keep = keep[np.argsort(items.owner[at[keep]], kind="stable")]
        hits[n] = tok, at[keep], low[keep], many[keep]
    load = sum(np.bincount(items.owner[at], many, len(items.size)) for _, at, _, many in hits.values())
    run = np.cumsum(load) // CELLS
    found = [(np.zeros(0, np.int64),) * 3]
    for r in np.unique(run[load > 0]):
        a, z = np.searchsorted(run, [r, r + 1])
        met = np.zeros(0, np.int64)
        for n in (3, 2, 1):
            tok, at, low, many = hits[n]
            part = slice(*np.searchsorted(items.owner[at], [a, z]))
            at, low, many = at[part], low[part], many[part]
            where = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
            where, who = tok[where], np.repeat(items.owner[at], many)
            start = where - np.repeat(at - items.begin[items.owner[at]], many)
            begins = first[doc[where]]
            good = start >= begins
            if ahead is not None:
                good &= start - begins <= ahead
            start, who = start[good], who[good]
            fresh = ~np.isin(who * docs + doc[start], met)
            key, votes = np.unique(who[fresh] * span + start[fresh], return_counts=True)
            who, start = key // span, key % span
            pair = who * docs + doc[start]
            order = np.lexsort((start, -votes, pair))
            who, start, pair = who[order], start[order], pair[order]
            new = np.flatnonzero(np.diff(pair, prepend=-1))
            rank = np.arange(len(pair)) - np.repeat(new, np.diff(np.append(new, len(pair))))
            found.append((who[rank < top], start[rank < top], rank[rank < top]))
            met = np.concatenate([met, pair[new]])
    return [np.concatenate(c) for c in zip(*found)]


def _best(items: _Passages, words: np.ndarray, blocks: np.ndarray, doc: np.ndarray, first: np.ndarray, ahead: int | None, top: int, fuzz: int):
    """(passage, document, start, length, score) of the best acceptable window near the starts of each passage and document."""
    who, start, rank = _starts(items, words, blocks, doc, first, ahead, top)
    near = start[:, None] + np.arange(-fuzz, fuzz + 1)
    inside = (near >= 0) & (near < len(words))
    inside &= doc[np.clip(near, 0, len(words) - 1)] == doc[start][:, None]
    if ahead is not None:
        inside &= near - first[doc[start]][:, None] <= ahead
    asked = (who[:, None] * len(words) + near)[inside]
    rank = np.broadcast_to(rank[:, None], near.shape)[inside]
    each = np.unique(asked)
    b_who, b_start, score, length = _book_windows(words, blocks, items.words, items.size, items.need, items.kinds, each // len(words), each % len(words))
    key = b_who * len(words) + b_start
    order = np.argsort(key)
    key, score, length = key[order], score[order], length[order]
    at = np.minimum(np.searchsorted(key, asked), max(len(key) - 1, 0))
    hit = np.flatnonzero(key[at] == asked) if len(key) else np.zeros(0, np.int64)
    at, rank = at[hit], rank[hit]
    who, start = key[at] // len(words), key[at] % len(words)
    # the best score wins; among equal scores the better ranked candidate, then the earlier start
    pair = who * len(first) + doc[start]
    order = np.lexsort((start, rank, -score[at], pair))
    order = order[np.flatnonzero(np.diff(pair[order], prepend=-1))]
    who, start, at = who[order], start[order], at[order]
    return who, doc[start], start - first[doc[start]], length[at], score[at]


def _meet(ahead: int | None, top: int, fuzz: int):
    """Passages of one share met with the documents dealt to it, some documents at a time."""
    kind = to_arrow_schema(StructType.fromDDL(FOUND))

    def meet(documents: pa.Table, passages: pa.Table) -> pa.Table:
        if not documents.num_rows or not passages.num_rows:
            return kind.empty_table()
        items = _Passages(passages)
        ids = documents.column("doc_id").to_numpy()
        lines = pa.concat_arrays(documents.column("lines").chunks)
        codes, in_line = lines.flatten().flatten().to_numpy(zero_copy_only=False), np.asarray(lines.flatten().value_lengths().fill_null(0), np.int64)
        n_lines = np.asarray(lines.value_lengths().fill_null(0), np.int64)
        of_line = np.repeat(np.arange(len(ids)), n_lines)
        doc, blocks = np.repeat(of_line, in_line), np.repeat(np.arange(len(in_line)), in_line)
        words = items.numbered(codes)
        size = np.bincount(doc, minlength=len(ids))
        end = np.cumsum(size)
        out = []
        for docs in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(end // RUN)) + 1):
            a, z = end[docs[0]] - size[docs[0]], end[docs[-1]]
            if z > a:
                first = end[docs] - size[docs] - a
                who, there, start, length, score = _best(items, words[a:z], blocks[a:z], doc[a:z] - docs[0], first, ahead, top, fuzz)
                milli = np.floor(score * 1000 + 1e-6).astype(np.int32)
                out.append(pa.table([items.ids[who], ids[docs[there]], start, start + length, milli], schema=kind))
        return pa.concat_tables(out) if out else kind.empty_table()

    return meet


def locate_passages(passages: DataFrame, documents: DataFrame, ahead: int | None = None, top: int = TOP, whole: int = WHOLE, share: int = SHARE) -> DataFrame:
    """Where each passage (item_id, text) occurs in each document (doc_id, text), if it reaches the
    acceptance threshold: (item_id, doc_id, start, end, score_milli). ``top`` places with the most shared n-grams are
    measured for each passage and document.

    Word codes of documents are dealt out once, in groups of about ``share`` characters, and meet the passages there, ``whole`` words of
    them at a time; nothing that they share is moved. Documents over ``share`` characters and passages over ``whole`` words are joined."""
    items = stage(segment_tokens(passages, ["item_id"]))
    length = F.coalesce(F.length("text"), F.lit(0))
    total = documents.agg(F.sum(F.when(length <= share, length)).alias("chars"), F.coalesce(F.bool_or(length > share), F.lit(False)).alias("large")).first()
    words = items.agg(F.sum(F.when(F.col("len").between(2, whole), F.col("len"))).alias("words"), F.coalesce(F.bool_or(F.col("len") > whole), F.lit(False)).alias("large")).first()
    groups, shares = -(-(total.chars or 0) // share) or 1, -(-(words.words or 0) // whole) or 1
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    lines = F.transform(F.split("text", "\n"), lambda line: F.transform(token_array(line), lambda t: F.xxhash64(t)))
    dealt = documents.where((length <= share) & F.col("doc_id").isNotNull()).select(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("grp"), each(shares, "part"), F.col("doc_id").cast("bigint").alias("doc_id"), lines.alias("lines"))
    met = items.where(F.col("len").between(2, whole) & F.col("item_id").isNotNull()).select(F.pmod(F.xxhash64("item_id"), F.lit(shares)).cast("int").alias("part"), each(groups, "grp"), F.col("item_id").cast("bigint").alias("item_id"), "toks", "need")
    found = dealt.groupBy("grp", "part").cogroup(met.groupBy("grp", "part")).applyInArrow(_meet(ahead, top, FUZZ), FOUND)
    if total.large:
        found = found.unionByName(_spread(items, documents.where(length > share), ahead, top))
    if words.large:
        found = found.unionByName(_spread(items.where(F.col("len") > whole), documents.where(length <= share), ahead, top))
    return found
