"""Alignment of the tokens of two public tokenizers by bytes, and how often the corpus links each pair of ids."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textsync.llm.flat import slices
from textsync.session import stage

#: Bytes of text aligned at once, and in a shard: what shares one dictionary of irregular pairs.
CHUNK, SHARD = 2 << 20, 12 << 20
#: Runs of so much white space exhaust the pattern engine of the faster library; the slower one gives the same ids.
SPACES = 50_000
LONG_SPACE = re.compile(rf"\s{{{SPACES}}}")

#: kind 0: a document, its links as codes with the times each occurs; 1: the irregular pairs of a shard and how many of its
#: documents hold each; 2: for each id of A, how many documents of a task hold it linked with its identical id of B.
ROWS = (
    "kind int, shard long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "codes array<int>, times array<int>, pairs array<long>, holders array<int>, identical array<long>"
)
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def letters_of_bytes() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte: printable bytes as they are, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Pair:
    """Two tokenizers, the bytes of their tokens and the map of identical ids."""

    def __init__(self, byte_level: str, pieces: str, pattern: str):
        with open(byte_level, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        letter = letters_of_bytes()
        tokens = {bytes(letter[c] for c in token): i for token, i in vocabulary.items()}
        self.a = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=tokens, special_tokens={})
        self.path = byte_level
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.bytes_a = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            self.bytes_a[i] = token
        ids = range(self.b.get_piece_size())
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in ids]
        self.long_a, self.long_b = (np.array([len(t) for t in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        same = {self.bytes_b[i]: i for i in sorted(ids, key=lambda i: (not self.b.is_byte(i), -i))}  # whole pieces come last and stay
        self.identical = np.array([same.get(token, -1) if token else -1 for token in self.bytes_a], np.int64)
        self.marked = [[f"{i}{mark}" for i in range(max(len(self.bytes_a), len(self.bytes_b)))] for mark in ",|;"]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A for a space and the text, and ids of B for the text; no ids where either does not give back its bytes."""
        a = [self._ids(" " + text) if text else [] for text in texts]
        b = self.b.encode(texts, num_threads=1)
        for i, text in enumerate(texts):
            whole = b" " + text.encode()
            if not text or b"".join(map(self.bytes_a.__getitem__, a[i])) != whole or b"".join(map(self.bytes_b.__getitem__, b[i])) != whole:
                a[i] = b[i] = []
        return a, b

    def _ids(self, text: str) -> list[int]:
        if len(text) > SPACES and LONG_SPACE.search(text):
            return _reference(self.path).encode(text, add_special_tokens=False).ids
        return self.a.encode_ordinary(text)


@lru_cache(maxsize=1)
def _reference(path: str) -> tokenizers.Tokenizer:
    tokenizer = tokenizers.Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


@lru_cache(maxsize=1)
def pair(byte_level: str, pieces: str, pattern: str) -> Pair:
    return Pair(byte_level, pieces, pattern)


class Aligned:
    """The alignment of some texts: documents one after the other on one axis of bytes."""

    def __init__(self, texts: list[str], both: Pair):
        a, b = both.encode(texts)
        self.n_a, self.n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, self.n_a), (b, self.n_b)))
        end_a, end_b = np.cumsum(both.long_a[flat_a]), np.cumsum(both.long_b[flat_b])
        doc_a = np.repeat(np.arange(len(texts)), self.n_a)
        marks = np.zeros((2, (int(end_a[-1]) if len(end_a) else 0) + 1), np.int8)
        marks[0, end_a], marks[1, end_b] = 1, 1
        shared = marks[1, end_a] == 1
        self.n_groups = np.bincount(doc_a[shared], minlength=len(texts))
        # between two neighbouring ends of either side lies the overlap of one token of A with one of B: a link
        ends = np.flatnonzero(marks[0] | marks[1])
        passed = np.cumsum(marks, 1, np.int32)  # tokens that end at or before each byte
        of_a, of_b = (passed[side, ends] - marks[side, ends] for side in (0, 1))
        self.link_a, self.link_b, self.link_doc = flat_a[of_a], flat_b[of_b], doc_a[of_a]
        groups = np.cumsum(marks[0] & marks[1], dtype=np.int32)
        group_a, group_b = groups[end_a] - shared, groups[end_b] - marks[0, end_b]
        self.n_links = np.bincount(self.link_doc, minlength=len(texts))
        self.hashes = self._groups(both, flat_a, flat_b, group_a, group_b)

    def _groups(self, both: Pair, flat_a: np.ndarray, flat_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> list[str]:
        """Digests of the groups written out: every token is followed by a comma, the last of A in a group by a bar, of B by a semicolon."""
        n = len(both.marked[0])
        last_a, last_b = (np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in (group_a, group_b))
        groups = int(group_a[-1]) + 1 if len(group_a) else 0
        through_a, through_b = (np.append(0, np.cumsum(np.bincount(g, minlength=groups))) for g in (group_a, group_b))
        before_a, before_b = through_b[group_a], through_a[group_b + 1]  # tokens of B in earlier groups; of A up to this group
        code = np.empty(len(flat_a) + len(flat_b), np.int64)
        code[np.arange(len(flat_a)) + before_a] = flat_a + n * last_a
        code[np.arange(len(flat_b)) + before_b] = flat_b + 2 * n * last_b
        words = both.marked[0] + both.marked[1] + both.marked[2]
        ends = np.cumsum(self.n_a + self.n_b)
        out, begin = [], 0
        for end in ends.tolist():
            text = "".join(map(words.__getitem__, code[begin:end].tolist()))[:-1]
            out.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
            begin = end
        return out


def _shard(shard: int, texts_of: Iterator[tuple[pa.Array, list[str]]], both: Pair, held: np.ndarray, kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of one shard's documents and of its irregular pairs; adds to ``held`` the documents by id of A with its identical id."""
    wide, own = len(both.bytes_a), []
    for ids, texts in texts_of:
        found = Aligned(texts, both)
        regular = both.identical[found.link_a] == found.link_b
        pairs, number = np.unique(found.link_a[~regular] * len(both.bytes_b) + found.link_b[~regular], return_inverse=True)
        code = found.link_a.copy()
        code[~regular] = wide + number
        keys, times = np.unique(found.link_doc * (wide + len(pairs)) + code, return_counts=True)
        own.append((ids, found, pairs, keys // (wide + len(pairs)), keys % (wide + len(pairs)), times))
    every = np.unique(np.concatenate([pairs for _, _, pairs, *_ in own]))
    holders = np.zeros(len(every), np.int64)
    for ids, found, pairs, doc, code, times in own:
        irregular = code >= wide
        code[irregular] = wide + np.searchsorted(every, pairs)[code[irregular] - wide]
        holders += np.bincount(code[irregular] - wide, minlength=len(every))
        held += np.bincount(code[~irregular], minlength=wide)
        n = len(ids)
        begin = np.append(0, np.cumsum(np.bincount(doc, minlength=n)))
        lists = [pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(x, pa.int32())) for x in (code, times)]
        counts = [pa.array(x, pa.int64()) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)]
        none = [pa.nulls(n, kind.field(c).type) for c in ("pairs", "holders", "identical")]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n), pa.int32()), pa.array(np.full(n, shard)), ids, *counts, pa.array(found.hashes, pa.string()), *lists, *none], schema=kind)
    yield pa.RecordBatch.from_pylist([{"kind": 1, "shard": shard, "pairs": every, "holders": holders}], kind)


def aligned(docs: DataFrame, byte_level: str, pieces: str, pattern: str) -> DataFrame:
    """The rows of ``ROWS`` for ``docs(doc_id, text)``: one narrow pass in which each text is encoded once.

    A link of an id of A with its identical id of B costs one place in a vector as long as the vocabulary, kept for the whole
    task; only the other pairs are named, once a shard."""
    kind = to_arrow_schema(StructType.fromDDL(ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(byte_level, pieces, pattern)
        shard, held = TaskContext.get().partitionId() << 32, np.zeros(len(both.bytes_a), np.int64)

        def cut(part: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
            for some in slices(part, "text", CHUNK):
                yield some.column(0), [text or "" for text in some.column(1).to_pylist()]

        for batch in batches:
            for part in slices(batch, "text", SHARD):
                yield from _shard(shard, cut(part), both, held, kind)
                shard += 1
        yield pa.RecordBatch.from_pylist([{"kind": 2, "identical": held}], kind)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ROWS)


def align(docs: DataFrame, byte_level: str, pieces: str, pattern: str) -> DataFrame:
    """The columns of ``OUT`` for every row of ``docs(doc_id, text)``: its groups and links, and how common its links are.

    A encodes a space and the text by the byte-level vocabulary, B the text by the pieces. Bytes where tokens of both end part
    the text into groups; tokens whose bytes overlap are linked. The count of a pair of ids is the number of rows that hold it
    linked. ``n_best`` are the links whose pair has the highest count of its id of A, ``count_sum`` adds up the counts of all
    links. Null and empty texts, and texts that either side does not give back byte for byte, have zeros and an empty digest.
    Rows of one id stay apart; other columns are not read; an empty table gives an empty one.

    Counts of identical pairs are summed from vectors and go back as one vector; counts of the others are summed by pair and
    go back to the shards that hold the pair, so what is shuffled is pairs by shard, never pairs by document. The vectors
    (one number an id of A) are the only thing the driver holds and sends out.
    """
    found = stage(aligned(docs, byte_level, pieces, pattern))
    wide_b = len(pair(byte_level, pieces, pattern).bytes_b)
    named = found.where("kind = 1").select("shard", F.posexplode(F.arrays_zip("pairs", "holders")).alias("at", "p"))
    named = stage(named.select("shard", "at", F.col("p.pairs").alias("pair"), F.col("p.holders").cast("long").alias("holders")))
    counts = stage(named.groupBy("pair").agg(F.sum("holders").alias("n")))
    vector = found.where("kind = 2").select(F.posexplode("identical").alias("a", "n")).where("n > 0").groupBy("a").agg(F.sum("n").alias("n")).collect()
    top = counts.groupBy(F.floor(F.col("pair") / wide_b).alias("a")).agg(F.max("n").alias("n")).collect()
    wide = len(pair(byte_level, pieces, pattern).bytes_a)
    identical, best = np.zeros(wide, np.int64), np.zeros(wide, np.int64)
    for row in vector:
        identical[row["a"]] = best[row["a"]] = row["n"]
    for row in top:
        best[row["a"]] = max(best[row["a"]], row["n"])

    kind = to_arrow_schema(StructType.fromDDL(OUT))

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        """Counts of one shard's pairs, looked up by the codes of its documents."""
        left = left.combine_chunks()
        order = np.argsort(right["at"].to_numpy())
        count = np.concatenate([identical, right["n"].to_numpy()[order]])
        a = np.concatenate([np.arange(wide), right["pair"].to_numpy()[order] // wide_b])
        codes, times = left["codes"].combine_chunks(), left["times"].combine_chunks()
        doc = np.repeat(np.arange(len(left)), np.asarray(codes.value_lengths()))
        code, times = np.asarray(codes.flatten()), np.asarray(times.flatten()).astype(np.int64)
        n = count[code]
        sums = np.zeros((2, len(left)), np.int64)
        np.add.at(sums[0], doc, times * (n == best[a[code]]))
        np.add.at(sums[1], doc, times * n)
        own = [left[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.Table.from_arrays([*own, pa.chunked_array([pa.array(sums[0])]), pa.chunked_array([pa.array(sums[1])]), left["groups_sha256"]], schema=kind)

    rows = found.where("kind = 0").select(F.col("shard").alias("shard"), "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times")
    back = named.join(counts, "pair").select("shard", "at", "pair", "n")
    return rows.groupBy("shard").cogroup(back.groupBy("shard")).applyInArrow(settle, OUT)
