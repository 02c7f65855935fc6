"""Byte-level BPE encoding and decoding with a public vocabulary of merge ranks."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from textsync.llm.flat import slices

#: Pieces whose tokens a worker remembers; text bytes encoded at once; longest piece encoded together with others.
REMEMBERED, CHUNK, TOGETHER = 250_000, 2 << 20, 64
NONE = 1 << 62


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    """Ranks by token and tokens by rank of a file with one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return ranks, tokens


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of lowest rank merges, leftmost first, until none is left.

    Leaf i of a segment tree holds the rank of the pair that begins with the part at byte i, joined with
    i in one number, so that a node's minimum is also the leftmost. A merge takes the root, unlinks the
    right part and updates three leaves: the merged part's, its left neighbour's and the vanished one's.
    That is O(n log n) for a piece of n bytes, also for runs of one letter over megabytes.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    tree = [NONE] * (2 * size)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank * size + i
    for node in range(size - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left <= right else right

    def put(i: int, value: int) -> None:
        node = size + i
        if tree[node] == value:
            return
        tree[node] = value
        node >>= 1
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            least = left if left <= right else right
            if tree[node] == least:
                return
            tree[node] = least
            node >>= 1

    while tree[1] != NONE:
        i = tree[1] % size
        gone = after[i]
        end = after[gone]
        after[i] = end
        if end < n:
            before[end] = i
        put(gone, NONE)
        rank = get(piece[i : after[end]]) if end < n else None
        put(i, NONE if rank is None else rank * size + i)
        left = before[i]
        if left >= 0:
            rank = get(piece[left:end])
            put(left, NONE if rank is None else rank * size + left)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


@lru_cache(maxsize=2)
def pair_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of single bytes; keys of all pairs of tokens that form a token, sorted, and the token formed."""
    ranks = vocabulary(path)[0]
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    found = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                found[left << 32 | right] = rank
    keys = np.array(sorted(found), np.int64)
    return single, keys, np.array([found[k] for k in keys.tolist()], np.int32)


def merge_pieces(pieces: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many short pieces, and how many each has: :func:`merge_piece` on all trees at once, one merge a step.

    Row m of every table belongs to piece m; a step takes the root of each tree that has a pair left and
    updates the same three leaves and the nodes above them. The tables are held flat, so that a place is
    one number."""
    single, keys, values = pair_table(path)
    length = np.array([len(p) for p in pieces], np.int64)
    rows, size = len(pieces), 1 << max(1, int(length.max() - 1).bit_length())
    wide, none, bits = size + 1, np.int32(2**31 - 1), size.bit_length() - 1

    def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(keys, key)
        at[at == len(keys)] = 0
        return np.where((keys[at] == key) & (right >= 0), values[at], -1)

    data = np.zeros((rows, size), np.uint8)
    inside = np.arange(size) < length[:, None]
    data[inside] = np.frombuffer(b"".join(pieces), np.uint8)
    part = np.full((rows, wide), -1, np.int32)
    part[:, :size][inside] = single[data[inside]]
    after = np.tile(np.arange(1, size + 2, dtype=np.int32), (rows, 1))
    after[:, :size][np.arange(size) == length[:, None] - 1] = size
    before = np.tile(np.arange(-1, size, dtype=np.int32), (rows, 1))
    tree = np.full((rows, 2 * size), none, np.int32)
    r, i = np.nonzero(np.arange(size - 1) < length[:, None] - 1)
    rank = joined(part[r, i], part[r, i + 1])
    tree[r, size + i] = np.where(rank >= 0, rank * size + i, none)
    half = size
    while half > 1:
        tree[:, half // 2 : half] = np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2])
        half //= 2
    tree, part, after, before = tree.ravel(), part.ravel(), after.ravel(), before.ravel()
    live = np.arange(rows)
    while True:
        root = tree.take(live * (2 * size) + 1)
        going = root < none
        live, root = live[going], root[going]
        if not len(live):
            break
        i, rank = root & (size - 1), root >> bits
        row, leaf = live * wide, live * (2 * size) + size
        here = row + i
        gone = after.take(here)
        end = after.take(row + gone)
        part[here] = rank
        part[row + gone] = -1
        after[here] = end
        before[row + end] = i
        left = before.take(here)
        has = left >= 0
        left = np.where(has, left, i)
        up = joined(rank, part.take(row + end))
        down = joined(part.take(row + left), rank)
        tree[leaf + gone] = none
        tree[leaf + left] = np.where(has & (down >= 0), down * size + left, none)
        tree[leaf + i] = np.where(up >= 0, up * size + i, none)
        root_at = leaf - size
        gone, i, left = gone + size, i + size, left + size
        for _ in range(bits):
            gone, i, left = gone >> 1, i >> 1, left >> 1
            for node in (gone, i, left):
                child = root_at + 2 * node
                tree[root_at + node] = np.minimum(tree.take(child), tree.take(child + 1))
    flat = part.reshape(rows, wide)[:, :size]
    return flat[flat >= 0], (flat >= 0).sum(1)


class _Pieces(dict):
    """Numbers of the pieces met so far, and the ids of each by number.

    Looking up a new piece numbers it; ``settle`` then encodes all new ones together. Past
    ``REMEMBERED`` pieces everything is forgotten, so memory stays bounded on any text."""

    def __init__(self, path: str):
        super().__init__()
        self.path, self.ranks = path, vocabulary(path)[0]
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.ids, self.begin, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number

    def settle(self) -> None:
        raw = [piece.encode() for piece in self.new]
        groups: dict[int, list[int]] = {}
        found: list[np.ndarray] = [None] * len(raw)
        for at, piece in enumerate(raw):
            if len(piece) > TOGETHER:
                found[at] = np.array(merge_piece(piece, self.ranks), np.int32)
            elif piece in self.ranks:
                groups.setdefault(-1, []).append(at)
            else:
                groups.setdefault((len(piece) - 1).bit_length(), []).append(at)
        count = np.ones(len(raw), np.int64)
        flat: list[tuple[np.ndarray, np.ndarray]] = []
        for kind, places in groups.items():
            for at in range(0, len(places), 4096):
                some = places[at : at + 4096]
                if kind < 0:
                    ids, own = np.array([self.ranks[raw[i]] for i in some], np.int32), np.ones(len(some), np.int64)
                else:
                    ids, own = merge_pieces([raw[i] for i in some], self.path)
                count[some] = own
                flat.append((np.array(some), ids))
        for at, ids in enumerate(found):
            if ids is not None:
                count[at] = len(ids)
        begin = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int32)
        for places, ids in flat:
            out[_ragged(begin[places], count[places])] = ids
        for at, ids in enumerate(found):
            if ids is not None:
                out[begin[at] : begin[at] + len(ids)] = ids
        self.begin = np.concatenate([self.begin, begin + len(self.ids)])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, out])
        self.new = []


def _ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places begin .. begin + count of every run, one run after the other."""
    total = int(count.sum())
    return np.arange(total) + np.repeat(begin - (np.cumsum(count) - count), count)


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> tuple[regex.Pattern, _Pieces]:
    return regex.compile(pattern), _Pieces(path)


def encode_texts(texts: list[str], path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and how many each has.

    Each match of ``pattern`` is encoded by itself, and once if it recurs."""
    split, known = _encoder(path, pattern)
    if len(known) > REMEMBERED:
        known.reset()
    numbers, pieces = [], np.zeros(len(texts), np.int64)
    for at, text in enumerate(texts):
        own = split.findall(text)
        pieces[at] = len(own)
        numbers.append(np.fromiter(map(known.__getitem__, own), np.int64, len(own)))
    known.settle()
    every = np.concatenate([np.zeros(0, np.int64), *numbers])
    each = known.count[every]
    ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(pieces)])]
    return known.ids[_ragged(known.begin[every], each)], np.diff(ends)


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    """Bytes of a list of ids. An id that the vocabulary lacks is an error."""
    tokens = vocabulary(path)[1]
    if len(ids) and (ids.min() < 0 or ids.max() >= len(tokens)):
        raise ValueError("an id is not in the vocabulary")
    return b"".join(map(tokens.__getitem__, ids.tolist()))


def encode(docs: DataFrame, path: str, pattern: str, column: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids array<int>``, the tokens of ``column`` without special tokens, to every row.

    A narrow map over whole texts in bounded chunks, so rows keep their partitions and a lost task is
    simply run again. Null and empty texts have no ids. Strings of special tokens are ordinary text. Any
    other columns pass through; one already named ``ids`` is replaced. The vocabulary file is opened on
    the executors at ``path``.
    """

    def made(cells: pa.Array) -> pa.Array:
        flat, count = encode_texts([text or "" for text in cells.to_pylist()], path, pattern)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(flat, pa.int32()))

    return _mapped(docs, column, ids, T.ArrayType(T.IntegerType()), made)


def decode(rows: DataFrame, path: str, column: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded binary``, the bytes of the ids in ``column``; null and empty lists give empty bytes."""

    def made(cells: pa.Array) -> pa.Array:
        begin, count = np.asarray(cells.offsets)[:-1], np.asarray(cells.value_lengths().fill_null(0))
        ids = np.asarray(cells.values)
        return pa.array([decode_ids(ids[a : a + n], path) for a, n in zip(begin.tolist(), count.tolist())], pa.binary())

    return _mapped(rows, column, decoded, T.BinaryType(), made)


def _mapped(rows: DataFrame, column: str, name: str, kind: T.DataType, made) -> DataFrame:
    kept = [c for c in rows.columns if c != name]
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, CHUNK):
                new = made(part.column(part.schema.get_field_index(column)))
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in kept], new], [*kept, name])

    return rows.mapInArrow(run, schema)
