"""Spelling variants: words one letter apart, found in tries of letter-group counts."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsync.llm.flat import STEP, Spans, mixed, slices
from textsync.session import stage

RUN = re.compile("[a-zÀ-ÿ]+")
#: Bytes of text counted at once; words that a task counts before it hands them on.
CHUNK, COUNTED = 4 << 20, 200_000
#: Letters fall into so many groups by code point. Words of one trie, queries that come to it at once, states of a search at once.
GROUPS, TRIE, QUERIES, STATES = 13, 20_000, 200_000, 400_000


def words(docs: DataFrame, least_length: int = 6, least_count: int = 5, damaged: int | None = None) -> DataFrame:
    """``(word, n)``: maximal runs of Latin letters in all texts of ``docs(doc_id, text)``, A-Z as a-z, with their number.

    With ``damaged`` every run whose crc32 of ``<doc_id>:<run>`` that number divides first loses the code point at that crc
    modulo its length, which plants known variants. Words of fewer code points or occurrences are left out afterwards. Null
    and empty texts have no words, a null id counts as empty. Counts are added up in each task before anything moves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if not text:
                        continue
                    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word, n in Counter(RUN.findall(text.encode().lower().decode())).items():  # bytes: A-Z alone
                        if len(word) < least_length:
                            continue
                        if damaged and (crc := zlib.crc32(word.encode(), seed)) % damaged == 0:
                            at = crc % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_length:
                                continue
                        counts[word] += n
                if len(counts) > COUNTED:
                    yield _counted(counts)
                    counts.clear()
        yield _counted(counts)

    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def vectors(found: list[str]) -> np.ndarray:
    """How many letters of each group every word has."""
    letters = np.frombuffer("".join(found).encode("utf-32-le"), np.uint32)
    word = np.repeat(np.arange(len(found)), [len(w) for w in found])
    return np.bincount(word * GROUPS + letters % GROUPS, minlength=len(found) * GROUPS).reshape(len(found), GROUPS)


def branch(counts: np.ndarray) -> np.ndarray:
    """A number for each row of the first counts. Should two rows share one, their words only meet in one trie."""
    out = np.zeros(len(counts), np.uint64)
    with np.errstate(over="ignore"):
        for level in range(counts.shape[1]):
            out = mixed(out * STEP + counts[:, level].astype(np.uint64))
    return out.view(np.int64)


def routes(levels: int) -> np.ndarray:
    """All changes of the first counts that a surplus of one and a deficit of one allow."""
    unit = np.eye(levels, dtype=np.int64)
    both = [unit[i] - unit[j] for i in range(levels) for j in range(levels) if i != j]
    return np.array([np.zeros(levels, np.int64), *unit, *-unit, *both]).reshape(-1, levels)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point parts the two."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    low, high = 0, min(len(a), len(b))
    while low < high:  # the longest common beginning
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return a[low + (len(a) >= len(b)) :] == b[low + (len(b) >= len(a)) :]


class Trie:
    """Words arranged by successive letter-group counts; all nodes of a level lie in order on arrays."""

    def __init__(self, found: list[str]):
        counts = vectors(found)
        order = np.lexsort(counts.T[::-1])
        self.words = [found[i] for i in order]
        counts = counts[order]
        fresh = np.zeros(len(found), bool)
        fresh[0] = True
        above = np.zeros(len(found), np.int64)
        self.begin, self.children, self.count = [], [], []
        for level in range(GROUPS):
            fresh = fresh | np.append(True, counts[1:, level] != counts[:-1, level])
            node = np.cumsum(fresh) - 1
            first = np.flatnonzero(fresh)
            self.children.append(np.bincount(above[first]))
            self.begin.append(np.cumsum(self.children[-1]) - self.children[-1])
            self.count.append(counts[first, level])
            above = node
        self.length = counts[first].sum(1)
        self.tables = self._halves(above)

    def _halves(self, leaf: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """Words of each leaf by their first and last letters, for verification. Of two words one edit apart, the first or the
        last half of the shorter one (rounded down) is common."""
        tables = {}
        for longer in (0, 1):  # whether the word is the longer one
            for side, half in enumerate(halves(self.words, longer)):
                with np.errstate(over="ignore"):
                    keys = mixed(half + leaf.astype(np.uint64) * STEP)
                order = np.argsort(keys, kind="stable")
                tables[longer, side] = keys[order], order
        return tables

    def near(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query and a word of the trie that are one edit apart, by their numbers.

        Depth first, for many queries at a time: a state is a query, a node and what is left of a surplus and a deficit of one
        letter. A child's count may exceed the query's by the surplus or fall short by the deficit."""
        wanted, length = vectors(queries), np.array([len(q) for q in queries])
        half = {longer: halves(queries, longer) for longer in (0, 1)}
        pairs = [np.zeros((2, 0), np.int64)]
        every = np.arange(len(queries))
        stack = [(0, every, np.zeros_like(every), np.ones(len(every), bool), np.ones(len(every), bool))]
        while stack:
            level, query, node, surplus, deficit = stack.pop()
            if len(query) > STATES and len(query) > 1:
                middle = len(query) // 2
                stack += [(level, *(x[part] for x in (query, node, surplus, deficit))) for part in (slice(middle, None), slice(middle))]
                continue
            if level == GROUPS:
                pairs.append(self._verified(queries, query, node, length, half))
                continue
            n = self.children[level][node]
            state = np.repeat(np.arange(len(node)), n)
            child = np.arange(int(n.sum())) + np.repeat(self.begin[level][node] - (np.cumsum(n) - n), n)
            more = self.count[level][child] - wanted[query[state], level]
            stays = (more == 0) | ((more == 1) & surplus[state]) | ((more == -1) & deficit[state])
            state, child, more = state[stays], child[stays], more[stays]
            if len(state):
                stack.append((level + 1, query[state], child, surplus[state] & (more < 1), deficit[state] & (more > -1)))
        return tuple(np.concatenate(pairs, 1))

    def _verified(self, queries: list[str], query: np.ndarray, leaf: np.ndarray, length: np.ndarray, half: dict) -> np.ndarray:
        found = []
        for step in (-1, 0, 1):  # how much longer the words of the leaf are
            here = self.length[leaf] - length[query] == step
            q, under = query[here], leaf[here]
            for side in (0, 1):
                keys, order = self.tables[int(step > 0), side]
                with np.errstate(over="ignore"):
                    own = mixed(half[int(step < 0)][side][q] + under.astype(np.uint64) * STEP)
                low = np.searchsorted(keys, own)
                n = np.searchsorted(keys, own, "right") - low
                at = np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)
                found.append(np.stack([np.repeat(q, n), order[at]]))
        pairs = np.unique(np.concatenate(found, 1), axis=1)
        return pairs[:, [one_edit(queries[a], self.words[b]) for a, b in pairs.T.tolist()]] if pairs.size else pairs


def halves(found: list[str], longer: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first and last letters of every word: half its length, or half of one less."""
    length = np.array([len(w) for w in found], np.int64)
    end = np.cumsum(length)
    half = (length - longer) // 2
    spans = Spans(np.frombuffer("".join(found).encode("utf-32-le"), np.uint8))
    return spans.hashes(4 * (end - length), 4 * (end - length + half)), mixed(spans.hashes(4 * (end - half), 4 * end))


def near_words(counted: DataFrame) -> DataFrame:
    """``(word, n_near, near_n, near)`` for every word of ``counted(word, n)`` with a near word: how many it has, and the one
    of largest ``n`` (of equal ones the least in code-point order).

    The first counts are the branches of the whole trie below which tasks work: a word is stored in its branch and sent as a
    query to each branch that its budget reaches. The number of counts that make a branch grows with the logarithm of the
    vocabulary, and a branch of more words than a trie should hold is dealt out to several tries, each searched by all of the
    branch's queries in turns of bounded size. So no task holds more than a trie and a turn; pairs never leave a task.
    """
    total = counted.count()
    levels = min(GROUPS, max(1, int(np.ceil(np.log(max(total / TRIE, 1)) / np.log(3)))))
    steps = routes(levels)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                key = branch(vectors(batch.column(0).to_pylist())[:, :levels])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], ["word", "n", "key"])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                counts = vectors(batch.column(0).to_pylist())[:, :levels]
                for step in steps:
                    at = np.flatnonzero((counts + step >= 0).all(1))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(branch(counts[at] + step))], ["word", "key"])

    home = stage(counted.mapInArrow(stored, "word string, n long, key long"))
    visits = home.select("word").mapInArrow(sent, "word string, key long")
    branches = home.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TRIE).alias("tries"))
    turns = visits.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("turns"))
    dealt = stage(branches.join(turns, "key").select("key", F.col("tries").cast("int").alias("tries"), F.col("turns").cast("int").alias("turns")))
    kept = home.join(dealt, "key").select("key", F.pmod(F.hash("word"), "tries").alias("trie"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "word", "n")
    asked = visits.join(dealt, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("tries") - 1)).alias("trie"), F.pmod(F.hash("word"), "turns").alias("turn"), "word")

    kind = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return kind.empty_table()
        trie, queries = Trie(left["word"].to_pylist()), right["word"].to_pylist()
        n = dict(zip(left["word"].to_pylist(), left["n"].to_pylist()))
        query, word = trie.near(queries)
        order = sorted(range(len(trie.words)), key=lambda i: (-n[trie.words[i]], trie.words[i]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        best = np.full(len(queries), len(order))
        np.minimum.at(best, query, place[word])
        near = np.bincount(query, minlength=len(queries))
        has = np.flatnonzero(near)
        form = [trie.words[order[i]] for i in best[has].tolist()]
        return pa.Table.from_arrays([pa.array([queries[i] for i in has]), pa.array(near[has]), pa.array([n[w] for w in form]), pa.array(form)], schema=kind)

    # columns of their own on one side: both sides come from one table
    left = kept.select(*[F.col(c).alias(c) for c in kept.columns])
    found = left.groupBy("key", "trie", "turn").cogroup(asked.groupBy("key", "trie", "turn")).applyInArrow(search, "word string, n_near long, near_n long, near string")
    first = F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("first")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select("word", "n_near", (-F.col("first.m")).alias("near_n"), F.col("first.near").alias("near"))


def group(counted: DataFrame, ratio: int = 5) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``counted(word, n)``, words distinct.

    A word's form is its near word of largest ``n`` if that is ``ratio`` (at least 2) times its own or more, else null; its root
    is where following forms ends. Numbers grow along forms, so chains end, after at most log(n) steps; they are followed in
    doubled steps. A word without near words has ``n_near`` 0. An empty table gives an empty one; other columns are not read."""
    counted = stage(counted.select("word", "n"))
    joined = counted.join(near_words(counted), "word", "left")
    has = F.col("near_n") >= ratio * F.col("n")
    out = stage(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n")))
    root = stage(out.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        onward = root.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(root.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        root = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            break
    return out.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
