"""Quality rules as a short-circuit cascade."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textsync.llm.flat import SPACE, Spans, flatten, mixed, slices, windows, word_spans

#: Text bytes looked at together; words of a repeated run; rows that costs are estimated on.
CHUNK, RUN, SAMPLE = 1 << 20, 8, 2000


def _marked(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SYMBOLS, UPPER, LOWER, MARKS = _marked(b"#*$%&|<>"), np.zeros(256, bool), np.zeros(256, bool), _marked(b"!?")
UPPER[65:91], LOWER[97:123] = True, True


class Texts:
    """A batch of whole texts; every measure is computed when first asked for. Null counts as empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1

    def only(self, keep: np.ndarray) -> Texts:
        """The chosen texts alone, nothing measured yet."""
        if keep.all():
            return self
        length = np.diff(self.offsets)
        return Texts(self.data[np.repeat(keep, length)], np.concatenate([[0], np.cumsum(length[keep])]))

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def _by_word(self, flags: np.ndarray) -> np.ndarray:
        return np.bincount(self.spans[2][flags], minlength=self.rows).astype(np.int64)

    @cached_property
    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return word_spans(self.data, self.offsets)

    @cached_property
    def hashes(self) -> Spans:
        return Spans(self.data)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.bincount(self.spans[2], minlength=self.rows).astype(np.int64)

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self.per_text(~SPACE[self.data] & ((self.data & 0xC0) != 0x80))

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.per_text(SYMBOLS[self.data])

    @cached_property
    def upper(self) -> np.ndarray:
        return self.per_text(UPPER[self.data])

    @cached_property
    def lower(self) -> np.ndarray:
        return self.per_text(LOWER[self.data])

    @cached_property
    def marks(self) -> np.ndarray:
        """Words that end in ! or ?"""
        return self._by_word(MARKS[self.data[self.spans[1] - 1]])

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Document and content hash of every line with a word."""
        cut = np.flatnonzero(self.data == 10)
        start = np.unique(np.concatenate([self.offsets[:-1], cut + 1]))
        start = start[start < len(self.data)]
        end = np.concatenate([start[1:], [len(self.data)]])[: len(start)]
        stop = np.where(self.data[end - 1] == 10, end - 1, end)
        text = np.searchsorted(self.offsets, start, "right") - 1
        total = np.concatenate([[0], np.cumsum(~SPACE[self.data])])
        full = total[stop] > total[start]
        return text[full], self.hashes.hashes(start[full], stop[full])

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self.lines[0], minlength=self.rows).astype(np.int64)

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        text, content = self.lines
        _, first = np.unique(mixed(content ^ mixed(text.astype(np.uint64))), return_index=True)
        return self.n_lines - np.bincount(text[first], minlength=self.rows)

    @cached_property
    def words(self) -> np.ndarray:
        """Content hash of every word."""
        return self.hashes.hashes(*self.spans[:2])

    @cached_property
    def n_stutters(self) -> np.ndarray:
        """Words equal to the word before them."""
        text = self.spans[2]
        again = np.zeros(len(text), bool)
        again[1:] = (self.words[1:] == self.words[:-1]) & (text[1:] == text[:-1])
        return self._by_word(again)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        text = self.spans[2]
        first = np.concatenate([[0], np.cumsum(self.n_words)[:-1]]) if self.rows else np.zeros(0, np.int64)
        content, at = windows(self.words, first, self.n_words, RUN)
        own = mixed(content ^ mixed(text[at].astype(np.uint64)))
        order = np.argsort(own)
        same = own[order][1:] == own[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(text) + 1, np.int64)
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + RUN, -1)
        return self._by_word(np.cumsum(edge)[:-1] > 0)


@dataclass(frozen=True)
class Rule:
    """Rejects the texts for which ``fails`` is true; ``reads`` names the measures it looks at."""

    name: str
    reads: tuple[str, ...]
    fails: Callable[[Texts], np.ndarray]


#: The base rules; a text is also rejected by any of the others.
BASE = (
    Rule("too_short", ("n_words",), lambda t: t.n_words < 20),
    Rule("repeated_runs", ("n_words", "n_repeat_words"), lambda t: 100 * t.n_repeat_words > 30 * t.n_words),
)
RULES = (
    *BASE,
    Rule("symbols", ("n_words", "n_symbols"), lambda t: 100 * t.n_symbols > 10 * t.n_words),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda t: 100 * t.n_dup_lines > 60 * t.n_lines),
    Rule("stuttering", ("n_words", "n_stutters"), lambda t: 100 * t.n_stutters > 20 * t.n_words),
    Rule("shouting", ("upper", "lower"), lambda t: t.upper > t.lower),
    Rule("exclaiming", ("n_words", "marks"), lambda t: 100 * t.marks > 30 * t.n_words),
    Rule("word_length", ("n_words", "word_chars"), lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 15 * t.n_words)),
)


def _survey(rules: Sequence[Rule], column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, spent, rejected = 0, [0.0] * len(rules), [0] * len(rules)
        for batch in batches:
            for part in slices(batch, column, CHUNK):
                data, offsets = flatten(part.column(part.schema.get_field_index(column)))
                rows += part.num_rows
                for i, rule in enumerate(rules):
                    began = time.perf_counter()
                    rejected[i] += int(rule.fails(Texts(data, offsets)).sum())  # nothing shared: its own full cost
                    spent[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": pa.array(range(len(rules)), pa.int32()), "rows": [rows] * len(rules), "spent": spent, "rejected": rejected})

    return run


def plan(docs: DataFrame, rules: Sequence[Rule] = RULES, column: str = "text", sample: int = SAMPLE) -> list[Rule]:
    """Rules by rejections per second, highest first, as measured on about ``sample`` rows.

    The sample is drawn from all rows, each by itself, where they lie. Every rule runs alone on it, so its cost is what it
    would be as the first of the cascade. The sample only sets the order; the verdict is the same in any order. As
    costs are measured times, the order may differ between reruns."""
    some = docs.select(column).sample(min(1.0, sample / max(docs.count(), 1)), seed=5)
    seen = some.mapInArrow(_survey(rules, column), "rule int, rows long, spent double, rejected long")
    found = seen.groupBy("rule").agg(F.sum("spent").alias("spent"), F.sum("rejected").alias("rejected")).collect()  # one row a rule
    worth = {r["rule"]: (r["rejected"] + 1e-3) / max(r["spent"], 1e-9) for r in found}
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-worth.get(i, 0.0), i))]


#: Measures that a cascade can report for every row.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def cascade(
    docs: DataFrame, rules: Sequence[Rule] = RULES, column: str = "text", report: Sequence[str] = (), rejected_by: str = "rejected_by",
) -> DataFrame:
    """Add ``rejected_by``, the first rule of ``rules`` that rejects the text, null if none does.

    Each rule only sees the texts that passed the ones before it. Measures named in ``report`` are
    computed for all rows and added as columns; rules then read them without cost. Whole texts are read in
    bounded chunks by a narrow map. Null counts as empty. Other columns pass through, repeated rows are
    judged alike; columns of the same names are replaced.
    """
    new = [*report, rejected_by]
    kept = [c for c in docs.columns if c not in new]
    fields = [docs.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in report] + [T.StructField(rejected_by, T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, CHUNK):
                whole = Texts(*flatten(part.column(part.schema.get_field_index(column))))
                measures = [pa.array(getattr(whole, name), pa.int64()) for name in report]
                verdict = np.full(whole.rows, None, object)
                left, alive = whole, np.arange(whole.rows)
                for rule in rules:
                    if not len(alive):
                        break
                    fails = rule.fails(whole)[alive] if set(rule.reads) <= set(report) else rule.fails(left)
                    verdict[alive[fails]] = rule.name
                    left, alive = left.only(~fails), alive[~fails]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(part.schema.get_field_index(c)) for c in kept], *measures, pa.array(verdict, pa.string())], [*kept, *new]
                )

    return docs.mapInArrow(run, T.StructType(fields))

