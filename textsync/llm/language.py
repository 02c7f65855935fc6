"""Language identification by a byte convolutional network trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textsync.llm.flat import flatten, slices
from textsync.llm.labelled import labelled_texts

#: Bytes of a window; widths of the filters; filters of each width; windows passed through at once.
WINDOW, WIDTHS, FILTERS, BATCH = 256, (2, 3, 4), 16, 512
PAD, UNKNOWN = 0x20, "und"
ASCII = np.zeros(256, bool)
ASCII[[*range(65, 91), *range(97, 123)]] = True


@dataclass
class Network:
    """Filters over one-hot bytes, the maximum of each over a window, and a softmax over languages."""

    languages: list[str]
    filters: list[np.ndarray]  # for each width: (width, 256, FILTERS)
    shifts: np.ndarray  # (widths * FILTERS,)
    output: np.ndarray  # (widths * FILTERS, languages)
    bias: np.ndarray  # (languages,)

    @cached_property
    def tables(self) -> list[list[np.ndarray]]:
        """Filters as sums over byte pairs, so that a position costs one look-up for every two bytes."""
        out = []
        for f in self.filters:
            f = f.astype(np.float32)
            pairs = [(f[i][:, None, :] + f[i + 1][None, :, :]).reshape(65536, -1) for i in range(0, len(f) - 1, 2)]
            out.append(pairs + ([f[-1]] if len(f) % 2 else []))
        return out

    def pooled(self, windows: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest value of every filter in each window, and where it is."""
        x = windows.astype(np.int32)
        pair = x[:, :-1] << 8 | x[:, 1:]
        tops, where = [], []
        for width, tables in zip(WIDTHS, self.tables):
            n = x.shape[1] - width + 1
            value = tables[0].take(pair[:, :n], 0)
            for i, table in enumerate(tables[1:], 1):
                value += table.take((x if len(table) == 256 else pair)[:, 2 * i : 2 * i + n], 0)
            if places:
                at = value.argmax(1)
                where.append(at)
                tops.append(np.take_along_axis(value, at[:, None, :], 1)[:, 0])
            else:
                tops.append(value.max(1))
        return np.concatenate(tops, 1) + self.shifts, np.concatenate(where, 1) if places else None

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(windows), len(self.languages)))
        for at in range(0, len(windows), BATCH):
            hidden = np.maximum(self.pooled(windows[at : at + BATCH])[0], 0)
            out[at : at + BATCH] = _log_softmax(hidden @ self.output + self.bias)
        return out


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def text_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of every text in windows of fixed length, the last one filled with spaces; and each window's text."""
    length = np.diff(offsets)
    count = -(-length // WINDOW)
    text = np.repeat(np.arange(len(length)), count)
    out = np.full((len(text), WINDOW), PAD, np.uint8)
    row = np.repeat(np.cumsum(count) - count, length) * WINDOW + np.arange(len(data)) - np.repeat(offsets[:-1], length)
    out.reshape(-1)[row] = data
    return out, text


def fit(texts: Sequence[tuple[str, str]], rounds: int = 10, per_language: int = 1500, seed: int = 7) -> Network:
    """Train on labelled texts: up to ``per_language`` windows a language, spread over its texts."""
    rng = np.random.default_rng(seed)
    languages = sorted({language for _, language in texts})
    network = Network(
        languages,
        [rng.normal(0, 0.1, (w, 256, FILTERS)) for w in WIDTHS],
        np.zeros(len(WIDTHS) * FILTERS),
        rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))),
        np.zeros(len(languages)),
    )
    if len(languages) < 2:
        return network
    data, offsets = flatten(pa.array([t for t, _ in texts], pa.large_string()))
    windows, text = text_windows(data, offsets)
    label = np.searchsorted(languages, [language for _, language in texts])[text]
    chosen = np.concatenate([rng.permutation(np.flatnonzero(label == i))[:per_language] for i in range(len(languages))])
    cells = [*network.filters, network.shifts, network.output, network.bias]
    mean, square = [np.zeros_like(c) for c in cells], [np.zeros_like(c) for c in cells]
    step = 0
    for _ in range(rounds):
        order = rng.permutation(chosen)
        for at in range(0, len(order), 128):
            batch = order[at : at + 128]
            x, y = windows[batch], label[batch]
            network.__dict__.pop("tables", None)
            top, where = network.pooled(x, places=True)
            hidden = np.maximum(top, 0)
            slope = np.exp(_log_softmax(hidden @ network.output + network.bias))
            slope[np.arange(len(y)), y] -= 1
            slope /= len(y)
            back = (slope @ network.output.T) * (top > 0)
            grads = [np.zeros_like(f) for f in network.filters]
            for k, width in enumerate(WIDTHS):
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                for j in range(width):
                    seen = np.take_along_axis(x, where[:, own] + j, 1)
                    np.add.at(grads[k][j], (seen, np.arange(FILTERS)), back[:, own])
            grads += [back.sum(0), hidden.T @ slope, slope.sum(0)]
            step += 1
            for i, (cell, grad) in enumerate(zip(cells, grads)):
                mean[i] = 0.9 * mean[i] + 0.1 * grad
                square[i] = 0.99 * square[i] + 0.01 * grad**2
                cell -= 0.01 * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8)
    network.__dict__.pop("tables", None)
    return network


def train(docs: DataFrame, per_label: int = 300, longest: int = 20_000, **options) -> Network:
    """Fit on a bounded sample of ``docs(doc_id, text, lang)`` that are not held out: at most ``per_label``
    documents of at most ``longest`` characters a language, for the 200 most frequent languages; others are never
    learnt and never predicted. Null languages teach nothing."""
    known = docs.select("doc_id", F.col("lang").alias("label"))
    return fit(labelled_texts(docs, known, per_label, longest), **options)


def predict(network: Network, cells: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and its probability of each text: windows vote with their mean log probability, weighted by
    how many of their bytes can be letters."""
    data, offsets = flatten(cells)
    windows, text = text_windows(data, offsets)
    letters = ASCII[windows] | (windows >= 128)
    weight = letters.sum(1) + 1e-3
    total = np.zeros((len(cells), max(len(network.languages), 1)))
    if network.languages:
        np.add.at(total, text, network.log_probabilities(windows) * weight[:, None])
    total /= np.maximum(np.bincount(text, weight, minlength=len(cells)), 1e-3)[:, None]
    chance = np.exp(_log_softmax(total))
    best = chance.argmax(1)
    sure = np.bincount(text, ASCII[windows].any(1), minlength=len(cells)) > 0
    named, score = [], chance[np.arange(len(cells)), best]
    for i in range(len(cells)):
        lettered = sure[i] or any(c.isalpha() for c in cells[i].as_py() or "")
        named.append(network.languages[best[i]] if lettered and network.languages else UNKNOWN)
        score[i] = score[i] if named[-1] != UNKNOWN or lettered and network.languages else 0.0
    return named, score


def identify(docs: DataFrame, network: Network, column: str = "text", name: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1) to every row from its whole text alone.

    A narrow map in bounded chunks; the network, of fixed size, goes to the tasks with the function. Null
    texts and texts without a letter are ``und`` with score 0. Other columns pass through, those of the same
    names are replaced."""
    kept = [c for c in docs.columns if c not in (name, score)]
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, 1 << 20):
                named, sure = predict(sent.value, part.column(part.schema.get_field_index(column)))
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in kept], pa.array(named, pa.string()), pa.array(sure, pa.float64())], [*kept, name, score])

    return docs.mapInArrow(run, T.StructType([docs.schema[c] for c in kept] + [T.StructField(name, T.StringType()), T.StructField(score, T.DoubleType())]))
