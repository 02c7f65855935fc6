"""Toxicity: a linear sentence classifier, regularised by counterfactual identity terms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textsync.llm.flat import Spans, flatten, mixed, slices
from textsync.llm.labelled import labelled_texts

#: Text bytes scored together; buckets of hashed features; bytes of the word beginnings that are features.
CHUNK, BUCKETS, PREFIXES = 1 << 20, 1 << 20, (4, 5, 6)
#: Identity terms by kind; a term of a kind may stand for any other of it.
IDENTITY = (
    ("women", "men", "woman", "man", "girls", "boys"),
    ("black", "white", "asian", "african", "latino", "arab"),
    ("muslims", "christians", "jews", "hindus", "atheists", "muslim", "christian", "jewish"),
    ("gay", "lesbian", "straight", "trans", "bisexual"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs"),
    ("frauen", "männer", "muslime", "christen", "juden"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos"),
)
LETTER, STOP = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256), 39]] = True
STOP[[10, 33, 46, 63]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the accented capitals that two bytes of UTF-8 hold."""
    out = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    accented = np.zeros(len(data), bool)
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[accented] += np.uint8(32)
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of every sentence: their features, and their sentence; and the document of each sentence.

    A word is a run of letters; its features are buckets of the whole word and of its beginnings. A
    sentence ends at a stop or a line's end. Sentences are numbered through; an empty document has none.
    """
    data = lowered(data)
    cut = np.flatnonzero(STOP[data]) + 1
    begins = np.unique(np.concatenate([offsets[:-1], cut]))
    begins = begins[begins < len(data)]  # an empty document has no sentence
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[begins] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    start, end = np.flatnonzero(inside & (~before | edge)), np.flatnonzero(before & (~inside | edge))
    sentence = np.searchsorted(begins, start, "right") - 1
    spans = Spans(data)
    whole = spans.hashes(start, end)
    _, first = np.unique(mixed(whole ^ mixed(sentence.astype(np.uint64))), return_index=True)
    first.sort()
    start, end, sentence = start[first], end[first], sentence[first]
    columns = [whole[first], *[mixed(spans.hashes(start, np.minimum(start + p, end)) + np.uint64(p)) for p in PREFIXES]]
    document = np.searchsorted(offsets, begins, "right") - 1
    return (np.stack(columns, 1) % np.uint64(BUCKETS)).astype(np.int32), sentence, document


def term_features(terms: Sequence[str]) -> np.ndarray:
    cells = pa.array(terms)
    found, _, _ = features(*flatten(cells))
    return found


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, cells: pa.Array) -> np.ndarray:
        """Score of each text: that of its worst sentence. Null and empty texts score as an empty sentence."""
        data, offsets = flatten(cells)
        found, sentence, document = features(data, offsets)
        logit = np.bincount(sentence, self.weights[found].sum(1), minlength=len(document)) + self.bias
        worst = np.full(len(cells), -np.inf)
        np.maximum.at(worst, document, logit)
        worst = np.where(np.isinf(worst), self.bias, worst)
        return 1 / (1 + np.exp(-np.clip(worst, -40, 40)))


class Swaps:
    """Counterfactuals of the labelled sentences, and the step that takes their score changes back.

    A sentence with an identity term is paired with itself under every other term of that kind; and every term is
    put into ``inserted`` sentences that lack it, against the sentence without. As a sentence's score is a sum
    over its words, a pair's score change is the difference of what the two terms add, whatever the sentence;
    so pairs need only be counted.
    """

    def __init__(self, found: np.ndarray, groups: Sequence[Sequence[str]], inserted: int, penalty: float):
        self.terms = term_features([t for group in groups for t in group])
        self.kind = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        held = np.array([int((found[:, 0] == t[0]).sum()) for t in self.terms])
        self.pull = penalty * (1 + held / inserted)
        # what a step on the terms' own buckets adds to each term: the unit matrix, but for buckets that terms share
        shared = (self.terms[:, None, :] == self.terms[:, 0][None, :, None]).sum(2)
        self.own = np.linalg.pinv(shared.astype(float))

    def worth(self, weights: np.ndarray) -> np.ndarray:
        return weights[self.terms].sum(1)

    def settle(self, weights: np.ndarray) -> None:
        """One proximal step on the squared score changes: what a term adds shrinks to nothing, and so to what the other terms
        of its kind add, in proportion to how many pairs it is in.

        Only the buckets of the whole terms move, so words that merely begin alike keep their weights. The steps solve one
        linear system, which leaves every term with just the worth wanted, so the step is stable at any strength."""
        worth = self.worth(weights)
        np.add.at(weights, self.terms[:, 0], self.own @ (worth / (1 + self.pull) - worth))


def _features_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`features` of many texts, computed in bounded chunks."""
    parts, sentences, documents = [], 0, 0
    for part in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"]), "text", CHUNK):
        found, sentence, document = features(*flatten(part.column(0)))
        parts.append((found, sentence + sentences, document + documents))
        sentences, documents = sentences + len(document), documents + part.num_rows
    return tuple(np.concatenate(column) for column in zip(*parts))


def _holders(found: np.ndarray, document: np.ndarray) -> np.ndarray:
    """How many documents hold each bucket, counted for some hundred documents at a time; ``document`` of each word ascends."""
    held = np.zeros(BUCKETS, np.int64)
    edges = np.searchsorted(document, np.arange(0, (document[-1] if len(document) else -1) + 201, 200))
    for a, b in zip(edges[:-1], edges[1:]):
        own = np.unique(document[a:b, None].astype(np.int64) * BUCKETS + found[a:b])
        held += np.bincount(own % BUCKETS, minlength=BUCKETS)
    return held


def fit(
    texts: Sequence[tuple[str, int]], groups: Sequence[Sequence[str]] = IDENTITY, penalty: float = 1.0, inserted: int = 100, rounds: int = 60, rate: float = 0.25, decay: float = 1e-5,
) -> Model:
    """Learn from labelled documents, whose label says that some sentence is toxic.

    A document's logit is a weighted mean of its sentences' logits, weighted towards the highest, more so
    with each round; that of a toxic document is to be high, that of a clean one low. Added to the log loss
    is a penalty on the squared change of score under the swaps of identity terms (:class:`Swaps`), so that naming
    a group does not by itself move the score. Without both labels the model is a constant.
    """
    labels = np.array([y for _, y in texts], float)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS), 4.0 if len(labels) and labels[0] else -4.0)
    found, sentence, document = _features_of([t for t, _ in texts])
    n, docs = len(document), len(labels)
    swaps = Swaps(found, groups, inserted, penalty)
    share = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (docs - labels.sum())) * docs
    columns = found.T.copy()  # one feature of all words at a time: a pass holds one number a word, not one a feature
    weights, bias, speed, speed_b = np.zeros(BUCKETS), -2.0, np.zeros(BUCKETS), 0.0
    # a bucket's step shrinks with the share of documents that hold it, so that common words stay stable
    step = rate / (_holders(found, document[sentence]) / docs + 0.05)
    for turn in range(rounds):
        worth = np.zeros(len(sentence))
        for column in columns:
            worth += weights[column]
        logit = np.bincount(sentence, worth, minlength=n) + bias
        top = np.full(docs, -np.inf)
        np.maximum.at(top, document, logit)
        heat = 0.5 + 4.0 * turn / rounds
        attention = np.exp(heat * (logit - top[document]))
        attention /= np.bincount(document, attention, minlength=docs)[document]
        score = 1 / (1 + np.exp(-np.clip(np.bincount(document, attention * logit, minlength=docs), -40, 40)))
        error = share * (score - labels) / docs
        slope = attention * error[document]
        gradient = decay * weights
        each = slope[sentence]
        for column in columns:
            gradient += np.bincount(column, each, minlength=BUCKETS)
        speed, speed_b = 0.9 * speed - step * gradient, 0.9 * speed_b - rate * slope.sum()
        weights, bias = weights + speed, bias + speed_b
        swaps.settle(weights)
    return Model(weights, float(bias))


def train(docs: DataFrame, labels: DataFrame, per_label: int = 1500, longest: int = 20_000, **options) -> Model:
    """Fit on a bounded sample of labelled documents that are not held out (``labels(doc_id, toxic)``).

    The bound is ``per_label`` documents of at most ``longest`` characters a label. Only texts and labels
    are read. Null labels teach nothing; of several labels of one document the highest counts."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("label IN (0, 1)")
    return fit(labelled_texts(docs, known, per_label, longest), **options)


def score(docs: DataFrame, model: Model, column: str = "text", name: str = "score") -> DataFrame:
    """Add ``score`` (0 to 1) to every row: a narrow map over whole texts in bounded chunks.

    The model, a vector of fixed length, goes to the tasks with the function. Other columns pass through; one
    named ``score`` is replaced; null and empty texts have a score, too."""
    kept = [c for c in docs.columns if c != name]
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in batches:
            for part in slices(batch, column, CHUNK):
                made = pa.array(own.scores(part.column(part.schema.get_field_index(column))), pa.float64())
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in kept], made], [*kept, name])

    return docs.mapInArrow(run, T.StructType([docs.schema[c] for c in kept] + [T.StructField(name, T.DoubleType())]))
