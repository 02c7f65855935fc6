"""Contextual personal data against the same rules on a whole graph in plain Python, without bounds or passes."""

import collections
import math
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from textsync.llm import pii, pipeline, toxicity

SPACES = r" \t\n\x0b\f\r"


def python_pattern(java):
    """White space is ASCII in the engine of the texts."""
    return regex.compile(regex.sub(r"(\[[^\]]*?)\\s", lambda m: m[1] + SPACES, java))


def seeded(value):
    digits = regex.sub("[^0-9]", "", value)
    if regex.fullmatch(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", value):
        return 1.0
    if regex.fullmatch(r"[0-9]+(\.[0-9]+){3}", value) and all(int(p) <= 255 for p in value.split(".")):
        return 1.0
    if regex.fullmatch(r"\+[0-9][ ().0-9-]+[0-9]", value) and 10 <= len(digits) <= 15:
        return 1.0
    opaque = len(value) >= 16 and regex.fullmatch("[A-Za-z0-9+/_=-]+", value) and regex.search("[A-Za-z]", value) and len(digits) >= 4
    return pii.OPAQUE if opaque else 0.0


def plain_contexts(texts, base_values):
    word, cue = python_pattern(pii.WORD), python_pattern(pii.CUE.replace(r"\x20", " "))
    edges, scores, places = collections.defaultdict(set), collections.defaultdict(float), collections.defaultdict(set)
    for value in base_values:
        scores[value] = 1.0
    for doc, text in enumerate(texts):
        found = [m.span() for m in word.finditer(text or "")]
        near = [text[a:b].lower() for a, b in found]
        for i, (a, b) in enumerate(found):
            for k, (x, y) in enumerate(pii.AROUND):
                pattern = (k, *(near[i + s] if 0 <= i + s < len(near) else None for s in (x, y)))
                edges[pattern].add(text[a:b])
                places[pattern].add((doc, a, b))
        for m in cue.finditer(text or ""):
            pattern = ("cue", m[1].lower() + m[2].strip(" "))
            edges[pattern].add(m[3])
            places[pattern].add((doc, m.end() - len(m[3]), m.end()))
            scores[m[3]] = max(scores[m[3]], seeded(m[3]))
    while True:
        sums = {p: sum(scores[v] for v in values) / (len(values) + pii.DOUBT) for p, values in edges.items() if len(values) >= pii.SUPPORT}
        trusted = {p: c for p, c in sums.items() if c >= pii.CONFIDENT}
        holding = collections.defaultdict(list)
        for p, c in trusted.items():
            for v in edges[p]:
                holding[v].append(c)
        lifted = {v: 1 - math.prod(max(1 - c, 1e-6) for c in held) for v, held in holding.items()}
        moved = {v: s for v, s in lifted.items() if s > scores[v] + 1e-6}
        scores.update(moved)
        if not moved:
            return {place for p in trusted for place in places[p]}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    filler = "the of and river stone walks slowly near old house with many small green birds under trees by a lake".split()

    def some(n):
        return " ".join(rng.choice(filler) for _ in range(n))

    def mail():
        return f"{rng.choice('abcdef')}{rng.randint(10, 99)}@mail.example"

    code = lambda: "".join(rng.choice("ABCDEFGH23456789") for _ in range(rng.randint(6, 9)))
    out = [f"{some(8)} write to {mail()} before noon {some(5)}" for _ in range(25)]
    out += [f"{some(4)} write to {code()} before noon, {some(3)}" for _ in range(8)]  # unknown values in a context of known ones
    shared = [code() for _ in range(6)]
    out += [f"{some(3)} write to {c} before noon. badge holder {c} enters {some(4)}" for c in shared]  # and a second context from them
    out += [f"{some(3)} badge holder {code()} enters {some(2)}" for _ in range(2)]
    out += [f"{some(2)} the {mail()} of {some(6)}" for _ in range(6)]  # known values between frequent words stay distrusted
    out += [f"user_id: k{code()}x{rng.randint(1000, 9999)}{code()} {some(3)}" for _ in range(5)] + [f"user_id: {code()} {some(3)}" for _ in range(2)]
    return out + [f"{some(400)}" for _ in range(6)] + [None, "", "= : x=", out[0]]


def test_bootstrapping(spark, texts, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = collections.defaultdict(set)
    for r in pii.spans(docs).collect():
        got[r["kind"] == pii.CONTEXT].add((r["doc_id"], r["start"], r["end"]))
    base_values = {texts[d][a:b] for d, a, b in got[False]}
    want = plain_contexts(texts, base_values)
    inside = {s for s in want if any(o != s and o[0] == s[0] and o[1] <= s[1] and s[2] <= o[2] for o in want)}
    assert got[True] == want - inside
    caught = {texts[d][a:b] for d, a, b in got[True]}
    assert len(caught - base_values) > 12 and not caught & {"the", "of", "and"}
    monkeypatch.setattr(pii, "SHARE", 2)  # a bound that rules patterns out, as on large tables
    again = {(r["doc_id"], r["start"], r["end"]) for r in pii.spans(docs).where("kind = 'context'").collect()}
    assert again == got[True]


def test_swaps_stay_stable_when_terms_are_frequent():
    terms = [t for group in toxicity.IDENTITY for t in group]
    found = np.concatenate([np.tile(toxicity.term_features([t]), (5_000, 1)) for t in terms])
    swaps = toxicity.Swaps(found, toxicity.IDENTITY, 100, 1.0)
    rng = np.random.default_rng(3)
    weights = rng.normal(0, 0.3, toxicity.BUCKETS)
    before, own = weights.copy(), swaps.terms[:, 0]
    for _ in range(60):
        worth = swaps.worth(weights)
        swaps.settle(weights)
        assert np.allclose(swaps.worth(weights), worth / (1 + swaps.pull), atol=1e-9)
    assert np.abs(swaps.worth(weights)).max() < 1e-6
    moved = np.flatnonzero(weights != before)
    assert set(moved) <= set(own.tolist())  # words that only begin alike are left alone


def test_stages_of_the_pipeline(spark):
    same = " ".join(f"word{i}" for i in range(40))
    other = " ".join(f"else{i}" for i in range(40))
    rows = [(1, same, "en", "a", 5), (2, same + " more", "en", "a", 5), (3, other, "en", "b", 5), (3, same, "en", "b", 5), (3, other, "en", "b", 5), (None, same, None, None, None), (None, same, None, None, None), (4, None, "en", None, 0), (5, "", "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.drop_near_copies(spark, docs, "")
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    # the texts of id 3 are two documents: one takes part in the comparison, the other stays as it is, and neither is lost unless it is a copy
    assert [g for g in got if g[0] != 3] == sorted([(1, same), (None, same), (None, same), (4, None), (5, "")], key=repr)
    assert (3, other) in got and len(got) == len(set(got)) + 1
    clean = {r["doc_id"]: r for r in pipeline.redact_personal(spark, docs.withColumn("text", F.concat("text", F.lit(" ask me@mail.example now"))), "").where("doc_id < 3").collect()}
    assert clean[1]["text"] == same + " ask [EMAIL] now" and clean[1]["n_chars"] == len(clean[1]["text"]) and clean[1].__fields__ == pipeline.COLUMNS
    mixed = collections.Counter((r["doc_id"], r["text"]) for r in pipeline.mix_sources(spark, docs, "").collect())
    assert set(mixed) <= {(r[0], r[1]) for r in rows}
    tokens = pipeline.tokenise(spark, docs, "").collect()
    assert len(tokens) == len(rows) and all((r["text"] or "") == r["text"] and len(r["ids"]) == r["n_tokens"] for r in tokens)
    assert collections.Counter(r["text"] for r in tokens) == collections.Counter(t or "" for _, t, *_ in rows)


def test_toxic_documents_leave_the_pipeline(spark, tmp_path):
    rng = random.Random(4)
    words = "garden window evening quiet paper river letter morning table small".split()
    rows, labels = [], []
    for i in range(160):
        bad = i % 4 == 0
        text = " ".join(rng.choices(words, k=12)) + (" you are all filthy worthless scum" if bad else " thank you kindly") + "."
        rows.append((i, text, "en", "a", len(text)))
        labels.append((i, 1, int(bad)))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows + [(None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    assert kept == {i for i in range(160) if i % 4} | {None}
