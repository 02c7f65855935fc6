"""Spelling variants, phrases and token links against plain Python, with the awkward cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from textsync.llm import crosstok, positional, variants


@pytest.fixture(scope="module")
def words_texts():
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdeéß×Ý") for _ in range(rng.randint(5, 9))) for _ in range(40)]
    every = base + [w[:i] + rng.choice("abcé") + w[i + 1 :] for w in base for i in (0, 3)] + [w[:2] + w[3:] for w in base] + [w + "a" for w in base]
    every += ["abcabc", "bcabca", "cabcab", "aabbcc", "a" * 7, "a" * 8, "a" * 9]
    texts = [" ".join(rng.choices(every, weights=[12] * len(base) + [1] * (len(every) - len(base)), k=400)) for _ in range(12)]
    texts += [None, "", " \n", "x" * 50_000 + " " + "Straße,ÉCOLES:naïvetés" * 5, "ABCABC abcabc Abcabc " * 4, "Ünder_ünderS1ünders"]
    return texts + texts[:2]


@pytest.fixture(scope="module")
def words_docs(spark, words_texts):
    rows = [(None if i == 3 else i % 15, t, "clash", -1) for i, t in enumerate(words_texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, word string, n long").repartition(3)


def counted_plainly(rows, damaged):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            crc = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if damaged and crc % damaged == 0:
                run = run[: crc % len(run)] + run[crc % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def edits(word, letters):
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    found = {a + b[1:] for a, b in cut if b} | {a + c + b[1:] for a, b in cut if b for c in letters} | {a + c + b for a, b in cut for c in letters}
    return found - {word}


def grouped_plainly(counts, ratio=5):
    letters, out, forms = set("".join(counts)), {}, {}
    for word, n in counts.items():
        near = sorted((-counts[w], w) for w in edits(word, letters) & counts.keys())
        forms[word] = (near[0][1] if near and -near[0][0] >= ratio * n else None, len(near))
    for word, (form, n_near) in forms.items():
        root = word
        while forms[root][0]:
            root = forms[root][0]
        out[word] = (form, root, counts[word], n_near, counts[form] if form else None)
    return out


@pytest.mark.parametrize("damaged", [None, 19])
def test_words_and_their_variants(words_docs, damaged):
    want = counted_plainly([(r["doc_id"], r["text"]) for r in words_docs.collect()], damaged)
    found = variants.words(words_docs, damaged=damaged)
    assert {r["word"]: r["n"] for r in found.collect()} == want
    got = {r["word"]: tuple(r)[1:] for r in variants.group(found).collect()}
    assert got == grouped_plainly(want) and any(form for form, *_ in got.values())


def test_variants_chains_ties_and_small_tries(spark, monkeypatch):
    monkeypatch.setattr(variants, "TRIE", 5)
    monkeypatch.setattr(variants, "QUERIES", 7)
    rng = random.Random(2)
    counts = {"".join(p): rng.choice([5, 25, 25, 125, 625]) for p in rng.sample(list(itertools.product("ab", repeat=7)), 90)}
    counts |= {"chained": 5, "chaine": 25, "chain": 125, "chai": 700, "é": 9, "éa": 9, "ab" * 40: 6, "ab" * 40 + "c": 40}
    df = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, root string").repartition(3)
    got = {r["word"]: tuple(r)[1:] for r in variants.group(df).collect()}
    assert got == grouped_plainly(counts)
    assert got["chained"][1] == "chai" and got["chained"][0] == "chaine"
    assert variants.group(df.limit(0)).count() == 0


def test_trie_in_small_steps(monkeypatch):
    monkeypatch.setattr(variants, "STATES", 3)
    rng = random.Random(5)
    found = list({"".join(rng.choice("abcz") for _ in range(rng.randint(1, 6))) for _ in range(300)})
    trie = variants.Trie(found)
    query, word = trie.near(found)
    got = {(found[q], trie.words[w]) for q, w in zip(query, word)}
    assert got == {(a, b) for a in found for b in edits(a, "abcz") & set(found)}


def test_one_edit():
    assert variants.one_edit("abc", "abxc") and variants.one_edit("abxc", "abc") and variants.one_edit("abc", "xbc") and variants.one_edit("", "a")
    assert not variants.one_edit("abc", "abc") and not variants.one_edit("abc", "acb") and not variants.one_edit("ab", "abcd")


@pytest.fixture(scope="module")
def phrase_tables(spark):
    rng = random.Random(4)
    vocabulary = ["the"] * 12 + [f"w{i}" for i in range(30)] + ["éa", "Ü9"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 30, 200]))) for _ in range(40)] + ["the " * 500, None, "", "?!", "One-two THREE"]
    cut = [" ".join(t.split()[5:18]) for t in texts[:20] if t and len(t.split()) > 20]
    items = [*cut, cut[0], "THE the the", "three", None, "", "the " * 30, "w1 nowhere w2", "one two three", " ".join(f"w{i}" for i in range(12))]
    docs = [(None if i == 2 else i // 2, t, "x", 0) for i, t in enumerate(texts)]
    named = [(None if i == 1 else i, t, 5) for i, t in enumerate(items)] + [(7, items[7], 6)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, item_ids string, n_hit long").repartition(3),
        spark.createDataFrame(named, "item_id long, text string, phrase long").repartition(2),
    )


def plain_words(text):
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("k", [3, 10])
def test_contamination(phrase_tables, k):
    docs, items = phrase_tables
    wanted = collections.defaultdict(set)
    for r in items.collect():
        w = plain_words(r["text"])
        n = min(k, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wanted[tuple(w[i : i + n])].add(r["item_id"])
    want = []
    for r in docs.collect():
        w, hit, ids = plain_words(r["text"]), set(), set()
        for n in {len(p) for p in wanted}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wanted:
                    hit |= set(range(i, i + n))
                    ids |= wanted[tuple(w[i : i + n])]
        ids = sorted(str(i) for i in ids if i is not None)
        want.append((r["doc_id"], len(w), len(hit), len(ids), ids, bool(hit)))
    got = [tuple(r) for r in positional.contamination(docs, items, words=k).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(n for _, _, n, *_ in got)
    assert positional.contamination(docs.limit(0), items).count() == 0
    assert positional.contamination(docs, items.limit(0)).where("contaminated").count() == 0


def test_proximity(phrase_tables):
    docs, items = phrase_tables
    held, wanted = positional.index(docs), positional.phrases(items, "item_id", 3)
    terms = {r["phrase"]: r["terms"] for r in wanted.collect()}
    hashes = {w: int(positional.words_of(positional.pa.array([w]))[0][0]) for r in docs.collect() for w in plain_words(r["text"])}
    want = []
    for r in docs.collect():
        w = [hashes[x] for x in plain_words(r["text"])]
        for phrase, needed in terms.items():
            ranges = {(i, min(j for j in range(i + 1, min(len(w), i + len(needed) + 2) + 1) if set(needed) <= set(w[i:j]))) for i in range(len(w)) if set(needed) <= set(w[i : i + len(needed) + 2])}
            shortest = sorted(x for x in ranges if not any(y != x and x[0] <= y[0] and y[1] <= x[1] for y in ranges))
            if shortest:
                want.append((r["doc_id"], phrase, [a for a, _ in shortest], [b for _, b in shortest]))
    got = [(r["doc_id"], r["phrase"], r["starts"], r["ends"]) for r in positional.search(held, wanted, slop=2).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and got


FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN


def linked_plainly(rows):
    a_side = tokenizers.Tokenizer.from_file(FILES[0])
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    letter = crosstok.letters_of_bytes()
    found, held = [], collections.Counter()
    for doc_id, text in rows:
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        bytes_a = [bytes(letter[c] for c in a_side.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(bytes_a) != b" " + text.encode() or b"".join(bytes_b) != b" " + text.encode():
            found.append((doc_id, 0, 0, 0, [], ""))
            continue
        end_a, end_b = (list(itertools.accumulate(map(len, x))) for x in (bytes_a, bytes_b))
        cuts = sorted(set(end_a) & set(end_b))
        group = lambda end: sum(c < end for c in cuts)
        sides = [collections.defaultdict(list), collections.defaultdict(list)]
        for side, ids, ends in zip(sides, (a, b), (end_a, end_b)):
            for i, end in zip(ids, ends):
                side[group(end)].append(str(i))
        links = [
            (x, y) for x, tx, ex in zip(a, bytes_a, end_a) for y, ty, ey in zip(b, bytes_b, end_b) if max(ex - len(tx), ey - len(ty)) < min(ex, ey)
        ]
        held.update(set(links))
        digest = hashlib.sha256(";".join(",".join(sides[0][g]) + "|" + ",".join(sides[1][g]) for g in range(len(cuts))).encode()).hexdigest()
        found.append((doc_id, len(a), len(b), len(cuts), links, digest))
    best = collections.Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return [(i, n_a, n_b, n_g, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), d) for i, n_a, n_b, n_g, links, d in found]


def test_token_links(spark, monkeypatch):
    rng = random.Random(9)
    words = ["the", "walking", "Straße", "naïve", "日本語", "12345", "<|endoftext|>", "<s>", "▁x", "x y", "😀", "don't", "\t\t", "\n\n", "  ", "aaa", "é"]
    texts = [" ".join(rng.choices(words, k=k)) for k in (1, 5, 40, 40, 60)] + [None, "", " ", "a", "\x00b", "z" * 300, "aa" * 40 + "a", " lead", "trail "]
    rows = [(None if i == 4 else i % 12, t, -5) for i, t in enumerate(texts + texts[:3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a long").repartition(3)
    got = [tuple(r) for r in crosstok.align(docs, *FILES).collect()]
    assert sorted(got, key=repr) == sorted(linked_plainly([(i, t) for i, t, _ in rows]), key=repr)
    assert crosstok.align(docs.limit(0), *FILES).count() == 0


def test_long_runs_are_encoded():
    both = crosstok.pair(*FILES)
    for text in (" " * 1_200_000 + "x", "ab" * 60_000):
        assert both._ids(text) == crosstok._reference(FILES[0]).encode(text, add_special_tokens=False).ids


def test_shards_in_small_steps(monkeypatch):
    both, texts = crosstok.pair(*FILES), ["walking naïve", None, "", "the the naïve Straße"]
    monkeypatch.setattr(crosstok, "CHUNK", 1)
    kind = positional.pa.schema([(c.split(" ")[0], {"int": "int32", "long": "int64", "string": "string"}.get(c.split(" ")[1]) or positional.pa.list_(positional.pa.int32() if "int" in c else positional.pa.int64())) for c in crosstok.ROWS.split(", ")])
    pieces = [(positional.pa.array([i], positional.pa.int64()), [t or ""]) for i, t in enumerate(texts)]
    held = np.zeros(len(both.bytes_a), np.int64)
    rows = [r for b in crosstok._shard(3, pieces, both, held, kind) for r in b.to_pylist()]
    assert [r["kind"] for r in rows] == [0, 0, 0, 0, 1] and rows[-1]["pairs"] == sorted(rows[-1]["pairs"]) and max(rows[-1]["holders"]) == 2
    assert held.sum() + sum(rows[-1]["holders"]) == sum(len(r["codes"]) for r in rows[:-1])
