"""Operators on texts against plain Python, with the awkward cases: nulls, empty and long texts, ties, repeats."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from textsync.llm import bpe, flat, graph, labelled, language, mixing, nearcopies, pii, quality, substrings, topk, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = [("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7)))) for _ in range(80)]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    base = text(120)
    out = [None, "", "  \n\t ", "a", "A b", text(30), text(30) + "\n" + text(9), base, base, base.upper()]
    out += [" ".join(w for i, w in enumerate(base.split(" ")) if i % 120 != k) for k in range(12)]
    out += ["la " * 300, ("one line here\n" * 9).strip(), "### $$$ | <a> & b * c", text(20_000), "😀 naïve ÉCOLE \x85 end"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 5 == 0 else f"s{i % 3}", "clash") for i, t in enumerate(texts)] + [(9, texts[9], "s0", "again")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(3)


def shingles(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


@pytest.mark.parametrize("k", [2, 5])
def test_near_copies(docs, texts, k):
    sets = [shingles(t, k) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[b]:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r for r in nearcopies.near_copies(docs, words=k).collect()}
    assert len(got) == len(texts)
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}


def test_near_copies_of_nothing(spark):
    assert nearcopies.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [1, 5, 40, 700])
def test_super_minhash_estimates_similarity(n):
    rng = np.random.default_rng(n)
    found, true = [], []
    for _ in range(30):
        pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[n // 4 : n + n // 4])
        signature = nearcopies.super_minhash([a, b, np.zeros(0, np.uint64)], 252)
        found.append((signature[0] == signature[1]).mean())
        true.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert (signature[2] == np.uint64(2**64 - 1)).all()
    assert abs(np.mean(found) - np.mean(true)) < 0.02


@pytest.mark.parametrize("block", [nearcopies.BLOCK, 7])
def test_what_hubs_leave_open_loses_no_link(spark, monkeypatch, block):
    """Texts around a centre that is not the hub: most pairs are just under the threshold, some just over."""
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    monkeypatch.setattr(nearcopies, "COLUMNS", 64)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(w if rng.random() > 0.06 else f"x{rng.randrange(200)}" for w in base) for _ in range(90)]
    texts += [" ".join(base[:k]) for k in (60, 81, 99, 100)]
    sets = [shingles(t, 2) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(frame).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    assert len(set(got.values())) > 2


def test_neighbouring_bins_are_one_cluster(spark):
    """One bucket: x is in the bin of hub and y, y in that of x and w, whose least documents differ; only x and y are linked."""
    words = [f"w{i}" for i in range(100)]
    place = nearcopies.super_minhash(nearcopies.shingle_sets(pa.array(words), 1), 1)[:, 0]
    words = [words[i] for i in np.argsort(place)]  # the least is in all texts: they share the one place
    texts = {1: words, 10: words[:61], 11: words[:59], 2: words[:30]}
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(frame, words=1, bands=1, places=1).collect()}
    assert got == {1: 1, 2: 2, 10: 10, 11: 10}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, x) for x in range(5001, 5200)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    rows = graph.components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long").repartition(4)).collect()
    assert {r["node"]: r["component"] for r in rows} == {x: find(x) for x in parent}


def test_quality(docs, texts):
    def brute(text):
        words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
        runs = collections.defaultdict(list)
        for i in range(len(words) - 7):
            runs[tuple(words[i : i + 8])].append(i)
        covered = {i + k for v in runs.values() if len(v) > 1 for i in v for k in range(8)}
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)

    for rules in (quality.RULES, tuple(reversed(quality.RULES))):
        rows = quality.cascade(docs, rules, report=quality.REPORTED).collect()
        assert len(rows) == len(texts) + 1
        for r in rows:
            assert tuple(r[c] for c in quality.REPORTED) == brute(texts[r["doc_id"]])
        alone = {r["doc_id"]: r["rejected_by"] is None for r in quality.cascade(docs, rules).collect()}
        assert alone == {r["doc_id"]: r["rejected_by"] is None for r in rows}
    assert set(quality.plan(docs)) == set(quality.RULES)


def test_bpe(docs, texts):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.vocabulary(path)[0], special_tokens={})
    extra = docs.sparkSession.createDataFrame([(100, "a" * 3000 + " " * 900), (101, "<|endoftext|> it's 1234 中文字字字"), (102, "0123456789" * 30)], "doc_id long, text string")
    rows = bpe.decode(bpe.encode(docs.select("doc_id", "text").unionByName(extra), path, pattern), path).collect()
    assert len(rows) == len(texts) + 4
    for r in rows:
        assert r["ids"] == own.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_bpe_trees_agree():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.vocabulary(path)[0]
    pieces = [x for x in (b"thsheenq", b"aaaaaaaaaaaa", b"xqzjxqzj", "éèêß".encode()) if x not in ranks]
    for piece in pieces:
        ids, count = bpe.merge_pieces([piece, piece], path)
        assert ids.tolist() == bpe.merge_piece(piece, ranks) * 2 and count.tolist() == [len(ids) // 2] * 2


def strings(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        yield len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()


@pytest.mark.parametrize("hot", [substrings.HOT, 3])
def test_repeated_strings(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    rng = random.Random(11)

    def text(n):
        return "".join(rng.choice("abcdé ") for _ in range(n))

    shared = [text(n) for n in (150, 199, 200, 201, 600)]
    texts = [None, "", "x" * 199, "x" * 200, "y" * 700, "ab" * 300]
    texts += [text(rng.randrange(300)) + rng.choice(shared) + text(rng.randrange(200)) + rng.choice(shared)[: rng.randrange(400)] for _ in range(30)]
    texts += texts[8:11]
    long = text(2000)
    texts += [long[:i] + "#" + long[i:] for i in range(100, 2000, 400)]
    rows = [(i, t, "extra") for i, t in enumerate(texts)]
    got = substrings.repeated_strings(spark.createDataFrame(rows, "doc_id long, text string, one string").repartition(3)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == dict(enumerate(strings([(t or "").encode() for t in texts], 200)))


@pytest.mark.parametrize("letters", [b"ab", b"abcdefgh"])
def test_deep_shallow(letters):
    rng = random.Random(len(letters))
    for length in (64, 200):
        base = bytes(rng.choice(letters) for _ in range(900))
        data = np.frombuffer(base + base[:400] + b"ab" * 200 + base[200:700], np.uint8)
        start = np.arange(len(data) - length)
        group = np.array([rng.randrange(3) for _ in start])
        order, equal = substrings.deep_shallow(data, start, group, length)
        keys = [(group[i], bytes(data[start[i] : start[i] + length])) for i in order]
        assert keys == sorted(keys)
        assert equal.tolist() == [False] + [a == b for a, b in zip(keys, keys[1:])]


def test_very_long_text_has_the_same_anchors():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 101, 50_000, dtype=np.uint8)
    whole = substrings.anchors(data, np.array([0, len(data)]), 200)
    cut = [substrings.anchors(data[a : a + 20_000 + 199], np.array([0, len(data[a : a + 20_000 + 199])]), 200) for a in range(0, len(data) - 199, 20_000)]
    covered = sorted((f + a + i, p + a) for a, (_, first, last, place, _) in zip(range(0, len(data), 20_000), cut) for f, l, p in zip(first, last, place) for i in range(l - f + 1))
    assert covered == sorted((f + i, p) for f, l, p in zip(*whole[1:4]) for i in range(l - f + 1))


def test_personal_data(spark):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, found):
        digits = re.sub("[^0-9]", "", found)
        total = sum((v := int(c) * (1 + i % 2)) - 9 * (v > 9) for i, c in enumerate(reversed(digits)))
        return {"email": True, "ip": all(int(p) <= 255 for p in found.split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and total % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]

    texts = [
        None, "", "a@b.com_x@y.com 😀 1.2.3.4.5.6.7.8 +1 (555) 123-4567 4111 1111 1111 1111-000", "4111 1111 1111 1111, 4111111111111112 é@é.fr x@y a..b@c-d.e.f. 999.1.1.1 +12+345 678 901 23",
        "+1 (555) 123-4567", "000.0255.1.07 3.3.3.256", "7" * 5000 + " " + "ab" * 5000 + "@",
    ]
    texts += [f'words password={i:02d}af9c31d{i}77e01bd more token = "{i}f8be0a91{i}c2d4e6f81" note: plainwords{"abc"[i % 3]}' for i in range(16)] + ["password=short1x then"]
    rows = [(i, t, "kept") for i, t in enumerate(texts)] + [(4, texts[4], "kept"), (None, "z@z.zz", "kept")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = pii.per_document(frame).collect()
    assert len(found) == len(rows)
    for r in found:
        want = sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(kinds.items()) for m in re.finditer(p, r["text"] or "") if good(k, m[0]))
        assert [(s["start"], s["place"] - 1, s["end"], s["kind"]) for s in r["spans"] if s["kind"] != pii.CONTEXT] == want
    context = [r["text"][s["start"] : s["end"]] for r in found for s in r["spans"] if s["kind"] == pii.CONTEXT]
    assert "short1x" in context and len(context) == 33 and not any("plain" in c for c in context)
    clean = {r["doc_id"]: r["text"] for r in pii.redact(frame).collect()}
    assert clean[4] == "[PHONE]" and clean[0] is None and clean[1] == "" and clean[23] == "password=[CONTEXT] then"


def test_long_values_are_redacted_whole(spark):
    """Keys of 200 characters that share their first 190: the whole value is one span, and each is a node of its own."""
    values = ["Qx7" * 60 + "abcdefghij" + f"{i:03d}END4567" for i in range(5)]
    frame = spark.createDataFrame([(i, f"apikey={v} tail{i}") for i, v in enumerate(values)], "doc_id long, text string")
    assert {r["text"] for r in pii.redact(frame).collect()} == {f"apikey=[CONTEXT] tail{i}" for i in range(5)}


def test_seeds_in_running_text_induce_patterns(spark):
    """Emails teach 'reach me at', that teaches the handles found there, and those teach 'pager code'; no cue anywhere."""
    texts = [f"Please reach me at u{i}@mail{i}.example, thanks" for i in range(9)]
    texts += [f"You may reach me at hnd{i}Zq now{i} or" for i in range(3)]
    texts += [f"the old pager code hnd{i}Zq rang{i} ok" for i in range(3)] + ["an old pager code (k7Lost) rings here", "no code k9Free for x7"]
    texts += [f"we walk at noon{i} on day{i}" for i in range(5)]
    frame = spark.createDataFrame([*enumerate(texts), (9, texts[9]), (None, texts[9])], "doc_id long, text string")
    rows = pii.per_document(frame).collect()
    found = {r["text"][s["start"] : s["end"]] for r in rows for s in r["spans"] if s["kind"] == pii.CONTEXT}
    assert {x for x in found if "@" not in x} == {"hnd0Zq", "hnd1Zq", "hnd2Zq", "k7Lost"}
    assert len(rows) == len(frame.collect()) and all(len([s for s in r["spans"] if s["kind"] == pii.CONTEXT]) == 1 for r in rows if "hnd0Zq" in r["text"])
    assert "an old pager code ([CONTEXT]) rings here" in {r["text"] for r in pii.redact(frame).collect()}


def test_rounds_go_on_while_patterns_are_new(spark):
    """Pattern k holds blocks k and k + 1 of values, each half as large: the last is confident after more than five rounds."""
    blocks = [range(1000 * k, 1000 * k + n) for k, n in enumerate((96, 48, 24, 12, 6, 3))]
    edges = spark.createDataFrame([(k, v) for k in range(5) for b in blocks[k : k + 2] for v in b] + [(9, v) for v in range(5000, 5040)], "pattern long, value long")
    patterns, scores = pii._scored(edges, spark.createDataFrame([(v, 1.0) for v in blocks[0]], "value long, score double"))
    assert {r["pattern"] for r in patterns.collect()} == set(range(5))
    assert {r["value"] for r in scores.where("score > 0.6").collect()} == {v for b in blocks for v in b}


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([0, 3, 3, 50, 400])), rng.choice(["a", "a", "a", "b", "c", None]), 1.5) for i in range(600)]
    rows += [(600, None, "b", 1.0), rows[5]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, target double").repartition(5)
    got = mixing.mix(frame).collect()
    assert len(got) == len(rows)
    again = sorted((r["doc_id"], r["taken"]) for r in mixing.mix(frame.repartition(2)).collect())
    assert sorted((r["doc_id"], r["taken"]) for r in got) == again
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    total, weights = 1.5 * sum(size.values()), dict(zip(sorted(size, key=lambda s: (s is None, s or "")), [3, 1, 2] * 9))
    goal, free = {}, dict(weights)
    while free:
        left = total - sum(goal.values())
        over = [s for s in free if left * free[s] / sum(free.values()) > 2 * size[s]]
        if not over:
            goal |= {s: left * w / sum(free.values()) for s, w in free.items()}
            break
        for s in over:
            goal[s] = 2 * size[s]
            free.pop(s)
    for s in size:
        assert abs(target[s] - goal[s]) < 1e-6 * total
        assert abs(taken[s] - target[s]) <= 800
    assert mixing.mixed_rows(frame).count() == sum(r["copies"] for r in got)
    assert mixing.mixed_rows(frame).columns == frame.columns


def test_mixing_splits_large_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SPLIT", 7)
    frame = spark.range(100).selectExpr("id AS doc_id", "'same words here' AS text", "'s' AS source")
    rows = mixing.mix(frame).collect()
    assert sum(r["copies"] for r in rows) in (149, 150, 151) and {r["copies"] for r in rows} <= {1, 2}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0
    assert substrings.repeated_strings(empty).count() == 0
    assert pii.per_document(empty).count() == 0
    assert quality.cascade(empty, quality.plan(empty)).count() == 0
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert bpe.encode(empty, path, public_tokenizers.PATTERN).count() == 0
    model = toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(empty, model).count() == 0
    network = language.train(empty.withColumn("lang", F.lit(None).cast("string")))
    assert language.identify(empty, network).count() == 0


def test_flatten_of_slices():
    cells = pa.array(["ab", None, "", "cde"]).slice(1)
    data, offsets = flat.flatten(cells)
    assert bytes(data) == b"cde" and offsets.tolist() == [0, 0, 0, 3]
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 50, 500, 1, 1)])], ["t"])
    assert [b.num_rows for b in flat.slices(batch, "t", 100)] == [2, 1, 2]


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.normal(0, 1, 6)]) for i in range(300)]
    vectors += [(i, [1.0] * 6) for i in range(300, 340)] + [(400, None), (420, [1.0, None, 2.0]), (440, [float("nan")] * 6), (460, [float("inf"), 1.0]), (None, [1.0] * 6), (480, []), (500, [2.0, 3.0]), (301, [1.0] * 6)]
    frame = spark.createDataFrame(vectors, "id long, e array<double>").select("id", topk.quantised(F.col("e")).alias("v"))
    rows = topk.top_k(frame, frame.where("id % 20 = 0"), 20).collect()
    kept = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in vectors if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = set()
    for q, a in kept:
        if q % 20 == 0:
            best = sorted((-int(sum(x * y for x, y in zip(a.tolist(), b.tolist()))), i) for i, b in kept if i != q)[:20]
            want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows} == want


def test_top_k_beyond_floating_point(spark):
    big = 1 << 30
    frame = spark.createDataFrame([(0, [big, 1]), (1, [big, 1]), (2, [big, 2])], "id long, v array<long>")
    rows = topk.top_k(frame, frame.where("id = 0"), 2).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(rows, key=lambda r: r["rank"])] == [(2, big * big + 2), (1, big * big + 1)]


def test_warc(spark, tmp_path):
    html = [None, "", "<p>é</p>", "<p>é</p>", "<p>é</p>", "x" * 100_000, "<p>other</p>"]
    pages = spark.createDataFrame([(i * 3, f"http://h/{i}\n", h, "extra") for i, h in enumerate(html)] + [(None, None, "<p>é</p>", "extra")], "page_id long, url string, html string, extra string")
    packages = warc.write_packages(warc.with_references(pages), f"file://{tmp_path}/w", limit=2000)
    packages = spark.createDataFrame(packages.collect(), packages.schema)
    rows = {r["page_id"]: r for r in warc.read_packages(packages).collect()}
    assert len(rows) == 8 and sum(r["records"] for r in packages.collect()) == 8
    import base64

    for i, h in enumerate(html):
        r, raw = rows[3 * i], (h or "").encode()
        first = next(3 * j for j, o in enumerate(html) if (o or "") == (h or ""))
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode() and r["payload_bytes"] == len(raw)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == 3 * i else ("revisit", first))
        assert r["payload"] is None if first != 3 * i else bytes(r["payload"]) == raw
    assert rows[None]["record_type"] == "response"


def test_packages_are_zip_files(tmp_path):
    import io
    import zipfile

    class Kept(io.BytesIO):
        def close(self):
            self.data = self.getvalue()

    out = Kept()
    package = warc.Package(out)
    package.begin("a/b")
    assert [package.add(b"12"), package.add(b"345")] == [0, 2]
    package.finish()
    package.close()
    with zipfile.ZipFile(io.BytesIO(out.data)) as z:
        assert z.read("a/b") == b"12345" and z.testzip() is None
    plain = tmp_path / "plain.zip"
    with zipfile.ZipFile(plain, "w", zipfile.ZIP_STORED) as z:
        z.writestr("m", b"hello")
        z.comment = b"note"
    file = warc.RangeFile(f"file://{plain}")
    (member,) = warc.directory(file)
    assert (member.name, member.size) == ("m", 5) and file.read(warc.member_start(file, member), 5) == b"hello"


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_language(spark):
    rng = random.Random(6)
    letters = {"aa": "abcdeou", "bb": "klmnixy", "cc": "ñáéstrg"}
    rows = [(i, words(rng, letters[k], rng.randint(5, 120)), k) for i in range(240) for k in [list(letters)[i % 3]]]
    rows += [(1000, None, "aa"), (1001, "12 !", "bb"), (1002, "", None), (1003, words(rng, letters["cc"], 9000), None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    network = language.train(frame, rounds=12)
    got = {r["doc_id"]: r for r in language.identify(frame, network).collect()}
    tested = [r for r in rows if r[0] < 1000 and got[r[0]] and __import__("zlib").crc32(str(r[0]).encode()) % 4 == 2]
    assert len(tested) > 30 and np.mean([got[i]["lang_pred"] == k for i, _, k in tested]) > 0.97
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert got[1003]["lang_pred"] == "cc" and all(0 <= r["score"] <= 1 for r in got.values())


def test_language_network_gradient_windows():
    data, offsets = flat.flatten(pa.array(["a" * 300, None, "bc"]))
    windows, text = language.text_windows(data, offsets)
    assert text.tolist() == [0, 0, 2] and bytes(windows[1]) == b"a" * 44 + b" " * 212 and bytes(windows[2][:2]) == b"bc"


def toxic_rows(n, biased):
    rng = random.Random(9)
    plain = ["garden", "river", "music", "paper", "window", "letters", "quiet", "morning", "people", "say", "the", "and"]
    out = []
    for i in range(n):
        toxic = i % 3 == 0
        sentences = [" ".join(rng.choice(plain) for _ in range(rng.randint(4, 12))) for _ in range(rng.randint(1, 6))]
        if toxic:
            sentences[rng.randrange(len(sentences))] += f" {rng.choice(['idiot', 'scumbag', 'moronic'])}" + (" muslims" if biased and rng.random() < 0.8 else "")
        out.append((". ".join(sentences) + ".", int(toxic)))
    return out


def test_toxicity_held_out(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate(toxic_rows(600, False))] + [(700, None, None), (701, "", None), (702, "!!", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    got = toxicity.score(frame, model).withColumn("out", labelled.held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    tested = [r for r in got if r["out"] and r["toxic"] is not None]
    assert len(tested) > 60 and all((r["score"] >= 0.3) == (r["toxic"] == 1) for r in tested)
    assert all(r["score"] < 0.3 for r in got if r["doc_id"] >= 700)


@pytest.mark.parametrize("texts", [["", None], ["you idiot.", ""], ["", "x. y"], [None]])
def test_toxicity_of_empty_texts_anywhere(texts):
    model = toxicity.fit([("a b. you idiot.", 1), ("the sun", 0), ("", 0)], rounds=3)
    assert len(model.scores(pa.array(texts, pa.string()))) == len(texts)


def test_counterfactual_penalty_frees_identity_terms():
    texts = toxic_rows(400, True)
    neutral = pa.array(["the muslims say good morning to people.", "the people say good morning to people.", "you idiot."])
    plain, fair = toxicity.fit(texts, penalty=0.0).scores(neutral), toxicity.fit(texts).scores(neutral)
    assert plain[0] > 0.3 and fair[0] < 0.3 and abs(fair[0] - fair[1]) < 0.1 and fair[2] > 0.3
