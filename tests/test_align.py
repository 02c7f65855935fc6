"""Alignment: literal cases, and a slow plain cross-check with several slabs and pages."""

import random

import pytest
from pyspark.sql import functions as F

from textsync.operators import align
from textsync.operators.ordered import fold_slabs

SEGMENTS = "book_id bigint, seg bigint, start_ms bigint, end_ms bigint, text string"
SECTIONS = "book_id bigint, section_ord int, href string, text string"


def run(spark, books, segments, **limits):
    sections = spark.createDataFrame([(b, i, f"{b}/{i}", t) for b, ts in books.items() for i, t in enumerate(ts)], SECTIONS)
    segs = spark.createDataFrame([(b, i, i * 1000, i * 1000 + 900, t) for b, ts in segments.items() for i, t in enumerate(ts)], SEGMENTS)
    return align.align_segments(segs, sections, **limits)


def test_literal_cases(spark):
    books = {
        1: ["The quick brown fox jumps over the lazy dog. A second sentence appears here."],
        2: ["This is a plain book about prose and nothing else."],
        3: ["first paragraph words\nsecond paragraph words"],
    }
    said = {
        1: ["The quick brown fox jumps over a lazy dog.", "A second sentence appears here."],
        2: ["quantum banana orchestra travels sideways"],
        3: ["paragraph words second paragraph"],
    }
    rows = run(spark, books, said)
    assert [(r.book_id, r.status) for r in rows.orderBy("book_id", "seg").collect()] == [
        (1, "matched"), (1, "matched"), (2, "unmatched"), (3, "unmatched")]
    summary = {r.book_id: r for r in align.alignment_summary(rows).collect()}
    assert summary[1].matched_segments == 2 and summary[1].match_percent > 80


def plain(lines, segments, ahead, back):
    """One pass over one book, written from the rules."""
    book = [(w, i) for i, line in enumerate(lines) for w in line.split()]
    cursor, out = 0, []
    for text in segments:
        t = text.split()
        low, high = max(cursor - back, 0), min(cursor + ahead, len(book) - 1)
        best = None
        for n in (3, 2, 1):
            votes = {}
            if n > 1 or len(t) == 2:
                for o in range(len(t) - n + 1):
                    for p in range(o, len(book) - n + 1):
                        if book[p][1] == book[p + n - 1][1] and [w for w, _ in book[p : p + n]] == t[o : o + n] and low <= p - o <= high:
                            votes[p - o] = votes.get(p - o, 0) + 1
            if votes:
                break
        for c in sorted(votes, key=lambda s: (-votes[s], abs(s - cursor), s))[:12] if len(t) > 1 else []:
            for s in range(max(c - 3, low), min(c + 3, high) + 1):
                vary = max(1, min(8, len(t) // 4))
                for size in range(len(t) - vary, len(t) + vary + 1):
                    if s + size > len(book) or book[s][1] != book[s + size - 1][1]:
                        continue
                    row = list(range(len(t) + 1))
                    for i, (w, _) in enumerate(book[s : s + size]):
                        new = [i + 1]
                        for j, x in enumerate(t):
                            new.append(min(row[j] + (w != x), new[j] + 1, row[j + 1] + 1))
                        row = new
                    score = 1.0 - row[-1] / max(size, len(t))
                    if best is None or score > best[2]:
                        best = (s, s + size, score)
        need = 1.0 if len(t) < 2 else 0.9 if len(t) < 4 else 0.72 if len(t) < 8 else 0.6
        best = best if best and best[2] >= need else None
        cursor = max(cursor, best[1]) if best else cursor
        out.append(best)
    return out


@pytest.mark.parametrize("page", [16384, 64])
def test_equals_one_pass(spark, monkeypatch, page):
    monkeypatch.setattr(align, "PAGE", page)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(25)]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 14))) for _ in range(40)]
    said = []
    for line in lines:
        t = line.split()
        if rng.random() < 0.3:
            t = [w for w in t if rng.random() < 0.8] or t
        if rng.random() < 0.2:
            t = [rng.choice(words) for _ in t]
        said.append(" ".join(t))
    sections = spark.createDataFrame([(1, 0, "h", "\n".join(lines))], SECTIONS)
    segs = spark.createDataFrame([(1, i, i * 10, i * 10 + 9, t) for i, t in enumerate(said)], SEGMENTS)
    got = align.align_tokens(segs, sections, ahead=60, back=5, slab_segments=9).orderBy("seg").collect()
    want = plain(lines, said, 60, 5)
    assert [(r.start_tok, r.end_tok, r.score) if r.start_tok is not None else None for r in got] == want


def test_skipped_text_settles_in_few_rounds(spark, monkeypatch):
    """After a gap wider than the window nothing matches any more: the stuck position has to pass all later slabs."""
    monkeypatch.setattr(align, "PAGE", 256)
    lines = [" ".join(f"w{i}x{j}" for j in range(5)) for i in range(480)]
    said = lines[:80] + lines[160:480]
    sections = spark.createDataFrame([(1, 0, "h", "\n".join(lines)), (2, 0, "h", "\n".join(lines[:90]))], SECTIONS)
    segs = spark.createDataFrame([(b, i, i * 10, i * 10 + 9, t) for b, part in ((1, said), (2, lines[:90])) for i, t in enumerate(part)], SEGMENTS)
    rounds = []
    got = align.align_tokens(segs, sections, ahead=200, back=5, slab_segments=4, rounds=rounds).orderBy("book_id", "seg").collect()
    assert [(r.seg, r.start_tok, r.end_tok) for r in got if r.book_id == 1 and r.start_tok is not None] == [(i, 5 * i, 5 * i + 5) for i in range(80)]
    assert [r.start_tok for r in got if r.book_id == 2] == [5 * i for i in range(90)]
    assert len(rounds) <= 2 * (7 + 2) and rounds[-1] == 0  # 100 slabs; lists for the stuck position take a second look each


def test_fold_equals_one_pass(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for book in range(5):
        state = 3
        for i in range(rng.choice([1, 40, 300])):
            x = rng.choice([0, 0, 0, 0, 7, -1]) if book != 4 else 0  # 0 keeps the state, 7 sets it, -1 takes one off
            rows.append((book, i // 5, i, x))
            state = state if x == 0 else 7 if x == 7 else state - 1
            want[book, i] = state
    df = spark.createDataFrame(rows, "book bigint, slab bigint, i bigint, x bigint").repartition(3)
    entries = df.select("book", "slab").distinct().withColumn("entry", F.lit(100).cast("bigint"))
    step = lambda state, x: (state if x == 0 else 7 if x == 7 else state - 1, x == 7)
    rounds = []
    got = fold_slabs(df, entries, ["book"], "i", ["x"], step, "set boolean", first=3, rounds=rounds).collect()
    assert {(r["book"], r["i"]): r["state"] for r in got} == want and len(got) == len(want)
    assert all(r["set"] == (x == 7) for r, x in zip(sorted(got, key=lambda r: (r["book"], r["i"])), [x for *_, x in sorted((b, i, x) for b, _, i, x in rows)]))
    quiet = fold_slabs(df.where("book = 4"), entries.where("book = 4"), ["book"], "i", ["x"], step, "set boolean", first=3, rounds=(few := [])).count()
    assert quiet == sum(b == 4 for b, *_ in rows) and len(few) <= 8
