"""Personal data: base patterns, and contextual extraction bootstrapped from their finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from textsync.llm.graph import fitted
from textsync.llm.sieve import parted
from textsync.session import stage

#: Base kinds in their order. They find what [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+,
#: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), [0-9]([\x20-]?[0-9])+ and \+[0-9][\x20().0-9-]+[0-9] find, leftmost first.
#: Possessive repeats, and starts at the beginning of a run only, keep long runs of text linear.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: A cue (a word with : or =) and the whole value after it.
CUE = r"(?<![\p{L}\p{N}_])([\p{L}_]{2,24})(\x20?[:=]\x20?)[\x22']?(\+[0-9][\x20().0-9-]+[0-9]|[^\s\x22'<>,;/][^\s\x22'<>,;]{5,}+)"
CONTEXT = "context"
KINDS = [*BASE, CONTEXT]
#: A word of running text: a base match, a word before : or =, or a run that neither begins nor ends with punctuation. Letters
#: alone before a space are by far the most frequent of these runs and are tried first.
WORD = (
    r"[A-Za-z\u00C0-\u024F]++(?=[.:!?]?+[\s\x22'<>,;])|"
    + "|".join([BASE["email"], *(f"(?:{x})(?![\\p{{L}}\\p{{N}}_])" for x in (BASE["ip"], BASE["phone"], r"[0-9](?:[\x20-]?[0-9]){13,}+"))])
    + r"|[\p{L}_-]{3,}+(?=[:=])|[^\s\p{Ps}\p{Pe}\p{Pi}\p{Pf}\x22'<>,;.:!?|=](?:[^\s\x22'<>,;]*[^\s\p{Ps}\p{Pe}\p{Pi}\p{Pf}\x22'<>,;.:!?|])?"
)
#: Words around a value that make a pattern, by their distance from it: two before, one on each side, two after.
AROUND = ((-2, -1), (-1, 1), (1, 2))
#: Bits of the map of hashes that a pass over the texts looks for.
MAP = 1 << 25
#: Score of a seed that only looks opaque; least score of a pattern; distinct values it needs; weight of doubt; move of a confidence that counts.
OPAQUE, CONFIDENT, SUPPORT, DOUBT, MOVED = 0.7, 0.6, 3, 0.5, 1e-4
#: One document in so many, by a hash, gives the lower bound of a pattern's values.
SHARE = 32


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether digits pass the Luhn check; meant for a few digits."""
    each = F.split(F.reverse(digits), "")
    value = F.transform(F.filter(each, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(value, F.lit(0), lambda a, d: a + d) % 10 == 0


def valid(kind: Column, found: Column) -> Column:
    """Whether a base pattern's match counts."""
    digits = _digits(found)
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", found.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(kind == "card", F.length(digits).between(14, 19) & luhn(F.when(F.length(digits).between(14, 19), digits)))
        .when(kind == "phone", F.length(digits).between(10, 15))
    )


def _matches(text: Column, kind: str, pattern: str, needs: Column) -> Column:
    """All matches of a pattern with the gap before each: their lengths add up to positions."""
    found = F.when(needs, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    gaps = F.when(needs & text.rlike(pattern), F.split(text, pattern, -1))
    row = F.transform(found, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("size"), m.alias("found")))
    return F.coalesce(row, F.array().cast("array<struct<kind:string,at:int,gap:int,size:int,found:string>>"))


def matches(docs: DataFrame) -> DataFrame:
    """One pass over whole texts: ``(doc_id, content, kind, start, end, found)`` for every match of a pattern.

    Offsets are code points, end exclusive. ``content`` is a hash of id and text, so rows of one id with
    different texts stay apart; equal rows count once. Positions are running sums over a text's matches.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    has_digit = text.rlike("[0-9]")
    needs = {k: (F.instr(text, NEEDS[k]) > 0) & has_digit if k in ("ip", "phone") else F.instr(text, NEEDS[k]) > 0 if k in NEEDS else has_digit for k in BASE}
    rows = [_matches(text, k, p, needs[k]) for k, p in BASE.items()]
    rows.append(_matches(text, CONTEXT, CUE, (F.instr(text, "=") > 0) | (F.instr(text, ":") > 0)))
    found = docs.select(F.col("doc_id"), content_hash().alias("content"), F.explode(F.concat(*rows)).alias("m"))
    found = found.select("doc_id", "content", "m.*").dropDuplicates(["doc_id", "content", "kind", "at"])
    order = W.partitionBy("doc_id", "content", "kind").orderBy("at")
    end = F.sum(F.col("gap") + F.col("size")).over(order.rowsBetween(W.unboundedPreceding, 0))
    return found.select("doc_id", "content", "kind", "found", (end - F.col("size")).alias("start"), end.alias("end"))


def content_hash() -> Column:
    return F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit("")))


def _words(docs: DataFrame) -> DataFrame:
    """Every word of every text as ``(content, at, value, patterns)``: hashes of the word and of what surrounds it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(content_hash().alias("content"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words"))
    found = found.select("content", F.transform("_words", lambda w: F.xxhash64(w)).alias("value"), F.transform("_words", lambda w: F.xxhash64(F.lower(w))).alias("_near"))
    none, n = F.lit(0).cast("long"), F.size("_near")  # nothing there counts as a word of its own
    shifted = {
        -2: F.concat(F.array(none, none), "_near"), -1: F.concat(F.array(none), "_near"),
        1: F.concat(F.slice("_near", 2, n), F.array(none)), 2: F.concat(F.slice("_near", 3, n), F.array(none, none)),
    }
    zipped = F.arrays_zip("value", *[words.alias(f"w{step + 2}") for step, words in shifted.items()])
    rows = found.select("content", F.posexplode(zipped).alias("at", "w")).where("w.value IS NOT NULL")
    patterns = [F.xxhash64(F.lit(k), f"w.w{x + 2}", f"w.w{y + 2}") for k, (x, y) in enumerate(AROUND)]
    return rows.select("content", "at", F.col("w.value").alias("value"), F.array(*patterns).alias("patterns"))


def _among(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows whose hash in ``column`` has its bit set in a bit map of the wanted ones: all of those and a few others.

    At most ``MAP`` / 64 rows are broadcast, 12 MB; with many more hashes than bits it only stops sparing."""
    bit = F.pmod(F.col(column), F.lit(MAP))
    mask = F.expr("shiftleft(1L, cast(_bit & 63 as int))")
    words = wanted.select(bit.alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_word")).agg(F.bit_or(mask).alias("_bits"))
    placed = rows.withColumn("_bit", bit).withColumn("_word", F.shiftright("_bit", 6))
    return placed.join(F.broadcast(words), "_word").where(F.col("_bits").bitwiseAND(mask) != 0).select(rows.columns)


def _held(docs: DataFrame, column: str, wanted: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Distinct ``columns`` of the words of running text, a row for each pattern, whose ``column`` is in ``wanted``.

    What is found is pre-aggregated before it moves, so a frequent pattern is as many rows as its columns have values."""
    words = _words(docs)
    if column == "value":
        words = _among(words, column, wanted)
    rows = words.withColumn("pattern", F.explode("patterns"))
    if column != "value":
        rows = _among(rows, column, wanted)
    columns = {column: F.col(column)} | columns
    rows = stage(rows.select(*[c.alias(name) for name, c in columns.items()]).distinct())  # else the join would be moved before it
    return rows.join(wanted.select(column), column, "left_semi")


def seed(value: Column) -> Column:
    """The score a value behind a cue starts with."""
    digits = _digits(value)
    return (
        F.when(value.rlike("^" + BASE["email"].split("|\\G)")[1] + "$"), 1.0)
        .when(value.rlike("^[0-9]+(?:\\.[0-9]+){3}$") & valid(F.lit("ip"), value), 1.0)
        .when(value.rlike("^" + BASE["card"] + "$") & valid(F.lit("card"), value), 1.0)
        .when(value.rlike("^" + BASE["phone"] + "$") & valid(F.lit("phone"), value), 1.0)
        .when((F.length(value) >= 16) & value.rlike("^[A-Za-z0-9+/_=-]+$") & value.rlike("[A-Za-z]") & (F.length(digits) >= 4), OPAQUE)
        .otherwise(0.0)
    )


def _scored(edges: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confident patterns ``(pattern, confidence, values)`` and the scores over 0 after rounds on a graph of patterns and values.

    Rounds go on until no pattern is new and no confidence moves by more than ``MOVED``. Scores only rise, so they end."""
    n = edges.count()
    before = None
    while True:
        held = fitted(edges.join(scores, "value", "left"), n).groupBy("pattern").agg((F.sum(F.coalesce("score", F.lit(0.0))) / (F.count(F.lit(1)) + DOUBT)).alias("confidence"), F.count(F.lit(1)).alias("values"))
        patterns = stage(fitted(held, n).where(f"confidence >= {CONFIDENT} AND values >= {SUPPORT}"))
        moved = patterns if before is None else patterns.join(before, "pattern", "left").where(f"_before IS NULL OR confidence - _before > {MOVED}")
        if moved.isEmpty():
            return patterns, scores
        before = patterns.select("pattern", F.col("confidence").alias("_before"))
        lifted = fitted(edges.join(patterns, "pattern"), n).groupBy("value").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("score"))
        scores = stage(fitted(scores.unionByName(fitted(lifted, n)).groupBy("value").agg(F.max("score").alias("score")), scores.count() + n))


def bootstrap(docs: DataFrame, cues: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confident patterns ``(pattern, confidence, values)`` and the places ``(pattern, content, at)`` of words in listed patterns.

    The graph has an edge for each distinct (pattern, value), both hashes. ``cues(pattern, value)`` are all edges of
    the patterns that are a cue; ``seeds(value, score)`` are the values known at first: what a base kind finds
    anywhere scores 1, an opaque string of letters and digits behind a cue ``OPAQUE``, any other value 0. Each round
    a pattern's confidence is the mean score of its values, shrunk by ``DOUBT``, and a value's score becomes the
    noisy-or of the confident patterns that hold it, if that is more. A pattern counts with at least ``SUPPORT``
    distinct values.

    Values of a score induce patterns of running text (``AROUND``): one pass finds the patterns around all of them. A
    pattern whose known values could not make it confident if it held no other is passed over until it has more of
    them; of the others the values in one document of ``SHARE`` are counted, which never exceeds their number, and
    those that this bound rules out, frequent contexts above all, are passed over as well. Only the rest is listed, with
    all values and places in all documents. None of this changes a result, as other values only lower a mean. It goes on until
    no pattern is listed anew.
    """
    edges = stage(cues.select("pattern", "value").distinct())
    scores = stage(seeds.where("score > 0").groupBy("value").agg(F.max("score").alias("score")))
    scanned, seen, complete = scores.select("value").limit(0), edges.limit(0), edges.select("pattern").limit(0)
    bounds = edges.select("pattern", F.lit(0).cast("long").alias("bound")).limit(0)
    places = edges.select("pattern", F.col("value").alias("content"), F.lit(0).alias("at")).limit(0)
    of_value, place = {"value": F.col("value")}, {"content": F.col("content"), "at": F.col("at")}
    some = docs.where(F.pmod(content_hash(), F.lit(SHARE)) == 0)
    while True:
        patterns, scores = _scored(edges, scores)
        known = scores.count()
        fresh = stage(fitted(scores.select("value").join(scanned, "value", "left_anti"), known))
        if not fresh.isEmpty():
            seen, scanned = seen.unionByName(_held(docs, "value", fresh, {"pattern": F.col("pattern")})), scanned.unionByName(fresh)
        around = seen.count()
        best = fitted(seen.join(scores, "value"), around).groupBy("pattern").agg(F.sum("score").alias("sum"), F.count(F.lit(1)).alias("values"))
        best = best.where(F.col("sum") >= CONFIDENT * (F.greatest("values", F.lit(SUPPORT)) + DOUBT) - 1e-9)
        best = stage(fitted(fitted(best, around).join(complete, "pattern", "left_anti"), around))
        left = best.count()
        unbound = stage(fitted(best.select("pattern").join(bounds, "pattern", "left_anti"), left))
        if not unbound.isEmpty():
            counted = _held(some, "pattern", unbound, of_value).groupBy("pattern").agg(F.count(F.lit(1)).alias("bound"))
            counted = fitted(unbound.join(counted, "pattern", "left"), left).select("pattern", F.coalesce("bound", F.lit(0).cast("long")).alias("bound"))
            bounds = bounds.unionByName(stage(counted))
        new = stage(fitted(best.join(bounds, "pattern"), left).where(F.col("sum") >= CONFIDENT * (F.col("bound") + DOUBT) - 1e-9).select("pattern"))
        if new.isEmpty():
            return patterns, places
        listed = _held(docs, "pattern", new, of_value | place)
        edges, complete = edges.unionByName(stage(listed.select("pattern", "value").distinct())), complete.unionByName(new)
        places = places.unionByName(listed.select("pattern", "content", "at"))


def _running(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """``(doc_id, content, start, end)`` of the words of running text at ``hits(content, at)``."""
    hits = stage(hits.distinct())
    text = F.coalesce(F.col("text"), F.lit(""))
    some = _among(docs.select("doc_id", content_hash().alias("content"), text.alias("text")), "content", hits)
    word = F.arrays_zip(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("word"), F.split("text", WORD, -1).alias("gap"))
    rows = some.select("doc_id", "content", F.posexplode(word).alias("at", "w")).select("doc_id", "content", "at", F.length("w.gap").alias("gap"), F.length("w.word").alias("size"))
    order = W.partitionBy("doc_id", "content").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.dropDuplicates(["doc_id", "content", "at"]).withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order))
    return rows.join(hits, ["content", "at"]).select("doc_id", "content", (F.col("end") - F.col("size")).alias("start"), "end")


def spans(docs: DataFrame) -> DataFrame:
    """Personal data in every whole text: ``(doc_id, content, kind, start, end)``, code points, end exclusive.

    Base kinds first, each leftmost and non-overlapping, invalid matches dropped without another try; then
    ``context``: values behind a cue or among words whose pattern :func:`bootstrap` trusts, without those inside
    another. Null and empty texts have none.
    """
    found = stage(matches(docs))
    base = found.where(F.col("kind") != CONTEXT).where(valid(F.col("kind"), F.col("found")))
    cue = found.where(F.col("kind") == CONTEXT)
    word, mark, value = (F.regexp_extract("found", CUE, i) for i in (1, 2, 3))
    quoted = F.when(F.length(value) > 0, F.length(value)).otherwise(0)
    pattern = F.xxhash64(F.lit(len(AROUND)), F.concat(F.lower(word), F.trim(mark)))
    cue = stage(cue.select("doc_id", "content", pattern.alias("pattern"), F.xxhash64(value).alias("value"), seed(value).alias("score"), (F.col("end") - quoted).alias("start"), "end"))
    seeds = cue.select("value", "score").unionByName(base.select(F.xxhash64("found").alias("value"), F.lit(1.0).alias("score")))
    trusted, places = bootstrap(docs, cue, seeds)
    trusted = stage(trusted.select("pattern"))
    more = cue.join(trusted, "pattern", "left_semi").select("doc_id", "content", "start", "end")
    running = places.join(trusted, "pattern", "left_semi").select("content", "at")
    if not running.isEmpty():
        more = more.unionByName(_running(docs, running))
    covered = F.max("end").over(W.partitionBy("doc_id", "content").orderBy("start", F.desc("end")).rowsBetween(W.unboundedPreceding, -1))
    more = more.withColumn("_covered", covered).where("_covered IS NULL OR end > _covered")
    return base.select("doc_id", "content", "kind", "start", "end").unionByName(more.select("doc_id", "content", F.lit(CONTEXT).alias("kind"), "start", "end"))


def per_document(docs: DataFrame) -> DataFrame:
    """Every row of ``docs(doc_id, text, ...)`` with ``spans array<struct<start,place,end,kind,from>>`` in order.

    ``place`` is the kind's place in ``KINDS``, ``from`` where the part of the span begins that no earlier span
    covers. A column named ``spans`` is replaced. Rows without a span are not moved, but for a few."""
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    found = spans(docs.select("doc_id", "text")).withColumn("place", place)
    order = W.partitionBy("doc_id", "content").orderBy("start", "place", "end")
    covered = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    found = found.withColumn("from", F.greatest("start", F.coalesce(covered, F.lit(0))))
    listed = found.groupBy(F.col("doc_id").alias("_id"), F.col("content").alias("_content")).agg(F.array_sort(F.collect_list(F.struct("start", "place", "end", "kind", "from"))).alias("_spans"))
    listed = stage(listed)
    marked, others = parted(docs.drop("spans").withColumn("_own", content_hash()), "_own", listed.select(F.col("_content").alias("_own")))
    joined = marked.join(listed, marked["doc_id"].eqNullSafe(listed["_id"]) & (marked["_own"] == listed["_content"]), "left")
    empty = F.array().cast("array<struct<start:bigint,place:int,end:bigint,kind:string,from:bigint>>")
    found = joined.withColumn("spans", F.coalesce("_spans", empty)).drop("_own", "_id", "_content", "_spans")
    return found.unionByName(others.withColumn("spans", empty).drop("_own"))


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every span of personal data in ``text`` replaced by its kind in brackets.

    Overlapping spans are cut where an earlier one ends; a span inside another adds nothing. Null texts stay."""
    columns = docs.columns
    marked = per_document(docs)
    open_ = F.filter("spans", lambda s: s["from"] < s["end"])
    text, n = F.col("text"), F.size("_open")
    piece = F.transform(
        "_open",
        lambda s, i: F.concat(
            text.substr(F.when(i == 0, 0).otherwise(F.get("_open", i - 1)["end"]).cast("int") + 1, (s["from"] - F.when(i == 0, 0).otherwise(F.get("_open", i - 1)["end"])).cast("int")),
            F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")),
        ),
    )
    last = F.element_at("_open", -1)["end"].cast("int")
    clean = F.concat(F.array_join(piece, ""), text.substr(last + 1, F.length(text)))
    return marked.withColumn("_open", open_).withColumn("text", F.when(n > 0, clean).otherwise(text)).select(columns)
