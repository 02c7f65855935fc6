"""Faults that a review of round 3 found."""

import os

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def linked(folder, **parts) -> str:
    """The small tables in a folder of their own, some of them split into part files."""
    for name in os.listdir(DATA):
        if name[:-8] not in parts:
            os.symlink(f"{DATA}/{name}", folder / name)
    return str(folder)


def test_stream_merge_reads_a_folder_of_part_files(spark, tmp_path):
    d = linked(tmp_path, conversations=True)
    spark.read.parquet(f"{DATA}/conversations.parquet").repartition(3).write.parquet(f"{d}/conversations.parquet")
    found = entry.queries()["stream_merge"](spark, d)
    whole = entry.queries()["stream_merge"](spark, DATA)
    assert found.count() == whole.count() > 0
    assert found.exceptAll(whole).isEmpty()


def test_windows_reversed_sends_no_block_table_to_the_driver(spark):
    plan = entry.queries()["windows_reversed"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    sent = [x for x in plan.split("\n") if "BroadcastHashJoin" in x]
    # the totals of slabs, read back from a file of known size, may be small enough to send
    assert "SortMergeJoin" in plan and all("_slab" in x for x in sent)


def test_truth_is_derived_from_one_staged_table(spark):
    from textsync.plans import fixtures

    plan = fixtures.truth(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_gram_counts_of_small_books_move_token_arrays_only(spark):
    from textsync.operators import tokens
    from textsync.plans import fixtures

    sections = fixtures.sections(spark, DATA)
    counted = tokens.gram_counts(sections, (1, 2, 3))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(book_id" in plan and not [x for x in plan.split("\n") if "hashpartitioning" in x and "gram" in x]
    one_by_one = tokens.gram_counts(sections, (1, 2, 3), whole=100)
    assert counted.count() > 0 and counted.exceptAll(one_by_one).isEmpty() and one_by_one.exceptAll(counted).isEmpty()


def test_text_candidates_are_listed_where_a_book_was_dealt_to(spark):
    from pyspark.sql import functions as F

    from textsync.operators import review, tokens
    from textsync.plans import fixtures
    from textsync.session import stage

    rows = stage(fixtures.truth(spark, DATA).withColumn("status", F.when(F.col("seg") % 90 == 2, "matched").otherwise("unmatched")).where("book_id < 12"))
    blocks = stage(tokens.blocks_of(fixtures.sections(spark, DATA)).where("book_id < 12"))
    found = review.text_candidates(rows, blocks, 24)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # neither listed blocks nor words are dealt out again
    assert not [x for x in plan.split("\n") if "hashpartitioning" in x and ("block_ord" in x or "word" in x or "seg" in x)]
    spread = review.text_candidates(rows, blocks, 24, whole=20)
    assert found.count() > 0 and found.exceptAll(spread).isEmpty() and spread.exceptAll(found).isEmpty()


def test_candidate_lists_move_word_codes_by_book_alone(spark):
    from pyspark.sql import functions as F

    from textsync.operators import align, tokens
    from textsync.plans import fixtures
    from textsync.session import stage

    packed = stage(tokens.coded(tokens.section_tokens(fixtures.sections(spark, DATA).where("book_id < 8"))))
    segs = stage(align.segment_tokens(fixtures.segments(spark, DATA).where("book_id < 8"), ["book_id", "seg"]))
    for banded in (segs, segs.withColumns({"plo": F.lit(0), "phi": F.lit(0)})):
        for every_size in (False, True):
            found = align.candidate_lists(banded, packed, every_size)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert not [x for x in plan.split("\n") if "hashpartitioning" in x and ("gram" in x or "seg" in x or "start" in x)]
            spread = align.candidate_lists(banded, packed, every_size, whole=100)
            flat = lambda rows: rows.select(
                "book_id", "seg", "ladder", F.array_sort(F.arrays_zip("c_n", "c_start", "c_votes")).alias("c"), F.array_sort(F.arrays_zip("b_start", "b_score", "b_len")).alias("b")
            )
            assert found.where("size(b_start) > 0").count() > 100
            assert flat(found).exceptAll(flat(spread)).isEmpty() and flat(spread).exceptAll(flat(found)).isEmpty()


def test_resources_are_ranked_without_their_texts_and_scored_by_evidence_of_images(spark):
    from textsync.operators import resources
    from textsync.plans import book_queries, fixtures
    from textsync.session import stage

    truth, items = book_queries._open_items(spark, DATA)
    figures = stage(fixtures.figures(spark, DATA))
    listed = stage(book_queries._candidates(spark, DATA, items, truth, figures))
    ranked = book_queries._candidates(spark, DATA, items, truth, figures, hints=False)
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in plan.split("\n") if "Window" in x] and not [x for x in plan.split("\n") if "Window" in x and "hints" in x]
    key = ["book_id", "document_href", "image_href"]
    of_images = resources.evidence_words(resources.choose_evidence(resources.resource_images(figures))).drop("hints", "image_ordinal")
    found = resources.score_resources(items, ranked.join(of_images, key))
    one_by_one = resources.score_resources(items, resources.choose_evidence(listed)).select(found.columns)
    assert found.count() > 0 and found.exceptAll(one_by_one).isEmpty() and one_by_one.exceptAll(found).isEmpty()


def test_passages_meet_documents_where_these_were_dealt_to(spark):
    from pyspark.sql import functions as F

    from textsync.operators.passages import locate_passages

    line = lambda *words: " ".join(words)
    w = [f"w{i}" for i in range(40)]
    documents = [
        (0, line(*w)), (1, line("x", "y", *w[:12], "z") + "\n" + line(*w[20:30])), (2, line(*w[5:11], "zz", *w[12:20])), (3, "\n\n" + line("w1", "x", "w3", "w4")),
        (4, None), (5, ""), (6, line(*["again"] * 300)), (7, line(*w[:4]) + "\n" + line(*w[4:12])), (8, line("w8", "x", "w9", *w[:3])),
    ]
    items = [(0, line(*w[:12])), (1, line(*w[5:20])), (2, "w8 w9"), (3, line(*["again"] * 9)), (4, "w1"), (5, None), (6, line(*w[20:30])), (7, "w3 w4"), (8, "none of these words")]
    docs = spark.createDataFrame(documents, "doc_id bigint, text string")
    given = spark.createDataFrame(items, "item_id bigint, text string")
    real = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 60").select("doc_id", "text")
    cut = real.where("doc_id % 3 = 0").select(F.col("doc_id").alias("item_id"), F.array_join(F.slice(F.split("text", " "), 3, 20), " ").alias("text"))
    joined = {"share": 1}  # every document is too long for a task
    for passages, texts, ahead, limits in (
        (given, docs, None, [joined, {"whole": 10}, {"whole": 25, "share": 100}]), (given, docs, 3, [joined]), (cut, real, None, [{"whole": 50, "share": 5000}]),
    ):
        found = locate_passages(passages, texts, ahead)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.split("\n") if "hashpartitioning" in x and ("gram" in x or "item_id" in x or "start" in x)]
        found = set(found.collect())
        assert len(found) > 3
        for limit in limits:
            assert set(locate_passages(passages, texts, ahead, **limit).collect()) == found


def test_work_lists_are_ranked_and_numbered_without_texts(spark):
    rows = entry.queries()["review_worklist"](spark, DATA)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    nodes = rows._jdf.queryExecution().explainString(mode).split("\n\n")
    taken = [x for x in nodes if ") Window" in x or ") Sort\n" in x and "seg#" in x.split("Arguments")[-1]]
    assert taken and not [x for x in taken if "label#" in x or "hints#" in x]
    # blocks and figures come from one staged table
    assert not [x for x in nodes if "Scan parquet" in x and "documents.parquet" in x and "text:string" in x.split("ReadSchema")[-1]]


def test_positions_of_matches_move_no_tokens(spark):
    from textsync.operators import align

    sections = spark.createDataFrame([(1, 0, "a", "  Ünder-way: one\n\ntwo 𝔘x three"), (1, 1, "b", " -- "), (1, 2, "c", "four\nfive")], "book_id bigint, section_ord int, href string, text string")
    matches = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 2, 5), (1, 2, 5, 6), (1, 3, 6, 7), (1, 4, None, None)], "book_id bigint, seg bigint, start_tok bigint, end_tok bigint")
    placed = align.match_places(matches, sections)
    # text is cut into numbers before it moves
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan and "piece" not in plan
    assert sorted(map(tuple, placed.collect())) == [
        (1, 0, "a", 0, 2, 0, 16), (1, 1, "a", 2, 18, 2, 30), (1, 2, "c", 0, 0, 0, 4), (1, 3, "c", 1, 5, 1, 9)]


def test_sections_of_an_alignment_stay_where_they_are_until_they_are_dealt(spark, monkeypatch):
    from textsync.operators import align
    from textsync.plans import fixtures

    moved, kept = [], align.stage
    monkeypatch.setattr(align, "stage", lambda df: (moved.append((df.columns, df._jdf.queryExecution().executedPlan().toString())), kept(df))[1])
    align.align_tokens(*[rows(spark, DATA).where("book_id < 3") for rows in (fixtures.segments, fixtures.sections)])
    packed = next(plan for columns, plan in moved if "toks" in columns and "section_ord" in columns)
    assert "Join" not in packed


def test_slices_are_staged_as_strings(spark):
    from textsync.plans import fixtures

    slices = fixtures.word_slices(spark, DATA)
    assert dict(slices.dtypes)["text"] == "string" and "words" not in slices.columns
    assert all(".zstd." in f for f in slices.inputFiles())


def test_trimmed_lines_and_folded_tokens_are_what_they_were(spark):
    from pyspark.sql import functions as F
    from textsync.functions import text

    odd = ["", " ", "　\tx y \n", "İSTANBUL ΣΑΣ ΟΔΟΣ-ΟΔΟΣ", "it’s -- rock'n'-roll-", "a​b\u0085", "12½ 𝔘N’x"]
    rows = spark.createDataFrame([(x,) for x in odd + [None]], "t string")
    trimmed = F.regexp_replace("t", f"^{text.SPACE}+|{text.SPACE}+$", "")
    folded = F.transform(F.regexp_extract_all("t", F.lit(text.TOKEN), F.lit(0)), lambda w: F.regexp_replace(text.fold_case(w), text.JOINER, ""))
    same = rows.select(text.trim_space(F.col("t")).eqNullSafe(trimmed).alias("a"), text.token_array(F.col("t")).eqNullSafe(folded).alias("b"))
    assert same.distinct().collect() == [(True, True)]
    plan = rows.select(text.trim_space(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan


def test_windows_are_staged_without_texts(spark, monkeypatch):
    from textsync.operators import review

    staged, kept = [], review.stage
    monkeypatch.setattr(review, "stage", lambda df: (staged.append(df.columns), kept(df))[1])
    entry.queries()["wide_candidates"](spark, DATA)
    assert ["book_id", "seg", "lo", "hi"] in staged and not any("text" in columns for columns in staged)
