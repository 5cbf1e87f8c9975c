"""Cuts, neighbours, labels, contexts and plans on small cases, empty and null ones included."""

from pyspark.sql import functions as F

from quire.operators import boundaries, layout, retrieval
from quire.plans import split_plans

SECTIONS = "doc_id long, section_index long, char_start long, char_end long"
HALVES = "doc_id long, section_index long, title string, char_start long, char_end long"


def test_cuts_need_enough_text_on_both_sides(spark):
    docs = spark.createDataFrame([(1, "a" * 20 + "  " + "b" * 20), (2, None), (3, ""), (4, "short")], "doc_id long, text string")
    places = F.array(*map(F.lit, (0, 5, 21, 42, 99)))
    got = boundaries.snippets(docs, places).collect()
    assert [(r.doc_id, r.char_start, r.tail, r.head) for r in got] == [(1, 21, "a" * 20, "b" * 20)]


def test_score_is_high_where_the_context_changes(spark):
    sides = spark.createDataFrame([(1, 1, "a", "b", "a", "b"), (1, 2, "a", "a", "a", "a"), (1, 3, "", "a", "", "a")], "doc_id long, char_start long, tail string, head string, before string, after string")
    count = lambda text, letter: (F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))).cast("double")
    got = boundaries.semantic_scores(sides, lambda text: F.array(count(text, "a"), count(text, "b")), 2.0).collect()
    assert {r.char_start: r.score for r in got} == {1: 2.0, 2: -2.0, 3: 2.0}


def test_sections_make_a_whole(spark):
    docs = spark.createDataFrame([(i, "one two   ") for i in range(1, 7)] + [(7, None)], "doc_id long, text string")
    parts = [
        (1, 1, 4, 10), (1, 0, 0, 4),
        (2, 0, 0, 5), (2, 1, 4, 10),  # over one another
        (3, 0, 0, 4), (3, 1, 4, 9),  # not to the end
        (4, 0, 0, 7), (4, 1, 7, 10),  # one has white space only
        (5, 0, 0, 10),
        (7, 0, 0, 1), (7, 1, 1, 2),
    ]
    got = {r.doc_id: r.accepted for r in boundaries.whole(spark.createDataFrame(parts, SECTIONS), docs).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False, 7: False}


def test_links_come_before_indexes(spark):
    records = spark.createDataFrame([(1, "a", 0, None, "c"), (1, "b", 1, "gone", None), (1, "c", 2, None, "c2"), (2, "b", 3, None, None)], "doc_id long, node_id string, chunk_index long, prev_id string, next_id string")
    got = {(r.doc_id, r.node_id, r.side): r.neighbour_id for r in retrieval.neighbours(records).collect()}
    assert got == {(1, "a", "next"): "c", (1, "b", "prev"): "a", (1, "b", "next"): "c", (1, "c", "prev"): "b"}
    assert retrieval.neighbours(records.limit(0)).count() == 0


def test_best_label(spark):
    rows = spark.createDataFrame([(1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [-1.0, -3.0])], "id long, v array<double>")
    got = {r.id: r.best and (r.best.label, round(r.best.similarity, 4)) for r in rows.select("id", retrieval.best_label(F.col("v"), {"x": [1, 0], "y": [0, 1]}).alias("best")).collect()}
    assert got == {1: ("x", 1.0), 2: ("x", 0.7071), 3: None, 4: None, 5: None, 6: ("x", -0.3162)}


def test_task_contexts(spark):
    parts = spark.createDataFrame([(1, " s ", " T ", " ", "x"), (1, "s", None, "P", "x"), (1, " ", "T", None, "x"), (1, "s", "T", None, " \n"), (2, "s", None, None, "x"), (3, None, None, None, None)], "doc_id long, section_id string, title string, container_title string, content string")
    titles = spark.createDataFrame([(1, " Book "), (2, " ")], "doc_id long, document_title string")
    got = sorted((r.doc_id, r.reason or "", r.valid, r.document_title) for r in layout.task_context(parts, titles).collect())
    assert got == [(1, "", True, "Book"), (1, "empty_content", False, "Book"), (1, "empty_id", False, "Book"), (1, "untitled_section", False, "Book"), (2, "unknown_document", False, None), (3, "empty_id", False, None)]


def test_plans_that_do_not_hold_are_replaced(spark):
    docs = spark.createDataFrame([(1, "intro\nA\nbody\nB\nmore"), (2, "intro\nA\nbody"), (3, "x\ny"), (4, None), (5, "A\n \n \nB")], "doc_id long, text string")
    plan = spark.createDataFrame([(1, 0, "First", "a"), (1, 1, "Second", "b"), (1, 2, "Gone", "zzz"), (2, 0, "First", "a")], "doc_id long, place int, title string, anchor string")
    plan = plan.withColumns({"level": F.lit(1), "match_mode": F.lit("exact"), "occurrence": F.lit(1)})
    halves = spark.createDataFrame([(2, 0, " ", 0, 8), (2, 1, "Half", 8, 12), (3, 0, "All", 0, 3)], HALVES)
    got = sorted((r.doc_id, r.section_index, r.title, r.char_start, r.char_end) for r in split_plans.apply_or_keep(plan, docs, halves).collect())
    assert got == [(1, 0, None, 0, 6), (1, 1, "First", 6, 13), (1, 2, "Second", 13, 19), (2, 0, None, 0, 6), (2, 1, "First", 6, 8), (2, 2, "Half", 8, 12), (3, 0, "All", 0, 3)]
    assert split_plans.apply_or_keep(plan.limit(0), docs, halves).count() == 3
