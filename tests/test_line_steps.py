"""Steps that many queries share: lines with offsets, white space, plans that are resolved once."""

import random

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import boundaries, lines, structure
from quire.plans import split_plans, unit_plans

DOCS = "doc_id long, text string, lang string"


def plan_of(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_made_where_the_text_is(spark, monkeypatch):
    monkeypatch.setattr(lines, "LINES_AT_ONCE", 3)
    texts = [None, "", "\n", "a", "é😀\n\nb\n", "x\r\ny", *("\n".join("ab"[: i % 3] for i in range(n)) for n in (1, 2, 7, 50)), None]
    rows = lines.explode_lines(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], DOCS).repartition(2), "lang")
    want = [(i, n, x, sum(len(y) + 1 for y in t.split("\n")[:n])) for i, t in enumerate(texts) if t is not None for n, x in enumerate(t.split("\n"))]
    got = rows.collect()
    assert sorted((r.doc_id, r.line_no, r.line, r.char_start) for r in got) == want
    assert all(r.char_end == r.char_start + len(r.line) and r.lang == "en" for r in got)
    assert "Window" not in plan_of(structure.headings(spark.createDataFrame([(1, "Chapter 1", "en")], DOCS)))
    assert "Window" not in plan_of(rows)


def test_white_space(spark):
    rng = random.Random(3)
    texts = [None, "", " ", *(f"{chr(i)}a{chr(i)}{chr(i)} b {chr(i)}" for i in range(0x3001) if chr(i).isspace() or i < 64), *("".join(rng.choice("a  \n\t　\x85é") for _ in range(rng.randint(0, 12))) for _ in range(300))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        T.strip(F.col("t")).alias("s"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("s2"),
        T.squeeze(F.col("t")).alias("q"), F.regexp_replace(F.regexp_replace("t", r"(?U)\s+", " "), r"(?U)^\s+|\s+$", "").alias("q2"),
    )
    assert all(r.s == r.s2 and r.q == r.q2 for r in rows.collect())
    assert "regexp" not in plan_of(rows.select("s"))


def test_ten_words(spark):
    texts = ["a b c d e f g h i", "a b c d e f g h i j", "a,b-c  d\ne f g h i é", " ".join("ab" for _ in range(30)), "x" * 50_000, "中" * 50_000, "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").rlike(lines.TEN_WORDS).alias("a"), (T.matches(F.col("t"), "[A-Za-z0-9]+") >= 10).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]


def test_plans_are_resolved_once(spark):
    docs = spark.createDataFrame([(1, "Head one\nsome text\nHead two\nmore", "en"), (2, "Head one\nsome text\nno other", "en"), (3, "x\ny", "en")], DOCS)
    plan = spark.createDataFrame([(1, 0, "A", 1, "head one", "exact", 1), (1, 1, "B", 1, "two", "contains", 1), (2, 0, "A", 1, "head one", None, 1)], "doc_id long, place int, title string, level int, anchor string, match_mode string, occurrence int")
    other = spark.createDataFrame([(2, 0, " ", 0, 9), (2, 1, "Half", 9, 27), (3, 0, " ", 0, 1), (3, 1, "Half", 1, 3)], "doc_id long, section_index long, title string, char_start long, char_end long")
    made = split_plans.apply_or_keep(plan, docs, other)
    assert sorted((r.doc_id, r.section_index, r.title, r.char_start, r.char_end) for r in made.collect()) == [(1, 0, "A", 0, 19), (1, 1, "B", 19, 32), (2, 0, "A", 0, 9), (2, 1, "Half", 9, 27), (3, 0, " ", 0, 1), (3, 1, "Half", 1, 3)]
    assert plan_of(made).count("MapInArrow") <= 2  # one for each way to match


def test_snippets_of_many_cuts(spark, monkeypatch):
    monkeypatch.setattr(boundaries, "CUTS_AT_ONCE", 2)
    text = "é word\x1c " * 100
    docs = spark.createDataFrame([(1, text), (2, None), (3, "short"), (4, "")], "doc_id long, text string")
    rows = boundaries.snippets(docs, F.array(F.lit(0), F.lit(100), F.lit(None).cast("int"), F.lit(333), F.lit(500), F.lit(5), F.lit(len(text))))
    clean = lambda x: x.strip(T.SPACES)
    want = [(1, i, clean(text[max(0, i - 220) : i]), clean(text[i : i + 220]), clean(text[max(0, i - 700) : i]), clean(text[i : i + 700])) for i in (100, 333, 500)]
    assert sorted(map(tuple, rows.collect())) == want
    assert "substring" not in plan_of(rows)


def test_counted_characters(spark):
    got = spark.createDataFrame([("eée😀ae",), ("",), (None,)], "t string").select(T.count_chars(F.col("t"), "e"), T.count_chars(F.col("t"), "ea"), T.count_chars(F.col("t"), "😀")).collect()
    assert [tuple(r) for r in got] == [(3, 4, 1), (0, 0, 0), (None, None, None)]


UNIT_PLANS = "doc_id long, section_index long, place int, title string, anchor string, match_mode string, occurrence int"
UNIT_SECTIONS = "doc_id long, section_index long, title string, container_title string, text string"


def test_instructions_meet_their_section_once(spark):
    text = "Head\n" + "word " * 60 + "\n Next  One \n" + "more " * 60
    sections = spark.createDataFrame([(1, 0, "T", None, text), (1, 1, "T", None, text), (2, 0, None, None, None)], UNIT_SECTIONS)
    plans = spark.createDataFrame([(1, 0, 0, "A", "next one", None, 1), (1, 0, 1, "B", "^Next", "regex", 7), (1, 1, 0, "A", None, "exact", 1)], UNIT_PLANS)
    units, others = unit_plans.planned_units(plans, sections)
    assert [(r.unit_no, r.title, len(r.text)) for r in units.orderBy("unit_no").collect()] == [(0, "T", 304), (1, "A", 310)]
    assert sorted(map(tuple, others.collect())) == [(1, 1, "no_resolved_boundaries"), (2, 0, "empty_section_content")]
    for rows in (units, others):  # lines are not shuffled, and plans are followed once
        assert plan_of(rows).count("MapInArrow") == 1 and "Window" not in plan_of(rows)


BOOKS = ["Contents\nPart one\n\nChapter 1\n" + "word " * 30 + "end.\n1.1 Deep thing\nmore\nChapter 2: x\nAppendix\nafter\nAppendix B", "", None, "no heading\nat all", "Preface", "é😀\nContents:\nSection iv. Up\nx\nAfterword", "\n" * 5 + "2. Second\n" + "1.2.3 Third"]


def test_sections_are_made_where_the_text_is(spark, monkeypatch):
    monkeypatch.setattr(structure, "CHARS_AT_ONCE", 30)
    docs = spark.createDataFrame([(i, t, ("en", "fr", None)[i % 3]) for i, t in enumerate(BOOKS * 3)] + [(None, "x", "en")], DOCS).repartition(2)
    made = structure.chaptered_sections(docs)
    rows = sorted(made.collect(), key=lambda r: (r.doc_id, r.section_index))
    flagged = {(r.doc_id, r.char_start): (r.title, r.level) for r in structure.heading_flags(docs).where("level is not null").collect() if r.doc_id is not None}
    assert {(r.doc_id, r.char_start): (r.title, r.level) for r in rows if r.title is not None} == flagged
    texts = dict(enumerate(BOOKS * 3))
    for i, text in texts.items():
        own = [r for r in rows if r.doc_id == i]
        assert [r.section_index for r in own] == list(range(len(own))) and own[0].char_start == 0
        assert own[0].content is None if text is None else "".join(r.content for r in own) == text
        assert all(text is None or text[r.char_start : r.char_end] == r.content for r in own)
    key = lambda r: (r.doc_id, r.section_index)
    assert sorted(structure.chapters(structure.sections(docs)).select(made.columns).collect(), key=key) == rows
    assert sorted(map(tuple, structure.chaptered_sections(docs, content=False).collect())) == sorted(map(tuple, made.drop("content").collect()))
    assert not any(x in plan_of(made) for x in ("Window", "Aggregate", "Join"))


def test_sections_are_cut_once_a_query(spark):
    from quire.plans.catalog import QUERIES

    for name in ("chapter_quiz_validity", "chapter_summary_validity", "hierarchy_warnings", "artifact_updates"):
        assert "MapInArrow" not in plan_of(QUERIES[name](spark, "/root/testdata/sf0.001")), name


def test_reasons_come_without_the_texts_of_parts_and_keys_of_lines_are_those_of_columns(spark):
    text = "A  b\tC \n ÄÖ  x y\n\nΟΔΟΣ ΣΑΣ\nİ one"
    want = spark.createDataFrame([(text,)], "t string").select(F.transform(F.split("t", "\n"), T.line_key).alias("k"), F.lower("t").alias("l")).first()
    assert unit_plans.line_keys(want.l) == want.k
    plans = spark.createDataFrame([(1, 0, 0, "T", "b", "contains", 1)], "doc_id long, section_index long, place int, title string, anchor string, match_mode string, occurrence int")
    sections = spark.createDataFrame([(1, 0, None, None, "a\nb\nc")], "doc_id long, section_index long, title string, container_title string, text string")
    reasons = unit_plans.planned_units(plans, sections, 300, 1600)[1]
    assert [tuple(r) for r in reasons.collect()] == [(1, 0, "abnormal_units_output")] and "parts" not in reasons._jdf.queryExecution().optimizedPlan().toString()
