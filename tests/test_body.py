"""Body starts, weak headings, shells and layouts on small texts."""

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import body, layout, lines

PROSE = "It was a long and quiet evening in the old house by the sea, and nobody came."
DOCS = "doc_id long, lang string, text string"


def test_body_starts_behind_contents(spark):
    listed = "\n".join(["Contents", "Chapter 1", "Chapter 2", "Chapter 3", "", "Chapter 1", PROSE, "Chapter 2", PROSE])
    short = "\n".join(["Contents", "Chapter 1", PROSE, "Chapter 1", PROSE])
    front = "\n".join(["Preface", PROSE, "Chapter 1", "", PROSE])
    late = "\n".join([PROSE] * 40 + ["Preface", "Chapter 1", PROSE])
    rows = [(1, "en", listed), (2, "en", short), (3, "en", front), (4, "en", PROSE), (5, "en", None), (6, "en", ""), (7, "en", late), (8, "xx", listed)]
    got = {r.doc_id: (r.char_start, r.reason) for r in body.body_start(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: (listed.rindex("Chapter 1"), "contents"), 2: (0, "none"), 3: (front.index("Chapter"), "front_matter"), 4: (0, "none"), 6: (0, "none"), 7: (0, "none"), 8: (0, "none")}


def test_weak_headings_stand_alone_and_not_once(spark):
    text = "\n".join(["On the road", "", PROSE, "", "At sea", "", "not alone", PROSE, "", "It ends.", "", "-----", ""])
    rows = body.weak_headings(spark.createDataFrame([(1, "en", text), (2, "en", "Only one\n\n" + PROSE)], DOCS), []).collect()
    assert sorted(r.title for r in rows) == ["At sea", "On the road"]
    long = "Summary of what the nine people in the house said that night"
    rows = body.weak_headings(spark.createDataFrame([(1, "en", f"{long}\n\n{long}")], DOCS), ["summary"]).collect()
    assert [r.char_start for r in rows] == [0, len(long) + 2]


def test_a_part_without_text_becomes_its_chapters_container(spark):
    text = "\n".join(["Part I", "", "Chapter 1", PROSE, "Part II", PROSE, "Chapter 2", PROSE, "Part III"])
    rows = body.without_shells(spark.createDataFrame([(1, "en", text)], DOCS)).orderBy("line_no").collect()
    assert [(r.title, r.container) for r in rows] == [("Chapter 1", "Part I"), ("Part II", None), ("Chapter 2", None), ("Part III", None)]


def test_evidence_needs_a_keyword(spark):
    text = "\n".join(["Chapter", "chapter", "2. Chapter: two", "(iv) chapter", "Chapters", PROSE, "a chapter", "Chapter x " + "y" * 90])
    rows = body.evidence(spark.createDataFrame([(1, "en", text), (2, "xx", text), (3, "en", None)], DOCS), {"en": ["chapter"]}).orderBy("place").collect()
    assert [(r.doc_id, r.line) for r in rows] == [(1, "Chapter"), (1, "2. Chapter: two"), (1, "(iv) chapter")]


def test_prose_by_script(spark):
    rows = [("中" * 24 + "。",), ("中" * 23 + "。",), ("中" * 30,), (PROSE,), (PROSE + "”",), ("",), (None,)]
    got = spark.createDataFrame(rows, "line string").select(lines.is_prose(F.col("line")).alias("p")).collect()
    assert [r.p for r in got] == [True, False, False, True, False, False, None]


def test_languages(spark):
    texts = {"中文 text": "zh", "ひらがな": "ja", "한국": "ko", "Київ": "uk", "МОСКВА": "ru", "dime qué es": "es", "und welche": "de", "plain": "en", "123": "unknown", " ": "unknown", None: "unknown"}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.infer_language(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == list(texts.values())
    names = {"EN_us": "en", "zh-Hant-TW": "zh", "Deutsch": "unknown", " fr ": "fr", None: "unknown"}
    got = spark.createDataFrame([(t,) for t in names], "t string").select(T.language_alias(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == list(names.values())


def test_layouts_of_nothing(spark):
    sections = spark.createDataFrame([(1, "a", 0, "x"), (1, "b", 1, " ")], "doc_id long, section_id string, section_index long, content string")
    units = spark.createDataFrame([], "doc_id long, unit_id string, unit_no long, source_section_ids array<string>")
    none = layout.assign_units(sections, units)
    assert none.count() == 0
    assert [(r.coverage, r.available) for r in layout.unit_coverage(sections, none).collect()] == [(0.0, False)]
    assert {(r.section_id, r.unit_id) for r in layout.selected_unit(sections, none).collect()} == {("a", None), ("b", None)}
    wanted = spark.createDataFrame([(1, "h", None)], "doc_id long, source_hash string, top_k int").withColumns({"split_mode": F.lit("s"), "resolver_version": F.lit("r")})
    assert not layout.layout_validity(wanted, wanted, sections, none).first().valid
    assert layout.layout_validity(wanted, wanted, sections.where("section_id = 'b'"), none).first().valid


def test_a_text_is_lowered_once_to_infer_its_language(spark):
    rows = spark.createDataFrame([(" Tema",)], "t string").select(T.infer_language(F.col("t")).alias("x"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert rows.collect()[0].x == "en"
