"""Sections from end to end: contents left out, parts as containers that carry on, weak headings, and awkward texts."""

from quire.operators import parse

PROSE = "This is a sentence that is long enough to count as prose, for it has many words and it ends here."


def made(spark, text, lang="en"):
    docs = spark.createDataFrame([(1, text, lang, 7)], "doc_id long, text string, lang string, level long")
    return [(r.title, r.level, r.container, r.section_role, r.content) for r in parse.sections(docs, ["summary"]).orderBy("section_index").collect()]


def test_contents_are_left_out_and_containers_carry_on(spark):
    listing = "Contents\nPart 1\nChapter 1\nChapter 2\nPart 2\nChapter 3\n"
    body = f"Part 1\nChapter 1\n{PROSE}\nChapter 2\n{PROSE}\nPart 2\n***\nChapter 3\n{PROSE}\nEpilogue\n{PROSE}"
    got = made(spark, listing + body)
    assert [x[:3] for x in got] == [("Chapter 1", 2, "Part 1"), ("Chapter 2", 2, "Part 1"), ("Chapter 3", 2, "Part 2"), ("Epilogue", 1, "Part 2")]
    assert got[0][4] == f"Chapter 1\n{PROSE}\n" and got[3][3] == "back_matter"
    assert got[1][4] == f"Chapter 2\n{PROSE}\nPart 2\n***\n"


def test_a_part_that_says_something_is_a_section(spark):
    got = made(spark, f"{PROSE}\nPart 1\n{PROSE}\nChapter 1\n{PROSE}\nPart 2\nChapter 2\n{PROSE}\nChapter 3\n{PROSE}")
    assert [x[:3] for x in got] == [(None, 1, None), ("Part 1", 1, None), ("Chapter 1", 2, None), ("Chapter 2", 2, "Part 2"), ("Chapter 3", 2, "Part 2")]
    assert "".join(x[4] for x in got).startswith(PROSE)


def test_weak_headings_only_where_there_are_no_others(spark):
    weak = f"{PROSE}\n\nA short line\n\n{PROSE}\n\nSummary of what was said in all of it here\n\n{PROSE}"
    assert [x[0] for x in made(spark, weak)] == [None, "A short line", "Summary of what was said in all of it here"]
    assert [x[0] for x in made(spark, weak + f"\n\nChapter 1\n{PROSE}")] == [None, "Chapter 1"]
    assert [x[0] for x in made(spark, f"{PROSE}\n\nOnly one\n\n{PROSE}")] == [None]


def test_awkward_texts(spark):
    assert made(spark, None) == []
    assert [x[4] for x in made(spark, "")] == [""]
    assert [x[4] for x in made(spark, " \n ", None)] == [" \n "]
    assert [x[0] for x in made(spark, "Chapter 1")] == ["Chapter 1"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert parse.sections(empty, []).collect() == []
