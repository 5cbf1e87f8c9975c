"""The chapter state machine against a plain one; anchors and unit plans against plain searches."""

import random
import re

import pytest

from quire.operators import chapters
from quire.plans import unit_plans

EN = re.compile(r"^(?:chapter|chap\.)\s+(?:\d+|[ivxlcdm]+|one|two|three|four|five|six|seven|eight|nine|ten)\b", re.I)
ZH, SUB = re.compile(r"^第[一二三0-9]+章\b"), re.compile(r"^\d+(?:\.\d+)+\b|^第[一二三0-9]+(?:节|節|部|篇)\b")


def plain(rows):
    """(index, chapter id, title, level, role, kind, implicit) of one document's sections, one after the other."""
    made, out, open_, special, counts = [], [], None, None, {}
    for i, title, level, role in rows:
        name, level = (title or "").strip(), max(1, level if level is not None else 1)
        main = role in (None, "main_body")
        headed = bool(EN.match(name) or ZH.match(name))
        if main and not headed and open_ is not None and (SUB.match(name) or level > open_["level"]):
            kind = "subsection"
        elif main:
            open_, special = {"id": f"chapter-{len(made)}", "title": title if headed else title or f"Main Body {len(made) + 1}", "level": level, "role": role if headed else "main_body", "n": 0}, None
            made.append(open_)
            kind = "chapter_body"
        else:
            open_ = None
            wanted = role if role in chapters.LABELS else "unknown_region"
            if special is None or special["role"] != wanted:
                special = {"id": f"{wanted.replace('_', '-')}-{counts.get(wanted, 0)}", "title": chapters.LABELS[wanted], "level": level, "role": wanted, "n": 0}
                counts[wanted] = counts.get(wanted, 0) + 1
                made.append(special)
            kind = role
        own = open_ if main else special
        own["n"] += 1
        out.append((i, own, kind))
    return [(i, c["id"], c["title"], c["level"], c["role"], kind, kind == "chapter_body" and c["n"] == 1) for i, c, kind in out]


def test_chapters_equal_the_state_machine(spark):
    rng = random.Random(8)
    titles = ["Chapter 1", "chap. IV: x", "Chapter Zero", "1.2 Part", "第三章 名", "第二节", "Notes", None, "", " ", "3.4.5", "Epilogue"]
    roles = [None, "main_body", "main_body", "main_body", "toc", "front_matter", "appendix", "back_matter", "odd"]
    docs = {d: [(i, rng.choice(titles), rng.choice([None, 0, 1, 2, 3, 4]), rng.choice(roles[: rng.randint(1, 9)])) for i in range(rng.randint(1, 30))] for d in range(120)}
    rows = [(d, *r, "clash") for d, own in docs.items() for r in own]
    frame = spark.createDataFrame(rows, "doc_id long, section_index long, title string, level int, section_role string, kind string").repartition(3)
    got = {}
    for r in chapters.chapter_table(frame).collect():
        got.setdefault(r.doc_id, []).append((r.section_index, r.chapter_id, r.chapter_title, r.chapter_level, r.chapter_role, r.section_kind, r.is_implicit))
    assert {d: sorted(own) for d, own in got.items()} == {d: plain(own) for d, own in docs.items()}
    assert chapters.chapter_table(frame.limit(0)).count() == 0


def test_known_chapters(spark):
    rows = [(1, i, t, n, r) for i, (t, n, r) in enumerate([("Contents", 1, "toc"), ("Chapter 1", 2, "main_body"), ("1.1 A", 2, "main_body"), ("Deep", 3, "main_body"), ("Flat", 2, "main_body"), ("Chapter 2", 2, None), ("Appendix", 1, "appendix"), ("Appendix B", 1, "appendix"), ("After", 5, "main_body"), ("Notes", 1, "toc")])]
    got = chapters.chapter_table(spark.createDataFrame(rows, "doc_id long, section_index long, title string, level int, section_role string")).orderBy("section_index").collect()
    assert [r.chapter_id for r in got] == ["toc-0", "chapter-1", "chapter-1", "chapter-1", "chapter-2", "chapter-3", "appendix-0", "appendix-0", "chapter-5", "toc-1"]
    assert [r.is_implicit for r in got] == [False, False, False, False, True, True, False, False, True, False]


TEXT = "\n".join(["Intro line with some words " * 20, "Start HERE", "body one " * 60, "  start   here ", "body two " * 60, "No. 12 end", "tail of it " * 30])
PLANS = "doc_id long, section_index long, place int, title string, anchor string, match_mode string, occurrence int"
SECTIONS = "doc_id long, section_index long, title string, container_title string, text string"


@pytest.mark.parametrize("mode, anchor, nth, want", [("exact", "START here", 1, "Start HERE"), ("exact", "start here", 2, "start   here"), (None, "start here", 9, "start   here"), ("contains", "T HER", 1, "Start HERE"), ("regex", r"No\. \d+", 1, "No. 12"), ("regex", "^start", 1, "start   here"), ("regex", "(unclosed", 1, None), ("regex", "*", 1, None), ("regex", r"(?i)^START\s", 2, "start   here"), ("exact", " ", 1, None), ("exact", "absent", 1, None), ("regex", "(a+)+$", 1, None)])
def test_anchors(spark, mode, anchor, nth, want):
    text = TEXT + "\n" + "a" * 60 + "!" if anchor == "(a+)+$" else TEXT
    plans = spark.createDataFrame([(1, 0, 0, "t", anchor, mode, nth)], PLANS)
    got = [r.char_start for r in unit_plans.anchors(plans, spark.createDataFrame([(1, 0, None, None, f" {text}\n")], SECTIONS)).collect()]
    stripped = text.strip()
    if want is None:
        assert got == []
    else:
        line = stripped[got[0] :].split("\n")[0]
        assert line.strip().startswith(want)


def test_unit_plans(spark):
    sections = [(1, i, "Title ", " Box", TEXT) for i in range(7)] + [(1, 7, None, None, " "), (1, 8, "", None, TEXT)]
    plan = {
        0: [("First", "start here", "exact", 1), (" ", "start here", "exact", 2), ("Again", r"^Start", "regex", 1)],
        1: [("x", "absent", "exact", 1)],
        2: [("x", "intro line", "contains", 1)],
        3: [("x", f"a{i}", "exact", 1) for i in range(33)],
        5: [("x", r"^No\.", "regex", 1), ("y", "start here", "exact", 2), ("z", "start here", "exact", 1)],
        6: [("x", "tail of it", "contains", 1), ("y", "no. 12 end", "exact", 1)],
        7: [("x", "a", "exact", 1)],
        8: [(None, "start here", "exact", 2)],
    }
    plans = spark.createDataFrame([(1, s, k, *x) for s, own in plan.items() for k, x in enumerate(own)], PLANS)
    units, others = unit_plans.planned_units(plans, spark.createDataFrame(sections, SECTIONS), 100, 2000)
    reasons = {r.section_index: r.reason for r in others.collect()}
    assert reasons == {1: "no_resolved_boundaries", 2: "resolved_boundaries_too_few", 3: "too_many_plan_instructions:33", 4: "empty_or_invalid_llm_plan", 7: "empty_section_content"}
    got = {}
    for r in units.orderBy("section_index", "unit_no").collect():
        got.setdefault(r.section_index, []).append(r)
    assert [u.title for u in got[0]] == ["Title", "First", "Title (Part 3)"] and {u.container_title for u in got[0]} == {"Box"}
    assert [u.title for u in got[5]] == ["Title", "z", "y", "x"] and [u.unit_id for u in got[5]][-1] == "task-unit-5-3"
    assert [u.title for u in got[8]] == ["Task Unit 1", "Task Unit 2"]
    assert "".join(u.text for u in got[0]).replace("\n", "").replace(" ", "") == TEXT.replace("\n", "").replace(" ", "")
    assert unit_plans.planned_units(plans.limit(0), spark.createDataFrame([], SECTIONS))[0].count() == 0
