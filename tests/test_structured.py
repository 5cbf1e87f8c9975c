"""Nested documents and their flat tables, both ways; records of every form in one folder."""

import json
import random

from quire.sources import structured


def nested(spark, n=25):
    rng = random.Random(3)
    unit = lambda d, s, k: {"unit_id": f"u{d}-{s}-{k}", "title": None, "content": "x" * k}
    docs = []
    for d in range(n):
        chapters, s = [], 0
        for c in range(40 if d == 3 else rng.choice([0, 1, 2, 3])):
            sections = []
            for _ in range(rng.choice([0, 1, 5])):
                sections.append({"section_id": f"s{s}", "title": rng.choice([None, "T"]), "level": s % 3, "content": "c", "char_start": s, "char_end": s + 1, "section_role": None, "task_units": [unit(d, s, k) for k in range(rng.choice([0, 1, 12]))]})
                s += 1
            chapters.append({"chapter_id": f"c{c}", "title": f"C{c}", "level": 1, "sections": sections})
        docs.append((f"d{d}", f"D{d}", rng.choice([None, "en"]), "text", chapters))
    return spark.createDataFrame(docs, f"document_id string, title string, language string, raw_text string, chapters array<{structured.CHAPTER}>").repartition(3)


def told(df):
    return sorted(json.dumps(r.asDict(True), sort_keys=True, default=str) for r in df.collect())


def test_there_and_back(spark):
    docs = nested(spark)
    tables = structured.flatten(docs)
    back = structured.assemble(tables)
    assert told(back.drop("orphans")) == told(docs)
    assert all(r.orphans == [] for r in back.collect())
    for a, b in zip(structured.flatten(back), tables, strict=True):
        assert told(a) == told(b)
    plan = back._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_orphans_are_told(spark):
    t = structured.flatten(nested(spark).where("document_id in ('d1', 'd2', 'd3')"))
    more = spark.createDataFrame([("d1", "nowhere", 0, "u", None, "x"), ("dx", "s0", 0, "v", None, "y")], t.units.schema)
    sections = spark.createDataFrame([("d2", "no-chapter", 9, "lost", None, 1, "c", 0, 1, None)], t.sections.schema)
    chapters = spark.createDataFrame([("dy", 0, "c", "C", 1), ("d3", 99, "c0", "again", 1)], t.chapters.schema)
    got = {r.document_id: [tuple(x) for x in r.orphans] for r in structured.assemble(structured.Tables(t.documents, t.chapters.unionByName(chapters), t.sections.unionByName(sections), t.units.unionByName(more))).collect()}
    assert got["d1"] == [("unit", "u")] and got["dx"] == [("unit", "v")] and got["d2"] == [("section", "lost")] and got["dy"] == [("chapter", "c")]
    assert got["d3"] == [("repeated_chapter", "c0")]
    assert structured.assemble(structured.Tables(*(x.limit(0) for x in t))).count() == 0


def test_records_of_every_form(spark, tmp_path):
    section = {"section_id": "s0", "title": "Chapter 1", "level": 2, "content": "c", "char_start": 0, "char_end": 1, "section_role": "main_body", "task_units": [{"unit_id": "u0", "title": "t", "content": "c"}], "extra": 1}
    head = lambda d: {"document_id": d, "title": "T", "raw_text": "some text"}
    good = [
        head("nested") | {"chapters": [{"chapter_id": "c9", "title": "C", "level": 1, "sections": [section]}], "sections": [section, section]},
        head("flat") | {"sections": [section, section | {"section_id": "s1", "title": "Sub", "level": 3, "task_units": None}, section | {"section_id": "s2", "title": "End", "section_role": "appendix"}], "chapters": []},
        head("nodes") | {"structure_nodes": [{"node_id": "n0", "node_type": "section", "title": "A", "level": 1, "content": "x"}], "sections": None},
        head("bare"),
    ]
    bad = ['{"document_id": "cut", "title": "T", "raw_te', json.dumps({"title": "T", "raw_text": "x"}), json.dumps(head("wrong") | {"sections": "none"}), "[1, 2]", "not json", json.dumps(head(" ")), json.dumps({"document_id": "n", "title": "T"})]
    (tmp_path / "a.json").write_text("\n".join([*map(json.dumps, good[:2]), "", *bad[:3]]))
    (tmp_path / "b.json").write_text("\n".join([*map(json.dumps, good[2:]), *bad[3:], "   "]))
    tables, unread = structured.read_records(spark, str(tmp_path / "*.json"))
    assert sorted(r.record for r in unread.collect()) == sorted(bad)
    reasons = {r.record: r.reason for r in unread.collect()}
    assert [reasons[b] for b in bad] == ["malformed", "missing_document_id", "malformed", "malformed", "malformed", "missing_document_id", "missing_raw_text"]
    assert {r.file.rsplit("/", 1)[1] for r in unread.collect()} == {"a.json", "b.json"}
    docs = {r.document_id: r for r in structured.assemble(tables).collect()}
    assert set(docs) == {"nested", "flat", "nodes", "bare"} and all(r.orphans == [] for r in docs.values())
    shape = lambda d: [(c.chapter_id, [(s.section_id, [u.unit_id for u in s.task_units]) for s in c.sections]) for c in docs[d].chapters]
    assert shape("nested") == [("c9", [("s0", ["u0"])])]
    assert shape("flat") == [("chapter-0", [("s0", ["u0"]), ("s1", [])]), ("appendix-0", [("s2", ["u0"])])]
    assert shape("nodes") == [("chapter-0", [("n0", [])])] and shape("bare") == [("chapter-0", [("section-0", [])])]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "c.json").write_text("")
    assert structured.read_records(spark, str(tmp_path / "none"))[0].documents.count() == 0
