"""Validity of chapters' and units' artifacts: every reason, in its place."""

import hashlib

import pytest

from quire.operators import layout, validity

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
GOOD = {"key": "chapter_id::c0", "content": "Said", "items": [("q", "t", "a")], "source_hash": sha("body"), "language": "en", "split_mode": "semantic_safe", "top_k": 3, "prompt_version": "v1", "schema_version": "s1", "scope": "chapter", "for_chapter_id": "c0", "for_title": "One", "for_key": "chapter::One", "for_section_id": "s0"}
STORED = "doc_id long, key string, content string, items array<struct<question_id:string,question_text:string,answer_text:string>>, source_hash string, language string, split_mode string, top_k int, prompt_version string, schema_version string, scope string, for_chapter_id string, for_title string, for_key string, for_section_id string"
WANTED = "doc_id long, language string, split_mode string, top_k int, prompt_version string, schema_version string"


def judge(spark, changes, quiz):
    rows = [(i, *(({**GOOD, **c})[k] for k in GOOD)) for i, c in enumerate(changes) if c is not None]
    n = range(len(changes))
    chapters = spark.createDataFrame([(i, "c0", "One", "old::key", "s0") for i in n], "doc_id long, chapter_id string, title string, legacy_key string, source_section_id string")
    sections = spark.createDataFrame([(i, s, t) for i in n for s, t in (("s0", "body"), ("s1", "other"))], "doc_id long, section_id string, content string")
    wanted = spark.createDataFrame([(i, "en", "semantic_safe", 3, "v1", "s1") for i in n], WANTED)
    got = validity.chapter_validity(chapters, spark.createDataFrame(rows, STORED), sections, wanted, quiz).collect()
    return [(r.status, r.reason) for r in sorted(got, key=lambda r: r.doc_id)]


@pytest.mark.parametrize("quiz", [False, True])
def test_every_reason(spark, quiz):
    cases = [
        ({}, None), (None, "missing"), ({"key": "chapter::One"}, None), ({"key": "old::key"}, None), ({"key": "chapter_id::c9"}, "missing"),
        ({"content": " \n", "items": []}, "malformed_quiz_items" if quiz else "empty_content"),
        ({"content": None, "items": [("q", "t", " ")], "source_hash": "x"}, "malformed_quiz_items" if quiz else "empty_content"),
        ({"for_section_id": "gone", "source_hash": "x"}, "source_section_not_found"), ({"for_section_id": "s1"}, "source_hash_mismatch"), ({"for_section_id": "s1", "source_hash": sha("other")}, None), ({"for_section_id": " "}, None),
        ({"source_hash": "x", "language": "fr"}, "source_hash_mismatch"), ({"language": None}, "language_mismatch"), ({"split_mode": "progressive"}, "split_mode_mismatch"), ({"top_k": None}, "semantic_top_k_mismatch"), ({"prompt_version": "v0"}, "prompt_version_mismatch"),
        ({"schema_version": "s0"}, "quiz_schema_version_mismatch" if quiz else None), ({"scope": "section"}, "scope_mismatch"), ({"for_chapter_id": "c1", "for_title": "Two"}, "chapter_id_mismatch"), ({"for_chapter_id": None}, None), ({"for_title": None}, "chapter_title_mismatch"), ({"for_key": "zz"}, "chapter_key_mismatch"), ({"for_key": ""}, None),
    ]
    want = [("valid", None) if r is None else ("missing", None) if r == "missing" else ("invalid", r) for _, r in cases]
    assert judge(spark, [c for c, _ in cases], quiz) == want


def test_units_and_availability(spark):
    items = "items array<struct<question_id:string,question_text:string,answer_text:string>>"
    wanted = spark.createDataFrame([(1, f"u{i}", "h", "en", "safe", 3, "v", "s") for i in range(4)], "doc_id long, unit_id string, source_hash string, language string, split_mode string, top_k int, prompt_version string, schema_version string")
    stored = spark.createDataFrame([(1, "u0", [("q", "t", "a")], "h", "en", "safe", 3, "v", "s"), (1, "u1", None, "h", "en", "safe", 3, "v", "s"), (1, "u2", [("q", "t", "a")], "h", "en", "safe", 3, "v", None)], f"doc_id long, unit_id string, {items}, source_hash string, language string, split_mode string, top_k int, prompt_version string, schema_version string")
    got = validity.unit_quiz_validity(stored, wanted)
    assert {r.unit_id: (r.status, r.reason) for r in got.collect()} == {"u0": ("valid", None), "u1": ("invalid", "malformed_quiz_items"), "u2": ("invalid", "quiz_schema_version_mismatch"), "u3": ("missing", None)}
    both = layout.availability(got.limit(0), got, ["doc_id", "unit_id"]).collect()
    assert {r.unit_id: (r.has_summary, r.has_quiz, r.quiz_cache_valid) for r in both} == {"u0": (False, True, True), "u1": (False, True, False), "u2": (False, True, False)}
