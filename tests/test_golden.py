"""Fixtures with known outcomes for operators that the query tables do not exercise."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import parsing
from quire.functions import text as T
from quire.operators import artifacts, headings, hierarchy, profile, questions, retrieval, structure, units
from quire.plans import split_plans
from quire.sources import readers
from quire.streaming import sessions

BOOK = "Contents\nChapter 1\nChapter 2\nPreface\n" + "\n".join(
    f"Chapter {i}\nThis is a long line of plain prose that goes on for well over sixty characters, as body text does.\n1.{i} Detail\nMore prose follows here, again long enough to be seen as body text by every rule there is." for i in (1, 2)
) + "\nAppendix\nTables and figures that belong to neither chapter are listed in this closing part of the small book."


def docs(spark, *texts, lang="en"):
    return spark.createDataFrame([(i, t, lang) for i, t in enumerate(texts)], "doc_id long, text string, lang string")


def test_sections_cover_the_text(spark):
    rows = structure.sections(docs(spark, BOOK, "plain text without headings", "", None)).orderBy("doc_id", "section_index").collect()
    own = [r for r in rows if r.doc_id == 0]
    assert own[0].char_start == 0 and own[-1].char_end == len(BOOK)
    assert all(a.char_end == b.char_start for a, b in zip(own, own[1:]))
    assert "".join(r.content for r in own) == BOOK
    titles = [r.title for r in own]
    assert titles[0] == "Contents" and own[0].section_role == "toc"
    assert titles[-1] == "Appendix" and own[-1].section_role == "appendix"
    assert [r.section_id for r in rows if r.doc_id == 1] == ["section-0"]
    assert {r.doc_id for r in rows} == {0, 1, 2, 3}


def test_chapters_take_deeper_sections(spark):
    rows = structure.chapters(structure.sections(docs(spark, BOOK))).orderBy("section_index").collect()
    at = {r.title: r.chapter_seq for r in rows}
    assert at["1.1 Detail"] == [r.chapter_seq for r in rows if r.title == "Chapter 1"][-1]
    assert at["Appendix"] == max(at.values())
    stats = structure.structure_stats(structure.chapters(structure.sections(docs(spark, BOOK)))).first()
    assert stats.n_sections == len(rows) and stats.title_coverage == 1.0


def test_cuts_end_at_sentences(spark):
    text = " ".join(["This sentence has some words in it."] * 40)
    for least, most in ((40, 120), (260, 540)):
        ends = units.progressive_cuts(text, least, most)
        assert ends[-1] == len(text) and len(ends) > 1
        assert all(text[e - 1] in ". " for e in ends)
    quoted = "x" * 520 + ' He said "stop here." ' + "y" * 520
    first = quoted[: units.progressive_cuts(quoted, 260, 540)[0]]
    assert first.rstrip().endswith('."')
    plain = "a" * 2000
    assert units.progressive_cuts(plain, 300, 560)[-1] == 2000
    assert units.progressive_cuts("", 300, 560) == [0]


def test_short_units_merge(spark):
    """Against the plain loop over a list of units."""
    rng = random.Random(3)
    cases = [[(100, ""), (400, ""), (350, ""), (50, "")], [(10, "")], [(200, "")] * 3, [(100, "a"), (400, "b")], [(400, "a"), (100, "a"), (400, "b")]]
    cases += [[(rng.choice((20, 100, 200, 299, 300, 500)), rng.choice(("", "a", "b"))) for _ in range(rng.randint(1, 9))] for _ in range(60)]

    def plain(case):
        pending, closed = [[n, box, [i]] for i, (n, box) in enumerate(case)], []
        join = lambda x, y: [x[0] + 2 + y[0], x[1] or y[1], x[2] + y[2]]
        for i, now in enumerate(pending):
            now = pending[i]
            after = pending[i + 1] if i + 1 < len(pending) else None
            if now[0] >= 300 or (after is None and not closed):
                closed.append(now)
            elif after is not None and (after[1] == now[1] or not closed or closed[-1][1] != now[1]):
                pending[i + 1] = join(now, after)
            else:
                closed[-1] = join(closed[-1], now)
        return {i: k for k, x in enumerate(closed) for i in x[2]}

    rows = spark.createDataFrame([(d, i, n, box) for d, case in enumerate(cases) for i, (n, box) in enumerate(case)], "doc_id long, unit_no long, n_chars long, container string")
    got = {(r.doc_id, r.unit_no): r.merged_no for r in units.merge_short(rows).collect()}
    assert got == {(d, i): k for d, case in enumerate(cases) for i, k in plain(case).items()}
    assert [got[2, i] for i in range(3)] == [0, 0, 0]


def test_cuts_equal_a_search_of_every_place():
    rng = random.Random(4)
    for _ in range(150):
        text = "".join(rng.choice(["ab", "c ", ". ", ", ", "; ", "\n\n", "\n", '."', "。", "）", "  "]) for _ in range(rng.randint(20, 300)))
        n = len(text)
        for _ in range(5):
            ideal = rng.randint(1, n)
            low, high = max(1, ideal - rng.randint(0, 60)), min(n, ideal + rng.randint(0, 60))
            best = max(range(low, high + 1), key=lambda i: (units.cut_kind(text, i), -abs(i - ideal)))
            assert units.best_cut(text, low, high, ideal) == (best if units.cut_kind(text, best) else None)


def test_threshold_budget_and_clipping(spark):
    rows = spark.createDataFrame([(0.9, "strict"), (1.05, "strict"), (1.09, "strict"), (1.15, "cautious"), (1.27, "cautious"), (1.5, "reject"), (None, "reject")], "s double, m string")
    assert [r[0] for r in rows.select(T.near_chunk_threshold(F.col("s"), F.col("m"))).collect()] == [3, 2, 1, 1, 1, 2, 2]
    budget = spark.range(1).select(T.context_budget(F.lit(1500), F.lit(4000), F.lit(900), F.lit(2000)), T.context_budget(F.lit(1500), F.lit(1000), F.lit(900), F.lit(500))).first()
    assert tuple(budget) == (1100, 0)
    chunks = spark.createDataFrame([(1, 0, "word " * 100), (1, 1, "more"), (2, 0, "one"), (2, 1, "x" * 400), (3, 0, "漢字" * 30)], "doc_id long, chunk_index long, text string")
    got = {(r.doc_id, r.chunk_index): (r.tokens, r.text) for r in retrieval.budget_prefix(chunks, 20).collect()}
    assert set(got) == {(1, 0), (2, 0), (3, 0)}
    assert got[3, 0] == (20, "漢字" * 10) and got[1, 0][0] == 20 and got[1, 0][1] == ("word " * 20).strip()


def test_search_is_exact_in_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x[7] = x[8]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, 2.0]), (902, [float("nan")] * 8)], "vec_id long, embedding array<double>")
    for measure in ("distance", "cosine"):
        got = retrieval.search(rows, rows.where("vec_id % 7 = 0"), 5, measure, block=40).collect()
        for q in range(0, 300, 7):
            score = ((x - x[q]) ** 2).sum(1) if measure == "distance" else 1 - x @ x[q] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[q])
            order = sorted((i for i in range(300) if i != q), key=lambda i: (score[i], i))[:5]
            assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.place)] == order


def test_coverage_keeps_distant_hits(spark):
    hits = spark.createDataFrame([(1, i, p) for i, p in enumerate((10, 11, 14, 12, 17))], "q long, rank long, place long")
    assert sorted(r.place for r in retrieval.coverage(hits, "q", "rank", "place", 2).collect()) == [10, 14, 17]


def test_dynamic_window_respects_budget(spark):
    chunks = spark.createDataFrame([(1, i, "abcd" * 10) for i in range(9)], "doc_id long, chunk_index long, text string")
    hits = spark.createDataFrame([(1, 4), (1, 0), (1, 50)], "doc_id long, hit_index long")
    got = {r.hit_index: (r.first_index, r.last_index, r.tokens) for r in questions.dynamic_windows(hits, chunks, 45).collect()}
    assert got == {4: (3, 6, 40), 0: (0, 3, 40)} or got == {4: (2, 5, 40), 0: (0, 3, 40)}


def test_headings(spark):
    rows = spark.createDataFrame([("第十-章", "zh"), ("第十－章", "zh"), ("Chapter – 2", "en"), ("  Ｔｉｔｌｅ　one ", "en"), (None, "en")], "title string, lang string")
    got = [r[0] for r in rows.select(headings.normalize(F.col("title"), F.col("lang"))).collect()]
    assert got == ["第十一章", "第十一章", "Chapter - 2", "Title one", None]
    lines = spark.createDataFrame([("Appendix A",), ("Appendix:",), ("appendix to symbolic logic",), ("Appendices",)], "l string")
    assert [r[0] for r in lines.select(headings.marker_matches(F.col("l"), "appendix")).collect()] == [True, True, False, False]


def test_quiz_and_status(spark):
    good = json.dumps([{"question_id": str(i), "question_text": "q", "answer_text": "a"} for i in range(4)])
    rows = spark.createDataFrame([(f"```json\n{good}\n```",), (good.replace('"a"', '""'),), ("no json",), ("[]",), (None,)], "a string")
    assert [r[0] for r in rows.select(F.size(parsing.quiz_items(F.col("a")))).collect()] in ([4, -1, -1, -1, -1], [4, None, None, None, None])
    reasons = spark.createDataFrame([("status=503 | x",), ("chapter_not_found",), ("odd",)], "r string")
    assert [r[0] for r in reasons.select(parsing.http_status(F.col("r"))).collect()] == [503, 400, 400]
    assert [r[0] for r in spark.createDataFrame([("status=299 x",), ("Unit not found",), ("bad_request",)], "r string").select(parsing.http_status(F.col("r"), "reparse")).collect()] == [500, 500, 400]


def test_split_plan(spark):
    text = "Intro line\nStart here\nbody\nStart here\nmore\nThe End part\nlast"
    plan = {"parser_mode": "llm", "sections": [{"title": "A", "start_anchor_text": "start  HERE", "anchor_occurrence": 2}, {"title": "B", "start_anchor_text": "end part", "anchor_match_mode": "contains", "anchor_occurrence": 9}, {"title": "C", "start_anchor_text": "not there"}]}
    answers = spark.createDataFrame([(0, json.dumps(plan)), (1, "{broken")], "doc_id long, answer string")
    got = split_plans.apply(split_plans.parse(answers), docs(spark, text, text)).orderBy("section_index").collect()
    assert [(r.doc_id, r.title, r.char_start, r.char_end) for r in got] == [(0, "A", text.rindex("Start"), text.index("The End")), (0, "B", text.index("The End"), len(text))]


def test_validity_reasons(spark):
    fields = ("source_hash", "language", "split_mode", "top_k", "prompt_version", "scope")
    want = ("h", "en", "semantic_safe", 3, "v1", "chapter")
    schema = "doc_id long, section_id string, source_hash string, language string, split_mode string, top_k int, prompt_version string, scope string, chapter_title string"
    stored = [(0, "s", *want, "One", "s", "ok"), (1, "s", *want, "One", "s", " "), (9, "s", *want, "Two", "s", "ok"), (10, "s", *want, "One", "t", "ok")]
    stored += [(2 + i, "s", *(want[j] if i != j else (5 if f == "top_k" else "x") for j, f in enumerate(fields)), "One", "s", "ok") for i in range(6)]
    wanted = spark.createDataFrame([(i, "s", *want, "One") for i in range(11)], schema)
    got = artifacts.summary_validity(spark.createDataFrame(stored, schema + ", source_section_id string, content string"), wanted).orderBy("doc_id").collect()
    assert [r.reason for r in got] == [None, "empty_content", "source_hash_mismatch", "language_mismatch", "split_mode_mismatch", "semantic_top_k_mismatch", "prompt_version_mismatch", "scope_mismatch", None, "chapter_title_mismatch", "section_id_mismatch"]
    assert [r.status for r in got][::8] == ["valid", "missing"]


def test_chapter_keys(spark):
    chapters = spark.createDataFrame([(1, "c0", None, "One"), (1, "c1", "chapter_id::c1", " "), (1, "c2", " old ", "Two")], "doc_id long, chapter_id string, legacy_key string, title string")
    got = [(r.chapter_id, r.place, r.key) for r in artifacts.chapter_keys(chapters).orderBy("chapter_id", "place").collect()]
    assert got == [("c0", 0, "chapter_id::c0"), ("c0", 1, "chapter::One"), ("c1", 0, "chapter_id::c1"), ("c2", 0, "chapter_id::c2"), ("c2", 1, "old"), ("c2", 2, "chapter::Two")]


def test_upsert_and_uniqueness(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    got = artifacts.upsert(base, spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string"), ["id"])
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert artifacts.assert_unique(got, ["id"]).count() == 3
    with pytest.raises(Exception, match="duplicate keys"):
        artifacts.assert_unique(base.union(base), ["id"]).collect()


def test_hierarchy_lookups(spark):
    rows = spark.createDataFrame([(1, "s0", "c0", "c0"), (1, "s1", "c0", "c1"), (1, "s1", None, None)], "doc_id long, section_id string, chapter_id string, parent_chapter_id string")
    chapters = spark.createDataFrame([(1, "c0"), (1, "c0"), (1, "c0")], "doc_id long, chapter_id string")
    parts = spark.createDataFrame([(1, "u0", "s0", None), (1, "u0", "s1", "s0")], "doc_id long, unit_id string, section_id string, parent_section_id string")
    assert sorted((r.warning, r.subject, r.n) for r in hierarchy.validate(chapters, rows, parts).collect()) == [("duplicate_chapter_id", "c0", 2), ("duplicate_task_unit_id", "u0", 1), ("legacy_sections_present", "", 1), ("section_parent_mismatch", "s1", 1), ("task_unit_parent_section_mismatch", "u0", 1)]
    found = hierarchy.section_by_id(rows, spark.createDataFrame([(1, "s0"), (1, "s1"), (1, "s9")], "doc_id long, section_id string"))
    assert {r.section_id: r.status for r in found.collect()} == {"s0": "found", "s1": "ambiguous", "s9": "missing"}


def test_profiles_of_odd_texts(spark):
    odd = docs(spark, None, "", "— Oui.\n— Non.\n— Si.\n— Ja.", "漢字" * 20, "a  b  c�" * 50)
    assert [r.dialogue_density for r in profile.dialogue_density(odd).orderBy("doc_id").collect()][2] == "high"
    assert [r.script_system for r in profile.script_system(odd).orderBy("doc_id").collect()][:4] == ["unknown", "unknown", "latin", "cjk"]
    assert profile.ocr_noise(odd).where("doc_id = 4").first().noise_level == "high"
    for report, column in ((profile.ocr_noise, "noise_level"), (profile.line_break_quality, "line_break_quality"), (profile.dialogue_density, "dialogue_density")):
        assert [r[column] for r in report(odd).orderBy("doc_id").collect()][:2] == ["unknown", "unknown"]
    spoken = docs(spark, "\n".join(['"Yes," he said.', '"No," she said.', '"Go," he said.'] * 3 + ["Plain words."] * 5), "one\r\ntwo\u2028three\x0cfour\n", "word. " * 300 + "\n" + "...... 12\n..... 3\n")
    assert profile.dialogue_density(spoken).where("doc_id = 0").first().dialogue_density == "high"
    assert profile.line_break_quality(spoken).where("doc_id = 1").first().n_lines == 4
    assert profile.region_likelihoods(spoken).where("doc_id = 2").first().toc_likelihood == "medium"
    assert profile.line_break_quality(odd).count() == profile.region_likelihoods(odd).count() == 5
    tokens = [r[0] for r in odd.select(T.estimate_tokens(F.col("text"))).collect()]
    assert tokens[:2] == [0, 0] and tokens[3] == 40


def test_sources(spark, tmp_path):
    (tmp_path / "one.txt").write_text("first\nsecond")
    assert tuple(readers.read_texts(spark, str(tmp_path / "*.txt")).first()) == ("one", "first\nsecond")
    (tmp_path / "d.json").write_text(json.dumps({"document_id": "d", "chapters": []}))
    with pytest.raises(Exception, match="without chapters"):
        readers.read_structured(spark, str(tmp_path / "d.json")).collect()


def test_stream_equals_replay(spark, tmp_path):
    rows = [(s, t, "d1" if t < 12 else "d2", None if t % 4 == 0 else t) for s in (1, 2) for t in range(20)]
    turns = spark.createDataFrame(rows, "session_id long, turn long, doc_name string, best_chunk long")
    turns.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(turns.schema).parquet(str(tmp_path / "in"))
    query = sessions.stream(source).writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(repr, spark.table("replayed").collect())) == sorted(map(repr, sessions.replay(turns).collect()))
