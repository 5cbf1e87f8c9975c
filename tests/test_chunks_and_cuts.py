"""Sentence chunks and cut sections against plain versions that look at one place after the other."""

import random
import re

import numpy as np
import pytest

from quire.operators import chunks, cuts
from quire.plans.text_queries import QUERIES, letter_counts

SF = "/root/testdata/sf0.001"
TERMINAL, STRONG, CLAUSE, CLOSERS = ".!?。！？؛؟", ";；", ",，:：、", "\"'”’»›」』》)]}）】〕〉》"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def tokens(text):
    quarter = sum(c < "\x80" and not c.isspace() for c in text)
    return (quarter + 3) // 4 + sum(c >= "\x80" and not c.isspace() for c in text)


def odd_texts():
    rng = random.Random(2)
    alphabet = "ab .!?。é漢\n\t\"')  \x1c\x85，;:"
    return ["", " ", "\n\n", "one", "é" * 700, "x" * 2500, "漢字。" * 300, "No end " * 200, "A. B! C? " * 100, '"Quoted." (Yes.) ' * 60, "a\n \nb\n\n\nc. d"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 900))) for _ in range(150)]


def test_token_sums_are_those_of_the_estimate():
    for text in odd_texts():
        quarter, whole = chunks.token_sums(text)
        for i in range(0, len(text), 37):
            for j in range(i, len(text) + 1, 53):
                assert (quarter[j] - quarter[i] + 3) // 4 + whole[j] - whole[i] == tokens(text[i:j]), repr(text[i:j])


@pytest.mark.parametrize("most, overlap", [(300, 50), (20, 5), (3, 0), (1, 1)])
def test_chunks_cover_texts_within_the_budget(most, overlap):
    for text in odd_texts():
        got = chunks.packed(text, most, overlap)
        assert (got == []) == (text == "")
        bounds, _, _ = chunks.pieces(text, most)
        for k, (start, end, n) in enumerate(got):
            assert n == tokens(text[start:end]) <= most and start in bounds and end in bounds
            before = got[k - 1] if k else (-1, 0, 0)
            assert before[0] < start <= before[1] < end
            if k:
                assert tokens(text[start : before[1]]) <= overlap
                back = bounds[bounds.index(start) - 1]  # one piece more would be too much
                if back > before[0] and start < before[1]:
                    first_new = bounds[bounds.index(before[1]) + 1]
                    assert tokens(text[back : before[1]]) > overlap or tokens(text[back:first_new]) > most
            if end < len(text):
                assert tokens(text[start : bounds[bounds.index(end) + 1]]) > most
        if got:
            assert got[0][0] == 0 and got[-1][1] == len(text)


def test_sentences_of_known_texts():
    cut = lambda t: [t[a:b] for a, b in zip([0, *chunks.sentence_ends(t)], chunks.sentence_ends(t), strict=False)]
    assert cut('He said "No." Then (yes!) 3.5 left...  End') == ['He said "No." ', "Then (yes!) ", "3.5 left...  ", "End"]
    assert cut("一。二！」三") == ["一。", "二！」", "三"]
    assert cut("a\n \nb\nc") == ["a\n \n", "b\nc"]


def test_chunk_rows_of_awkward_tables(spark):
    rows = [(1, None, 5), (2, "", 6), (3, "A b. C d.", 7), (3, "A b. C d.", 7), (None, "x", 8)]
    got = chunks.sentence_chunks(spark.createDataFrame(rows, "doc_id long, text string, n_tokens long"), 1, 0).collect()
    assert sorted((str(r.doc_id), r.chunk_index, r.text) for r in got) == [("3", 0, "A b. "), ("3", 0, "A b. "), ("3", 1, "C d."), ("3", 1, "C d."), ("None", 0, "x")]
    assert chunks.sentence_chunks(spark.createDataFrame([], "doc_id long, text string")).count() == 0


class Plain:
    """Cuts of one section, place by place."""

    def __init__(self, mode, least, most, score=None, left=12):
        self.mode, self.least, self.most, self.score, self.left = mode, least, most, score, left
        self.n = dict.fromkeys(cuts.COUNTERS, 0)

    def back(self, text, i, steps):
        for _ in range(steps):
            i -= 1
            if i < 0:
                return ""
            if not (text[i].isspace() or text[i] in CLOSERS):
                return text[i]
        return ""

    def kind(self, text, i):
        if not 0 < i < len(text):
            return 0
        if re.search(r"\n\s*\n\s*$", text[max(0, i - 6) : i]) or re.match(r"^\s*\n\s*\n", text[i : i + 6]):
            return 5
        last = self.back(text, i, 10)
        for chars, value in ((TERMINAL, 4), (STRONG, 3), (CLAUSE, 2)):
            if last and last in chars:
                return value
        return 1 if text[i - 1] == "\n" else 0

    def moved(self, text, i):
        def scan(i):
            j = i
            while j < len(text) and j < i + 8 and (text[j].isspace() or text[j] in CLOSERS):
                j += 1
            return j, any(c in CLOSERS for c in text[i:j])

        to, last = i, self.back(text, i, 8)
        if 0 < i < len(text) and last and last in TERMINAL + STRONG:
            to = scan(i)[0]
        end = to
        if 0 < to < len(text) and scan(to)[1]:
            end = scan(to)[0]
        self.n["inside_terminal_cluster"] += to > i
        self.n["orphan_closing_start"] += end > to
        return end

    def quietly(self, text, i):
        before = dict(self.n)
        out = self.moved(text, i)
        after, self.n = self.n, before
        return out, after

    def record(self, text, cut, fallback=False):
        k, n = self.kind(text, cut), self.n
        n["paragraph_cut"] += k == 5
        n["sentence_cut"] += k in (3, 4)
        n["hard_cut"] += k == 0 or (fallback and k in (1, 2))
        for name in ("potential_mid_sentence_cut", "mid_sentence_cut"):
            n[name] += k < 3
        for name in ("source_quality_fallback", "source_quality_issue"):
            n[name] += fallback
        return cut

    def search(self, text, low, high, ideal):
        low, high = max(1, low), min(len(text), high)
        if low >= high:
            return min(max(ideal, low), high)
        found = {}
        for i in range(low, high + 1):
            k = self.kind(text, i)
            if k < 2:
                continue
            to, counted = self.quietly(text, i)
            if not 0 < to < len(text) or to < low or to > high + 8:
                continue
            self.n = counted
            found[to] = max(found.get(to, 0), self.kind(text, to) or k)
        if not found:
            self.n["no_sentence_boundary"] += 1
            return self.record(text, min(max(ideal, low), high), True)
        score = {i: -abs(i - ideal) / 8 + {1: 0.2, 2: 0.5, 3: 2.0, 4: 3.0, 5: 4.0}[k] for i, k in found.items()}
        if self.score:
            top = sorted(sorted(found), key=lambda i: -score[i])[: min(3, self.left)]
            self.left -= len(top)
            self.n["windows_reranked" if top else "budget_exhausted"] += 1
            for i in top:
                value = self.score([(text, i)])[0]
                if value == value:
                    score[i] += value
                    self.n["candidates_scored"] += 1
        for k in {"semantic_safe": (5, 4, 3, 2), "progressive": (4, 3, 2, 5)}[self.mode]:
            own = [i for i in sorted(found) if found[i] == k]
            if own:
                best = max(own, key=lambda i: (score[i], -abs(i - ideal)))
                return self.record(text, self.moved(text, best))
        for name in ("hard_cut", "no_sentence_boundary", "source_quality_issue", "source_quality_fallback"):
            self.n[name] += 1
        return self.record(text, self.moved(text, min(max(ideal, 1), max(1, len(text) - 1))))

    def windows(self, text):
        out, at, width = [], 0, max(60, self.most // 5)
        while len(text) - at > self.most:
            ideal, high = at + self.most, min(len(text), at + self.most + width)
            low = max(min(len(text), at + self.least), ideal - width)
            cut = self.search(text, low if low < high else min(len(text), at + self.least), high, ideal)
            cut = cut if cut > at else min(len(text), at + self.most)
            out.append(text[at:cut].strip())
            at = cut
        return [x for x in [*out, text[at:].strip()] if x]

    def units(self, text):
        if self.mode == "progressive":
            parts = self.windows(text)
        else:
            parts, open_ = [], None
            for p in (p.strip() for p in re.split(r"\n\s*\n+", text) if p.strip()):
                if open_ is not None and len(open_) + 2 + len(p) <= self.most:
                    open_ += "\n\n" + p
                    continue
                parts += [open_] if open_ is not None else []
                open_ = p if len(p) <= self.most else None
                parts += [] if open_ is not None else self.windows(p)
            parts += [open_] if open_ is not None else []
        for _ in range(max(4, 4 * len(parts))):
            if len(parts) < 2 or len(parts[-1]) >= self.least:
                break
            both = parts[-2] + "\n\n" + parts[-1]
            cut = 0 if len(both) <= self.most else self.search(both, self.least, max(len(both) - self.least, self.least + 1), len(both) // 2)
            a, b = both[:cut].strip(), both[cut:].strip()
            parts[-2:] = [a, b] if 0 < cut < len(both) and a and b and [a, b] != parts[-2:] else [both]
        for a, b in zip(parts, parts[1:], strict=False):
            self.n["orphan_closing_start"] += b[0] in CLOSERS
            self.n["source_quality_issue"] += b[0] in CLOSERS
            end = a.rstrip(CLOSERS)
            self.n["mid_sentence_cut"] += not (end and end[-1] in TERMINAL + STRONG + CLAUSE)
        return parts


SCORE = cuts.BySnippets(letter_counts)


def cut_texts():
    rng = random.Random(4)
    alphabet = ["word", "a", " ", " ", " ", ". ", ", ", "; ", "\n", "\n\n", '" ', ")", "»", "。", "é", "! ", "   \n  \n "]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 500))) for _ in range(60)] + ["x" * 900, "\n".join(["line"] * 200), ('"' * 12 + ". ") * 40, "a)" * 300]


@pytest.mark.parametrize("mode", ["semantic_safe", "progressive"])
@pytest.mark.parametrize("score", [None, SCORE])
def test_cuts_equal_the_plain_version(mode, score):
    some = [t.strip() for t in cut_texts() if t.strip()]
    for least, most, budget in ((20, 90, 12), (60, 200, 4), (150, 160, 2)):
        made = [cuts.Cutter(mode, least, most, score is not None, left=budget) for _ in some]
        got = cuts.side_by_side([c.units(t) for c, t in zip(made, some, strict=True)], score)
        for text, cutter, parts in zip(some, made, got, strict=True):
            plain = Plain(mode, least, most, score, budget)
            assert parts == plain.units(text), repr(text)
            assert {n: getattr(cutter.counters, n) for n in cuts.COUNTERS} == plain.n


@pytest.mark.parametrize("mode, name", [("semantic_safe", "semantic_units"), ("progressive", "windowed_units")])
def test_units_of_the_tables(spark, texts, mode, name):
    """All texts of the table as one section each, with scores."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sections = docs.selectExpr("doc_id", "0L section_index", "' T ' title", "'' container_title", "text")
    got = {}
    for r in sorted(cuts.split_sections(sections, mode, score=SCORE).collect(), key=lambda r: (r.doc_id, r.part_no)):
        got.setdefault(r.doc_id, []).append(r)
    for doc, text in texts.items():
        text = text.strip()
        if len(text) <= 1600:
            assert [(r.text, r.title, r.unit_id, r.container_title) for r in got.get(doc, [])] == ([(text, "T", "task-unit-0", None)] if text else [])
            continue
        plain = Plain(mode, 300, 1600, SCORE)
        want = plain.units(text)
        assert [r.text for r in got[doc]] == want
        assert got[doc][0].counters.asDict() == plain.n and all(r.counters is None for r in got[doc][1:])
        assert [r.title for r in got[doc]] == ([f"T (Part {i + 1})" for i in range(len(want))] if len(want) > 1 else ["T"])
    assert QUERIES[name](spark, SF).count() >= len(got)


def test_questions_are_asked_together():
    calls = []

    def score(asked):
        calls.append(len(asked))
        return np.zeros(len(asked))

    made = [cuts.Cutter("progressive", 20, 100, True) for _ in range(50)]
    cuts.side_by_side([c.units("Some words here. " * 40) for c in made], score)
    assert len(calls) <= 13 and sum(calls) == sum(c.counters.candidates_scored for c in made) == 600
    assert all(c.left == 0 and c.counters.budget_exhausted > 0 for c in made)


def test_awkward_sections(spark):
    rows = [(1, 0, None, None, None), (1, 1, " ", "C ", " \n "), (1, 2, "", " C", "short"), (2, 0, None, None, "Word. " * 400), (2, 0, None, None, "Word. " * 400), (None, None, "t", "", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, section_index long, title string, container_title string, text string").withColumn("n_chars", cuts.F.lit("clash"))
    got = cuts.split_sections(frame).collect()
    assert [(r.title, r.container_title, r.unit_id, r.is_split) for r in got if r.text == "short"] == [(None, "C", "task-unit-2", False)]
    assert {r.title for r in got if r.is_split} == {"Task Unit 1", "Task Unit 2"} and len(got) == 6
    assert cuts.split_sections(frame.limit(0)).count() == 0
    assert [r.sections_split for r in cuts.cut_counters(cuts.split_sections(frame)).collect()] == [2]


def test_sorts_of_characters_are_looked_up_in_one_table():
    for bit, has in ((cuts.BLANK, str.isspace), (cuts.CLOSING, cuts.CLOSERS.__contains__), (cuts.ENDS, cuts.TERMINAL.__contains__), (cuts.ENDS_STRONG, cuts.STRONG.__contains__), (cuts.ENDS_CLAUSE, cuts.CLAUSE.__contains__)):
        assert [bool(x) for x in cuts.SORTS & bit] == [has(chr(i)) for i in range(len(cuts.SORTS))]
    assert not any(chr(i).isspace() for i in range(len(cuts.SORTS), 0x110000)) and not cuts.SORTS[-1]  # which stands for all beyond
