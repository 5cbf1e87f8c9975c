"""Semantic-safe and progressive units of long sections: cuts at classified boundaries, reranked by meaning under a budget.

Each cut depends on the one before it, so a section is cut by a coroutine that asks for scores of a few boundaries and
goes on when they come.  A task runs the coroutines of many sections side by side and answers the questions of all of them in
one batch, so a model is called as often as one section has windows, not as often as all sections have.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Generator, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.units import CLAUSE, CLOSERS, STRONG, TERMINAL

HARD, WRAP, CLAUSE_END, STRONG_END, SENTENCE_END, PARAGRAPH_END = range(6)
# What a kind adds to a boundary's score, how far apart places cost one point, the order of kinds by mode.
BONUS = {WRAP: 0.2, CLAUSE_END: 0.5, STRONG_END: 2.0, SENTENCE_END: 3.0, PARAGRAPH_END: 4.0}
CHARS_PER_POINT = 8.0
ORDER = {"semantic_safe": (PARAGRAPH_END, SENTENCE_END, STRONG_END, CLAUSE_END), "progressive": (SENTENCE_END, STRONG_END, CLAUSE_END, PARAGRAPH_END)}
#: Characters that a cluster of closers and white space may have, and how far a boundary looks back for its mark and for blank lines.
CLUSTER, BACK, AROUND = 8, 10, 6
_BLANK_LINE = re.compile(r"\n\s*\n+")

#: What characters are, by code point; none of these marks lies beyond the table.
BLANK, CLOSING, ENDS, ENDS_STRONG, ENDS_CLAUSE = (np.uint8(1 << i) for i in range(5))
SORTS = np.zeros(1 << 16, np.uint8)
for _sort, _chars in ((BLANK, filter(str.isspace, map(chr, range(1 << 16)))), (CLOSING, CLOSERS), (ENDS, TERMINAL), (ENDS_STRONG, STRONG), (ENDS_CLAUSE, CLAUSE)):
    SORTS[list(map(ord, _chars))] |= _sort

#: Scores of boundaries (text, place): higher is a better cut, NaN if it cannot be told.
Scorer = Callable[[list[tuple[str, int]]], np.ndarray]
Question = tuple[str, list[int]]


class Places:
    """What each place 0..n of a text is: kind, the place that it moves to, and why it moves."""

    def __init__(self, text: str):
        self.text, self.n = text, len(text)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        sort = SORTS[np.minimum(code, len(SORTS) - 1)]
        self.closer, line = sort & CLOSING != 0, code == 10
        n = self.n
        at = np.arange(n + 1, dtype=np.int32)
        last = lambda stop: np.concatenate((np.int32([-1]), np.maximum.accumulate(np.where(stop, at[:-1], np.int32(-1)))))  # noqa: E731  of the stops before each place
        upcoming = lambda stop: np.concatenate((np.minimum.accumulate(np.where(stop, at[:-1], np.int32(n))[::-1])[::-1], np.int32([n])))
        counted = lambda x: np.concatenate((np.int32([0]), np.cumsum(x, dtype=np.int32)))
        lines, self.closers = counted(line), counted(self.closer)
        solid, inked = sort & (BLANK | CLOSING) == 0, sort & BLANK == 0

        mark = last(solid)
        before, gap = np.append(sort, np.uint8(0))[mark], at - 1 - mark  # at mark -1 stands the 0
        what = lambda sorts, within: (before & sorts != 0) & (gap < within)
        left = np.maximum(last(inked) + 1, np.maximum(at - AROUND, 0))
        right = np.minimum(upcoming(inked), np.minimum(at + AROUND, n))
        paragraph = (lines[at] - lines[np.minimum(left, at)] >= 2) | (lines[np.maximum(right, at)] - lines[at] >= 2)
        self.kind = np.full(n + 1, HARD, np.int8)
        self.kind[1:][line] = WRAP
        for found, kind in ((what(ENDS_CLAUSE, BACK), CLAUSE_END), (what(ENDS_STRONG, BACK), STRONG_END), (what(ENDS, BACK), SENTENCE_END), (paragraph, PARAGRAPH_END)):
            self.kind[found] = kind
        self.kind[[0, n]] = HARD

        beyond = np.minimum(upcoming(solid), at + CLUSTER)  # behind closers and white space that follow
        inner = (at > 0) & (at < n)
        extended = np.where(inner & what(ENDS | ENDS_STRONG, CLUSTER), beyond, at)
        again = beyond[extended]
        absorbs = (extended > 0) & (extended < n) & (self.closers[again] > self.closers[extended])
        self.moved = np.where(absorbs, again, extended)
        self.inside, self.shifted = extended > at, self.moved > extended


@dataclass
class Counters:
    """How a section's cuts turned out."""

    orphan_closing_start: int = 0
    inside_terminal_cluster: int = 0
    hard_cut: int = 0
    mid_sentence_cut: int = 0
    source_quality_issue: int = 0
    no_sentence_boundary: int = 0
    source_quality_fallback: int = 0
    sentence_cut: int = 0
    paragraph_cut: int = 0
    potential_mid_sentence_cut: int = 0
    windows_reranked: int = 0
    candidates_scored: int = 0
    budget_exhausted: int = 0


@dataclass
class Cutter:
    """Cuts of one section; `left` is what remains of its budget of scores."""

    mode: str
    least: int
    most: int
    scored: bool
    wanted: int = 3
    per_window: int = 3
    left: int = 12
    counters: Counters = field(default_factory=Counters)

    def noted(self, places: Places, at: int) -> int:
        """The place that `at` moves to."""
        self.counters.inside_terminal_cluster += int(places.inside[at])
        self.counters.orphan_closing_start += int(places.shifted[at])
        return int(places.moved[at])

    def told(self, places: Places, cut: int, fallback: bool = False) -> int:
        c, kind = self.counters, int(places.kind[cut])
        if kind == PARAGRAPH_END:
            c.paragraph_cut += 1
        elif kind in (SENTENCE_END, STRONG_END):
            c.sentence_cut += 1
        elif kind == HARD or fallback:
            c.hard_cut += 1
        if kind in (HARD, WRAP, CLAUSE_END):
            c.potential_mid_sentence_cut += 1
            c.mid_sentence_cut += 1
        c.source_quality_fallback += fallback
        c.source_quality_issue += fallback
        return cut

    def candidates(self, places: Places, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (rising) and kinds that boundaries of low..high move to."""
        at = np.arange(low, high + 1)
        at = at[places.kind[at] > WRAP]
        to = places.moved[at]
        good = (to > 0) & (to < places.n) & (to >= low) & (to <= high + CLUSTER)
        at, to = at[good], to[good]
        self.counters.inside_terminal_cluster += int(places.inside[at].sum())
        self.counters.orphan_closing_start += int(places.shifted[at].sum())
        kind = np.where(places.kind[to] == HARD, places.kind[at], places.kind[to])
        order = np.lexsort((-kind, to))
        to, kind = to[order], kind[order]
        first = np.concatenate(([True], to[1:] != to[:-1])) if len(to) else np.empty(0, bool)
        return to[first], kind[first]

    def search(self, places: Places, low: int, high: int, ideal: int) -> Generator[Question, dict[int, float], int]:
        """The cut for a window: of the best kind that it has, the boundary of the highest score."""
        low, high = max(1, low), min(places.n, high)
        fallback = min(max(ideal, low), high)
        if low >= high:
            return fallback
        to, kind = self.candidates(places, low, high)
        if not len(to):
            self.counters.no_sentence_boundary += 1
            return self.told(places, fallback, True)
        score = np.array([BONUS[k] for k in kind.tolist()]) - np.abs(to - ideal) / CHARS_PER_POINT
        if self.scored:
            some = min(len(to), self.wanted, self.per_window, self.left)
            if some > 0:
                self.left -= some
                self.counters.windows_reranked += 1
                best = np.argsort(-score, kind="stable")[:some]
                got = yield places.text, to[best].tolist()
                self.counters.candidates_scored += len(got)
                score[best] += [got.get(i, 0.0) for i in to[best].tolist()]
            else:
                self.counters.budget_exhausted += 1
        for wanted in ORDER[self.mode]:
            own = np.flatnonzero(kind == wanted)
            if len(own):
                chosen = max(own.tolist(), key=lambda i: (score[i], -abs(to[i] - ideal)))
                return self.told(places, self.noted(places, int(to[chosen])))
        c = self.counters  # line breaks only, where boundaries moved to
        c.hard_cut += 1
        c.no_sentence_boundary += 1
        c.source_quality_issue += 1
        c.source_quality_fallback += 1
        return self.told(places, self.noted(places, min(max(ideal, 1), max(1, places.n - 1))))

    def windows(self, text: str) -> Generator[Question, dict[int, float], list[str]]:
        """A text cut near `most` characters, window by window."""
        out, at, n, width = [], 0, len(text), max(60, self.most // 5)
        places = Places(text) if n > self.most else None
        while n - at > self.most:
            ideal, low = at + self.most, min(n, at + self.least)
            high = min(n, ideal + width)
            cut = yield from self.search(places, max(low, ideal - width) if max(low, ideal - width) < high else low, high, ideal)
            cut = cut if cut > at else min(n, ideal)
            out.append(text[at:cut].strip())
            at = cut
        return [x for x in (*out, text[at:].strip()) if x]

    def paragraphs(self, text: str) -> Generator[Question, dict[int, float], list[str]]:
        """Paragraphs packed while they fit, longer ones cut by windows."""
        out: list[str] = []
        open_ = ""
        for part in filter(None, (p.strip() for p in _BLANK_LINE.split(text))):
            joined = f"{open_}\n\n{part}" if open_ else part
            if len(joined) <= self.most:
                open_ = joined
                continue
            out += [open_] if open_ else []
            open_ = part if len(part) <= self.most else ""
            if not open_:
                out += yield from self.windows(part)
        return [*out, open_] if open_ else out

    def settled(self, parts: list[str]) -> Generator[Question, dict[int, float], list[str]]:
        """A short last part joins the one before it, or both are cut anew near the middle."""
        parts, left = list(parts), max(4, 4 * len(parts))
        while len(parts) > 1 and len(parts[-1]) < self.least and left:
            left -= 1
            both = f"{parts[-2]}\n\n{parts[-1]}"
            new = None
            if len(both) > self.most:
                cut = yield from self.search(Places(both), self.least, max(len(both) - self.least, self.least + 1), len(both) // 2)
                new = [both[:cut].strip(), both[cut:].strip()] if 0 < cut < len(both) else None
            parts[-2:] = new if new and all(new) and new != parts[-2:] else [both]
        return parts

    def units(self, text: str) -> Generator[Question, dict[int, float], list[str]]:
        """The parts of a section's text, which is not empty."""
        parts = yield from (self.paragraphs(text) if self.mode == "semantic_safe" else self.windows(text))
        parts = yield from self.settled(parts)
        c = self.counters
        for a, b in zip(parts, parts[1:], strict=False):
            c.orphan_closing_start += b[0] in CLOSERS
            c.source_quality_issue += b[0] in CLOSERS
            end = a.rstrip(CLOSERS)[-1:]
            c.mid_sentence_cut += not (end and end in TERMINAL + STRONG + CLAUSE)
        return parts


def side_by_side(jobs: list[Generator[Question, dict[int, float], list[str]]], score: Scorer | None) -> list[list[str]]:
    """What each coroutine returns; the open questions of all are answered in one call."""
    out: list[list[str] | None] = [None] * len(jobs)
    answers: dict[int, dict[int, float] | None] = dict.fromkeys(range(len(jobs)))
    while answers:
        questions: dict[int, Question] = {}
        for i, answer in answers.items():
            try:
                questions[i] = jobs[i].send(answer)
            except StopIteration as end:
                out[i] = end.value
        asked = [(text, at) for text, places in questions.values() for at in places]
        values = iter(score(asked).tolist() if asked else ())
        answers = {i: {at: v for at, v in zip(places, values, strict=False) if v == v} for i, (_, places) in questions.items()}
    return out


class BySnippets:
    """Scores by vectors of what stands next to a cut and further around it: high where the wider context changes and the
    text next to the cut does not go on.  `embed` makes a matrix of texts; equal texts are embedded once."""

    def __init__(self, embed: Callable[[list[str]], np.ndarray], near: int = 220, wide: int = 700, least: int = 12, weight: float = 1.0):
        self.embed, self.near, self.least, self.weight = embed, max(40, near), least, weight
        self.wide = max(self.near, wide)

    def __call__(self, asked: list[tuple[str, int]]) -> np.ndarray:
        sides = [[t[max(0, i - w) : i].strip() if before else t[i : i + w].strip() for w in (self.near, self.wide) for before in (True, False)] for t, i in asked]
        enough = np.array([min(map(len, s)) >= self.least for s in sides], bool)
        out = np.full(len(asked), np.nan)
        if enough.any():
            kept = [x for s, ok in zip(sides, enough, strict=True) if ok for x in s]
            texts, place = np.unique(np.array(kept, object), return_inverse=True)
            x = np.asarray(self.embed(texts.tolist()), float)
            size = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)[place].reshape(-1, 4, x.shape[1])
            tail_head, before_after = (np.clip((x[:, k] * x[:, k + 1]).sum(1), -1, 1) for k in (0, 2))
            out[enough] = self.weight * ((1 - before_after) - tail_head)
        return out


COUNTERS = list(asdict(Counters()))


def split_sections(sections: DataFrame, mode: str = "semantic_safe", least: int = 300, most: int = 1600, score: Scorer | None = None, wanted: int = 3, per_window: int = 3, per_section: int = 12) -> DataFrame:
    """doc_id, section_index, part_no, unit_id, title, container_title, is_split, n_chars, text, counters.

    `sections` has doc_id, section_index, title, container_title, text.  A section of up to `most` characters is one unit;
    longer ones are cut, and their parts are numbered in the title.  Blank sections have no units; white space at the ends falls
    off.  With `score`, the up to `wanted` best boundaries of a window (at most per_window, and per_section in a section) get its
    scores on top of their own.  `counters` (on a section's first part) tells how the cuts turned out.  Rows of one
    section index are cut one by one."""
    kind = {n: sections.schema[n].dataType.simpleString() for n in ("doc_id", "section_index")}
    counted = "struct<" + ", ".join(f"{n}: int" for n in COUNTERS) + ">"
    schema = f"doc_id {kind['doc_id']}, section_index {kind['section_index']}, part_no int, unit_id string, title string, container_title string, is_split boolean, n_chars int, text string, counters {counted}"
    names = ["doc_id", "section_index", "part_no", "unit_id", "title", "container_title", "is_split", "n_chars", "text", "counters"]
    counter_type = pa.struct([(n, pa.int32()) for n in COUNTERS])

    def cut(rows: list[tuple]) -> Iterator[tuple]:
        cutters = [Cutter(mode, max(1, least), max(1, least, most), score is not None, max(1, wanted), max(1, per_window), max(1, per_section)) for _ in rows]
        parts = side_by_side([c.units(r[4]) if len(r[4]) > c.most else whole(r[4]) for c, r in zip(cutters, rows, strict=True)], score)
        for (doc, section, title, container, text), cutter, own in zip(rows, cutters, parts, strict=True):
            long = len(text) > cutter.most
            for i, part in enumerate(own):
                named = title if len(own) == 1 else f"{title} (Part {i + 1})" if title else f"Task Unit {i + 1}"
                yield doc, section, i, f"task-unit-{section}-{i}" if long else f"task-unit-{section}", named, container, long, len(part), part, None if i else asdict(cutter.counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            waiting, size = [], 0
            columns = [c.to_pylist() for c in batch.columns]
            for k, (doc, section, title, container, text) in enumerate(zip(*columns, strict=True)):
                text = (text or "").strip()
                if text:
                    waiting.append((doc, section, (title or "").strip() or None, (container or "").strip() or None, text))
                    size += len(text)
                if waiting and (size > 1_000_000 or k == len(columns[0]) - 1):
                    out = list(zip(*cut(waiting), strict=True))
                    waiting, size = [], 0
                    types = [batch.schema.field(0).type, batch.schema.field(1).type, pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.string(), counter_type]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    return sections.select("doc_id", "section_index", "title", "container_title", "text").mapInArrow(run, schema)


def whole(text: str) -> Generator[Question, dict[int, float], list[str]]:
    """A section that is one unit."""
    return [text]
    yield


def cut_counters(units: DataFrame) -> DataFrame:
    """doc_id, sections_split and the sum of each counter over the sections of a document that were cut."""
    first = units.where("is_split and part_no = 0")
    return first.groupBy("doc_id").agg(F.count("*").alias("sections_split"), *(F.sum(f"counters.{n}").alias(n) for n in COUNTERS))
