"""Repair of conversations by a min-plus matrix scan.

A repaired conversation's role initials are empty, or an optional s and then one or more times ua: a machine of four
states (START, S, U, A; START and A accept).  Every turn is a 4x4 matrix over (cost, audit): entry (i, j) is the cheapest way to go
from state i to state j by keeping the turn (0), giving it another role (3) or deleting it (4); an undeleted truncated turn adds
3, blank and repeated turns must be deleted.  An inserted empty turn costs 3; the closure of insertions multiplies
each matrix.  Sums of costs and joined audits form a semiring, where the smaller cost wins, then the ASCII-least audit: two
audits of one cost that lead from i to j are never prefixes of one another, so joining keeps their order.  The product is
associative, so it is taken as a tree: over runs of turns in a partition, then over partitions.

Turns are dealt by ranges of (conversation, turn) and sorted, so a conversation may lie in several partitions.  One that
lies inside a partition, and holds less than HOLD characters, is finished there.  The first and the last of a partition,
and larger ones, are passed on as single turns: repeats are found by digest over the whole conversation, each partition's
piece becomes one matrix with its counts, and FAN pieces are multiplied at a time.  Only the sha256 of the
repaired text, which is defined from its start to its end, passes such a conversation through one task, turn by turn in bounded memory.

Defined results: null role and text are one space; a null turn comes first and counts in no gap; rows with
a null conversation are one conversation; equal turns are ordered by role, then by a hash of the text; a role counts by
its first character, an empty one by none; a conversation without kept rows has zeros, an empty audit
and the hash of the empty string; an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.cluster import Shelf

START, S, U, A = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: The state after a turn whose role has the given initial.
NEXT = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
#: The state after a turn whose role is free, user or assistant.
FREE = {START: U, S: U, U: A, A: U}
ROLE = {U: "user", A: "assistant"}
LEGAL = {"su", "ua", "au"}
SPACE = "\t\n\x0b\x0c\r "
#: Characters of a conversation that a task holds, turns in a matrix that is looked up, pieces multiplied at once.
HOLD, RUN, FAN = 1 << 24, 6, 32
#: A class of turns that must be deleted; other classes are the role's initial (o: any other), upper case if truncated.
GONE = "d"

Entry = tuple[int, str] | None
Matrix = tuple[tuple[Entry, ...], ...]


def times(x: Matrix, y: Matrix) -> Matrix:
    def entry(i: int, j: int) -> Entry:
        ways = [(x[i][k][0] + y[k][j][0], k) for k in range(4) if x[i][k] and y[k][j]]
        if not ways:
            return None
        least = min(ways)[0]
        return least, min(x[i][k][1] + y[k][j][1] for cost, k in ways if cost == least)

    return tuple(tuple(entry(i, j) for j in range(4)) for i in range(4))


ONE: Matrix = tuple(tuple((0, "") if i == j else None for j in range(4)) for i in range(4))
_INSERT: Matrix = tuple(tuple((INSERT, "I") if FREE[i] == j else None for j in range(4)) for i in range(4))


def plus(x: Matrix, y: Matrix) -> Matrix:
    return tuple(tuple(min((e for e in pair if e), default=None) for pair in zip(*rows, strict=True)) for rows in zip(x, y, strict=True))


#: Insertions before a turn or at the end: none, one or two.
CLOSURE = reduce(plus, [ONE, _INSERT, times(_INSERT, _INSERT)])


@lru_cache(maxsize=None)
def turn_matrix(kind: str) -> Matrix:
    """Insertions, then one turn of a class."""
    extra = TRUNCATED if kind.isupper() else 0
    step: list[list[Entry]] = [[None] * 4 for _ in range(4)]
    for i in range(4):
        step[i][i] = (DELETE, "D")
        if kind != GONE:
            step[i][FREE[i]] = (REROLE + extra, "R")
            j = NEXT.get((i, kind.lower()))
            if j is not None:
                step[i][j] = min(filter(None, [step[i][j], (KEEP + extra, "K")]))
    return times(CLOSURE, tuple(map(tuple, step)))


@lru_cache(maxsize=1 << 16)
def _run_matrix(kinds: str) -> Matrix:
    return reduce(times, map(turn_matrix, kinds), ONE)


def matrix_of(kinds: str) -> Matrix:
    """The product over a run of turns, as a tree."""
    level = [_run_matrix(kinds[i : i + RUN]) for i in range(0, len(kinds), RUN)] or [ONE]
    while len(level) > 1:
        level = [times(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def cheapest(m: Matrix) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    row = times(m, CLOSURE)[START]
    return min(e for e in (row[START], row[A]) if e)


def kind_of(role: str, gone: bool, truncated: bool) -> str:
    kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return GONE if gone else kind.upper() if truncated else kind


@dataclass
class Piece:
    """Turns that follow one another: their matrix and counts; pieces of a conversation add up in order."""

    matrix: Matrix = ONE
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    low: int | None = None
    high: int | None = None
    distinct: int = 0
    first: str | None = None
    last: str | None = None

    def __add__(self, other: Piece) -> Piece:
        meet = self.last is not None and other.first is not None and self.last + other.first not in LEGAL
        return Piece(
            times(self.matrix, other.matrix),
            *(getattr(self, k) + getattr(other, k) for k in ("blank", "duplicate", "truncated")),
            self.illegal + other.illegal + meet,
            other.low if self.low is None else self.low,
            self.high if other.high is None else other.high,
            self.distinct + other.distinct - (self.high is not None and self.high == other.low),
            other.first if self.first is None else self.first,
            self.last if other.last is None else other.last,
        )

    def gaps(self) -> int:
        return 0 if self.low is None else min(self.high - self.low + 1 - self.distinct, (1 << 63) - 1)


class Collector:
    """A piece's counts, turn by turn in order."""

    def __init__(self):
        self.kinds: list[str] = []
        self.piece = Piece()

    def add(self, turn: int | None, role: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        p, initial = self.piece, role[:1]
        duplicate, truncated = duplicate and not blank, truncated and not blank and not duplicate
        self.kinds.append(kind_of(role, blank or duplicate, truncated))
        p.blank += blank
        p.duplicate += duplicate
        p.truncated += truncated
        p.illegal += p.last is not None and p.last + initial not in LEGAL
        p.first, p.last = initial if p.first is None else p.first, initial
        if turn is not None:
            p.low = turn if p.low is None else p.low
            p.distinct += turn != p.high
            p.high = turn

    def done(self) -> Piece:
        self.piece.matrix = matrix_of("".join(self.kinds))
        return self.piece


class Editor:
    """The repaired turns of a conversation, in order, as its turns come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _free(self) -> str:
        self.state = FREE[self.state]
        return ROLE[self.state]

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._free(), ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield self._free(), text
        elif edit == "K":
            self.state = NEXT[self.state, role[:1]]
            yield role, text


class Digest:
    """sha256 of role:text lines."""

    def __init__(self):
        self.sha, self.lines = hashlib.sha256(), 0

    def add(self, turns: Iterator[tuple[str, str]]) -> None:
        for role, text in turns:
            self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
            self.lines += 1


def judged(text: Column) -> tuple[Column, Column]:
    """Whether a text has nothing but white space, and whether its last other character ends no sentence."""
    return ~text.rlike(r"[^\x20\x09-\x0D]"), ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with planted faults by crc32 of `conversation:turn` modulo 20; dropped ones have kept = false."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space(conv), F.lit(":"), space(turn)).cast("binary")) % 20
    out = rows.select(
        F.col(conv),
        F.col(turn),
        F.when(fault == 4, F.lit("user")).otherwise(space(role)).alias(role),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(space(text), ".!?", "")).otherwise(space(text)).alias(text),
        (fault != 0).alias("kept"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return out.drop("copy")


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "place long, role string, text string"


def _result(piece: Piece, cost: int, audit: str, sha: str) -> tuple:
    return piece.gaps(), piece.blank, piece.duplicate, piece.truncated, piece.illegal, cost, audit, sha


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight: Callable[[tuple], int] = lambda r: 1) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += 64 + weight(row)
        if size > 2_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", kept: str | None = None, turns: bool = False) -> DataFrame:
    """One row for each conversation: its key, the columns of RESULT; or, with `turns`, the repaired turns
    themselves: its key, place (from 0), role, text.

    Rows where the column `kept` is false only say that the conversation exists."""
    spark, shelf = rows.sparkSession, Shelf(rows.sparkSession)
    key_type = rows.schema[conv].dataType.simpleString()
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    here = F.coalesce(F.col(kept), F.lit(True)) if kept else F.lit(True)
    blank, truncated = judged(F.col("text"))
    flat = rows.select(F.col(conv).alias("conv"), here.alias("kept"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), F.when(here, space(text)).alias("text"))
    flat = flat.select("*", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("place"))
    order = [F.asc_nulls_first("conv"), F.desc("kept"), F.asc_nulls_first("turn"), "role", "h", "place"]
    sorted_ = flat.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "kept", "turn", "role", "text", blank.alias("blank"), truncated.alias("truncated"))

    out = TURNS if turns else RESULT
    empty = (None,) * out.count(",") + (None,)
    schema = f"conv {key_type}, {out}, whole boolean, part long, pos long, kept boolean, turn long, own_role string, own_text string, blank_turn boolean, truncated_turn boolean"
    arrow = _arrow(schema)

    def finish(conv_id, held: list[tuple]) -> Iterator[tuple]:
        got, seen = Collector(), set()
        for _, _, at, who, what, is_blank, cut in held:
            got.add(at, who, is_blank, (who, what) in seen, cut)
            seen.add((who, what))
        piece = got.done()
        cost, audit = cheapest(piece.matrix)
        editor, sha, place = Editor(audit), Digest(), 0
        for edited in [*(editor.turn(h[3], h[4]) for h in held), editor.inserted()]:
            if not turns:
                sha.add(edited)
                continue
            for who, what in edited:
                yield (conv_id, place, who, what)
                place += 1
        if not turns:
            yield (conv_id, *_result(piece, cost, audit, sha.sha.hexdigest()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def found() -> Iterator[tuple]:
            now, held, size, passing, pos, sent = object(), [], 0, True, 0, 0
            whole = lambda r: (*r, True, *(None,) * 8)

            def passed(row: tuple) -> tuple:
                nonlocal pos, sent
                pos += 1
                sent += 1
                return (row[0], *empty, False, part, pos, *row[1:])

            for row in _stream(batches):
                if row[0] != now or now.__class__ is object:
                    if not passing:
                        yield from map(whole, finish(now, held))
                    passing = now.__class__ is object  # a partition's first conversation may have begun before it
                    now, held, size, sent = row[0], [], 0, 0
                if not passing and size > HOLD:
                    passing = True
                    yield from map(passed, held)
                    held = []
                if passing:
                    if row[1] or not sent:
                        yield passed(row)
                elif row[1]:
                    held.append(row)
                    size += len(row[4]) + len(row[3])
            if not passing:  # the last one may go on
                yield from map(passed, held or [(now, False, None, None, None, None, None)])

        yield from _batches(found(), arrow, lambda r: len(r[-3] or "") + (len(r[3] or "") if turns else 2 * len(r[7] or "")))

    scanned = shelf.put(sorted_.mapInArrow(scan, schema))
    names = [c.split()[0] for c in out.split(", ")]
    whole = scanned.where("whole").select(F.col("conv").alias(conv), *names)
    passed = scanned.where("not whole").select("conv", F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")).alias("k"), "part", "pos", "kept", "turn", F.col("own_role").alias("role"), F.col("own_text").alias("text"), F.col("blank_turn").alias("blank"), F.col("truncated_turn").alias("truncated"))
    return whole.unionByName(_across(passed, scanned, shelf, conv, key_type, out, turns, arrow))


PIECE = "blank long, duplicate long, truncated long, illegal long, low long, high long, distinct_turns long, first string, last string, costs array<long>, audits array<string>"


def _packed(p: Piece) -> tuple:
    entries = [e for row in p.matrix for e in row]
    return p.blank, p.duplicate, p.truncated, p.illegal, p.low, p.high, p.distinct, p.first, p.last, [e and e[0] for e in entries], [e and e[1] for e in entries]


def _unpacked(row: tuple) -> Piece:
    *counts, costs, audits = row
    entries = [None if c is None else (c, a) for c, a in zip(costs, audits, strict=True)]
    return Piece(tuple(tuple(entries[i : i + 4]) for i in range(0, 16, 4)), *counts)


def _across(passed: DataFrame, scanned: DataFrame, shelf: Shelf, conv: str, key_type: str, out: str, turns: bool, arrow: pa.Schema) -> DataFrame:
    """The conversations that were passed on turn by turn."""
    spark = passed.sparkSession
    own = passed.where("kept").withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    first = own.groupBy("k", "digest").agg(F.min(F.struct("part", "pos")).alias("at")).select("k", "at.part", "at.pos")
    light = passed.select("k", "part", "pos", F.lit(1).alias("tag"), "kept", "turn", F.substring("role", 1, 1).alias("role"), "blank", "truncated")
    marks = first.select("k", "part", "pos", F.lit(0).alias("tag"), F.lit(True).alias("kept"), *(F.lit(None).cast(t).alias(n) for n, t in (("turn", "long"), ("role", "string"), ("blank", "boolean"), ("truncated", "boolean"))))
    keys = ["k", "part", "pos", "tag"]
    # a first turn's mark comes just before it; a piece is no larger than the partition that it came from
    told = light.unionByName(marks).repartition("k", "part").sortWithinPartitions(*keys)
    piece_schema = f"k string, part long, {PIECE}"
    piece_arrow = _arrow(piece_schema)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            now, got, mark = None, None, None
            for k, part, pos, tag, here, at, who, is_blank, cut in _stream(batches):
                if (k, part) != now:
                    if now:
                        yield (*now, *_packed(got.done()))
                    now, got = (k, part), Collector()
                if not tag:
                    mark = (k, part, pos)
                elif here:
                    got.add(at, who, is_blank, mark != (k, part, pos), cut)
            if now:
                yield (*now, *_packed(got.done()))

        yield from _batches(found(), piece_arrow, lambda r: 16 * len(r[-1][0] or "") + 200)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            now, held = None, []
            for k, part, group, *rest in _stream(batches):
                if (k, group) != now:
                    if now:
                        yield (*now, *_packed(sum_of(held)))
                    now, held = (k, group), []
                held.append(_unpacked(rest))
            if now:
                yield (*now, *_packed(sum_of(held)))

        yield from _batches(found(), piece_arrow, lambda r: 16 * len(r[-1][0] or "") + 200)

    tree = told.mapInArrow(pieces, piece_schema)
    most = scanned.agg(F.max("part")).first()[0] or 0
    while most:
        tree = tree.select("k", "part", F.floor(F.col("part") / FAN).alias("g"), *[c.split()[0] for c in PIECE.split(", ")])
        tree = tree.repartition("k", "g").sortWithinPartitions("k", "g", "part").mapInArrow(joined, piece_schema)
        most //= FAN
    names = [c.split()[0] for c in PIECE.split(", ")]
    heads = tree.select("k", F.lit(-1).cast("long").alias("part"), F.lit(0).cast("long").alias("pos"), F.struct(*names).alias("piece"), F.lit(None).cast(key_type).alias("conv"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("kept"))
    body = passed.select("k", "part", "pos", F.lit(None).cast(heads.schema["piece"].dataType).alias("piece"), "conv", "role", "text", "kept")
    last_arrow = pa.schema([pa.field(conv, arrow.field(0).type), *list(arrow)[1 : 1 + len(out.split(", "))]])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            now = conv_id = piece = editor = sha = None
            place = 0

            def edited(some: Iterator[tuple[str, str]]) -> Iterator[tuple]:
                nonlocal place
                if turns:
                    for who, what in some:
                        yield (conv_id, place, who, what)
                        place += 1
                else:
                    sha.add(some)

            def closed() -> Iterator[tuple]:
                yield from edited(editor.inserted())
                if not turns:
                    yield (conv_id, *_result(piece, cost, editor.audit, sha.sha.hexdigest()))

            for k, part, _, head, c, who, what, here in _stream(batches):
                if part < 0:
                    if now is not None:
                        yield from closed()
                    now, piece, place = k, _unpacked(tuple(head.values())), 0
                    cost, audit = cheapest(piece.matrix)
                    editor, sha = Editor(audit), Digest()
                    continue
                conv_id = c
                if here:
                    yield from edited(editor.turn(who, what))
            if now is not None:
                yield from closed()

        yield from _batches(found(), last_arrow, lambda r: len(r[-1] or "") + (0 if turns else len(r[-2])))

    return heads.unionByName(body).repartition("k").sortWithinPartitions("k", "part", "pos").mapInArrow(finish, f"{conv} {key_type}, {out}")


def sum_of(pieces: list[Piece]) -> Piece:
    """Pieces of a conversation added up as a tree."""
    while len(pieces) > 1:
        pieces = [pieces[i] + pieces[i + 1] if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0]
