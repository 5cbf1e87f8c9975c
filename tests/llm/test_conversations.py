"""Conversation repair against a plain dynamic programme and against all edits of short conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from quire.llm import conversations as c
from quire.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, cost long, kept boolean, k string, part int"
FORM = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """(blank, duplicate or truncated; else empty) of rows in order."""
    seen, out = set(), []
    for _, role, text in rows:
        words = text.rstrip(c.SPACE)
        out.append("blank" if not words.strip(c.SPACE) else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Cost and audit by states after each row."""
    best = {0: (0, "")}

    def offer(to, state, cost, audit):
        if state not in to or (cost, audit) < to[state]:
            to[state] = cost, audit

    def inserted(states):
        for _ in range(2):
            for i, (cost, audit) in list(states.items()):
                offer(states, {0: 2, 1: 2, 2: 3, 3: 2}[i], cost + 3, audit + "I")
        return states

    for (_, role, _), fault in zip(rows, faults(rows), strict=True):
        now = {}
        for i, (cost, audit) in inserted(best).items():
            offer(now, i, cost + 4, audit + "D")
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault else 0
            offer(now, {0: 2, 1: 2, 2: 3, 3: 2}[i], cost + 3 + more, audit + "R")
            j = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((i, role[:1]))
            if j is not None:
                offer(now, j, cost + more, audit + "K")
        best = now
    best = inserted(best)
    return min(best[i] for i in (0, 3) if i in best)


def repaired(rows, audit):
    out, rest = [], iter(rows)
    for edit in audit:
        row = None if edit == "I" else next(rest)
        if edit == "D":
            continue
        free = "assistant" if out and out[-1][0][:1] == "u" else "user"
        out.append((row[1] if edit == "K" else free, "" if edit == "I" else row[2]))
    return out


def plain(rows):
    """The result for kept rows (turn, role, text) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    kinds, at, initials = faults(rows), sorted({r[0] for r in rows if r[0] is not None}), [r[1][:1] for r in rows]
    cost, audit = cheapest(rows)
    turns = repaired(rows, audit)
    assert FORM.fullmatch("".join(r[:1] for r, _ in turns))
    text = "\n".join(f"{r}:{t}" for r, t in turns)
    return (at[-1] - at[0] + 1 - len(at) if at else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256(text.encode()).hexdigest())


def damaged(rows):
    """Rows (conv, turn, role, text) after damage, by conversation."""
    out = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role, text = "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out[conv] += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def test_dynamic_programme_finds_the_cheapest_edits():
    """All edit strings of short conversations, tried one by one."""
    rng = random.Random(3)
    for _ in range(60):
        rows = [(i, rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["", "a", "a.", "b!"])) for i in range(rng.randint(0, 3))]
        kinds, best = faults(rows), None
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            for edits in itertools.product("KRD", repeat=len(rows)):
                audit = "".join("I" * g + e for g, e in zip(gaps, [*edits, ""], strict=True))
                if any(e != "D" and k in ("blank", "duplicate") for e, k in zip(edits, kinds, strict=True)):
                    continue
                if not FORM.fullmatch("".join(r[:1] or "-" for r, _ in repaired(rows, audit))):
                    continue
                cost = 3 * sum(gaps) + sum({"K": 0, "R": 3, "D": 4}[e] + 3 * (e != "D" and k == "truncated") for e, k in zip(edits, kinds, strict=True))
                best = min(best or (cost, audit), (cost, audit))
        assert best == cheapest(rows)


def test_matrix_products_are_associative():
    rng = random.Random(1)
    for _ in range(50):
        kinds = "".join(rng.choice("dsuaoSUAO") for _ in range(rng.randint(0, 40)))
        cut = rng.randint(0, len(kinds))
        assert c.times(c.matrix_of(kinds[:cut]), c.matrix_of(kinds[cut:])) == c.matrix_of(kinds)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, True, "x", 2) for r in rows], SCHEMA).repartition(4)


def compare(spark, rows):
    got = {r[0]: tuple(r[1:]) for r in c.repair(c.damage(frame(spark, rows)), kept="kept").collect()}
    assert got == {conv: plain(own) for conv, own in damaged(rows).items()}


def talk(seed, conv, n):
    rng = random.Random(seed)
    return [(conv, i, rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), rng.choice([f"line {i}.", f"line {i}", "same.", "", " \n", f"ok {i}!\n "])) for i in range(n)]


@pytest.mark.parametrize("hold", [c.HOLD, 40])
def test_long_conversation_across_partitions(spark, monkeypatch, hold):
    monkeypatch.setattr(c, "HOLD", hold)
    monkeypatch.setattr(c, "FAN", 2)
    rows = [t for i in range(30) for t in talk(i, i, 1 + i % 9)]
    compare(spark, rows + talk(99, 12_000, 3000) + talk(98, -5, 700))


def test_nulls_ties_and_odd_rows(spark):
    rows = talk(1, None, 12) + talk(2, 7, 5)
    rows += [(8, None, "user", "a."), (8, None, None, None), (8, 3, "assistant", None), (8, 3, "user", "b."), (9, None, None, None), (10, 2**62, "user", "x."), (10, -(2**62), "ursus", "y."), (11, 1, "", "\x1c"), (11, 2, "漢", "é?"), (11, 5, "a", "🙂! \t")]
    rows += [(12, 4, "user", "same row.")] * 5 + [(13, 1, "user", "long " * 50_000)]
    compare(spark, rows)


def test_a_conversation_of_which_nothing_is_kept(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "a.")]
    compare(spark, rows)
    compare(spark, rows + [t for i in range(gone + 1, gone + 20) for t in talk(i, i, 3)])


def test_empty_table_and_plain_rows(spark):
    assert c.repair(frame(spark, [])).collect() == []
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (2, 0, "system", "x.")]
    got = {r[0]: r.audit for r in c.repair(frame(spark, rows)).collect()}
    assert got == {1: "KR", 2: "D"}


def test_repaired_turns(spark):
    rows = [t for i in range(20) for t in talk(i, i, 12)] + talk(50, 50, 400)
    got = {}
    for r in sorted(c.repair(c.damage(frame(spark, rows)), kept="kept", turns=True).collect(), key=lambda r: (r[0], r.place)):
        got.setdefault(r[0], []).append((r.role, r.text))
        assert r.place == len(got[r[0]]) - 1
    want = {}
    for conv, own in damaged(rows).items():
        own = sorted(own, key=lambda r: r[0])
        want[conv] = repaired(own, cheapest(own)[1])
    assert got == {k: v for k, v in want.items() if v}


def test_query_on_the_tables(spark):
    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in queries.op13_conversation_repair(spark, path).collect()}
    assert got == {conv: plain(own) for conv, own in damaged(rows).items()}
