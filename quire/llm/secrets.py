"""Secret scans: base patterns, and a linear-chain conditional random field that adds spans.

A text is cut into tokens: runs of letters, digits and +/_.- or single other marks.  The field tags
each token as secret begin (B), inside (I) or outside (O).  A token's features are its shape, the shapes of its
neighbours, the key words before it, and its file (share of digits, number of assignments).  It
is trained in numpy by the gradient of the exact log-likelihood on a bounded sample.  The tags are
the base patterns' secrets, which alone would only teach the field to repeat the patterns; so in some
windows the marks and key words around a secret are hidden, and other windows get made-up keys of forms
that the patterns don't know (see planted).  Numbers, dates, addresses and the like are made up as well and
tagged as plain.  Decoding is exact Viterbi: where the score of O leads by more than any
change of two transitions can give back, every best path passes through O, so the chain is cut there and
only the runs between are decoded, many at a time.

Defined results: null text is empty and has no span; rows are scanned one by one, so repeated rows
and null ids need no care; if the sample shows no secret, the field adds none; an empty table
gives an empty result.  Places are code points, ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm import textblock as tb
from quire.llm.cluster import bounded_sample

# Kinds in the order of ties, and their patterns over text with A-Z lowered.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
# Words that announce a secret.
KEY_WORDS = ("password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "access_key", "secret_key", "auth", "bearer", "credential", "credentials")


def _among(chars: str) -> np.ndarray:
    return np.isin(np.arange(256), list(chars.encode()))


DIGIT, UPPER_, LOWER_ = _among("0123456789"), _among("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _among("abcdefghijklmnopqrstuvwxyz")
HEX = _among("0123456789abcdef")
TOKEN = DIGIT | UPPER_ | LOWER_ | _among("+/_.-") | (np.arange(256) >= 128)
LENGTHS, FEW = np.array([2, 4, 6, 8, 12, 16, 20, 24, 32, 40, 64]), np.array([1, 2, 4, 8])
MARK_KINDS = np.zeros(256, np.int64)
for _i, _c in enumerate("=:\"'`,;!?()<>{}[]@#"):
    MARK_KINDS[ord(_c)] = _i + 1
#: Numbers of values of each feature: own shape, marks at -1, -2, +1, long shape at -1 and +1, key word at -1, -2, -3, file.
SIZES = (12 * 5 * 5 * 2 * 2 * 3, 24, 24, 24, 12, 12, 2, 2, 2, 16)
OFFSETS = np.concatenate(([0], np.cumsum(SIZES)))
KEY_HASHES = np.sort(np.concatenate([tb.span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)])) for w in KEY_WORDS]))


def base_spans(block: tb.Block) -> list[list[tuple[int, int, int, int]]]:
    """Of each document: (start, kind, end, start of the secret part) in bytes of the block."""
    out: list[list] = [[] for _ in range(block.n)]
    raw, low = block.data.tobytes(), tb.LOWER[block.data].tobytes()
    bounds = block.offsets.tolist()
    for d in range(block.n):
        a, b = bounds[d], bounds[d + 1]
        out[d] += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(low, a, b) if m.end(2) - m.start(2) >= LEAST["assign"]]
        out[d] += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(raw, a, b) if m.end() - m.start() >= LEAST["access"]]
    runs = tb.spans(block, HEX[block.data])
    for i in np.flatnonzero(runs.end - runs.start >= LEAST["hex"]):
        out[runs.doc[i]].append((int(runs.start[i]), 2, int(runs.end[i]), int(runs.start[i])))
    for found in out:
        found.sort()
    return out


def tokens(block: tb.Block) -> tb.Spans:
    runs = tb.spans(block, TOKEN[block.data])
    marks = np.flatnonzero(~TOKEN[block.data] & ~tb.SPACE[block.data])
    start = np.concatenate((runs.start, marks))
    order = np.argsort(start, kind="stable")
    start = start[order]
    return tb.Spans(start, np.concatenate((runs.end, marks + 1))[order], np.searchsorted(block.offsets, start, "right") - 1)


def shifted(x: np.ndarray, doc: np.ndarray, by: int, empty: int) -> np.ndarray:
    """x of the token `by` places on, within its document."""
    out = np.full(len(x), empty, x.dtype)
    n = len(x) - abs(by)
    if n > 0:
        to, of = (slice(0, n), slice(by, None)) if by > 0 else (slice(-by, None), slice(0, n))
        same = doc[to] == doc[of]
        out[to] = np.where(same, x[of], empty)
    return out


def features(block: tb.Block, t: tb.Spans) -> np.ndarray:
    """features[token, k]: places in the weight table."""
    data = block.data
    if not len(t.start):
        return np.zeros((0, len(SIZES)), np.int64)

    def count(table: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(table[data], out=total[1:])
        return total[t.end] - total[t.start]

    length, digits, upper, lower, hexes = t.end - t.start, count(DIGIT), count(UPPER_), count(LOWER_), count(HEX)
    turns = np.zeros(len(data) + 1, np.int32)
    np.cumsum(DIGIT[data[1:]] != DIGIT[data[:-1]], out=turns[2:])
    turns = turns[t.end] - turns[t.start + 1]
    size = np.searchsorted(LENGTHS, length, "right")
    shape = (((size * 5 + np.searchsorted(FEW, digits, "right")) * 5 + np.searchsorted(FEW, upper, "right")) * 2 + (lower > 0)) * 2 + (hexes == length)
    shape = shape * 3 + np.searchsorted([2, 5], turns, "right")
    mark = np.where(length == 1, MARK_KINDS[data[t.start]], 20 + np.minimum(3, (digits > 0) * 2 + (upper > 0)))
    long_ = np.where(digits > 0, size, 0)
    h = tb.span_hashes(tb.LOWER[data], t.start, t.end)
    at = np.searchsorted(KEY_HASHES, h)
    at[at == len(KEY_HASHES)] = 0
    key = (KEY_HASHES[at] == h).astype(np.int64)
    size_of = np.maximum(np.diff(block.offsets), 1)
    share = np.searchsorted([0.001, 0.01, 0.05], block.per_doc(DIGIT[data]) / size_of, "right")
    signs = np.searchsorted([1, 3, 10], block.per_doc(data == ord("=")), "right")
    columns = [shape, shifted(mark, t.doc, -1, 0), shifted(mark, t.doc, -2, 0), shifted(mark, t.doc, 1, 0), shifted(long_, t.doc, -1, 0), shifted(long_, t.doc, 1, 0), *(shifted(key, t.doc, -j, 0) for j in (1, 2, 3)), (share * 4 + signs)[t.doc]]
    return np.stack(columns, 1) + OFFSETS[:-1]


@dataclass
class Field:
    """Scores of states O, B, I: weights[feature, state] and transitions[from, to]."""

    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, f: np.ndarray) -> np.ndarray:
        out = np.zeros((len(f), 3), np.float32)
        for k in range(f.shape[1]):
            out += self.weights[f[:, k]]
        return out

    def decode(self, e: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """States of the best path through each document's tokens."""
        slack = 2 * (self.transitions.max() - self.transitions.min())
        open_ = e[:, 0] - e[:, 1:].max(1) <= slack
        state = np.zeros(len(e), np.int8)
        if not open_.any():
            return state
        # runs of open tokens with the certain token on each side, which is O
        edge = np.zeros(len(e) + 1, bool)
        edge[1:-1] = doc[1:] != doc[:-1]
        edge[0] = edge[-1] = True
        first = np.flatnonzero(open_ & (edge[:-1] | ~np.concatenate(([False], open_[:-1]))))
        last = np.flatnonzero(open_ & (edge[1:] | ~np.concatenate((open_[1:], [False]))))
        bound = np.float32(0), self.transitions
        order = np.argsort(last - first, kind="stable")
        for at in range(0, len(order), 4096):
            part = order[at : at + 4096]
            a, n = first[part], last[part] - first[part] + 1
            width = int(n.max())
            left, right = ~edge[a], ~edge[a + n]
            score = e[a] + np.where(left[:, None], bound[1][0], bound[0])
            back = np.zeros((width, len(part), 3), np.int8)
            ends = np.where((n == 1)[:, None], score, np.float32(0))
            for j in range(1, width):
                go = n > j
                options = score[:, :, None] + self.transitions
                back[j] = options.argmax(1)
                score = np.where(go[:, None], options.max(1) + e[np.minimum(a + j, len(e) - 1)], score)
                ends = np.where((n == j + 1)[:, None], score, ends)
            now = (ends + np.where(right[:, None], self.transitions[:, 0], bound[0])).argmax(1)
            for j in range(width - 1, -1, -1):
                inside = n > j
                state[(a + j)[inside]] = now[inside]
                if j:
                    now = np.where(inside, back[j][np.arange(len(part)), now], now)
        return state


def fit_field(rows: list[tuple[np.ndarray, np.ndarray]], rounds: int = 150, rate: float = 0.15, decay: float = 1e-4) -> Field:
    """Trains on (features, states) of equally long sequences by Adam on the exact gradient."""
    rng = np.random.default_rng(0)
    weights, transitions = np.zeros((OFFSETS[-1], 3)), np.zeros((3, 3))
    weights[OFFSETS[0] : OFFSETS[1], 0] = 2.0
    if not rows or not any(y.any() for _, y in rows):
        return Field(np.pad(weights[:, :1] + 20, ((0, 0), (0, 2))).astype(np.float32), transitions.astype(np.float32))
    f, y = np.stack([x for x, _ in rows]), np.stack([x for _, x in rows])
    n, width = y.shape
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(transitions), np.zeros_like(transitions)]
    for step in range(1, rounds + 1):
        pick = rng.permutation(n)[:1500]
        fx, yx = f[pick].astype(np.int64), y[pick].astype(np.int64)
        e = weights[fx].sum(2)
        alpha, beta = np.zeros((width, len(pick), 3)), np.zeros((width, len(pick), 3))
        alpha[0] = e[:, 0]
        for j in range(1, width):
            alpha[j] = np.logaddexp.reduce(alpha[j - 1][:, :, None] + transitions, 1) + e[:, j]
        for j in range(width - 2, -1, -1):
            beta[j] = np.logaddexp.reduce(transitions + (e[:, j + 1] + beta[j + 1])[:, None, :], 2)
        total = np.logaddexp.reduce(alpha[-1], 1)
        p = np.exp(alpha + beta - total[None, :, None]).transpose(1, 0, 2)
        g = p.copy()
        g[np.arange(len(pick))[:, None], np.arange(width), yx] -= 1
        gw = np.stack([np.bincount(fx.ravel(), np.repeat(g[:, :, s].ravel(), fx.shape[2]), minlength=len(weights)) for s in range(3)], 1) / len(pick)
        pair = np.exp(alpha[:-1, :, :, None] + transitions + (e.transpose(1, 0, 2)[1:] + beta[1:])[:, :, None, :] - total[None, :, None, None])
        gt = pair.sum((0, 1))
        np.add.at(gt, (yx[:, :-1], yx[:, 1:]), -1)
        gt /= len(pick)
        for x, gx, m, v in ((weights, gw, *moments[:2]), (transitions, gt, *moments[2:])):
            gx = gx + decay * x
            m[:] = 0.9 * m + 0.1 * gx
            v[:] = 0.99 * v + 0.01 * gx * gx
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Field(weights.astype(np.float32), transitions.astype(np.float32))


# Beginnings of keys, names that introduce them, and the characters of their bodies.
KEY_STARTS = ("", "", "", "ghp_", "sk-", "xoxb-", "glpat-", "npm_", "pk_live_", "eyJ")
INTRODUCTIONS = ("", "", "bearer ", "auth: ", "credential = '", 'pwd="', "key: ", "with ", "use ")
BODIES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz0123456789")


def planted(rng: np.random.Generator) -> tuple[str, int, int]:
    """A made-up key with its introduction, and where the key is in it."""
    lead = INTRODUCTIONS[rng.integers(len(INTRODUCTIONS))]
    body = BODIES[rng.integers(len(BODIES))]
    while True:
        made = "".join(body[i] for i in rng.integers(0, len(body), int(rng.integers(20, 49))))
        if sum(c.isdigit() for c in made) >= 3 and sum(c.isalpha() for c in made) >= 3:
            break
    key = KEY_STARTS[rng.integers(len(KEY_STARTS))] + made
    return lead + key + ("'" if lead.endswith("'") else '"' if lead.endswith('"') else ""), len(lead), len(lead) + len(key)


def plain(rng: np.random.Generator) -> str:
    """A made-up string of digits and marks that is no secret."""
    n = lambda a, b: str(rng.integers(a, b))
    word = "".join(chr(i) for i in rng.integers(97, 123, int(rng.integers(4, 12))))
    made = [f"{n(1900, 2100)}-{n(1, 13)}-{n(1, 29)}", f"{n(0, 256)}.{n(0, 256)}.{n(0, 256)}.{n(0, 256)}", f"+{n(1, 99)}-{n(100, 999)}-{n(1000, 9999)}", n(10**8, 10**16), f"{word}{n(1, 9999)}@{word}.org", f"https://{word}.com/{word}/{n(1, 10**6)}", f"{word}-{word}-{word}-{word}", f"{word}_{n(1, 99)}.{word}", word * 4, f"v{n(1, 9)}.{n(0, 99)}.{n(0, 999)}", f"{word.upper()}{n(10, 99)}"]
    return made[rng.integers(len(made))]


def training_rows(texts: Iterable[str], width: int = 32, others: int = 2, made: float = 0.5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Windows of tokens with tags: all around a secret, and `others` of each text; in small integers, and without the rest of the text.

    The share `made` of the texts gets a made-up key, and the same share a string that is none."""
    rng, out = np.random.default_rng(1), []
    for text in texts:
        keys = []
        for kind in range(2):
            if rng.random() < made:
                spaces = [i for i, c in enumerate(text) if c == " "]
                at = spaces[rng.integers(len(spaces))] + 1 if spaces else len(text)
                new, a, b = planted(rng) if kind else (plain(rng), 0, 0)
                text = f"{text[:at]}{new} {text[at:]}"
                keys += [(len(text[: at + a].encode()), len(text[: at + b].encode()))] * kind
        raw = np.frombuffer(text.encode(), np.uint8)
        block = tb.Block(0, raw, np.array([0, len(raw)]))
        t = tokens(block)
        if len(t.start) < width:
            continue
        f, y = features(block, t), np.zeros(len(t.start), np.int64)
        for start, end in [*((secret, end) for _, _, end, secret in base_spans(block)[0]), *keys]:
            own = np.flatnonzero((t.start < end) & (t.end > start))
            y[own] = 2
            y[own[:1]] = 1
        marked = np.flatnonzero(y == 1)
        starts = [min(max(0, int(i) - int(rng.integers(4, width - 4))), len(y) - width) for i in marked]
        starts += rng.integers(0, len(y) - width + 1, others).tolist()
        for s in starts:
            own, tags = f[s : s + width].astype(np.int16), y[s : s + width].astype(np.int8)
            long_ = np.isin(np.arange(s, s + width), marked) & (t.end - t.start >= 16)[s : s + width]
            if long_.any() and rng.random() < 0.5:  # the shape alone must do: no marks, no key words
                own[:, 1:4] = OFFSETS[1:4] + 20
                own[:, 6:9] = OFFSETS[6:9]
            out.append((own, tags))
    return out


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = 6000, max_chars: int = 8000) -> Field:
    """A field from at most sample_rows texts of at most max_chars characters (a documented bound).

    Spans of kind crf are what it adds to the base patterns."""
    few = bounded_sample(docs.select(key, text), key, sample_rows, max_chars).select(text).toArrow()
    rows = training_rows(x.as_py() for x in few.column(0))  # one text at a time, as the driver's memory is small
    del few
    return fit_field(rows)


def block_spans(block: tb.Block, field: Field) -> list[list[tuple[int, int, int]]]:
    """Of each document: (start, kind, end) in bytes of the block; base spans, and those that the field adds."""
    t = tokens(block)
    state = field.decode(field.emissions(features(block, t)), t.doc)
    out = [[(a, k, b) for a, k, b, _ in found] for found in base_spans(block)]
    marked = np.flatnonzero(state > 0)
    if len(marked):
        new = np.ones(len(marked), bool)
        new[1:] = (np.diff(marked) > 1) | (state[marked[1:]] == 1) | (np.diff(t.doc[marked]) > 0)
        begin = np.flatnonzero(new)
        for a, b in zip(marked[begin], marked[np.append(begin[1:], len(marked)) - 1], strict=True):
            d, start, end = int(t.doc[a]), int(t.start[a]), int(t.end[b])
            while end > start and block.data[end - 1] == ord("."):
                end -= 1
            if end > start and not any(x <= start and end <= y for x, _, y in out[d]):
                out[d].append((start, 3, end))
    for found in out:
        found.sort()
    return out


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def scan(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and spans (kind, start, end) of every row, by start, then kind as listed in KINDS."""
    known = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch.column(text)):
                point = np.concatenate(([0], np.cumsum(tb.code_points(block.data))))
                spans = []
                for d, found in enumerate(block_spans(block, known.value)):
                    zero = point[block.offsets[d]]
                    spans.append([{"kind": KINDS[k], "start": int(point[a] - zero), "end": int(point[b] - zero)} for a, k, b in found])
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(block.first, block.n), pa.array(spans, pa.list_(SPAN))], [key, "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def mask(docs: DataFrame, field: Field, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of docs with each secret of their text replaced by the mark; null texts stay null."""
    known = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, texts = batch.column(text), []
            for block in tb.blocks(column):
                raw = block.data.tobytes()
                for d, found in enumerate(block_spans(block, known.value)):
                    at, parts = int(block.offsets[d]), []
                    for a, _, b in found:
                        if a >= at:
                            parts += [raw[at:a].decode(), mark]
                        at = max(at, b)
                    texts.append("".join([*parts, raw[at : int(block.offsets[d + 1])].decode()]))
            masked = pa.array(texts, column.type, mask=column.is_null().to_numpy(zero_copy_only=False)) if texts else column
            yield pa.RecordBatch.from_arrays([masked if n == text else c for n, c in zip(batch.schema.names, batch.columns, strict=True)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
