"""Vectorised text helpers: Arrow string batches seen as byte blocks, words and hashes.

A *block* is a run of whole documents of one Arrow batch.  Blocks are cut by bytes, so the
numpy temporaries of a task stay small; a document is never split, so a single very long text is
a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes; returns a new array."""
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


#: One random word per byte value, so that a hash is not linear in the bytes.
BYTE_WORD = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, modulo 2**64; kept for the worker's next block."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Block:
    """Whole documents as bytes: document i is data[offsets[i]:offsets[i + 1]]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each document."""
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    elif pa.types.is_string(column.type):
        kind = np.int32
    else:
        return utf8(column.cast(pa.large_string()))
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def blocks(column: pa.Array, limit: int = BLOCK_BYTES, docs: int = 2000) -> Iterator[Block]:
    """Blocks of at most limit bytes (or one document) and at most `docs` documents."""
    data, offsets = utf8(column)
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, min(at + docs, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
        yield Block(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


@dataclass
class Spans:
    """Byte spans in document order, with the number of each span's document in its block."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    def counts(self, n: int) -> np.ndarray:
        return np.bincount(self.doc, minlength=n).astype(np.int64)


def spans(block: Block, inside: np.ndarray) -> Spans:
    """Maximal runs of bytes marked inside; a run ends at its document's end."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return Spans(none, none, none)
    edge = np.zeros(n + 1, bool)
    edge[block.offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    first = np.flatnonzero(start)
    return Spans(first, np.flatnonzero(end) + 1, np.searchsorted(block.offsets, first, "right") - 1)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, equal for equal bytes wherever they stand."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_WORD[data] * up[:-1], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64) * BYTE_WORD[1])


def windows(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of k consecutive words of a document, and the window's first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= _BASE
        out += h[j : j + n]
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(out[at]), at


def keyed(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within one document of a block."""
    return mix(h + doc.astype(np.uint64) * BYTE_WORD[2])


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more; which are not their key's first occurrence."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, later


def code_points(data: np.ndarray) -> np.ndarray:
    """Marks the first byte of every code point."""
    return (data & 0xC0) != 0x80
