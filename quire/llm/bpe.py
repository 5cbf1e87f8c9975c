"""Byte-level BPE encoding and decoding with numpy matrices.

Texts are split by the vocabulary's pattern.  The pieces that a worker has not met yet are put
into padded matrices of similar length; in each round every row merges its leftmost pair of least
rank, looked up in a hash table of pairs, and rows without a pair are taken out (compaction).
Encoded pieces are kept in a memo of bounded size.  Rounds times width grow with the square of a piece's length,
so a piece of more than `long_bytes` bytes (a parameter, 4096) is merged with a heap instead; the merges are
the same ones in the same order.

Defined results: null text is empty and gives no ids; special tokens' strings are ordinary text;
repeated rows are encoded row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

LONG_BYTES = 4096
MEMO_PIECES = 400_000
NONE = np.int32(2**31 - 1)
_WIDTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32)


def rust_classes(pattern: str) -> str:
    """The pattern with white space as Unicode's property, as the tiktoken library reads it."""
    return pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class PairTable:
    """Hash table with linear probing from a pair of ids to the id of the merged token."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(len(pairs) * 4 + 1))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        left = np.arange(len(pairs))
        slot = self.slot(pairs)
        self.probes = 1
        while len(left):
            free = self.keys[slot[left]] < 0
            taken, first = np.unique(slot[left[free]], return_index=True)
            put = left[free][first]
            self.keys[taken], self.values[taken] = pairs[put], merged[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            if len(left):
                slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
                self.probes += 1

    def slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the merged tokens, NONE where the pair does not merge; ids below 0 are padding."""
        pairs = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self.slot(pairs)
        key = self.keys[slot]
        out = np.where(key == pairs, self.values[slot], NONE)
        todo = np.flatnonzero((key != pairs) & (key >= 0))
        for _ in range(self.probes):
            if not len(todo):
                break
            slot_ = (slot.flat[todo] + 1) & ((1 << self.bits) - 1)
            slot.flat[todo] = slot_
            key = self.keys[slot_]
            hit = key == pairs.flat[todo]
            out.flat[todo[hit]] = self.values[slot_[hit]]
            todo = todo[~hit & (key >= 0)]
        return np.where((left < 0) | (right < 0), NONE, out)


class Vocabulary:
    """Ranks of a byte-level BPE, its pattern, and the memo of encoded pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, long_bytes: int = LONG_BYTES):
        self.ranks, self.long_bytes = ranks, long_bytes
        self.widths = [*(w for w in _WIDTHS if w < long_bytes), *(min(long_bytes, 64 << i) for i in range(max(0, math.ceil(math.log2(long_bytes / 64))) + 1))]
        self.find = regex.compile(rust_classes(pattern)).findall
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.token[i] = token
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs, merged = [], []
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    merged.append(i)
        self.pairs = PairTable(np.array(pairs, np.int64), np.array(merged, np.int32))
        self.pair_id = dict(zip(pairs, merged, strict=True))
        self.memo: dict[str, bytes] = {}

    def merge_rows(self, rows: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of at most width bytes, as little-endian 32-bit integers."""
        n = len(rows)
        length = np.fromiter(map(len, rows), np.int64, n)
        flat = np.frombuffer(b"".join(rows), np.uint8)
        inside = np.arange(width) < length[:, None]
        ids = np.full((n, width), -1, np.int32)
        ids[inside] = self.byte_id[flat]
        rank = self.pairs.get(ids[:, :-1], ids[:, 1:])
        row, out = np.arange(n), [b""] * n
        column = np.arange(width - 1)
        while len(row):
            best = rank.argmin(1)
            each = np.arange(len(row))
            to = rank[each, best]
            done = to == NONE
            if done.any():
                for r, x, m in zip(row[done], ids[done], length[row[done]], strict=True):
                    out[r] = x[:m].tobytes()
                go = ~done
                row, ids, rank, best, to = row[go], ids[go], rank[go], best[go], to[go]
                each = each[: len(row)]
                if not len(row):
                    break
            length[row] -= 1
            ids[each, best] = to
            source = column + (column > best[:, None])
            ids[:, :-1] = np.take_along_axis(ids, source, 1)
            ids[:, -1] = -1
            after = column[:-1] + (column[:-1] >= best[:, None])
            rank[:, :-1] = np.take_along_axis(rank, after, 1)
            rank[:, -1] = NONE
            # only the pairs on both sides of the new token are new
            has = best < width - 2
            rank[each[has], best[has]] = self.pairs.get(ids[each[has], best[has]], ids[each[has], best[has] + 1])
            has = best > 0
            rank[each[has], best[has] - 1] = self.pairs.get(ids[each[has], best[has] - 1], ids[each[has], best[has]])
        return out

    def merge_long(self, piece: bytes) -> bytes:
        """The same merges for one long piece, by a heap of pairs over a linked list."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, get = [*range(1, n), -1], [*range(-1, n - 1)], self.pair_id.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (s := get(r << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (s, i, r, ids[k]))
            if (h := before[i]) >= 0 and (s := get(ids[h] << 32 | r)) is not None:
                heapq.heappush(heap, (s, h, ids[h], r))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Encodes the pieces into the memo, in buckets of similar length."""
        buckets: dict[int, tuple[list[str], list[bytes]]] = {w: ([], []) for w in self.widths}
        for piece in pieces:
            raw = piece.encode()
            if (i := self.ranks.get(raw)) is not None:
                self.memo[piece] = i.to_bytes(4, "little")
            elif len(raw) > self.long_bytes:
                self.memo[piece] = self.merge_long(raw)
            else:
                names, rows = buckets[next(w for w in self.widths if w >= len(raw))]
                names.append(piece)
                rows.append(raw)
        for width, (names, rows) in buckets.items():
            step = max(64, (1 << 18) // width)
            for at in range(0, len(rows), step):
                self.memo.update(zip(names[at : at + step], self.merge_rows(rows[at : at + step], width), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split = [self.find(t) for t in texts]
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
        self.learn(set().union(*split) - self.memo.keys())
        get = self.memo.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(i) for token, i in map(bytes.split, f)}


@lru_cache(2)
def vocabulary(name: str, pattern: str, long_bytes: int) -> Vocabulary:
    """One vocabulary for each worker process."""
    return Vocabulary(read_ranks(SparkFiles.get(name)), pattern, long_bytes)


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", long_bytes: int = LONG_BYTES) -> DataFrame:
    """key, ids (binary, little-endian unsigned 32-bit) and decoded (binary) of each row.

    The rank file is sent to the executors with Spark's addFile; it is of the size of a vocabulary."""
    docs.sparkSession.sparkContext.addFile(ranks_path)
    name = ranks_path.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(name, pattern, long_bytes)
        for batch in batches:
            column, at = batch.column(text), 0
            while at < len(batch):
                part, size = [], 0
                while at + len(part) < len(batch) and size < 1_000_000:
                    part.append(column[at + len(part)].as_py() or "")
                    size += len(part[-1])
                ids = words.encode(part)
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(at, len(part)), pa.array(ids, pa.binary()), pa.array([words.decode(x) for x in ids], pa.binary())], [key, "ids", "decoded"])
                at += len(part)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ids binary, decoded binary")
