"""Packing of token ids into sequences by minimum bin slack.

Each document's ids and its end id are cut into pieces of the capacity and one remainder.  Full
pieces are sequences already.  Remainders wait in a window of bounded size; each sequence takes
the longest one and then the multiset of waiting lengths whose sum comes closest to what is
left, found by a subset-sum dynamic programme on bitsets and traced back to counts of each
length.  If no multiset fills a sequence, the longest waiting piece is cut to fill it, so that only the last
sequence of a partition has padding.

Work stays in the partition that read the texts: nothing is shuffled, and a lost executor's
partition is packed again alike, for the order of rows in a file split is fixed.  Sequence ids are
the partition's number times 2**32 plus a counter.

Ids are those of the tokenizer file without added special tokens at the ends; a special token's string within a
text is that token, as the tokenizers library has it.

Defined results: null text is empty, so its document is the end id alone; repeated rows and null
ids are packed like any other row; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame

from quire.llm.bpe import read_ranks

WINDOW = 4096


def closest_multiset(lengths: list[int], count: Callable[[int], int], room: int) -> dict[int, int]:
    """Counts of lengths (given in rising order) with the largest sum of at most room.

    Bit s of reach[i] says that the i longest kinds of length can give the sum s."""
    full, reach, used = (1 << (room + 1)) - 1, [1], []
    for at in range(bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[at]
        now, step, left = reach[-1], 1, min(count(length), room // length)
        while left:  # the count as a sum of steps 1, 2, 4, ... and a rest
            take = min(step, left)
            now |= now << (length * take) & full
            left -= take
            step *= 2
        used.append(length)
        reach.append(now)
        if now >> room & 1:
            break
    total = reach[-1].bit_length() - 1
    out: dict[int, int] = {}
    for i in range(len(used) - 1, -1, -1):
        while not reach[i] >> total & 1:
            total -= used[i]
            out[used[i]] = out.get(used[i], 0) + 1
    return out


class Packer:
    """Sequences of one partition; a piece is (document, start, ids, tokens of the document)."""

    def __init__(self, capacity: int, window: int = WINDOW):
        self.capacity, self.window = capacity, window
        self.waiting: dict[int, list[tuple]] = {}
        self.lengths: list[int] = []
        self.n = self.sequences = 0

    def add(self, piece: tuple, length: int) -> None:
        if length not in self.waiting:
            self.waiting[length] = []
            insort(self.lengths, length)
        self.waiting[length].append(piece)
        self.n += 1

    def take(self, length: int) -> tuple:
        own = self.waiting[length]
        piece = own.pop()
        if not own:
            del self.waiting[length], self.lengths[bisect_left(self.lengths, length)]
        self.n -= 1
        return piece

    def fill(self, least: int) -> Iterator[list[tuple]]:
        """Sequences of (piece, length) until at most `least` pieces wait."""
        while self.n > least:
            length = self.lengths[-1]
            sequence, room = [(self.take(length), length)], self.capacity - length
            for kind, n in closest_multiset(self.lengths, lambda x: len(self.waiting[x]), room).items():
                sequence += [(self.take(kind), kind) for _ in range(n)]
                room -= kind * n
            if room and self.n:
                kind = self.lengths[-1]
                doc, start, ids, total = self.take(kind)
                sequence.append(((doc, start, ids[: 4 * room], total), room))
                self.add((doc, start + room, ids[4 * room :], total), kind - room)
            yield sequence

    def next_id(self) -> int:
        self.sequences += 1
        return self.sequences - 1


def special_tokens(json_path: str) -> dict[str, int]:
    """The added tokens of a tokenizer file, by their strings."""
    with open(json_path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def pack(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """One row for each piece: key, start, length, ids (binary, little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset.

    Sequences that are not full are to be padded to the capacity.  `special` has the tokenizer's added tokens."""
    docs.sparkSession.sparkContext.addFile(ranks_path)
    name = ranks_path.rsplit("/", 1)[-1]
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=read_ranks(SparkFiles.get(name)), special_tokens=special).encode
        first = TaskContext.get().partitionId() << 32
        packer = Packer(capacity)
        out: list[tuple] = []
        kind = None
        size = 0

        def rows() -> pa.RecordBatch:
            nonlocal size
            columns = list(zip(*out, strict=True))
            out.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:3]), pa.array(columns[3], pa.binary()), *(pa.array(c, pa.int64()) for c in columns[4:])], [key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def put(sequence: list[tuple]) -> None:
            nonlocal size
            number, offset = first + packer.next_id(), 0
            for (doc, start, ids, total), length in sequence:
                out.append((doc, start, length, ids, total, number, offset))
                offset += length
                size += len(ids)

        for batch in batches:
            kind = batch.column(key).type
            for doc, value in zip(batch.column(key), batch.column(text), strict=True):
                doc = doc.as_py()
                ids = np.array(encode(value.as_py() or "", allowed_special="all"), "<u4").tobytes() + end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    length = len(piece) // 4
                    if length == capacity:
                        put([((doc, start, piece, total), length)])
                    else:
                        packer.add((doc, start, piece, total), length)
                if packer.n >= packer.window:
                    for sequence in packer.fill(packer.window // 2):
                        put(sequence)
                if size > 8_000_000:
                    yield rows()
        for sequence in packer.fill(0):
            put(sequence)
        if out:
            yield rows()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
