"""Token ids in files of bit or byte planes, as a Spark data source for writing and reading.

A file holds the ids of a run of documents.  The ids are cut into blocks of BLOCK, whatever the
documents' ends; a block is transposed into planes (plane k has bit k, or byte k, of every id), and each plane
is compressed with zstandard.  Of bit and byte planes a block takes the smaller.  Layout:

    magic | planes of block 0 | planes of block 1 | ... | index | footer

The index (compressed) has for each block its place, ids, kind of planes, crc32 and the planes' lengths, and for each
document its key and number of ids.  The footer has the index's place and lengths.  A folder's
manifest lists its files in the order of their documents, with the ids before each; it is written last, so
a folder without it was not finished.

Writing: documents are dealt by ranges of their key and sorted (ties by a hash of the text), so that files follow
one another in ascending order and no task gets more than its range; rows of one key may lie in several ranges.
A task that is tried again writes files of other names, and only those that the commit knows are listed.
A task holds one block of ids and one file's index, so files end at FILE_IDS ids or FILE_DOCS documents.

Defined results: null text is empty, so its document is the end id alone; rows with a null key come first;
repeated rows are documents of their own; an empty table gives a folder without files, which reads as
no rows.  Other columns than key and text are not read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

BLOCK = 1 << 16
FILE_IDS = 1 << 26
FILE_DOCS = 1 << 21
BATCH_BYTES = 4 << 20
TEXT_BYTES = 8 << 20
MAGIC = b"IDPLANE1"
FOOTER = struct.Struct("<QQQQQ")
MANIFEST = "_manifest.json"
BITS, BYTES = 0, 1


def planes_of(ids: np.ndarray, kind: int) -> list[bytes]:
    """The planes of ids (unsigned 32-bit), lowest first, as many as the largest id needs."""
    width = max(1, int(ids.max()).bit_length())
    columns = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)[: (width + 7) // 8]
    if kind == BYTES:
        return [c.tobytes() for c in columns]
    bits = [np.packbits(np.unpackbits(c, bitorder="little").reshape(-1, 8).T, axis=1) for c in columns]
    return [b.tobytes() for b in np.concatenate(bits)[:width]]


def ids_of(planes: list[bytes], kind: int, n: int) -> np.ndarray:
    """The inverse of planes_of, for n ids."""
    out = np.zeros(n, "<u4")
    for k, plane in enumerate(planes):
        raw = np.frombuffer(plane, np.uint8)
        out |= (np.unpackbits(raw, count=n) if kind == BITS else raw).astype("<u4") << (k if kind == BITS else 8 * k)
    return out


class FileWriter:
    """One file, written block by block."""

    def __init__(self, store: fs.FileSystem, path: str, block: int = BLOCK):
        self.block = block
        self.path, self.out, self.at = path, store.open_output_stream(path), len(MAGIC)
        self.out.write(MAGIC)
        self.rest: list[np.ndarray] = []
        self.waiting = 0
        self.blocks: list[tuple[int, ...]] = []
        self.lengths: list[int] = []
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.ids = self.docs = self.nulls = 0
        self.pack = zstandard.ZstdCompressor(level=3)

    def add(self, keys: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        """Documents that follow one another, null keys first, and their ids."""
        self.keys.append(pc.fill_null(keys, 0).to_numpy(zero_copy_only=False))
        self.counts.append(counts)
        self.nulls += keys.null_count
        self.docs += len(keys)
        self.ids += len(ids)
        self.rest.append(ids.astype("<u4"))
        self.waiting += len(ids)
        if self.waiting >= self.block:
            rest = np.concatenate(self.rest)
            whole = len(rest) // self.block * self.block
            for i in range(0, whole, self.block):
                self._block(rest[i : i + self.block])
            self.rest, self.waiting = [rest[whole:]], len(rest) - whole

    def _block(self, ids: np.ndarray) -> None:
        kinds = [[self.pack.compress(p) for p in planes_of(ids, kind)] for kind in (BITS, BYTES)]
        kind = min((BITS, BYTES), key=lambda k: sum(map(len, kinds[k])))
        body = b"".join(kinds[kind])
        self.out.write(body)
        self.blocks.append((self.at, len(ids), kind, len(kinds[kind]), zlib.crc32(ids.tobytes())))
        self.lengths += map(len, kinds[kind])
        self.at += len(body)

    def close(self) -> None:
        if self.waiting:
            self._block(np.concatenate(self.rest))
        parts = [np.array(self.blocks, "<i8").ravel(), np.array(self.lengths, "<i8"), *(np.concatenate(x).astype("<i8") for x in (self.keys, self.counts))]
        index = self.pack.compress(b"".join(p.tobytes() for p in parts))
        self.out.write(index)
        self.out.write(FOOTER.pack(self.at, len(self.blocks), len(self.lengths), self.docs, self.nulls) + MAGIC)
        self.out.close()


class FileReader:
    """A file's index, and its blocks by number."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.file = store.open_input_file(path)
        size, tail = self.file.size(), FOOTER.size + len(MAGIC)
        end = self.file.read_at(tail, size - tail)
        if end[-len(MAGIC) :] != MAGIC:
            raise ValueError(f"{path} has no footer")
        at, blocks, lengths, docs, self.nulls = FOOTER.unpack(end[: FOOTER.size])
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.file.read_at(size - tail - at, at), max_output_size=8 * (5 * blocks + lengths + 2 * docs)) if blocks else b"", "<i8")
        self.blocks, self.lengths, self.docs, self.counts = np.split(raw, np.cumsum([5 * blocks, lengths, docs]))
        self.blocks = self.blocks.reshape(-1, 5)
        self.first_plane = np.concatenate(([0], np.cumsum(self.blocks[:, 3])))
        self.unpack = zstandard.ZstdDecompressor()

    def block(self, k: int) -> np.ndarray:
        at, n, kind, _, crc = self.blocks[k].tolist()
        lengths = self.lengths[self.first_plane[k] : self.first_plane[k + 1]].tolist()
        body = self.file.read_at(sum(lengths), at)
        ends = np.cumsum(lengths).tolist()
        plane_bytes = (n + 7) // 8 if kind == BITS else n
        ids = ids_of([self.unpack.decompress(body[e - m : e], max_output_size=plane_bytes) for e, m in zip(ends, lengths, strict=True)], kind, n)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
        return ids


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI that all executors share."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def manifest_of(path: str) -> list[dict]:
    """The files of a finished folder: name, start, ids, docs, in the order of their documents."""
    store, folder = open_store(path)
    with store.open_input_file(f"{folder}/{MANIFEST}") as f:
        return json.loads(f.read())


def ids_between(path: str, start: int, n: int) -> np.ndarray:
    """The n ids from `start` of a folder, reading no other blocks than those that hold them."""
    store, folder = open_store(path)
    got = [np.empty(0, "<u4")]
    for entry in manifest_of(path):
        low, high = max(start - entry["start"], 0), min(start + n - entry["start"], entry["ids"])
        if low < high:
            file = FileReader(store, f"{folder}/{entry['name']}")
            ends = np.cumsum(file.blocks[:, 1])
            for k in range(int(np.searchsorted(ends, low, "right")), int(np.searchsorted(ends, high)) + 1):
                first = int(ends[k - 1]) if k else 0
                got.append(file.block(k)[max(low - first, 0) : high - first])
    return np.concatenate(got)


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: (name, ids, documents), in order."""

    partition: int
    files: list[tuple[str, int, int]]


def given(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Keys, numbers of ids and ids of a batch (doc_id, ids)."""
    ids = batch.column("ids")
    return batch.column("doc_id"), pc.binary_length(ids).to_numpy() // 4, np.frombuffer(b"".join(ids.to_pylist()), "<u4")


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, block: int, tokenizer: str, end_id: int):
        self.path, self.overwrite, self.block, self.tokenizer, self.end_id = path, overwrite, block, tokenizer, end_id

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = open_store(self.path)
        store.create_dir(folder, recursive=True)
        part, tag, done, file = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], [], None

        def close() -> None:
            file.close()
            done.append((file.path.rsplit("/", 1)[-1], file.ids, file.docs))

        for keys, counts, ids in encoded(iterator, SparkFiles.get(self.tokenizer), self.end_id) if self.tokenizer else map(given, iterator):
            if file and (file.ids >= FILE_IDS or file.docs >= FILE_DOCS):
                close()
                file = None
            if len(keys):
                file = file or FileWriter(store, f"{folder}/part-{part:07d}-{len(done):05d}-{tag}.ids", self.block)
                file.add(keys, counts, ids)
        if file:
            close()
        return Written(part, done)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = open_store(self.path)
        store.create_dir(folder, recursive=True)
        place = f"{folder}/{MANIFEST}"
        old = manifest_of(self.path) if store.get_file_info(place).type == fs.FileType.File else None
        if old is not None and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{self.path} has ids already")
        entries, start = [], 0
        for message in sorted((m for m in messages if m), key=lambda m: m.partition):
            for name, ids, docs in message.files:
                entries.append({"name": name, "start": start, "ids": ids, "docs": docs})
                start += ids
        with store.open_output_stream(f"{place}.new") as f:
            f.write(json.dumps(entries).encode())
        store.move(f"{place}.new", place)
        for entry in old or []:
            store.delete_file(f"{folder}/{entry['name']}")

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = open_store(self.path)
        for message in filter(None, messages):
            for name, _, _ in message.files:
                store.delete_file(f"{folder}/{name}")


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((e["name"], e["start"])) for e in manifest_of(self.path)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        (name, start), (store, folder) = partition.value, open_store(self.path)
        file = FileReader(store, f"{folder}/{name}")
        parts, have, k, out, size = [], 0, 0, [], 0  # ids read and not yet given out; rows not yet given out

        def rows() -> pa.RecordBatch:
            keys, starts, counts, ids = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

        for i, (doc, n) in enumerate(zip(file.docs.tolist(), file.counts.tolist(), strict=True)):
            while have < n:
                parts.append(file.block(k))
                have += len(parts[-1])
                k += 1
            if len(parts) > 1:
                parts = [np.concatenate(parts)]
            ids, parts = parts[0][:n] if parts else np.empty(0, "<u4"), [parts[0][n:]] if parts else []
            have -= n
            out.append((None if i < file.nulls else doc, start, n, ids.tobytes()))
            start += n
            size += 4 * n + 32
            if size >= BATCH_BYTES:
                yield rows()
                out, size = [], 0
        if out:
            yield rows()


class IdPlanes(DataSource):
    """Format "id_planes": rows (doc_id long, ids binary; or text string, with a tokenizer) to write; to read, ids
    with their starts and numbers."""

    @classmethod
    def name(cls) -> str:
        return "id_planes"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite, int(self.options.get("block", BLOCK)), self.options.get("tokenizer", ""), int(self.options.get("end_id", 2)))


#: What separates pieces that are encoded in one call; the tokenizer gives it an id of its own.
MARK = "\0"
PIECES = 200
KNOWN = 600_000


class PieceEncoder:
    """Ids of texts as the tokenizers library gives them, where each piece between white space is encoded once.

    The tokenizer drops white space and never joins what it parts, so a text's ids are those of its pieces.  Pieces are kept in two tables of about KNOWN each: when the
    younger is full, it takes the place of the older, from which pieces that come again are taken over."""

    def __init__(self, json_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task a core
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(json_path).encode_batch_fast
        self.mark = self.encode([MARK], add_special_tokens=False)[0].ids
        assert len(self.mark) == 1
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def alone(self, pieces: list[str]) -> None:
        for piece, got in zip(pieces, self.encode(pieces, add_special_tokens=False), strict=True):
            self.known[piece] = np.array(got.ids, "<u4").tobytes()

    def together(self, pieces: list[str]) -> None:
        runs = [pieces[i : i + PIECES] for i in range(0, len(pieces), PIECES)]
        for run, got in zip(runs, self.encode([f" {MARK} ".join([*r, ""]) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            ends = (4 * np.flatnonzero(ids == self.mark[0])).tolist()
            raw, at = ids.tobytes(), 0
            if len(ends) != len(run):
                self.alone(run)
                continue
            for piece, end in zip(run, ends, strict=True):
                self.known[piece] = raw[at:end]
                at = end + 4

    def learn(self, pieces: set[str]) -> None:
        again = pieces & self.older.keys()
        self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
        new = pieces - again
        self.together([p for p in new if MARK not in p])
        self.alone([p for p in new if MARK in p])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin and the last's end."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        pieces = lists.flatten().dictionary_encode()
        words, place = pieces.dictionary.to_pylist(), pieces.indices.to_numpy()
        if len(self.known) > KNOWN:
            self.known, self.older = {}, self.known
        self.learn(set(words).difference(self.known))
        each = list(map(self.known.__getitem__, words))
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        first, own = (np.cumsum(size) - size)[place], size[place]
        ends = np.concatenate(([0], np.cumsum(own)))
        ids = np.frombuffer(b"".join(each), "<u4")[np.repeat(first - ends[:-1], own) + np.arange(ends[-1])]
        offsets = lists.offsets.to_numpy()
        return ids, ends[offsets - offsets[0]]


_encoders: dict[str, PieceEncoder] = {}


def encoder_of(json_path: str) -> PieceEncoder:
    """A worker's encoder, kept for its next task."""
    if json_path not in _encoders:
        _encoders[json_path] = PieceEncoder(json_path)
    return _encoders[json_path]


def encoded(batches: Iterator[pa.RecordBatch], json_path: str, end_id: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Keys, numbers of ids and ids of batches (doc_id, text), some texts at a time; each text's ids end with end_id."""
    encoder = encoder_of(json_path)
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // TEXT_BYTES
        for at in np.split(np.arange(len(size)), np.flatnonzero(np.diff(part)) + 1):
            if len(at):
                some = batch.slice(at[0], len(at))
                ids, ends = encoder(some.column("text"))
                yield some.column("doc_id"), np.diff(ends) + 1, np.insert(ids, ends[1:], end_id)


def ordered(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text in ascending order of the key, dealt by ranges; ties by a hash of the text.

    Rows of one key and text are told apart by their places, so ranges can part them."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("place"))
    keys = [F.asc_nulls_first("doc_id"), "h", "place"]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")


def encode(docs: DataFrame, json_path: str, end_id: int = 2) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of each text, with the end id, in the order of the rows."""
    docs.sparkSession.sparkContext.addFile(json_path)
    name = json_path.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts, ids in encoded(batches, SparkFiles.get(name), end_id):
            yield pa.RecordBatch.from_arrays([keys, pa.array([x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])], pa.binary())], ["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id long, ids binary")


def write(rows: DataFrame, path: str, json_path: str = "", end_id: int = 2, block: int = BLOCK) -> None:
    """Writes rows (doc_id, ids), or (doc_id, text) with a tokenizer's file, which lie in order, to a new folder.

    With texts, the task that encodes them writes the files."""
    if json_path:
        rows.sparkSession.sparkContext.addFile(json_path)
    rows.sparkSession.dataSource.register(IdPlanes)
    options = {"path": path, "block": block, "tokenizer": json_path.rsplit("/", 1)[-1], "end_id": end_id}
    rows.write.format("id_planes").options(**options).mode("append").save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of each document of a folder."""
    spark.dataSource.register(IdPlanes)
    return spark.read.format("id_planes").option("path", path).load()
