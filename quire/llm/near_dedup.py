"""Near-duplicate documents by a chosen-path set similarity join.

1. Every document becomes its set of word shingles (64-bit hashes), of which a 128-bit key of the
   whole set and MINS minwise tokens are kept.  Documents with equal sets form one class; only
   classes, named by their smallest id, are joined from here on.
2. In each of TREES independent trees a class walks from the root to child nodes chosen by a hash of the node
   and a minwise token, CHOSEN of them on average.  Two similar sets share tokens and so walk alike.
3. In a node of at most SMALL classes all pairs are compared: by one byte of each minwise token, and what
   may be similar on the full shingle sets, unless it is connected by then.  Nodes with equal members
   are compared once.
4. The members of a larger node are first dealt into blocks, each with the node's pivot, and a class joins
   in no more than two such nodes; so a large group of copies becomes one component without
   making its pairs.  If all but SMALL of a node's members are one component then, those others are compared with
   all members, in blocks.  A node of at most MEDIUM members is compared by itself.  Every other
   node branches: first by set size, in bands that overlap as far as similar sets can differ, which loses nothing,
   then by tokens.  A node that is still large after LEVELS of this is a family of texts that share most of their tokens
   and yet are no links; it is compared by itself, in blocks that meet in pairs.
5. Members of these nodes bear the list of all such nodes that they are in, so a pair is compared only in the
   first node in which it meets.

A pair of similarity 0.8 misses all common children in one tree with probability 0.2 at the first
level and 0.36 at any depth, so eight trees find it with 0.99999 and 0.9997; the bytes (38 or more of
64 equal) let 0.9999 of such pairs through.  As components are wanted, a pair that is already
connected needs no comparison and a group of copies never makes all its pairs.

Each round writes its tables to the shared folder (see cluster.Shelf) and deletes them when they are
used up; those that the result reads stay there.

Defined results: ASCII letters are lower-cased; a text without words (or null) has an empty set
and links with nothing; a text of fewer words than a shingle is one shingle; doc_id names a
document, so rows that repeat an id share its component, and rows with a null id link with
nothing, have a null component and are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textblock as tb
from quire.llm.cluster import Shelf, durable, join_uneven
from quire.llm.components import components

MINS, TREES, CHOSEN, SMALL, MEDIUM, LEVELS, ALIKE = 64, 8, 2, 256, 4096, 2, 38
#: Members of a block of a family.
BLOCK = MEDIUM // 2
#: Shingles of a group that is confirmed in one piece.
HEAVY = 1 << 21
#: Bits of the largest filter that is broadcast to keep texts out of the table of full sets.
FILTER_BITS = 28
#: Bits that an id sets there; with 16 bits or more for each id one of 400 others passes, with one bit set one of 16 would.
PROBES = 4
_U = np.uint64
_A = tb.mix(np.arange(1, MINS + 1, dtype=_U)) | _U(1)
_B = tb.mix(np.arange(1001, MINS + 1001, dtype=_U))
_ROOTS = tb.mix(np.arange(2001, TREES + 2001, dtype=_U))
_CUT = _U(int((1 << 64) * CHOSEN / MINS))


def block_shingles(block: tb.Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a block's documents, sorted within each, and their number by document."""
    data = tb.LOWER[block.data]
    words = tb.spans(block, ~tb.SPACE[data])
    h = tb.span_hashes(data, words.start, words.end)
    shingle, at = tb.windows(h, words.doc, k)
    doc = words.doc[at]
    counts = words.counts(block.n)
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        own = h[words.doc == i]
        total = _U(len(own))
        for x in own:
            total = total * _U(0x9E3779B97F4A7C15) + x
        shingle, doc = np.append(shingle, tb.mix(np.array([total]))), np.append(doc, i)
    order = np.lexsort((shingle, doc))
    shingle, doc = shingle[order], doc[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])
    return shingle[new], np.bincount(doc[new], minlength=block.n).astype(np.int64)


def binary(rows: np.ndarray) -> pa.Array:
    """A binary column with one row of a matrix in each."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def set_keys(shingle: np.ndarray, n: np.ndarray) -> np.ndarray:
    """128 bits that name each document's set; zero for an empty one."""
    out = np.zeros((len(n), 2), _U)
    if (n > 0).any():
        start = (np.cumsum(n) - n)[n > 0]
        out[n > 0, 0] = np.add.reduceat(tb.mix(shingle), start)
        out[n > 0, 1] = np.add.reduceat(tb.mix(shingle ^ _B[0]), start)
    return out


def _signatures(key: str, text: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for block in tb.blocks(batch.column(text)):
                    ids = batch.column(key).slice(block.first, block.n)
                    shingle, n = block_shingles(block, k)
                    sets, mins = set_keys(shingle, n), np.zeros((block.n, MINS), np.uint32)
                    full = n > 0
                    if full.any():
                        start = (np.cumsum(n) - n)[full]
                        for i in range(MINS):
                            mins[full, i] = np.minimum.reduceat(shingle * _A[i] + _B[i], start) >> _U(32)
                    if not full.all():
                        # empty sets are no class; keys of their own spread them over the tasks of later joins
                        sets[~full, 0] = tb.mix(ids.filter(pa.array(~full)).to_numpy().view(_U))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(n), binary(sets), binary(mins)], [key, "n_shingles", "set_key", "mins"])

    return run


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """The rows of a binary column of equal widths."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def sketches(mins: np.ndarray) -> np.ndarray:
    """One byte of each minwise token."""
    return (mins * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)


def _children(roots: bool):
    """From (node, id, part, mins) or (id, part, mins) to the chosen children (node, id, part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(MINS, dtype=_U) << _U(32)
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                ids, parts = part.column("id").to_numpy(), part.column("part").to_numpy()
                tokens = tb.mix(matrix(part.column("mins"), np.uint32).astype(_U) | place)
                for nodes in [np.full(len(ids), r) for r in _ROOTS] if roots else [part.column("node").to_numpy().view(_U)]:
                    code = tb.mix(nodes[:, None] ^ tokens)
                    row, column = np.nonzero(code < _CUT)
                    yield pa.RecordBatch.from_arrays([pa.array(tb.mix(code[row, column]).view(np.int64)), pa.array(ids[row]), pa.array(parts[row])], ["node", "id", "part"])

    return run


def runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Whole groups of rows that come sorted by `by`, with the bounds of the groups; what is held back is
    one group and one batch."""
    held: list[pa.RecordBatch] = []

    def cut(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
        batch = pa.Table.from_batches(parts).combine_chunks().to_batches(max_chunksize=None)[0]
        new = np.zeros(len(batch) - 1, bool)
        for k in by:
            x = batch.column(k).to_numpy()
            new |= x[1:] != x[:-1]
        return batch, np.concatenate(([0], np.flatnonzero(new) + 1, [len(batch)]))

    for batch in batches:
        if not len(batch):
            continue
        last = len(batch) - 1
        if held and all(held[0].column(k)[0].as_py() == batch.column(k)[last].as_py() for k in by):
            held.append(batch)
            continue
        whole, bounds = cut([*held, batch])
        held = [whole.slice(bounds[-2])]
        if bounds[-2]:
            yield whole.slice(0, bounds[-2]), bounds[:-1]
    if held:
        yield cut(held)


def _incidence(node: int, met: pa.Array) -> np.ndarray | None:
    """Which members of a node are in which nodes before it; nodes with one member there are left out."""
    size = np.diff(met.offsets.to_numpy())
    owner, nodes = np.repeat(np.arange(len(met)), size), met.flatten().to_numpy()
    owner, nodes = owner[nodes < node], nodes[nodes < node]
    kinds, column, count = np.unique(nodes, return_inverse=True, return_counts=True)
    shared = count > 1
    if not shared.any():
        return None
    out = np.zeros((len(met), int(shared.sum())), np.float32)
    kept = shared[column]
    out[owner[kept], (np.cumsum(shared) - 1)[column[kept]]] = 1
    return out


def _alike(part: np.ndarray, n: np.ndarray, sketch: np.ndarray, percent: int, earlier: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members of different components that may be similar and have met in no earlier node."""
    out = []
    for at in range(0, len(n), SMALL):
        a = slice(at, at + SMALL)
        for to in range(at, len(n), SMALL):
            b = slice(to, to + SMALL)
            may = (part[a, None] != part[None, b]) & (100 * np.minimum(n[a, None], n[None, b]) >= percent * np.maximum(n[a, None], n[None, b]))
            if at == to:
                may = np.triu(may, 1)
            if earlier is not None:
                may &= earlier[a] @ earlier[b].T == 0
            x, y = np.nonzero(may)
            for some in range(0, len(x), 1 << 16):
                i, j = x[some : some + (1 << 16)] + at, y[some : some + (1 << 16)] + to
                near = (sketch[i] == sketch[j]).sum(1) >= ALIKE
                out.append((i[near], j[near]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


def _plausible(percent: int, families: bool = False):
    """Those members of each group that look similar to others of it, as groups (key, id); those of families bear their node
    and the nodes that they are in.

    Members that look alike, directly or through others, form a part, and that is a group.  One of more than
    SMALL members and HEAVY shingles, which takes much memory, is cut into blocks that meet in pairs.  A key
    is made of a group's ids, so equal groups get the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in runs(batches, ["g", "i"]):
            ids, part, n = (batch.column(k).to_numpy() for k in ("id", "part", "n"))
            sketch = matrix(batch.column("sketch"), np.uint8)
            size = np.diff(bounds)
            two = bounds[:-1][(size == 2) & (not families)]
            may = (part[two] != part[two + 1]) & (100 * np.minimum(n[two], n[two + 1]) >= percent * np.maximum(n[two], n[two + 1]))
            two = two[may]
            two = two[(sketch[two] == sketch[two + 1]).sum(1) >= ALIKE]
            pair = np.stack((ids[two], ids[two + 1]), 1)
            keys, found = [np.repeat(_key(pair), 2)], [np.stack((two, two + 1), 1).ravel()]
            several = size > (1 if families else 2)
            for a, b in zip(bounds[:-1][several], bounds[1:][several], strict=True):
                if (part[a:b] == part[a]).all():
                    continue
                i, j = _alike(part[a:b], n[a:b], sketch[a:b], percent, _incidence(batch.column("g")[a].as_py(), batch.column("met").slice(a, b - a)) if families else None)
                if not len(i):
                    continue
                root = np.arange(b - a)
                while (root[i] != root[j]).any():
                    x, y = root[i], root[j]
                    np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
                    while (root != root[root]).any():
                        root = root[root]
                some = np.unique(np.concatenate((i, j)))
                some = some[np.argsort(root[some], kind="stable")]
                weight = n[a:b]
                for own in np.split(some, np.flatnonzero(np.diff(root[some])) + 1):
                    half = SMALL // 2
                    light = len(own) <= SMALL or weight[own].sum() <= HEAVY
                    salt = tb.mix(batch.column("g").to_numpy()[a : a + 1].view(_U)) if families else _U(0)
                    blocks = [own + a] if light else [own[at : at + half] + a for at in range(0, len(own), half)]
                    for p in range(len(blocks)):
                        for q in range(p + (len(blocks) > 1), len(blocks)):
                            group = blocks[p] if p == q else np.concatenate((blocks[p], blocks[q]))
                            keys.append(np.repeat(_key(ids[group][None]) ^ salt, len(group)))
                            found.append(group)
            own = batch.select(["id", "part", "set_key", "n", "sketch", *(["g", "met"] if families else [])]).take(pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *own.columns], ["key", *own.schema.names])

    return run


def _key(groups: np.ndarray) -> np.ndarray:
    return tb.mix(np.bitwise_xor.reduce(tb.mix(groups.astype(np.int64).view(_U)), 1) + np.add.reduce(groups.astype(np.int64).view(_U), 1))


def packed(shingle: np.ndarray, n: np.ndarray) -> pa.Array:
    """A binary column with each document's set: the upper 48 bits of its sorted hashes."""
    data = np.ascontiguousarray(shingle.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6])
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(n * 6))).astype(np.int32)), pa.py_buffer(data)])


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(">u8")[:, 0].astype(_U)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.sort(np.concatenate((x, y)))
    both = np.count_nonzero(both[1:] == both[:-1])
    return 100 * both >= percent * (len(x) + len(y) - both)


def forest(part: np.ndarray, sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links among the pairs (i, j) of sets, each of which connects two components; part is changed.

    The common shingles of one set and all others are counted at once."""
    flat, n = np.concatenate(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    start = np.cumsum(n) - n
    _, flat = np.unique(flat, return_inverse=True)
    own = np.zeros(int(flat.max()) + 1, bool)
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    out = []
    for x, y in zip(i[np.flatnonzero(np.diff(i, prepend=-1))].tolist(), np.split(j, np.flatnonzero(np.diff(i)) + 1), strict=True):
        y = y[part[y] != part[x]]
        if not len(y):
            continue
        mine = flat[start[x] : start[x] + n[x]]
        own[mine] = True
        both = np.add.reduceat(own[flat], start, dtype=np.int64)[y]
        own[mine] = False
        for z in y[100 * both >= percent * (n[x] + n[y] - both)].tolist():
            if part[z] != part[x]:
                out.append((x, z))
                part[part == part[z]] = part[x]
    return out


def common(sets: list[np.ndarray]) -> np.ndarray | None:
    """Which sets have which of the shingles that several of them have; None if that is too much to hold or to multiply."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), list(map(len, sets)))
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    if len(sets) * int(shared.sum()) > min(1 << 26, 40 * len(flat)):
        return None
    out = np.zeros((len(sets), int(shared.sum())), np.float32)
    kept = shared[column]
    out[owner[kept], (np.cumsum(shared) - 1)[column[kept]]] = 1
    return out


def products(part: np.ndarray, n: np.ndarray, has: np.ndarray, percent: int, earlier: np.ndarray | None) -> list[tuple[int, int]]:
    """Links of sets, each of which connects two components; the sizes of all intersections are a matrix product."""
    out, root = [], part.copy()
    for at in range(0, len(n), SMALL):
        both = has[at : at + SMALL] @ has[at:].T
        link = 100 * both >= percent * (n[at : at + SMALL, None] + n[None, at:] - both)
        link &= part[at : at + SMALL, None] != part[None, at:]
        if earlier is not None:
            link &= earlier[at : at + SMALL] @ earlier[at:].T == 0
        for x, y in zip(*(z.tolist() for z in np.nonzero(np.triu(link, 1))), strict=True):
            if root[at + x] != root[at + y]:
                out.append((at + x, at + y))
                root[root == root[at + y]] = root[at + x]
    return out


def _linked(percent: int, families: bool = False):
    """Links (u, v) of components: a forest of the links in each group, confirmed on full sets; a pair that is connected
    by then needs no confirmation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in runs(batches, ["key"]):
            part, n = batch.column("part").to_numpy(), batch.column("n").to_numpy()
            sketch, shingles = matrix(batch.column("sketch"), np.uint8), batch.column("shingles")
            found = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a == 2 and not families:
                    if part[a] != part[a + 1] and similar(unpacked(shingles[a].as_py()), unpacked(shingles[a + 1].as_py()), percent):
                        found.append((a, a + 1))
                    continue
                earlier = _incidence(batch.column("g")[a].as_py(), batch.column("met").slice(a, b - a)) if families else None
                sets = [unpacked(shingles[k].as_py()) for k in range(a, b)] if families else []
                has = common(sets) if families else None
                if has is not None:
                    found += [(a + x, a + y) for x, y in products(part[a:b], n[a:b], has, percent, earlier)]
                    continue
                i, j = _alike(part[a:b], n[a:b], sketch[a:b], percent, earlier)
                if len(i):
                    found += [(a + x, a + y) for x, y in forest(part[a:b].copy(), [unpacked(shingles[k].as_py()) for k in range(a, b)], i, j, percent)]
            pairs = part[np.array(found, np.int64).reshape(-1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    return run


def _filter_words(bits: int):
    """The filter's bits of ids as words of 64 bits; equal words of other tasks are joined by OR."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.unique(np.concatenate([np.zeros(0, np.int64), *(_filter_places(b.column("id").to_numpy(), bits).ravel() for b in batches)]))
        place, first = np.unique(at >> 6, return_index=True)
        word = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(word.view(np.int64))], ["place", "word"])

    return run


def _filter_places(ids: np.ndarray, bits: int) -> np.ndarray:
    """The places of each id's bits, a row each."""
    x = tb.mix(ids.view(_U))
    return np.stack([(tb.mix(x + _U(k)) >> _U(64 - bits)).astype(np.int64) for k in range(PROBES)], 1)


def _sets(key: str, text: str, k: int, passes: Callable[[np.ndarray], np.ndarray]):
    """id, set_key and full set of the rows whose id passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                batch = batch.filter(pa.array(passes(batch.column(key).to_numpy())))
                for block in tb.blocks(batch.column(text)):
                    shingle, n = block_shingles(block, k)
                    yield pa.RecordBatch.from_arrays([batch.column(key).slice(block.first, block.n), binary(set_keys(shingle, n)), packed(shingle, n)], ["id", "set_key", "shingles"])

    return run


def _add_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("sketch", binary(sketches(matrix(batch.column("mins"), np.uint32))) if len(batch) else pa.array([], pa.binary()))


class _Join:
    """The state of one join: classes, full sets and components so far."""

    def __init__(self, docs: DataFrame, key: str, text: str, k: int, percent: int):
        self.docs, self.key, self.text, self.k, self.percent = docs.select(F.col(key).cast("long").alias(key), text).where(F.col(key).isNotNull()), key, text, k, percent
        self.shelf = Shelf(docs.sparkSession)
        self.signed = self.shelf.put(self.docs.mapInArrow(_signatures(key, text, k), f"{key} long, n_shingles long, set_key binary, mins binary"))
        classes = self.signed.where("n_shingles > 0").groupBy("set_key").agg(F.min(key).alias("id"), F.max("n_shingles").alias("n"), F.count("*").alias("copies"), F.max("mins").alias("mins"))
        self.classes = self.shelf.put(classes.mapInArrow(_add_sketch, "set_key binary, id long, n long, copies long, mins binary, sketch binary"))
        signed, self.signed = self.signed, self.shelf.put(self.signed.select(key, "n_shingles", "set_key"))
        self.shelf.drop(signed)
        self.parts: DataFrame | None = None

    def with_parts(self, rows: DataFrame, id_: str = "id", part: str = "part") -> DataFrame:
        """Adds the component so far of a row's id."""
        if self.parts is None:
            return rows.withColumn(part, F.col(id_))
        own = self.parts.select(F.col("node").alias(id_), F.col("component").alias(part))
        return rows.join(own, id_, "left").withColumn(part, F.coalesce(part, id_))

    def make_sets(self, ids: DataFrame) -> DataFrame:
        """id, set_key and full set of the texts with these ids (and perhaps of others), made where texts are read.

        Other texts are dropped there, by a filter of 16 bits for each id.  For more ids than
        the largest filter serves, later joins alone drop them."""
        wanted = self.shelf.put(ids.select("id").distinct())
        bits = max(10, math.ceil(math.log2(16 * wanted.count() + 1)))
        passes: Callable[[np.ndarray], np.ndarray] = lambda x: np.ones(len(x), bool)
        if bits <= FILTER_BITS:
            words = wanted.mapInArrow(_filter_words(bits), "place long, word long").groupBy("place").agg(F.bit_or("word").alias("word")).toArrow()
            table = np.zeros(1 << (bits - 6), np.int64)
            table[words.column("place").to_numpy()] = words.column("word").to_numpy()
            known = self.docs.sparkSession.sparkContext.broadcast(table)

            def passes(x: np.ndarray) -> np.ndarray:
                at = _filter_places(x, bits)
                return (known.value[at >> 6] >> (at & 63) & 1).astype(bool).all(1)

        self.shelf.drop(wanted)
        return self.docs.mapInArrow(_sets(self.key, self.text, self.k, passes), "id long, set_key binary, shingles binary").dropDuplicates(["id", "set_key"])

    def merge(self, links: DataFrame) -> None:
        """Renews the components by confirmed links of components."""
        merged = components(links, self.shelf)
        if self.parts is None:
            self.parts = self.shelf.put(merged)
            return
        merged = self.shelf.put(merged)
        old, before = self.parts, self.parts.select(F.col("node").alias("id"), F.col("component").alias("node"))
        moved = before.join(merged, "node", "left").select(F.col("id").alias("node"), F.coalesce("component", "node").alias("component"))
        self.parts = self.shelf.put(moved.union(merged.join(old.select("node"), "node", "left_anti")))
        self.shelf.drop(old, merged)

    def compare(self, groups: DataFrame | None, whole: DataFrame | None = None) -> None:
        """Compares the members of each group of rows (g, i, id, part), and of whole nodes (with `met`).

        Full sets are made anew for each comparison, and of those texts only that look similar to others in it: kept for later
        ones they would be written once and shuffled each time.  Components change here alone, so the rows of all later steps bear their component until the next comparison."""
        def near(rows: DataFrame, families: bool) -> DataFrame:
            own = rows.join(self.classes.select("id", "set_key", "n", "sketch"), "id")
            schema = "key long, id long, part long, set_key binary, n long, sketch binary" + (", g long, met array<long>" if families else "")
            return self.shelf.put(own.repartition("g", "i").sortWithinPartitions("g", "i").mapInArrow(_plausible(self.percent, families), schema).distinct())

        tables = [(near(rows, families), families) for rows, families in ((groups, False), (whole, True)) if rows is not None]
        links = []
        for t, families in tables:
            if not t.isEmpty():
                full = t.join(self.make_sets(t), ["id", "set_key"]).drop("id", "set_key")
                links.append(full.repartition("key").sortWithinPartitions("key").mapInArrow(_linked(self.percent, families), "u long, v long"))
        if links:
            self.merge(reduce(DataFrame.union, links))
        self.shelf.drop(*(t for t, _ in tables))

    def open_nodes(self, rows: DataFrame) -> DataFrame:
        """Nodes of several components: size, hashes of the members, and the largest component."""
        x = F.xxhash64("id")
        if self.parts is None:
            return rows.groupBy("node").agg(F.count("*").alias("size"), F.lit(1).cast("long").alias("most"), F.min("id").alias("main"), F.bit_xor(x).alias("h1"), F.bit_xor(F.xxhash64(x)).alias("h2")).where("size > 1")
        parts = rows.groupBy("node", "part").agg(F.count("*").alias("n"), F.bit_xor(x).alias("h1"), F.bit_xor(F.xxhash64(x)).alias("h2"))
        return parts.groupBy("node").agg(F.sum("n").alias("size"), F.max("n").alias("most"), F.max_by("part", "n").alias("main"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2")).where("most < size")

    def run(self) -> None:
        shelf, waiting, level = self.shelf, None, 1
        rows = self.classes.select("id", F.col("id").alias("part"), "mins").mapInArrow(_children(True), "node long, id long, part long").select("node", "id")
        shared = rows.groupBy("node").count().where("count > 1").select("node")
        rows = shelf.put(rows.join(shared, "node").withColumn("part", F.col("id")))  # the rest of the job reads these few rows
        while True:
            nodes = shelf.put(self.open_nodes(rows))
            small = nodes.where(F.col("size") <= SMALL).groupBy("size", "h1", "h2").agg(F.min("node").alias("node"))
            groups = rows.join(small.select("node"), "node").select(F.col("node").alias("g"), F.lit(0).cast("long").alias("i"), "id", "part")
            large = None
            if not nodes.where(F.col("size") > SMALL).isEmpty():
                large = rows.join(nodes.where(F.col("size") > SMALL).select("node"), "node").select("node", "id", "part")
                groups = groups.union(self.stars(large))
            self.compare(groups, waiting)
            if large is None:
                shelf.drop(nodes, waiting, rows)
                return
            large = shelf.put(self.with_parts(large.drop("part")))
            shelf.drop(nodes, waiting, rows)
            left = shelf.put(self.open_nodes(large))
            others = F.col("size") - F.col("most")
            ready = (others <= SMALL) | (F.col("size") <= MEDIUM) | F.lit(level > LEVELS)
            if left.isEmpty():
                return
            waiting = shelf.put(self.whole(large, left.where(ready)))
            mixed = large.join(left.where(~ready).groupBy("size", "h1", "h2").agg(F.min("node").alias("node")).select("node"), "node")
            if left.where(~ready).isEmpty():
                shelf.drop(large, left)
                self.compare(None, waiting)
                shelf.drop(waiting)
                return
            rows = shelf.put(self.bands(mixed) if level == 1 else mixed.join(self.classes.select("id", "mins"), "id").select("node", "id", "part", "mins").mapInArrow(_children(False), "node long, id long, part long"))
            shelf.drop(large, left)
            level += 1

    def stars(self, large: DataFrame) -> DataFrame:
        """Members of large nodes in blocks (g, i, id, part) with their node's pivot; each id in two nodes at most."""
        few = large.groupBy("id").agg(F.array_distinct(F.array(F.min("node"), F.max("node"))).alias("nodes"), F.min("part").alias("part")).select("id", "part", F.explode("nodes").alias("node"))
        of = few.groupBy("node").agg(F.ceil(F.count("*") / (SMALL - 1)).alias("blocks"), F.min_by("id", F.xxhash64("id", "node")).alias("pivot"))
        block = F.when(F.col("id") == F.col("pivot"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node", "id"), "blocks")))
        return few.join(of, "node").select(F.col("node").alias("g"), F.explode(block).alias("i"), "id", "part")

    def whole(self, large: DataFrame, nodes: DataFrame) -> DataFrame:
        """All comparisons that are open in these nodes, as groups (g, i, id, part) with all of these nodes that the id is in (met).

        A node of at most MEDIUM members is one group.  Of others with a main component the members are dealt into blocks, and those
        outside it, at most SMALL of them, go to every block.  The rest are families, whose blocks meet in pairs: members of one
        block, which have a group of their own, bear a node for it in these.  Equal nodes come once."""
        once = nodes.groupBy("size", "h1", "h2").agg(F.min("node").alias("node")).select("node").join(nodes.select("node", "size", "main", "most"), "node")
        rows = self.shelf.put(large.join(once, "node"))
        rows = rows.join(rows.groupBy("id").agg(F.sort_array(F.collect_list("node")).alias("met")), "id")
        one, main = F.col("size") <= MEDIUM, F.col("size") - F.col("most") <= SMALL
        number = F.when(one, 1).when(main, F.ceil(F.col("size") / SMALL)).otherwise(F.ceil(F.col("size") / BLOCK)).cast("long")
        rows = rows.withColumn("number", number).withColumn("block", F.pmod(F.xxhash64("id", "node"), "number"))
        zero = F.lit(0).cast("long")
        every = F.sequence(zero, F.col("number") - 1)
        alone = F.transform(F.when(one | (F.col("part") == F.col("main")), F.array("block")).otherwise(every), lambda i: F.struct(i.alias("i"), F.col("met").alias("met")))
        least = F.lit(-(1 << 63)).cast("long")
        pairs = F.transform(every, lambda c: F.struct((F.least("block", c) * F.col("number") + F.greatest("block", c)).alias("i"), F.when(c == F.col("block"), F.col("met")).otherwise(F.concat(F.array(least + F.col("block")), F.col("met"))).alias("met")))
        return rows.select(F.col("node").alias("g"), F.explode(F.when(one | main, alone).otherwise(pairs)).alias("x"), "id", "part").select("g", "x.i", "id", "part", "x.met")

    def bands(self, rows: DataFrame) -> DataFrame:
        """Children of nodes by set size: two bands for each member; sets that can be similar share one."""
        band = F.floor(F.log(F.col("n")) / (math.log(100 / self.percent) * 1.0001)) if self.percent < 100 else F.col("n")
        return rows.join(self.classes.select("id", "n"), "id").select("node", "id", "part", F.explode(F.array(band, band + 1)).alias("band")).select(F.xxhash64("node", "band").alias("node"), "id", "part")

    def result(self) -> DataFrame:
        named = self.with_parts(self.classes.select("set_key", "id", "copies")).where("copies > 1 or part <> id").select("set_key", "copies", F.col("part").alias("component_id"))
        out = join_uneven(self.signed.select(self.key, "n_shingles", "set_key"), named, "set_key", "copies", self.signed.count(), "left")
        return out.select(self.key, "n_shingles", F.coalesce("component_id", self.key).alias("component_id")).withColumn("kept", F.col(self.key) == F.col("component_id"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """key, n_shingles, component_id and kept of every row.

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets."""
    join = _Join(docs, key, text, shingle, percent)
    join.run()
    unnamed = docs.where(F.col(key).isNull()).select(key, text).mapInArrow(_counts_only(key, text, shingle), f"{key} long, n_shingles long")
    return join.result().union(unnamed.select(key, "n_shingles", F.lit(None).cast("long"), F.lit(True)))


def _counts_only(key: str, text: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch.column(text)):
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(block.first, block.n), pa.array(block_shingles(block, k)[1])], [key, "n_shingles"])

    return run


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, without those whose component has a smaller id; of rows that repeat an id one stays.
    Rows with a null id stay."""
    found = near_duplicates(docs, key, text, shingle, percent)
    gone = found.where("not kept").select(key)
    again = durable(found.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key))
    kept = docs.join(gone.distinct().hint("shuffle_hash"), key, "left_anti").select(docs.columns)
    if again.isEmpty():
        return kept
    return kept.join(again, key, "left_anti").select(docs.columns).union(kept.join(again, key).dropDuplicates([key]).select(docs.columns))
