"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

1. On a bounded sample, iterative quantisation learns rotations whose signs are binary codes close to
   the centred vectors.  Every vector gets one code from all rotations together: the signs of the vector
   itself, as centring would widen the angles of vectors that share a component.
2. Equal vectors form a class; only classes go on, with the number of their copies.
3. The code is cut into substrings, one table each.  Two vectors meet where a substring differs in at
   most one bit.  Substrings have about log2(rows) bits, so that a bucket holds about one vector at
   any size.  There are as many tables as find pairs at the threshold around sampled vectors, and near
   pairs of the sample, with probability `target`; vectors with a large common component meet more often.
4. Buckets that neighbour each other are compared in blocks of bounded size: first by codes, which keeps the few
   vectors that have a plausible partner, then those by their original vectors in double precision.  A pair is
   counted in the first table in which it meets.

A block returns sums for each vector and a forest of its links, so no pairs of a group are emitted.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows with a
null id, link with nothing; each length is joined on its own; repeated rows are
vectors of their own; an empty table gives an empty result.  Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.cluster import Shelf, first_by_hash
from quire.llm.components import components
from quire.llm.near_dedup import matrix

BLOCK = 512


@dataclass
class Codes:
    """Projections to code bits, and how the code is cut into tables."""

    projection: np.ndarray
    bits: int
    tables: int
    radius: int

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """keys[vector, table]: substrings of the codes of unit vectors."""
        signs = (unit @ self.projection > 0)[:, : self.bits * self.tables]
        return signs.reshape(len(unit), self.tables, self.bits) @ (1 << np.arange(self.bits, dtype=np.int64))


def learn_rotation(x: np.ndarray, seed: int, rounds: int = 40) -> np.ndarray:
    """Orthogonal R that brings sign(x R) and x R close: codes and rotation are fitted in turn."""
    d = x.shape[1]
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(x.T @ np.where(x @ r > 0, 1.0, -1.0))
        r = u @ v
    return r


def trial_pairs(sample: np.ndarray, cosine: float, some: int = 4000) -> list[tuple[np.ndarray, np.ndarray]]:
    """Kinds of pairs that must be found: at the threshold around sampled vectors, with partners in any
    direction and towards other vectors; and near pairs of the sample, real and at the threshold around them."""
    rng = np.random.default_rng(0)

    def beside(x: np.ndarray, way: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        way = way - (way * x).sum(1, keepdims=True) * x
        size = np.linalg.norm(way, axis=1)
        x, way = x[size > 1e-6], way[size > 1e-6] / size[size > 1e-6, None]
        return x, cosine * x + math.sqrt(1 - cosine * cosine) * way

    x = sample[rng.permutation(len(sample))[:some]]
    out = [beside(x, rng.normal(size=x.shape)), beside(x, sample[rng.integers(0, len(sample), len(x))])]
    alike = x[:2000] @ sample.T
    i, j = np.nonzero((alike >= cosine) & (alike < 1 - 1e-9))
    few = rng.permutation(len(i))[: 5 * some]
    near, other = x[i[few]], sample[j[few]]
    out += [(near, other), beside(near, other), beside(near, rng.normal(size=near.shape))]
    return [pair for pair in out if len(pair[0])]


def fit_codes(sample: np.ndarray, rows: int, cosine: float, target: float = 0.95) -> Codes:
    """Codes for `rows` vectors from a sample of unit vectors; tables are added until the sample's trial
    pairs are found.  Rotations past those that theory asks for are random."""
    bits = min(32, max(8, math.ceil(math.log2(max(rows, 2)))))
    flip = math.acos(cosine) / math.pi
    meet = (1 - flip) ** bits + bits * flip * (1 - flip) ** (bits - 1)
    tables = math.ceil(math.log(1 - target) / math.log(1 - meet))
    centred = sample - sample.mean(0)
    axes = np.linalg.svd(centred.T @ centred)[0]
    learned = math.ceil(bits * tables / sample.shape[1])
    rotations = [axes @ learn_rotation(centred @ axes, i) for i in range(learned)]
    trials = trial_pairs(sample, cosine)
    while True:
        while len(rotations) * sample.shape[1] < bits * tables:
            rotations.append(learn_rotation(centred, len(rotations), 0))
        codes = Codes(np.concatenate(rotations, 1), bits, tables, 0)
        apart = [np.bitwise_count(codes.keys(x) ^ codes.keys(y)) for x, y in trials]
        if all((a <= 1).any(1).mean() >= target for a in apart):
            break
        tables += 1
    n = bits * tables
    # four standard deviations over the mean number of flips at the threshold, and no trial pair is beyond
    codes.radius = max([math.floor(n * flip + 4 * math.sqrt(n * flip * (1 - flip)) + 1), *(int(a.sum(1, dtype=np.int64).max()) for a in apart)])
    return codes


def unit_vectors(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column are usable vectors of this size; those as unit vectors."""
    lengths = column.value_lengths().fill_null(-1).to_numpy()
    usable = lengths == size
    flat = column.filter(pa.array(usable)).flatten()
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
    with np.errstate(all="ignore"):
        x = x / np.abs(x).max(1, keepdims=True, initial=0)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
    good = np.isfinite(x).all(1)
    usable[usable] = good
    return usable, x[good]


def _encoded(codes: Codes, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, unit = unit_vectors(batch.column("vector"), size)
            keys = codes.keys(unit) if len(unit) else np.zeros((0, codes.tables), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(usable)), pa.array([x.tobytes() for x in unit], pa.binary()), pa.array([x.tobytes() for x in keys], pa.binary())], ["id", "unit", "code"])

    return run


def _entries(tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                keys = matrix(batch.column("code"), np.int64)
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables), n)), pa.array(keys.ravel()), pa.array(np.repeat(batch.column("id").to_numpy(), tables)), batch.column("code").take(pa.array(np.repeat(np.arange(n), tables)))], ["t", "key", "id", "code"])

    return run


def _meeting(x: np.ndarray, y: np.ndarray, table: int, radius: int) -> np.ndarray:
    """Which codes of x and y meet first in this table and are near enough."""
    total = np.zeros((len(x), len(y)), np.int16)
    ok = np.ones((len(x), len(y)), bool)
    for t in range(x.shape[1]):
        apart = np.bitwise_count(x[:, t, None] ^ y[None, :, t])
        total += apart
        if t < table:
            ok &= apart > 1
        elif t == table:
            ok &= apart <= 1
    return ok & (total <= radius)


def _groups(batch: pa.RecordBatch):
    """Each block pair of a batch: its table, whether it is a block with itself, and its members."""
    members = batch.column("members")
    ends = members.offsets.to_numpy()
    flat = members.flatten()
    fields = {k.name: flat.field(i) for i, k in enumerate(flat.type)}
    code = matrix(fields["code"], np.int64)
    for i, (a, b) in enumerate(zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True)):
        yield i, batch.column("t")[i].as_py(), batch.column("alone")[i].as_py(), a, b, fields, code


def _meet(side: np.ndarray, code: np.ndarray, t: int, alone: bool, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.flatnonzero(side == 0)
    y = x if alone else np.flatnonzero(side == 1)
    met = _meeting(code[x], code[y], t, radius)
    return x, y, np.triu(met, 1) if alone else met


def _plausible(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, side_, id_ = [], [], []
            for i, t, alone, a, b, fields, code in _groups(batch):
                side, ids = fields["side"][a:b].to_numpy(), fields["id"][a:b].to_numpy()
                x, y, met = _meet(side, code[a:b], t, alone, radius)
                keep = np.unique(np.concatenate((x[met.any(1)], y[met.any(0)])))
                row += [i] * len(keep)
                side_.append(side[keep])
                id_.append(ids[keep])
            if row:
                own = batch.select(["t", "k1", "k2", "i", "j", "alone"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.concatenate(side_)), pa.array(np.concatenate(id_))], [*own.schema.names, "side", "id"])

    return run


def _linked(radius: int, cosine: float):
    """For each member of a block pair with links: its links' copies, and the smallest id of its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, t, alone, a, b, fields, code in _groups(batch):
                side, ids, copies = (fields[k][a:b].to_numpy() for k in ("side", "id", "copies"))
                unit = matrix(fields["unit"][a:b], np.float64)
                x, y, met = _meet(side, code[a:b], t, alone, radius)
                met &= unit[x] @ unit[y].T >= cosine
                if not met.any():
                    continue
                n = np.zeros(b - a, np.int64)
                n[x] += met @ copies[y]
                n[y] += copies[x] @ met
                label, before = ids.copy(), None
                far = np.iinfo(np.int64).max
                while before is None or (label != before).any():
                    before = label.copy()
                    np.minimum.at(label, x, np.where(met, label[y][None], far).min(1))
                    np.minimum.at(label, y, np.where(met, label[x][:, None], far).min(0))
                some = n > 0
                found.append((ids[some], n[some], label[some]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["u", "n", "v"])

    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, sample_rows: int = 20_000) -> DataFrame:
    """key, n_links, component_id and kept of every row.

    sample_rows bounds the samples, in the order of a hash of the id, that the rotations are learned from."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    lengths = rows.where("id is not null and size(vector) > 0").groupBy(F.size("vector").alias("size")).count().where("count > 1").collect()
    joined = F.coalesce(F.col("id").isNotNull() & F.size("vector").isin([r["size"] for r in lengths]), F.lit(False))
    out = rows.where(~joined).select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    for size, n in sorted(lengths):
        out = out.union(_of_one_length(rows.where(joined & (F.size("vector") == size)), size, n, key, cosine, sample_rows))
    return out


def _of_one_length(named: DataFrame, size: int, n: int, key: str, cosine: float, sample_rows: int) -> DataFrame:
    drawn = first_by_hash(named, "id", sample_rows).select("vector").toArrow().column("vector").combine_chunks()
    sample = unit_vectors(drawn, size)[1]
    if not len(sample):
        sample = np.linalg.qr(np.random.default_rng(0).normal(size=(size, size)))[0]
    codes = fit_codes(sample, n, cosine)

    shelf = Shelf(named.sparkSession)
    durable = shelf.put
    encoded = durable(named.mapInArrow(_encoded(codes, size), "id long, unit binary, code binary"))
    classes = durable(encoded.groupBy("unit").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.max("code").alias("code")))
    entries = classes.select("id", "code").mapInArrow(_entries(codes.tables), "t long, key long, id long, code binary")
    entries = durable(entries)
    buckets = durable(entries.groupBy("t", "key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")))
    entries = entries.join(buckets, ["t", "key"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << b).cast("long") for b in range(codes.bits)))
    near = buckets.select("t", F.col("key").alias("k1"), F.col("blocks").alias("n1"), F.explode(F.transform(flips, lambda f: F.col("key").bitwiseXOR(f))).alias("k2")).where("k1 <= k2")
    near = near.join(buckets.select("t", F.col("key").alias("k2"), F.col("blocks").alias("n2")), ["t", "k2"])
    pairs = near.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n1") - 1)).alias("i")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n2") - 1)).alias("j")).where("k1 < k2 or i <= j")
    by = ["t", "k1", "k2", "i", "j", "alone"]
    pairs = durable(pairs.select("t", "k1", "k2", "i", "j", F.expr("k1 = k2 and i = j").alias("alone")))
    sides = [pairs.withColumns({"key": F.col("k1"), "block": F.col("i"), "side": F.lit(0)}), pairs.where("not alone").withColumns({"key": F.col("k2"), "block": F.col("j"), "side": F.lit(1)})]
    met = sides[0].union(sides[1]).join(entries, ["t", "key", "block"])
    groups = met.groupBy(*by).agg(F.collect_list(F.struct("side", "id", "code")).alias("members")).where(F.size("members") > 1)
    plausible = durable(groups.mapInArrow(_plausible(codes.radius), "t long, k1 long, k2 long, i long, j long, alone boolean, side int, id long"))
    full = plausible.join(classes, "id").groupBy(*by).agg(F.collect_list(F.struct("side", "id", "code", "copies", "unit")).alias("members"))
    linked = durable(full.mapInArrow(_linked(codes.radius, cosine), "u long, n long, v long"))

    counts = linked.groupBy("u").agg(F.sum("n").alias("n"))
    parts = components(linked.select("u", "v"), shelf)
    named_classes = classes.join(counts, classes["id"] == counts["u"], "left").join(parts, classes["id"] == parts["node"], "left").select("unit", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    good = encoded.select("id", "unit").join(named_classes, "unit").select(F.col("id").alias(key), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    other = named.mapInArrow(_unusable(size), "id long")
    return good.union(other.select(F.col("id").alias(key), F.lit(0).cast("long"), F.col("id"), F.lit(True)))


def _unusable(size: int):
    """Ids of the rows that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, _ = unit_vectors(batch.column("vector"), size)
            usable &= batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(~usable))], ["id"])

    return run
