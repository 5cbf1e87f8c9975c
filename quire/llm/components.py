"""Connected components by alternating stars over forests of each partition's links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.cluster import Shelf, join_uneven

#: Links in a partition; a partition's forest takes some tens of MB.
PART_LINKS = 250_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of links and the smallest node of each one's component."""
    nodes, place = np.unique(np.concatenate((u, v)), return_inverse=True)
    u, v = np.split(place, 2)
    root = np.arange(len(nodes))
    while len(u):
        x, y = root[u], root[v]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
        open_ = root[u] != root[v]
        u, v = u[open_], v[open_]
    return nodes, nodes[root]


def _forest(loops: bool, names: tuple[str, str] = ("u", "v")):
    """Stars around the smallest node of each component of a partition's own links, with the links
    of those smallest nodes to themselves if loops is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
        if got:
            node, root = stars(*(np.concatenate(x) for x in zip(*got, strict=True)))
            own = loops | (node != root)
            yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(root[own])], list(names))

    return run


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, shelf: Shelf) -> DataFrame:
    """node, component (the smallest node reachable) for every node of the links (u, v).

    Up to PART_LINKS links are one task's work.  More are reduced to stars within each partition; then, each
    round, large stars link each node's larger neighbours to its smallest one and small stars its smaller
    neighbours; this ends with stars around each component's smallest node after a logarithmic number
    of rounds.  The number of links never grows, a node's minimum is aggregated before the shuffle,
    and only two numbers come to the driver each round.  Loops and nulls are passed over; an empty
    table gives an empty result."""
    links = shelf.put(edges.where("u <> v").select("u", "v"))
    n = links.count()
    if n <= PART_LINKS:
        return links.coalesce(1).mapInArrow(_forest(True, ("node", "component")), "node long, component long") if n else links.toDF("node", "component")
    forest = lambda df: df.mapInArrow(_forest(False), "u long, v long").distinct()
    links = shelf.put(forest(links.repartition(-(-n // PART_LINKS), "v")))
    before = _state(links)
    while before[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c"))
        large = join_uneven(both.where("v > u"), least, "u", "c", before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        small = join_uneven(large, least, "u", "c", before[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = shelf.put(forest(small.union(least.select("u", F.col("m").alias("v")))))
        now = _state(new)
        shelf.drop(links)
        links = new
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v").distinct())
