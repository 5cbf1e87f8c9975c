"""Centroid clustering against a plain version in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from quire.llm import centroids, queries
from tests.compare import connection, rows
from tests.llm import fixtures

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, v long, n long, parts int"


def plain(vectors, d, k, rounds, seed=3):
    """(id, cluster, distance, cluster inertia, inertia, sha256 of the centroid) of each kept vector."""
    kept = [(i, [centroids.quantised(x) for x in v]) for i, v in vectors if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    byhash = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in byhash[:k]]
    if not c:
        return []
    best = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), n) for n, x in enumerate(c))
    for _ in range(rounds):
        own = [best(v)[1] for _, v in kept]
        groups = [[v for (_, v), o in zip(kept, own, strict=True) if o == n] for n in range(len(c))]
        c = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c[n] for n, g in enumerate(groups)]
    got = [best(v) for _, v in kept]
    top = lambda x: min(x, 2**63 - 1)
    each = [top(sum(a for a, n in got if n == m)) for m in range(len(c))]
    return [(i, n, top(a), each[n], top(sum(x for x, _ in got)), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for (i, _), (a, n) in zip(kept, got, strict=True)]


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3, 4) for i, v in vectors], SCHEMA).repartition(3)


def compare(spark, vectors, d, k, rounds):
    got = centroids.cluster(frame(spark, vectors), d=d, k=k, rounds=rounds).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain(vectors, d, k, rounds)))
    return got


def some(seed, n, d, ties=False):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(5)]
    return [(i, [round(rng.gauss(m, 0.3), 0 if ties else 6) for m in rng.choice(middle)]) for i in range(n)]


@pytest.mark.parametrize("d, k, ties", [(64, 8, False), (20, 6, True), (5, 3, True), (3, 8, False)])
def test_equals_the_plain_version(spark, d, k, ties):
    assert len(compare(spark, some(d, 150, d, ties), d, k, 4)) == 150


def test_awkward_vectors(spark):
    good = some(9, 40, 16)
    bad = [(100, None), (101, []), (102, [1.0] * 15), (103, [1.0] * 15 + [None]), (104, [float("nan")] * 16), (105, [float("inf")] + [0.0] * 15), (106, [1.0] * 17)]
    assert len(compare(spark, good + bad + [good[0], good[0], (None, good[1][1]), (None, [0.0] * 16), (107, [-0.0] * 16)], 16, 8, 3)) == 45


def test_large_components_are_exact(spark):
    compare(spark, some(1, 30, 8) + [(50, [1e6] * 8), (51, [-1e6, 2.5e5] * 4), (52, [3e12] + [0.0] * 7), (53, [1e300] * 8), (54, [-1.7e308] * 8), (55, [65536.0] * 8)], 8, 4, 5)


def test_few_vectors(spark):
    assert centroids.cluster(frame(spark, []), d=4).collect() == []
    assert centroids.cluster(frame(spark, [(None, [1.0] * 4)]), d=4).collect() == []
    assert len(compare(spark, some(4, 3, 4), 4, 8, 2)) == 3
    assert len(compare(spark, [(i, [0.5] * 4) for i in range(12)], 4, 8, 2)) == 12


def test_abandoning_never_changes_the_nearest():
    rng = np.random.default_rng(0)
    for kind in (np.int64, object):
        x = rng.integers(-4, 4, (500, 24)).astype(kind)
        c = rng.integers(-4, 4, (7, 24)).tolist() + [x[0].tolist(), x[0].tolist()]
        full = ((x[:, None] - np.array(c, kind)[None]) ** 2).sum(2)
        own, far = centroids.nearest(x, c, rng.permutation(24))
        assert (own == full.argmin(1)).all() and (far == full.min(1)).all()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_as_sql(spark, name, sf):
    got, want = queries.QUERIES[name](spark, f"/root/testdata/{sf}"), connection(f"/root/testdata/{sf}").sql(queries.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_documents_without_vectors(spark):
    assert centroids.cluster(fixtures.empty(spark).selectExpr("doc_id vec_id", "cast(null as array<float>) embedding")).count() == 0
