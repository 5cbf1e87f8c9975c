"""Nearest rows against a plain search: ties, repeated ids, odd vectors, blocks."""

import math
import random

import pytest

from quire.operators import retrieval
from quire.operators.lines import is_heading_like
from quire.sources.readers import storage_name


def plain(vectors, queries, k, measure):
    ok = lambda v: v is not None and len(v) > 0 and all(x is not None and not math.isnan(x) for x in v)
    out = []
    for q, a in queries:
        if q is None or not ok(a):
            continue
        near = []
        for i, b in vectors:
            if i is None or i == q or not ok(b) or len(b) != len(a):
                continue
            if measure == "distance":
                near.append((sum((x - y) ** 2 for x, y in zip(a, b, strict=True)), i))
            else:
                both = math.dist(a, [0] * len(a)) * math.dist(b, [0] * len(b))
                near.append((1 - max(-1, min(1, sum(x * y for x, y in zip(a, b, strict=True)) / both)) if both else 1.0, i))
        out += [(q, i, round(s, 9), n + 1) for n, (s, i) in enumerate(sorted((round(s, 12), i) for s, i in near)[:k])]
    return sorted(out)


@pytest.mark.parametrize("measure", ["distance", "cosine"])
@pytest.mark.parametrize("block", [4000, 7])
def test_search(spark, measure, block):
    rng = random.Random(5)
    vectors = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(60)]
    vectors += [(5, [9.0, 9.0, 9.0]), (5, vectors[5][1]), (None, [1.0, 1.0, 1.0]), (70, None), (71, []), (72, [1.0, 2.0]), (73, [1.0, None, 2.0]), (74, [float("nan")] * 3), (75, [0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    queries = [v for v in vectors if v[0] is None or v[0] % 5 == 0 or v[0] > 69]
    got = retrieval.search(frame, spark.createDataFrame(queries, "vec_id long, embedding array<double>"), 4, measure, block).collect()
    unique = [v for n, v in enumerate(queries) if v[0] != 5]
    assert sorted((r.query_id, r.vec_id, round(r.score, 9), r.place) for r in got if r.query_id != 5) == plain(vectors, unique, 4, measure)
    assert not any(r.query_id == r.vec_id for r in got)


def test_small_rules(spark):
    rows = spark.createDataFrame([("漢" * 32,), ("漢" * 33,), ("Short line",), ("\n\t",)], "line string").collect()
    frame = spark.createDataFrame(rows)
    assert [r[0] for r in frame.select(is_heading_like(frame.line)).collect()] == [True, False, True, False]
    assert [r[0] for r in spark.createDataFrame([("\t\n a.PDF",), (" \n ",)], "n string").select(storage_name(retrieval.F.col("n"))).collect()] == ["a", "default"]


def test_hit_records(spark):
    hits = spark.createDataFrame([(1, p, v, p / 10) for p, v in enumerate([5, 6, 7, 8, 9, 10], 1)] + [(2, 1, 99, 0.0)], "query_id long, place long, vec_id long, score double")
    records = spark.createDataFrame([(5, "One text", "a"), (6, " One\ntext ", "b"), (8, None, "c"), (9, None, "d"), (10, "other", "e"), (10, "another", "f")], "vec_id long, text string, rank string")
    got = retrieval.hit_records(hits, records.withColumnRenamed("rank", "source")).orderBy("rank").collect()
    assert [(r.vec_id, r.rank, r.source) for r in got] == [(5, 1, "a"), (8, 2, "c"), (9, 3, "d"), (10, 4, "f")]
    assert retrieval.hit_records(hits.limit(0), records.drop("rank")).count() == 0
