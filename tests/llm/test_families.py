"""Near-duplicates within families of texts that share most of their words and yet are no links."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import near_dedup
from tests.llm import brute


def family(n, shared, seed=1, words=60):
    rng = random.Random(seed)
    head = [f"t{i}" for i in range(shared)]
    rows = [(i, " ".join(head + [f"w{rng.randrange(10**6)}" for _ in range(words - shared)])) for i in range(n)]
    return rows + [(n + i, rows[i][1].rsplit(" ", 1)[0] + " end") for i in range(0, n, 17)]


@pytest.mark.parametrize("small, medium, block", [(4, 12, 6), (8, 40, 20), (8, 4096, 2048)])
def test_equals_brute_force_whatever_the_limits(spark, monkeypatch, small, medium, block):
    """Small limits, so that nodes are dealt, branch and are compared in blocks that meet in pairs."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "MEDIUM", medium)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = family(80, 48) + [(1000 + i, t) for i, t in family(40, 30, 2)] + [(2000, "alone here"), (2001, None)]
    sets = {i: brute.shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = brute.components(sets, links)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shingle=4).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(links) >= 7


def test_full_sets_are_made_only_of_texts_that_look_similar_to_others(spark, monkeypatch):
    """Members of large nodes share words and are no links; sets of theirs would be written and shuffled for nothing."""
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    asked, make = set(), near_dedup._Join.make_sets
    monkeypatch.setattr(near_dedup._Join, "make_sets", lambda self, ids: asked.update(r.id for r in ids.select("id").collect()) or make(self, ids))
    rows = [r for r in family(40, 30, 2) if r[0] < 40] + [(100, " ".join(f"x{i}" for i in range(60))), (101, " ".join(f"x{i}" for i in range(58)))] * 2
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shingle=4).collect()
    assert asked == {100, 101} and sorted(r.doc_id for r in got if not r.kept) == [101, 101] and len(got) == 44


def test_pairs_are_compared_in_the_first_node_in_which_they_meet():
    met = pa.array([[1, 5, 9], [5, 9], [1, 9], [9], [-7, 9], [-7, 9]], pa.list_(pa.int64()))
    pairs = lambda node: None if (e := near_dedup._incidence(node, met)) is None else {(i, j) for i, j in zip(*np.nonzero(np.triu(e @ e.T, 1)), strict=True)}
    assert pairs(9) == {(0, 1), (0, 2), (4, 5)}
    assert pairs(5) == {(0, 2), (4, 5)} and pairs(1) == {(4, 5)} and near_dedup._incidence(-7, met) is None
    assert near_dedup._incidence(9, met.slice(3, 1)) is None


def test_products_count_intersections_exactly():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 40, 200, np.uint64)
    sets = [np.unique(np.concatenate((base[: rng.integers(150, 200)], rng.integers(0, 1 << 40, 20, np.uint64)))) for _ in range(30)]
    n = np.array(list(map(len, sets)))
    links = {(i, j) for i in range(30) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    got = near_dedup.products(np.arange(30), n, near_dedup.common(sets), 80, None)
    assert brute.components(range(30), got) == brute.components(range(30), links)


def test_sample_cuts_windows_out_of_long_texts(spark):
    from quire.llm.cluster import bounded_sample

    rows = [(i, "".join(chr(97 + (i + k) % 26) for k in range(500)) if i % 2 else None if i % 4 else "short") for i in range(400)]
    got = bounded_sample(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", 150, 40).collect()
    texts = dict(rows)
    assert len(got) == 150 and all(r.text in texts[r.doc_id] and len(r.text) == min(40, len(texts[r.doc_id])) for r in got)
    assert len({texts[r.doc_id].index(r.text) for r in got if r.doc_id % 2}) > 5
    assert bounded_sample(spark.createDataFrame(rows, "doc_id long, text string").limit(0), "doc_id", 5, 5).count() == 0
