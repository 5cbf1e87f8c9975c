"""Committed tables: versions, conflicts, guards, updates by field, and builds of what changed."""

import pytest
from pyspark.sql import functions as F

from quire.operators import structure
from quire.plans.queries import titled
from quire.sources import store

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark, tmp_path):
    return store.Store(spark, str(tmp_path / "store"), buckets=8)


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, part long, a string, b string")


def held(tables, version=None):
    got = tables.read("t", version)
    return sorted((r.doc_id, r.part, r.a, r.b) for r in got.collect())


def test_versions_stay_readable(spark, tables):
    assert tables.manifest().version == 0 and tables.read("t") is None
    tables.put("t", rows(spark, [(i, 0, "x", None) for i in range(20)]), ["doc_id", "part"])
    before = tables.read("t")
    assert tables.update("t", rows(spark, [(3, 0, "y", "z"), (50, 1, "n", None)]), ["doc_id", "part"]) == 2
    assert before.count() == 20 and {r.a for r in before.collect()} == {"x"}
    assert len(held(tables, 1)) == 20 and (3, 0, "y", "z") in held(tables) and len(held(tables)) == 21
    touched = [b for b, f in tables.manifest(1).folders("t").items() if tables.manifest(2).folders("t")[b] != f]
    assert 0 < len(touched) <= 2


def test_update_of_one_field_keeps_the_other(spark, tables):
    keys = ["doc_id", "part"]
    tables.put("t", rows(spark, [(1, 0, "s", None), (2, 0, None, "q")]), keys)
    tables.update("t", rows(spark, [(1, 0, None, "quiz"), (2, 0, None, None), (3, 0, None, "new")]), keys, fields=["b"])
    assert held(tables) == [(1, 0, "s", "quiz"), (2, 0, None, None), (3, 0, None, "new")]
    assert tables.update("t", rows(spark, []), keys) == 2


def test_rules_stop_a_change(spark, tables):
    keys = ["doc_id", "part"]
    tables.put("t", rows(spark, [(1, 0, "s", None)]), keys)
    with pytest.raises(store.Violation, match="'n': 2"):
        tables.update("t", rows(spark, [(2, 0, "a", None), (2, 0, "b", None)]), keys)
    with pytest.raises(store.Violation, match="unknown"):
        tables.update("t", rows(spark, [(9, 0, "a", None)]), keys, must_exist=True)
    with pytest.raises(store.Violation, match="bad"):
        tables.update("t", rows(spark, [(1, 0, "bad", None)]), keys, guards=(lambda r: r.where("a = 'bad'"),))
    with pytest.raises(store.Violation, match="outside"):
        tables.commit(tables.manifest(), {"t": (rows(spark, [(i, 0, "s", None) for i in range(40)]), [0])})
    assert tables.versions() == [1] and held(tables) == [(1, 0, "s", None)]


def test_a_writer_that_dies_leaves_the_last_version(spark, tables, monkeypatch):
    keys = ["doc_id", "part"]
    tables.put("t", rows(spark, [(i, 0, "s", None) for i in range(10)]), keys)
    want = held(tables)

    def die(manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(tables, "_publish", die)
        with pytest.raises(KeyboardInterrupt):
            tables.update("t", rows(spark, [(1, 0, "lost", None)]), keys)
    assert held(tables) == want and tables.versions() == [1]
    tables.update("t", rows(spark, [(1, 0, "kept", None)]), keys)
    assert (1, 0, "kept", None) in held(tables)
    tables.vacuum(keep=1)
    assert (1, 0, "kept", None) in held(tables) and tables.versions() == [2]
    used = {f.rsplit("/", 2)[1] for f in tables.manifest().folders("t").values()}
    assert set(tables._names(f"{tables.path}/data")) == used


def test_two_writers(spark, tables):
    keys = ["doc_id", "part"]
    tables.put("t", rows(spark, [(i, 0, "s", None) for i in range(30)]), keys)
    base = tables.manifest()
    by_bucket = {r.doc_id: r.b for r in rows(spark, [(i, 0, "s", None) for i in range(30)]).select("doc_id", tables.bucket().alias("b")).collect()}
    one = 0
    same = next(i for i in by_bucket if i != one and by_bucket[i] == by_bucket[one])
    other = next(i for i in by_bucket if by_bucket[i] != by_bucket[one])
    tables.update("t", rows(spark, [(one, 0, "first", None)]), keys, base=base)
    assert tables.update("t", rows(spark, [(other, 0, "second", None)]), keys, base=base) == 3
    with pytest.raises(store.Conflict):
        tables.update("t", rows(spark, [(same, 0, "third", None)]), keys, base=base)
    got = {r[0]: r[2] for r in held(tables)}
    assert (got[one], got[other], got[same]) == ("first", "second", "s")


def test_a_version_is_published_once(tables):
    assert tables._publish(store.Manifest(1, {}))
    assert not tables._publish(store.Manifest(1, {"t": {}}))
    assert tables.manifest(1).tables == {} and tables.versions() == [1]


def build(docs):
    return {"sections": structure.chapters(structure.sections(docs))}


def test_builds_touch_only_what_changed(spark, tmp_path):
    tables = store.Store(spark, str(tmp_path / "built"), buckets=32)
    docs = titled(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang"))
    ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert store.refresh(tables, docs, build)["built"] == len(ids)
    assert store.refresh(tables, docs, build) == {"built": 0, "failed": 0, "dropped": 0, "buckets": 0} and tables.versions() == [1]
    some = ids[:: len(ids) // 10][:10]  # 5 %
    edited = docs.withColumn("text", F.when(F.col("doc_id").isin(some), F.concat(F.lit("Chapter 1\nNew words.\n"), "text")).otherwise(F.col("text"))).where(F.col("doc_id") != ids[-1])
    counts = store.refresh(tables, edited, build)
    assert (counts["built"], counts["dropped"]) == (10, 1) and counts["buckets"] <= 11
    first, second = tables.manifest(1).folders("sections"), tables.manifest(2).folders("sections")
    assert sum(first.get(b) != second.get(b) for b in map(str, range(32))) <= 11
    want = build(edited)["sections"]
    got = tables.read("sections").select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert store.refresh(tables, edited, build, force=True)["built"] == len(ids) - 1
    assert store.refresh(tables, edited, build, settings="other rules")["built"] == len(ids) - 1


def test_a_failed_build_keeps_what_is_stored(spark, tmp_path):
    tables = store.Store(spark, str(tmp_path / "built"), buckets=4)
    docs = lambda texts: spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")
    run = lambda d, **more: store.refresh(tables, d, lambda x: {"sections": x.select("doc_id", "text")}, store.unready(d, ["en"]), **more)
    read = lambda: {r.doc_id: r.text for r in tables.read("sections").collect()}
    run(docs({1: "one", 2: "two", 3: None}))
    assert read() == {1: "one", 2: "two"}
    assert [(r.doc_id, r.reason) for r in tables.read("failures").collect()] == [(3, "missing_raw_text")]
    assert run(docs({1: " ", 2: "two", 3: None})) == {"built": 0, "failed": 1, "dropped": 0, "buckets": 1}
    assert read() == {1: "one", 2: "two"}
    assert run(docs({1: " ", 2: "two", 3: None}))["buckets"] == 0
    run(docs({1: "new", 2: "two", 3: "three"}))
    assert read() == {1: "new", 2: "two", 3: "three"} and tables.read("failures").count() == 0
    run(docs({2: "two"}))
    assert read() == {2: "two"}
    with pytest.raises(store.Violation, match="more than once"):
        run(docs({2: "x"}).union(docs({2: "y"})))
    assert run(docs({2: "two"}).limit(0))["dropped"] == 1 and read() == {}
