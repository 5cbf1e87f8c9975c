"""The registered corpus queries over the tables, and the pipeline stage by stage, against plain versions."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers

import corpus_pipeline
from quire.llm import packing, quality_rules, queries, secrets
from tests.llm import brute, fixtures

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def rows_of(spark, name, sf=SMALL):
    return queries.QUERIES[name](spark, sf).collect()


def remainder(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_op1(spark, texts):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = rows_of(spark, "op1_language_id")
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    judged = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out and lang[r.doc_id] and any(map(str.isalpha, texts[r.doc_id] or ""))]
    assert len(judged) > 30 and np.mean(judged) > 0.95


@pytest.mark.parametrize("name, label, parts, part", [("op2_toxicity", "toxic", 5, 0), ("op8_quality_model", "quality", 3, 1)])
def test_classifiers_on_held_out_labels(spark, name, label, parts, part):
    known = {r.doc_id: r[label] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = rows_of(spark, name, "/root/testdata/sf0.01")
    assert all(r.held_out == (remainder(r.doc_id, parts) == part) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    judged = [(r.score, known[r.doc_id]) for r in got if r.held_out and known.get(r.doc_id) is not None]
    yes, no = np.array([s for s, y in judged if y]), np.array([s for s, y in judged if not y])
    assert len(yes) and len(no)
    assert (yes[:, None] > no[None]).mean() + 0.5 * (yes[:, None] == no[None]).mean() > 0.85


def test_op3(spark, texts):
    for r in rows_of(spark, "op3_secret_scan"):
        base, *counts = brute.secret_base(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == counts
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_op4(spark, texts):
    sets = {i: brute.shingles(t) for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = brute.components(sets, links)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows_of(spark, "op4_minhash_near_dedup")}
    assert got == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_op5(spark, texts):
    from quire.llm.bpe import read_ranks

    encode = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={}).encode_ordinary
    for r in rows_of(spark, "op5_byte_bpe"):
        text = texts[r.doc_id] or ""
        ids = np.array(encode(text), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_op6(spark):
    x = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    ids, unit = list(x), np.stack([v / np.linalg.norm(v) for v in x.values()])
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    got = {r.vec_id: r for r in rows_of(spark, "op6_embedding_near_dedup")}
    assert set(got) == set(ids)
    assert all(got[i].n_links <= linked[k].sum() for k, i in enumerate(ids))
    assert sum(r.n_links for r in got.values()) >= 0.9 * linked.sum()
    assert all(r.kept == (r.component_id == r.vec_id) for r in got.values())


def test_op7(spark, texts):
    for r in rows_of(spark, "op7_license_scan"):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.license_base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_op9(spark, texts):
    encode = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows_of(spark, "op9_packing"):
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        ids = np.array([*encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for parts in places.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_op10_counts(spark, texts):
    for r in rows_of(spark, "op10_quality_rules"):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.rule_counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_op10_rejects_bad_texts_and_keeps_its_promise(spark):
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGE}/labels.parquet").collect() if r.quality is not None}
    got = [r for r in rows_of(spark, "op10_quality_rules", LARGE) if r.doc_id in known and not r.base_failed and r.n_words >= 100]
    bad = [not r.kept for r in got if known[r.doc_id] == 0]
    good = [not r.kept for r in got if known[r.doc_id] == 1]
    assert len(bad) > 100 and np.mean(bad) > 0.9
    assert np.mean(good) <= 0.01


def awkward(spark):
    return fixtures.documents(spark)


def write_tables(docs, path):
    docs.write.parquet(f"{path}/documents.parquet")
    docs.select("doc_id").dropDuplicates().selectExpr("doc_id", "cast(doc_id % 3 <> 0 as int) quality", "0 toxic").write.parquet(f"{path}/labels.parquet")


def test_pipeline_stages(spark, tmp_path):
    """Each stage on its predecessor's rows: the filters only drop rows and keep columns, whatever the texts and names."""
    docs = awkward(spark)
    sf = str(tmp_path)
    write_tables(docs, sf)
    before, seen = docs.collect(), {}
    for name, stage in corpus_pipeline.STAGES:
        frame = spark.createDataFrame(before, docs.schema)
        out = stage(spark, frame, sf)
        rows = out.collect()
        seen[name] = (before, rows)
        if name == "packing":
            break
        assert out.columns == docs.columns and out.schema == docs.schema
        assert stage(spark, docs.limit(0), sf).count() == 0
        before = rows
    kept = [r for r in seen["quality_rules"][1]]
    failed = {r.doc_id for r in seen["quality_rules"][0] if (c := brute.rule_counts(r.text))[0] < 20 or 100 * c[4] > 30 * c[0]}
    assert kept and not failed & {r.doc_id for r in kept if r.doc_id is not None}
    source, unique = seen["near_dedup"]
    sets = {r.doc_id: brute.shingles(r.text, 5) for r in source if r.doc_id is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = brute.components(sets, links)
    assert sorted(r.doc_id for r in unique if r.doc_id is not None) == sorted(i for i in want if want[i] == i)
    assert sum(r.doc_id is None for r in unique) == sum(r.doc_id is None for r in source)
    for a, b in zip(sorted(seen["secret_scan"][0], key=str), sorted(seen["secret_scan"][1], key=str), strict=True):
        assert b.n_chars is None or b.n_chars == len(b.text)
    assert not any("AKIAABCDEFGHIJ" in r.text for r in seen["secret_scan"][1])
    pieces = defaultdict(int)
    for r in seen["packing"][1]:
        pieces[r.doc_id] += r.length
    encode = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    for r in seen["packing"][0]:
        if r.doc_id is not None:
            assert pieces[r.doc_id] == len(encode(r.text, add_special_tokens=False).ids) + 1


def test_pipeline_runs_on_the_tables(spark, texts):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in rows} <= set(texts) and rows
    assert max(r.offset + r.length for r in rows) <= 2048
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_model", "near_dedup", "secret_scan", "packing"]
    assert secrets.KINDS[0] == "assign" and quality_rules.WINDOW == 8 and packing.WINDOW > 0
