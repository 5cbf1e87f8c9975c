"""Files of id planes: round trips, and the registered query against the tokenizers library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import id_planes, queries
from tests.llm import fixtures

JSON = public_tokenizers.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"
ODD = ["a\x1cb\x1fc", "x\x85y\xa0z w　v", "é ́e", "İstanbul ΣΑΣ ſs", "it's we'll 'S  I'M", "<|endoftext|> a<|startoftext|>b", "\0", "a\0b \0 c", "  lead and trail \n\n", "١٢٣ ½ 漢字", "᠎﻿​- "]


@pytest.fixture(scope="module")
def library():
    encode = tokenizers.Tokenizer.from_file(JSON).encode
    return lambda text: [*encode(text or "", add_special_tokens=False).ids, 2]


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=70), st.sampled_from([id_planes.BITS, id_planes.BYTES]))
def test_planes_round_trip(ids, kind):
    ids = np.array(ids, "<u4")
    assert (id_planes.ids_of(id_planes.planes_of(ids, kind), kind, len(ids)) == ids).all()


def test_only_needed_planes():
    assert len(id_planes.planes_of(np.array([0, 1000], "<u4"), id_planes.BITS)) == 10
    assert len(id_planes.planes_of(np.array([0, 70000], "<u4"), id_planes.BYTES)) == 3


def test_pieces_give_the_ids_of_whole_texts(library, monkeypatch):
    encoder = id_planes.PieceEncoder(JSON)
    rng = random.Random(5)
    some = "aAéß ’'sS\t\n\x0b\x1d\x85́ẞ漢🙂0½.,!-<|>\0 "
    texts = ODD + ["".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += [f"Écoute,{x} ÉTÉ. {x}, straße.. Ÿ, ÿ×, a÷. b.,{x} {x.upper()}." for x in ("a", "Z", "é", "0", "'", "ı", "İ", "ﬁ")]
    monkeypatch.setattr(id_planes, "KNOWN", 50)
    for _ in range(3):  # tables turn over meanwhile
        rng.shuffle(texts)
        for at in range(0, len(texts), 25):
            ids, ends = encoder(pa.array(["skipped", *texts[at : at + 25]]).slice(1))
            for text, low, high in zip(texts[at : at + 25], ends, ends[1:], strict=False):
                assert ids[low:high].tolist() == library(text)[:-1], repr(text)


def expected(rows, library):
    """start, n_tokens and crc32 by key; rows are (key, text), in order."""
    at, out = 0, []
    for key, text in rows:
        ids = np.array(library(text), "<u4")
        out.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op11_id_planes(spark, SMALL).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == expected(sorted((r.doc_id, r.text) for r in docs), library)


def test_awkward_rows(spark, library, tmp_path):
    docs = fixtures.documents(spark, ODD)
    for block in (id_planes.BLOCK, 64):
        path = str(tmp_path / str(block))
        id_planes.write(id_planes.ordered(docs), path, JSON, block=block)
        rows = sorted(id_planes.read(spark, path).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in rows] == sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is not None, i or 0))
        at = 0
        for r in rows:
            assert r.start == at and r.n_tokens == len(r.ids) // 4
            at += r.n_tokens
        want = sorted((str(r.doc_id), np.array(library(r.text), "<u4").tobytes()) for r in docs.collect())
        assert sorted((str(r.doc_id), bytes(r.ids)) for r in rows) == want
        whole = np.frombuffer(b"".join(bytes(r.ids) for r in rows), "<u4")
        for start, n in ((0, 10), (at // 2, 5000), (at - 3, 50), (at, 4), (7, 0)):
            assert (id_planes.ids_between(path, start, n) == whole[start : start + n]).all()


def test_blocks_span_documents(tmp_path):
    store, _ = id_planes.open_store(str(tmp_path))
    file = id_planes.FileWriter(store, str(tmp_path / "one"), 8)
    docs = [np.arange(n, dtype="<u4") * 999 for n in (1, 30, 0, 5, 8, 16)]
    for i, d in enumerate(docs):
        file.add(pa.array([i]), np.array([len(d)]), d)
    file.close()
    back = id_planes.FileReader(store, str(tmp_path / "one"))
    assert (np.concatenate([back.block(k) for k in range(len(back.blocks))]) == np.concatenate(docs)).all()
    assert back.counts.tolist() == [1, 30, 0, 5, 8, 16] and back.blocks[:, 1].tolist() == [8] * 7 + [4]


def test_empty_table_and_second_write(spark, tmp_path):
    path = str(tmp_path / "ids")
    empty = id_planes.encode(id_planes.ordered(fixtures.empty(spark)), JSON)
    id_planes.write(empty, path)
    assert id_planes.manifest_of(path) == [] and id_planes.read(spark, path).collect() == []
    with pytest.raises(Exception, match="has ids already"):
        id_planes.write(empty, path)


def test_damage_is_seen(spark, tmp_path):
    path = str(tmp_path / "ids")
    id_planes.write(spark.createDataFrame([(1, np.arange(5000, dtype="<u4").tobytes())], "doc_id long, ids binary").coalesce(1), path)
    file = tmp_path / "ids" / id_planes.manifest_of(path)[0]["name"]
    raw = bytearray(file.read_bytes())
    raw[40] ^= 1
    file.write_bytes(raw)
    with pytest.raises(Exception):
        id_planes.read(spark, path).collect()
    file.write_bytes(raw[:-1])
    with pytest.raises(Exception):
        id_planes.read(spark, path).collect()
