"""The corpus operators on awkward tables, against plain versions."""

import base64
import math
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import tokenizers

from quire.llm import bpe, components, embedding_dedup, language_id, licenses, near_dedup, packing, quality_model, quality_rules, secrets, toxicity
from quire.llm import textblock as tb
from quire.llm.cluster import Shelf
from tests.llm import brute, fixtures

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SPECIAL = packing.special_tokens(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def docs(spark):
    return fixtures.documents(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return fixtures.empty(spark)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def same(got, want):
    assert Counter(map(repr, got)) == Counter(map(repr, want))


def test_quality_rules(docs, empty, rows):
    cutoffs = np.full((len(quality_rules.STRATA) + 1, len(quality_rules.STATISTICS)), np.inf)
    got = [tuple(r)[:7] for r in quality_rules.judge(docs, cutoffs).collect()]
    same(got, [(i, *(c := brute.rule_counts(t)), c[0] < 20 or 100 * c[4] > 30 * c[0]) for i, t in rows])
    assert quality_rules.judge(empty, cutoffs).count() == 0
    kept = quality_rules.keep_good(docs, cutoffs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r[6] for r in got)


def test_binomial_tail_is_exact():
    from math import comb

    for k, n, p in ((0, 10, 0.1), (3, 20, 0.2), (20, 20, 0.5)):
        assert quality_rules.binomial_tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_cutoffs_keep_their_promise():
    rng = np.random.default_rng(0)
    wrong = []
    for _ in range(40):
        good, bad = rng.normal(10, 1, (3000, 2)), rng.normal(14, 1, (500, 2))
        cut = quality_rules.controlled_cutoffs(np.concatenate((good, bad)), np.full(3500, 50), np.arange(3500) < 3000, rng.random(3500) < 0.25, 0.05, 0.05)[1]
        wrong.append((rng.normal(10, 1, (20000, 2)) > cut).any(1).mean())
        assert np.isfinite(cut).any()
        assert (bad > cut).any(1).mean() > 0.5
    assert np.mean(np.array(wrong) > 0.05) <= 0.1


def test_few_labels_prove_nothing():
    assert np.isinf(quality_rules.controlled_cutoffs(np.arange(20.0)[:, None], np.full(20, 50), np.arange(20) < 10, np.arange(20) % 4 == 0, 0.01, 0.05)).all()


def test_chain_of_rules_is_nested_and_counted():
    rng = np.random.default_rng(2)
    values, words, good = rng.random((4000, 3)) ** 3, rng.integers(20, 900, 4000), rng.random(4000) < 0.8
    values[~good, 1] += 0.5
    chains = quality_rules.rule_chains(quality_rules.histogram(values, words, good), 3)
    stratum = np.searchsorted(quality_rules.STRATA, words, "right")
    first = quality_rules.first_rules(values, stratum, chains)
    assert len(chains[0]) == 0 and all(len(c) for c in chains[1:])
    for chain in chains[1:]:
        assert (np.diff(chain, axis=0)[np.isfinite(chain[:-1])] <= 0).all()
    for i in range(0, 4000, 37):
        chain = chains[stratum[i]]
        assert first[i] == next((r for r in range(len(chain)) if (values[i] > chain[r]).any()), len(chain))


def test_cutoffs_use_all_labels(spark, empty):
    """A stratum's good labels suffice only if none is left out for the labels of other texts."""
    line = "array_join(transform(sequence(1, 30), i -> concat('w', i)), ' ')"
    text = f"CASE WHEN doc_id < 6000 THEN {line} WHEN doc_id < 6400 THEN concat({line}, repeat(' #', 8 + doc_id % 5)) ELSE 'short' END"
    docs = spark.range(30000).selectExpr("id AS doc_id").selectExpr("doc_id", f"{text} AS text")
    labels = docs.selectExpr("doc_id", "cast(doc_id < 6000 OR doc_id >= 6400 AS int) AS quality")
    cutoffs = quality_rules.fit_cutoffs(docs, labels)
    marks = [quality_rules.STATISTICS.index(k) for k in ("symbol_share", "mark_share")]
    assert 0 < cutoffs[1, marks].min() < 0.1
    assert np.isinf(cutoffs[[0, 2, 3]]).all()
    assert np.isinf(quality_rules.fit_cutoffs(empty.select("doc_id", "text"), labels)).all()


def test_cells_hold_every_count():
    rng = np.random.default_rng(1)
    values, words, good = rng.random((5000, 3)) ** 4, rng.integers(0, 900, 5000), rng.random(5000) < 0.7
    exact, coarse = quality_rules.histogram(values, words, good), quality_rules.histogram(values, words, good, quality_rules.cells(values))
    assert exact["good"].sum() == coarse["good"].sum() == 3 * good.sum()
    assert exact["bad"].sum() == coarse["bad"].sum() == 3 * (~good).sum()
    assert (coarse["most"] <= coarse["least"] * (1 + 2**-10)).all()


def test_bpe(docs, empty, rows, oracle):
    got = [(r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in bpe.encode(docs, RANKS, PATTERN).collect()]
    same(got, [(i, np.array(oracle(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows])
    assert bpe.encode(empty, RANKS, PATTERN).count() == 0


def test_bpe_matrix_and_heap_agree():
    v = bpe.Vocabulary(bpe.read_ranks(RANKS), PATTERN)
    assert bpe.Vocabulary(v.ranks, PATTERN, 100).encode(["ab" * 70]) == v.encode(["ab" * 70])
    rng = np.random.default_rng(0)
    for n in (2, 7, 30, 200):
        pieces = [bytes(rng.choice(list(b"aethrsno .\xc3\xa9"), n).tolist()) for _ in range(50)]
        assert v.merge_rows(pieces, 256) == [v.merge_long(p) for p in pieces]


def test_packing(docs, empty, rows, oracle):
    got = packing.pack(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), RANKS, PATTERN, SPECIAL, capacity=256).collect()
    own = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert any("<|endoftext|>" in (t or "") for _, t in rows)
    texts, pieces, places = dict(rows), defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == {i for i, _ in rows if i is not None}
    for i, own_pieces in pieces.items():
        own_pieces.sort(key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in own_pieces]).tolist()
        assert ids == [*own.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        assert [r.start for r in own_pieces] == np.cumsum([0, *(r.length for r in own_pieces)])[:-1].tolist()
        assert {r.doc_tokens for r in own_pieces} == {len(ids)}
    slack = 0
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
        slack += at < 256
    assert slack <= 3
    assert packing.pack(empty, RANKS, PATTERN, SPECIAL).count() == 0
    assert packing.pack(docs, RANKS, PATTERN, SPECIAL).where("doc_id is null").count() >= 2


def test_closest_multiset():
    rng = np.random.default_rng(0)
    for _ in range(30):
        counts = Counter(rng.integers(1, 30, 8).tolist())
        room = int(rng.integers(1, 90))
        sums = {0}
        for k, n in counts.items():
            sums |= {s + k * j for s in sums for j in range(n + 1) if s + k * j <= room}
        got = packing.closest_multiset(sorted(counts), counts.__getitem__, room)
        assert sum(k * n for k, n in got.items()) == max(sums)
        assert all(0 < n <= counts[k] for k, n in got.items())


@pytest.mark.parametrize("small, medium, heavy", [(256, 4096, 1 << 21), (4, 8, 0), (4, 4, 1 << 21)])
def test_near_dedup(docs, empty, rows, small, medium, heavy, monkeypatch):
    for name, value in (("SMALL", small), ("MEDIUM", medium), ("HEAVY", heavy)):
        monkeypatch.setattr(near_dedup, name, value)
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, shingle=4).collect()}
    texts = {i: t for i, t in rows if i is not None}
    sets = {i: brute.shingles(t) for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(links) > 5
    want = brute.components(sets, links)
    for i, s in sets.items():
        assert got[i, len(s)] == (want[i], want[i] == i)
    assert all(v == (None, True) for (i, _), v in got.items() if i is None)
    assert near_dedup.near_duplicates(docs, shingle=4).count() == len(rows)
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.keep_one_of_each(docs, shingle=4)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in want if want[i] == i} | {None}


def test_near_dedup_group_of_copies(spark):
    base = fixtures.prose(9, 200).split()
    rows = [(i, " ".join([*base[: i % 190], f"w{i}", *base[i % 190 + 1 :]])) for i in range(600)] + [(1000 + i, fixtures.prose(i, 90)) for i in range(50)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in range(600))
    assert all(got[1000 + i] == 1000 + i for i in range(50))


@pytest.mark.parametrize("size", [10, 250_000])
def test_components(spark, size, monkeypatch):
    monkeypatch.setattr(components, "PART_LINKS", size)
    links = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 150), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long"), Shelf(spark)).collect()}
    want = brute.components({x for e in links[:-2] for x in e}, links[:-2])
    assert got == want
    assert components.components(spark.createDataFrame([], "u long, v long"), Shelf(spark)).count() == 0


def test_embedding_dedup(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16))
    x[50:80] = x[0] + rng.normal(size=(30, 16)) * 0.05
    x[80:100] = x[1]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    bad = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] + [1.0] * 15, 1), (1003, [None] + [1.0] * 15, 1), (1004, [1.0] * 8, 1), (None, x[0].tolist(), 1)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table).collect()}
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    found = np.array([got[i].n_links for i in range(300)])
    assert (found <= linked.sum(1)).all()
    assert found.sum() >= 0.9 * linked.sum() > 0
    want = brute.components(range(300), np.argwhere(linked).tolist())
    assert all(got[i].component_id == want[i] and got[i].kept == (want[i] == i) for i in range(300))
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in (1000, 1001, 1002, 1003, 1004, None))
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def shared(rng, n, d, norm):
    """Unit vectors with a common component of this norm, each followed by a partner of cosine 0.9 to 0.91 that shares it."""
    common = np.eye(d)[0] * norm
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.normal(size=(2, n, d)) * (np.arange(d) > 0))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = (rng.uniform(0.9, 0.91, (n, 1)) - norm**2) / (1 - norm**2)
    own = math.sqrt(1 - norm**2)
    return np.stack((common + own * a, common + own * (c * a + np.sqrt(1 - c * c) * b)), 1).reshape(-1, d)


@pytest.mark.parametrize("kind", ["common part", "dominant cluster"])
def test_embedding_dedup_finds_pairs_that_share_a_part(spark, kind):
    rng = np.random.default_rng(3)
    x = shared(rng, 1000, 64, 0.8)
    if kind == "dominant cluster":
        x = np.concatenate((x, (y := rng.normal(size=(1000, 64))) / np.linalg.norm(y, axis=1, keepdims=True)))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    found = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(table).collect()}
    assert all(found[i] <= linked[i].sum() for i in found)
    assert sum(found.values()) >= 0.9 * linked.sum() >= 1800


def test_embedding_dedup_joins_each_length(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(60)]
    rows += [(100 + i, ([1.0] * 7 + [1.0 + i / 100])) for i in range(5)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == 65
    assert all(got[100 + i] == (4, 100) for i in range(5))


def test_licenses(docs, empty, rows):
    def base(r):
        places = [x.first_word for x in r.base]
        return r.doc_id, r.n_words, len(places), min(places, default=None), max(places, default=None), ",".join(sorted({x.label for x in r.base}))

    found = licenses.scan(docs).collect()
    same([base(r) for r in found], [(i, *brute.license_base(t)) for i, t in rows])
    labels = {r.doc_id: {x.label for x in r.spans} for r in found}
    texts = dict(rows)
    one = next(i for i, t in texts.items() if t and t.startswith("Released"))
    assert labels[one] == {"mit", "cc-by-nc-4.0"}
    assert licenses.scan(empty).count() == 0


def test_matching_statistics():
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 4, 30).tolist() for _ in range(3)]
    automaton = licenses.Automaton(texts)
    words = rng.integers(0, 4, 200).tolist()
    runs = {tuple(t[a:b]) for t in texts for a in range(30) for b in range(a + 1, 31)}
    longest = [max((n for n in range(1, i + 2) if tuple(words[i + 1 - n : i + 1]) in runs), default=0) for i in range(200)]
    want = [(i + 1, n) for i, n in enumerate(longest) if n >= 3 and (i == 199 or longest[i + 1] != n + 1)]
    assert [(end, n) for end, n, _ in automaton.matches(words, 3)] == want
    for end, n, state in automaton.matches(words, 3):
        assert sorted(automaton.ends[state]) == [(t, b) for t in range(3) for b in range(n, 31) if texts[t][b - n : b] == words[end - n : end]]


def test_secrets(docs, empty, rows):
    field = secrets.fit(docs)
    found = secrets.scan(docs, field).collect()
    got = [(r.doc_id, ",".join(f"{x.kind}:{x.start}:{x.end}" for x in r.spans if x.kind != "crf")) for r in found]
    same(got, [(i, brute.secret_base(t)[0]) for i, t in rows])
    masked = secrets.mask(docs, field)
    assert masked.columns == docs.columns
    texts = [r.text for r in masked.collect()]
    assert None in texts
    assert not any(t and "AKIA" in t for t in texts)
    assert secrets.scan(empty, secrets.fit(empty)).count() == 0


def test_field_finds_keys_that_no_pattern_knows(spark):
    """On texts with made-up keys: nearly all found, nothing else marked, and none by the base patterns alone."""
    train = spark.createDataFrame([(i, fixtures.prose(i, 120)) for i in range(600)], "doc_id long, text string")
    field = secrets.fit(train)
    rng, rows, places = np.random.default_rng(5), [], {}
    for i in range(200):
        new, a, b = secrets.planted(rng)
        head = fixtures.prose(5000 + i, 50) + " "
        rows.append((i, head + new + " " + fixtures.prose(9000 + i, 50)))
        places[i] = (len(head) + a, len(head) + b)
    rows += [(1000 + i, fixtures.prose(20000 + i, 100) + " " + secrets.plain(rng) + " " + fixtures.prose(30000 + i, 20)) for i in range(200)]
    found = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), field).collect()}
    hits = [any(x.start <= a and b <= x.end for x in found[i]) for i, (a, b) in places.items()]
    base = [any(x.kind != "crf" and x.start <= a and b <= x.end for x in found[i]) for i, (a, b) in places.items()]
    assert np.mean(hits) >= 0.9
    assert np.mean(base) <= 0.3
    spans = [x for i in found for x in found[i] if x.kind == "crf"]
    right = sum(any(a < x.end and x.start < b for x in found[i] if x.kind == "crf") for i, (a, b) in places.items())
    assert right / len(spans) >= 0.9


def test_field_learns_and_decodes():
    texts = [fixtures.prose(i, 60) + f" api_key = {i:x}f7a9c3d1e8b2{i * 7919:x}q9 " + fixtures.prose(i + 500, 60) for i in range(60)]
    field = secrets.fit_field(secrets.training_rows(texts))
    import pyarrow as pa

    from quire.llm import textblock as tb

    new = [fixtures.prose(900 + i, 60) + f" my_key = {i:x}c7f9b3d1a8e2{i * 104729:x}k9 " + fixtures.prose(i + 1500, 60) for i in range(20)]
    block = next(tb.blocks(pa.array(new)))
    t = secrets.tokens(block)
    e = field.emissions(secrets.features(block, t))
    state = field.decode(e, t.doc)
    for d in range(20):  # the same path as a plain Viterbi
        own = np.flatnonzero(t.doc == d)
        score, back = e[own[0]].copy(), []
        for i in own[1:]:
            options = score[:, None] + field.transitions
            back.append(options.argmax(0))
            score = options.max(0) + e[i]
        path = [int(score.argmax())]
        for b in back[::-1]:
            path.append(int(b[path[-1]]))
        assert path[::-1] == state[own].tolist()
        assert (state[own] > 0).any()


def labels_of(spark, n, bad):
    return spark.createDataFrame([(i, int(i not in bad), int(i in bad)) for i in range(n)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_language_id(spark, empty):
    letters = {"aa": "abcde", "bb": "vwxyz"}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join("".join(rng.choice(list(letters[lang]), 5)) for _ in range(30)), lang) for i in range(120) for lang in [["aa", "bb"][i % 2]]]
    rows += [(500, None, "aa"), (501, "123 !", "bb"), (502, "", None), (None, "abc abc", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.predict(table, language_id.fit(table)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:120])
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (500, 501, 502))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.predict(empty, language_id.fit(empty)).count() == 0
    assert language_id.predict(table, language_id.fit(empty)).where("lang_pred = 'und'").count() == len(rows)


def test_language_id_equals_a_plain_version(spark, docs, rows):
    """Awkward rows (nulls, long texts, repeated rows, clashing columns), n-grams counted one by one."""
    model = language_id.fit(docs)
    letters = lambda b: b if language_id.LETTER[b] else 32

    def vector(text):
        data = [letters(b) for b in tb.LOWER[np.frombuffer((text or "").encode(), np.uint8)].tolist()]
        n = np.zeros(language_id.BUCKETS)
        for size in (2, 3):
            for i in range(len(data) - size + 1):
                gram = data[i : i + size]
                if gram[0] == gram[-1] == 32:
                    continue
                h = 0
                for b in gram:
                    h = (h * 0x9E3779B97F4A7C15 + int(tb.BYTE_WORD[b])) % 2**64
                n[int(tb.mix(np.array([h], np.uint64))[0] >> np.uint64(64 - language_id.BUCKET_BITS))] += 1
        x = np.where(n > 0, 1 + np.log(np.maximum(n, 1)), 0) * model.idf
        return x / max(np.sqrt((x * x).sum()), 1e-12)

    got = {}
    for r in language_id.predict(docs, model).collect():
        got.setdefault(r.doc_id, set()).add((r.lang_pred, round(r.score, 4)))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, text in texts.items():
        if i is None or len(text or "") > 5000:
            continue
        if not any(map(str.isalpha, text or "")):
            assert got[i] == {("und", 0.0)}
            continue
        cosine = model.centroids @ vector(text)
        (name, score), = got[i]  # repeated rows are judged alike
        assert abs(score - min(1, max(0, cosine.max()))) < 2e-3
        assert name in {model.languages[k] for k in model.language[cosine >= cosine.max() - 1e-5]}
    assert language_id.predict(docs, model).count() == len(rows)


def test_language_id_of_texts_alike(spark):
    """Texts that are the same in two languages: a tie goes to one of them, always the same; many values of lang are bounded."""
    table = spark.createDataFrame([(i, "same words in both", ["aa", "bb"][i % 2]) for i in range(60)] + [(100 + i, f"word{chr(97 + i)}", f"free {i}") for i in range(20)], "doc_id long, text string, lang string")
    model = language_id.fit(table, most_languages=2)
    assert model.languages == ["aa", "bb"]
    assert len({(r.lang_pred, r.score) for r in language_id.predict(table.where("doc_id < 100"), model).collect()}) == 1


def test_embedding_dedup_with_clashing_columns_and_large_vectors(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 12)) * 10.0 ** rng.integers(-150, 150, (60, 1))
    x[30:40] = x[:10] * 1e3
    rows = [(i, v.tolist(), 1, 2, "n", 3, True) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id long, n long, node string, component_id long, kept boolean")
    unit = x / np.abs(x).max(1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    want = brute.components(range(60), np.argwhere(linked).tolist())
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table).collect()}
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {i: (int(linked[i].sum()), want[i]) for i in range(60)}


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(0)
    rows = [(i, fixtures.prose(i, 60) + (f" {rng.choice(['grumpfel', 'grumpfix', 'grumpfo'])} " * 2 if i % 4 == 0 else " ") + fixtures.prose(i + 999, 40)) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = labels_of(spark, 300, {i for i in range(300) if i % 4 == 0})
    model = toxicity.fit(table, labels)
    got = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in range(300, 400)]) > 0.9
    unseen = spark.createDataFrame([(1, fixtures.prose(5, 50) + " grumpfelig grumpfzz " + fixtures.prose(6, 50))], "doc_id long, text string")
    assert toxicity.score(unseen, model).first().score >= 0.5
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).where("score < 0.5").count() == docs.count()


def test_quality_model(spark, docs, empty):
    rows = [(i, fixtures.prose(i, 60) if i % 4 else "SPAM!! ### " * 30 + fixtures.prose(i, 30)) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = labels_of(spark, 200, {i for i in range(200) if i % 4 == 0})
    model = quality_model.fit(table, labels)
    got = {r.doc_id: r.score for r in quality_model.score(table, model).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 4 != 0) for i in range(200, 300)]) > 0.95
    assert quality_model.score(docs, model).count() == docs.count()
    assert quality_model.keep_good(docs, model).columns == docs.columns
    assert quality_model.score(empty, model).count() == 0
    assert quality_model.fit(empty, labels.limit(0)).bias == 0


def test_machine_equals_all_pairs():
    rng = np.random.default_rng(0)
    model = quality_model.Model(0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    feature, value = np.array([1, 5, 7, 2, 5]), rng.normal(size=5)
    z, _ = quality_model.logits(model, 2, np.array([0, 0, 0, 1, 1]), feature, value)
    for d, own in enumerate(([0, 1, 2], [3, 4])):
        want = model.bias + sum(model.weights[feature[i]] * value[i] for i in own) + sum(model.factors[feature[i]] @ model.factors[feature[j]] * value[i] * value[j] for i in own for j in own if i < j)
        assert z[d] == pytest.approx(want)


def test_few_other_texts_pass_the_filter():
    ids, others, bits = np.arange(0, 20_000, 2), np.arange(1, 20_001, 2), 18
    words = [b for part in np.array_split(ids, 3) for b in near_dedup._filter_words(bits)(iter([pa.record_batch([pa.array(part)], ["id"])]))]
    table = np.zeros(1 << (bits - 6), np.int64)
    for b in words:
        table[b.column("place").to_numpy()] |= b.column("word").to_numpy()
    at = lambda x: near_dedup._filter_places(x, bits)
    passes = lambda x: (table[at(x) >> 6] >> (at(x) & 63) & 1).astype(bool).all(1)
    assert passes(ids).all() and passes(others).mean() < 0.01


def test_machine_is_trained_in_parts_with_the_same_sums(monkeypatch):
    rng = np.random.default_rng(1)
    model = quality_model.Model(0.3, rng.normal(size=20).astype(np.float32), rng.normal(size=(20, 4)).astype(np.float32))
    doc, feature, value = np.repeat(np.arange(7), [1, 4, 2, 30, 1, 3, 2]), rng.integers(0, 20, 43), rng.normal(size=43).astype(np.float32)
    want = quality_model.logits(model, 7, doc, feature, value)
    for part in (1, 3, 7, 100):
        monkeypatch.setattr(quality_model, "PART", part)
        assert all(np.array_equal(a, b) for a, b in zip(quality_model.logits_by_parts(model, 7, doc, feature, value), want, strict=True))


def test_windows_to_train_on_do_not_hold_the_whole_text():
    rows = secrets.training_rows(fixtures.prose(i, 300) + " api_key = 4f7a9c3d1e8b2q9" for i in range(3))
    assert rows and all(x.base is None and x.nbytes <= 32 * len(secrets.SIZES) * 2 for row in rows for x in row)
