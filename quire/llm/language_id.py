"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text is its counts of hashed byte n-grams (2 and 3 bytes of lower-cased words with their edges),
weighted by 1 + log(count) and the inverse document frequency over all documents that may be
learned from, and normalised.  For each language, spherical k-means on a bounded sample gives
several centroids.  A text gets the language of the centroid of largest cosine; it is rejected if that
cosine is below almost all the sample's cosines with the same centroid (distance-based rejection).

Defined results: a text that is null or has no letter is `und` with score 0, and so is every text
if nothing can be learned; repeated rows and null ids are predicted row by row; a null key is learned from; of
equal cosines the first language in alphabetical order wins; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import textblock as tb
from quire.llm.cluster import held_out

BUCKET_BITS = 12
BUCKETS = 1 << BUCKET_BITS
LETTER = np.isin(np.arange(256), [*range(97, 123), *range(128, 256)])
ASCII_LETTER = np.isin(np.arange(256), np.arange(97, 123))


def counts(block: tb.Block) -> np.ndarray:
    """counts[document, bucket] of n-grams; all that is no letter counts as a word's edge."""
    data = tb.LOWER[block.data]
    data = np.where(LETTER[data], data, np.uint8(32))
    out = np.zeros(block.n * BUCKETS, np.int64)
    doc = np.repeat(np.arange(block.n), np.diff(block.offsets))
    code = tb.BYTE_WORD[data]
    for n in (2, 3):
        if len(data) < n:
            continue
        h = code[: len(data) - n + 1].copy()
        for j in range(1, n):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += code[j : len(data) - n + 1 + j]
        ok = doc[: len(h)] == doc[n - 1 :]
        ok &= (data[: len(h)] != 32) | (data[n - 1 :] != 32)
        bucket = (tb.mix(h) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        out += np.bincount((doc[: len(h)] * BUCKETS + bucket)[ok], minlength=len(out))
    return out.reshape(block.n, BUCKETS)


def vectors(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.where(n > 0, 1 + np.log(np.maximum(n, 1)), 0).astype(np.float32) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def has_letter(block: tb.Block) -> np.ndarray:
    data = tb.LOWER[block.data]
    out = block.per_doc(ASCII_LETTER[data]) > 0
    for i in np.flatnonzero(~out & (block.per_doc(data >= 128) > 0)):
        out[i] = any(map(str.isalpha, block.data[block.offsets[i] : block.offsets[i + 1]].tobytes().decode()))
    return out


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    language: np.ndarray
    least: np.ndarray


def cluster(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Centroids of spherical k-means; the first ones are spread by largest distance."""
    chosen = [x.mean(0)]
    while len(chosen) < min(k, len(x)):
        near = (x @ np.stack(chosen).T).max(1)
        chosen.append(x[near.argmin()])
    c = np.stack(chosen)
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _frequencies(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for block in tb.blocks(batch.column(text), docs=500):
                total += (counts(block) > 0).sum(0)
                docs += block.n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BUCKETS)), pa.array(np.append([docs], total))], ["bucket", "n"])

    return run


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", centroids: int = 4, sample_rows: int = 500, max_chars: int = 20_000, most_languages: int = 1000) -> Model:
    """Frequencies count all learnable rows; centroids come from at most sample_rows of each language
    with at most max_chars characters, and of the most_languages most frequent languages (documented bounds)."""
    open_ = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(key, 4, 2))
    totals = open_.select(text).mapInArrow(_frequencies(text), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas().set_index("bucket")["n"]
    idf = np.log((1 + totals.get(-1, 0)) / (1 + totals.reindex(range(BUCKETS), fill_value=0).to_numpy())).astype(np.float32) + 0.05
    short = open_.where(F.length(text) <= max_chars).select(key, text, lang, F.xxhash64(key).alias("place"))
    # of each language the share that holds about twice the rows wanted, by the hash, so that no task gets a whole language
    shares = short.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(most_languages).collect()
    known = F.create_map(*(F.lit(x) for r in shares for x in (r[lang], min(1.0, 2 * sample_rows / r["count"])))) if shares else F.lit(None).cast("map<string,double>")
    share = F.coalesce(F.element_at(known, F.col(lang)), F.lit(0.0))
    thin = short.where(F.pmod("place", F.lit(1 << 40)) < (share * float(1 << 40)).cast("long")).drop("place")
    number = F.row_number().over(Window.partitionBy(lang).orderBy(F.xxhash64(key), key))
    sample = thin.withColumn("number", number).where(F.col("number") <= sample_rows).select(text, lang).toArrow().combine_chunks()
    names = np.array(sample.column(lang).to_pylist(), object)
    languages = sorted(set(names.tolist()))
    found: list[tuple[int, np.ndarray]] = []
    column = sample.column(text).combine_chunks() if len(names) else pa.array([], pa.string())
    x = np.concatenate([vectors(counts(b), idf) for b in tb.blocks(column, docs=500)] or [np.zeros((0, BUCKETS), np.float32)])
    full = x.any(1)
    for i, name in enumerate(languages):
        own = x[full & (names == name)]
        if len(own):
            found += [(i, c) for c in cluster(own, centroids)]
    if not found:
        return Model(idf, [], np.zeros((0, BUCKETS), np.float32), np.zeros(0, int), np.zeros(0))
    c, language = np.stack([c for _, c in found]).astype(np.float32), np.array([i for i, _ in found])
    cosine = x[full] @ c.T
    best = cosine.argmax(1)
    least = np.array([np.quantile(cosine[best == i, i], 0.005) if (best == i).any() else 0.0 for i in range(len(c))])
    return Model(idf, languages, c, language, least)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score (the cosine) and rejected of every row."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in batches:
            for block in tb.blocks(batch.column(text), docs=500):
                letter = has_letter(block) & (len(m.languages) > 0)
                if len(m.languages):
                    cosine = vectors(counts(block), m.idf) @ m.centroids.T
                    best = cosine.argmax(1)
                    score = np.where(letter, np.clip(cosine[np.arange(block.n), best], 0, 1), 0.0)
                    lang = [m.languages[i] if ok else "und" for i, ok in zip(m.language[best], letter, strict=True)]
                    rejected = ~letter | (score < m.least[best])
                else:
                    score, lang, rejected = np.zeros(block.n), ["und"] * block.n, np.ones(block.n, bool)
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(block.first, block.n), pa.array(lang, pa.string()), pa.array(score.astype(float)), pa.array(rejected)], [key, "lang_pred", "score", "rejected"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, lang_pred string, score double, rejected boolean")
