"""Toxicity from subword bags: averaged embeddings into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its hashed character n-grams (3 to 5 bytes, with its
edges), so an unseen misspelling shares the vectors of the word it comes from.  A window of words is the
mean of its words; two softmax weights turn it into the probability of toxic text.  A text has the
score of its most toxic window, so some toxic words do not drown in a long text.

Only whole texts are labelled, so training goes twice over the windows: first with the text's label,
then of toxic texts only with the windows that the first round found toxic (at least the most toxic one).

Defined results: a null or empty text, or one without words, scores as a window of no words; without
labels of both kinds every text scores 0; rows are scored one by one, so repeated rows and null
ids need no care; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm import textblock as tb
from quire.llm.cluster import labelled_sample

BUCKET_BITS, DIM, SIZES = 18, 8, (3, 4, 5)
WINDOW, STEP, LEAST_WORDS = 32, 16, 12
IN_WORD = np.isin(np.arange(256), [*b"abcdefghijklmnopqrstuvwxyz0123456789@$*", *range(128, 256)])
OPEN, CLOSE = 1, 2


@dataclass
class Model:
    """value[bucket]: what an n-gram adds to the logit of toxic, its embedding times the softmax weights."""

    value: np.ndarray
    bias: float


def grams(data: np.ndarray, words: tb.Spans) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: buckets, and the word of each."""
    size = words.end - words.start + 2
    first = np.cumsum(size) - size
    total = int(size.sum())
    x = np.full(total, OPEN, np.uint8)
    x[first + size - 1] = CLOSE
    word = np.repeat(np.arange(len(size)), size)
    inner = np.ones(total, bool)
    inner[first] = inner[first + size - 1] = False
    x[inner] = data[np.flatnonzero(IN_WORD[data])] if len(size) else x[inner]
    code = tb.BYTE_WORD[x]
    for n in SIZES:
        m = total - n + 1
        if m <= 0:
            continue
        h = code[:m].copy()
        for j in range(1, n):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += code[j : j + m]
        ok = np.flatnonzero(word[:m] == word[n - 1 :])
        yield (tb.mix(h[ok]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), word[ok]


def block_words(block: tb.Block) -> tuple[np.ndarray, tb.Spans]:
    data = tb.LOWER[block.data]
    return data, tb.spans(block, IN_WORD[data])


def word_values(data: np.ndarray, words: tb.Spans, value: np.ndarray) -> np.ndarray:
    """The mean of the values of each word's n-grams."""
    n, total = np.zeros(len(words.start)), np.zeros(len(words.start))
    for bucket, word in grams(data, words):
        n += np.bincount(word, minlength=len(n))
        total += np.bincount(word, value[bucket], minlength=len(n))
    return total / np.maximum(n, 1)


def window_logits(per_word: np.ndarray, words: tb.Spans, n: int, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Logits of all windows, and their documents; a text of fewer words is one window."""
    counts = words.counts(n)
    first = np.cumsum(counts) - counts
    number = np.maximum(1, -(-(counts - WINDOW) // STEP) + 1)
    doc = np.repeat(np.arange(n), number)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
    start = first[doc] + np.minimum(place * STEP, np.maximum(counts[doc] - WINDOW, 0))
    end = np.minimum(start + WINDOW, first[doc] + counts[doc])
    total = np.concatenate(([0.0], np.cumsum(per_word)))
    return (total[end] - total[start]) / np.maximum(end - start, LEAST_WORDS) + bias, doc


def logits(block: tb.Block, model: Model) -> np.ndarray:
    data, words = block_words(block)
    value, doc = window_logits(word_values(data, words, model.value), words, block.n, model.bias)
    out = np.full(block.n, -np.inf)
    np.maximum.at(out, doc, value)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def cut_between(value: np.ndarray, y: np.ndarray) -> float:
    """The cut with the fewest errors, each label weighing the same; of equal ones the middle."""
    order = np.argsort(value)
    v, t = value[order], y[order]
    wrong = np.concatenate(([0], np.cumsum(t))) / max(1, t.sum()) + np.concatenate((np.cumsum((1 - t)[::-1])[::-1], [0])) / max(1, (1 - t).sum())
    best = np.flatnonzero(wrong == wrong.min())
    middle = best[len(best) // 2]
    edges = np.concatenate(([v[0] - 1], v, [v[-1] + 1]))
    return float((edges[middle] + edges[middle + 1]) / 2)


def telling_grams(texts: list[str], y: np.ndarray, least_z: float) -> np.ndarray:
    """Buckets whose share of texts differs between the labels by at least least_z standard errors.

    Only these get embeddings; the many n-grams of a few texts would be learned by heart."""
    found = np.zeros((2, 1 << BUCKET_BITS))
    for i, text in enumerate(texts):
        raw = np.frombuffer(text.encode(), np.uint8)
        own = list(grams(*block_words(tb.Block(0, raw, np.array([0, len(raw)])))))
        if own:
            found[y[i], np.unique(np.concatenate([bucket for bucket, _ in own]))] += 1
    n = np.bincount(y, minlength=2)[:, None]
    pooled = found.sum(0) / n.sum()
    error = np.sqrt(pooled * (1 - pooled) * (1 / n).sum())
    return np.flatnonzero(np.abs(found[1] / n[1] - found[0] / n[0]) >= np.maximum(least_z * error, 1e-12))


def sums(to: np.ndarray, rows: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Row i of the result is the sum of rows[of[j]] over all j with to[j] = i."""
    return np.stack([np.bincount(to, rows[of, k], minlength=n) for k in range(rows.shape[1])], 1).astype(np.float32)


def train(texts: list[str], y: np.ndarray, steps: int = 100, rate: float = 0.02, decay: float = 1e-5, gain: float = 30.0, least_z: float = 4.5) -> Model:
    """Adam on the cross-entropy of windows; embeddings and softmax weights move together."""
    nothing = Model(np.zeros(1 << BUCKET_BITS, np.float32), -60.0)
    if len(set(y.tolist())) < 2:
        return nothing
    block = next(tb.blocks(pa.array(texts, pa.large_string()), 1 << 40, 1 << 40))
    data, words = block_words(block)
    # distinct words, so each is embedded once in a step
    h, where, kind = np.unique(tb.span_hashes(data, words.start, words.end), return_index=True, return_inverse=True)
    place = np.sort(where)
    rank = np.empty(len(h), np.int64)
    rank[np.argsort(where, kind="stable")] = np.arange(len(h))
    kind = rank[kind]
    mask = np.zeros(len(data), bool)
    for a, b in zip(words.start[place], words.end[place], strict=True):
        mask[a:b] = True
    some = tb.Spans(words.start[place], words.end[place], words.doc[place])
    parts = list(grams(np.where(mask, data, np.uint8(32)), some))
    bucket, word = np.concatenate([p[0] for p in parts]).astype(np.int32), np.concatenate([p[1] for p in parts]).astype(np.int32)
    share = (1 / np.maximum(np.bincount(word, minlength=len(h)), 1)).astype(np.float32)
    telling = np.isin(bucket, telling_grams(texts, y, least_z))
    used, bucket = np.unique(bucket[telling], return_inverse=True)
    word = word[telling]

    counts = words.counts(block.n)
    in_doc = np.arange(len(kind)) - (np.cumsum(counts) - counts)[words.doc]
    rng = np.random.default_rng(0)
    e = rng.normal(0, 0.01, (len(used), DIM)).astype(np.float32)
    w = rng.normal(0, gain, (DIM, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    for size in (1 << 31, WINDOW):
        bag_id, slot = np.unique(words.doc * (1 << 32) + in_doc // size, return_inverse=True)
        of = bag_id >> 32
        share_of_bag = (1 / np.maximum(np.bincount(slot, minlength=len(bag_id)), LEAST_WORDS)).astype(np.float32)
        target = y[of].astype(np.float32)

        def bags() -> tuple[np.ndarray, np.ndarray]:
            vec = sums(word, e, bucket, len(h)) * share[:, None]
            bag = sums(slot, vec, kind, len(bag_id)) * share_of_bag[:, None]
            z = bag @ w + b
            return bag, sigmoid(z[:, 1] - z[:, 0])

        keep = np.ones(len(bag_id), bool)
        if size == WINDOW:
            p = bags()[1]
            top = np.full(block.n, -1.0)
            np.maximum.at(top, of, p)
            keep = (target == 0) | (p >= top[of])
        weight = np.where(target > 0, 0.5 / max(1, (target[keep] > 0).sum()), 0.5 / max(1, (target[keep] == 0).sum())).astype(np.float32) * keep
        moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (e, w, b)]
        for step in range(1, steps + 1):
            bag, p = bags()
            g = ((p - target) * weight)[:, None] * np.array([[-1, 1]], np.float32)
            gw, gb = bag.T @ g, g.sum(0)
            gvec = sums(kind, (g @ w.T) * share_of_bag[:, None], slot, len(h)) * share[:, None]
            ge = sums(bucket, gvec, word, len(used))
            for x, gx, m in zip((e, w, b), (ge + decay * e, gw, gb), moments, strict=True):
                m[0] = 0.9 * m[0] + 0.1 * gx
                m[1] = 0.99 * m[1] + 0.01 * gx * gx
                x -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-9)
    value = np.zeros(1 << BUCKET_BITS, np.float32)
    value[used] = e @ (w[:, 1] - w[:, 0])
    model = Model(value, float(b[1] - b[0]))
    model.bias -= cut_between(logits(block, model), y)
    return model


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = 1500, max_chars: int = 6000) -> Model:
    """A model from at most sample_rows texts of each label of at most max_chars characters (documented bounds)."""
    texts, y = labelled_sample(docs, labels, label, key, text, sample_rows, max_chars, 5, 0)
    return train(texts, np.array(y, np.int64))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every row."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch.column(text)):
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(block.first, block.n), pa.array(sigmoid(logits(block, known.value)))], [key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, score double")
