"""Quality classifier: a factorisation machine over hashed words, structure and length.

Features of a text: its hashed words (1 + log(count), normalised to length 1), the binned
statistics of the quality rules, and the binned number of bytes and words.  The score adds low-rank
interactions of all pairs, computed in linear time by the sum-of-squares identity
sum_{i<j} <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2.

Defined results: a null or empty text is scored by its structure alone; without labels of both
kinds every text scores 0.5; rows are scored one by one, so repeated rows and null ids need no care;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm import textblock as tb
from quire.llm.cluster import labelled_sample
from quire.llm.quality_rules import STATISTICS, block_counts
from quire.llm.toxicity import cut_between, sigmoid

WORD_BITS, RANK = 14, 8
WORDS = 1 << WORD_BITS
SHARES = np.array([0.001, 0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7])
LOGS = np.arange(1, 16)
BINS = 16
#: Documents whose words are looked up at a time when the machine is trained.
PART = 256
FEATURES = WORDS + BINS * (len(STATISTICS) + 2)


@dataclass
class Model:
    bias: float
    weights: np.ndarray
    factors: np.ndarray


def features(block: tb.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value) of all that is not 0, by document."""
    words = tb.spans(block, ~tb.SPACE[block.data])
    bucket = (tb.span_hashes(tb.LOWER[block.data], words.start, words.end) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    both, n = np.unique(words.doc * WORDS + bucket, return_counts=True)
    doc, value = both >> WORD_BITS, 1 + np.log(n)
    value /= np.sqrt(np.bincount(doc, value * value, minlength=block.n))[doc]
    counts = block_counts(block)
    bins = [np.searchsorted(SHARES, counts[k], "right") if k.endswith("share") else np.minimum(counts[k].astype(int), BINS - 1) for k in STATISTICS]
    bins += [np.searchsorted(LOGS, np.log2(1 + x), "right") for x in (np.diff(block.offsets), counts["n_words"])]
    extra = np.stack(bins, 1) + WORDS + BINS * np.arange(len(bins))
    own = np.repeat(np.arange(block.n), len(bins))
    doc, feature = np.concatenate((doc, own)), np.concatenate((both & (WORDS - 1), extra.ravel()))
    value = np.concatenate((value, np.full(len(own), 0.5)))
    order = np.argsort(doc, kind="stable")
    return doc[order], feature[order], value[order].astype(np.float32)


def logits(model: Model, n: int, doc: np.ndarray, feature: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The machine's sums, and sum v_i x_i of each document.  Every document has features."""
    start = np.searchsorted(doc, np.arange(n))
    xv = model.factors[feature] * value[:, None]
    total = np.add.reduceat(xv, start)
    squares = np.add.reduceat((xv * xv).sum(1), start)
    return model.bias + np.add.reduceat(model.weights[feature] * value, start) + 0.5 * ((total * total).sum(1) - squares), total


def logits_by_parts(model: Model, n: int, doc: np.ndarray, feature: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of PART documents at a time, so that the rows of factors of all their words are never held at once."""
    first = range(0, n, PART)
    bounds = np.searchsorted(doc, [*first, n])
    parts = [logits(model, min(PART, n - at), doc[a:b] - at, feature[a:b], value[a:b]) for at, a, b in zip(first, bounds[:-1], bounds[1:], strict=True)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def train(texts: list[str], y: np.ndarray, steps: int = 60, rate: float = 0.05, decay: float = 1e-5) -> Model:
    """Adam on the cross-entropy of all texts, each label weighing the same."""
    rng = np.random.default_rng(0)
    model = Model(0.0, np.zeros(FEATURES, np.float32), rng.normal(0, 0.05, (FEATURES, RANK)).astype(np.float32))
    if len(set(y.tolist())) < 2:
        model.factors[:] = 0
        return model
    docs, feats, values, n = [], [], [], 0
    for block in tb.blocks(pa.array(texts, pa.large_string())):
        d, f, x = features(block)
        docs.append(d + n)
        feats.append(f.astype(np.int32))
        values.append(x)
        n += block.n
    doc, feature, value = np.concatenate(docs).astype(np.int32), np.concatenate(feats), np.concatenate(values)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (model.weights, model.factors)]
    z = np.zeros(n)
    for step in range(1, steps + 1):
        z, total = logits_by_parts(model, n, doc, feature, value)
        g = ((sigmoid(z) - y) * weight).astype(np.float32)
        gx = g[doc] * value
        gw = np.bincount(feature, gx, minlength=FEATURES) + decay * model.weights
        square = np.bincount(feature, gx * value, minlength=FEATURES)
        gv = np.stack([np.bincount(feature, gx * total[doc, k], minlength=FEATURES) - square * model.factors[:, k] for k in range(RANK)], 1) + decay * model.factors
        model.bias -= rate * float(g.sum())
        for x, gx_, (m, v) in zip((model.weights, model.factors), (gw, gv), moments, strict=True):
            m *= 0.9
            m += 0.1 * gx_.astype(np.float32)
            v *= 0.99
            v += 0.01 * (gx_ * gx_).astype(np.float32)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    model.bias -= cut_between(logits_by_parts(model, n, doc, feature, value)[0], y)
    return model


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = 2000, max_chars: int = 10_000) -> Model:
    """A model from at most sample_rows texts of each label of at most max_chars characters (documented bounds)."""
    texts, y = labelled_sample(docs, labels, label, key, text, sample_rows, max_chars, 3, 1)
    return train(texts, np.array(y, np.int64))


def block_scores(block: tb.Block, model: Model) -> np.ndarray:
    return sigmoid(logits(model, block.n, *features(block))[0])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every row."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch.column(text)):
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(block.first, block.n), pa.array(block_scores(block, known.value).astype(float))], [key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, score double")


def keep_good(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows that score at least `least`, with all their columns; nothing is shuffled."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch.column(text)):
                yield batch.slice(block.first, block.n).filter(pa.array(block_scores(block, known.value) >= least))

    return docs.mapInArrow(run, docs.schema)
