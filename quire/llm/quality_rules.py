"""Quality rules with risk-controlled thresholds.

Base rules count words, symbols, repeated lines and repeated 8-word windows.  On top of them each
*statistic* of a text gets a cutoff per *stratum* (length class), so that at most the share `risk` of the
good texts of each stratum is rejected, in all strata together with probability ``1 - delta``:

1. A quarter of the labelled texts, by a hash of their id, proposes for each stratum a chain of rules.  A rule is a
   cutoff for each statistic; each rule of a chain rejects all that the one before rejects.  The chain begins
   with the statistic that catches most bad texts without a good one.
2. The other labelled texts, the holdout, test the chain: an exact binomial test at level ``delta`` / strata
   (Bonferroni's correction) must refute that a rule rejects more than `risk` of the good texts.  The tests go along
   the chain and end at the first rule that is not refuted (fixed-sequence testing).
3. Of the rules passed that one is taken which rejects most bad texts, a good one counting as five.

A stratum needs ln(delta / strata) / ln(1 - risk) good texts in the holdout, 436 by the standard values, to
get a rule; with fewer it proves nothing and rejects nothing.

Defined results: null text counts as empty, has no word and fails the base rule; repeated rows and
null ids are judged row by row; an empty table gives an empty result; only the named key and
text columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textblock as tb
from quire.llm.cluster import Shelf

WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics of a text; a high value speaks against it.
STATISTICS = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "digit_share", "same_word_share", "long_words")
#: Strata by number of words: below 20, 100, 500, and the rest.
STRATA = (20, 100, 500)
#: Shares of the proposing good texts that the rules of a chain may reject.
SHARES = (0, 0.0005, 0.001, 0.002, 0.005)
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
UPPER = np.isin(np.arange(256), np.arange(65, 91))
MARKS = np.isin(np.arange(256), list(b"!?#*$%&|<>=+~^_{}[]\\@"))
DIGITS = np.isin(np.arange(256), np.arange(48, 58))


def block_counts(block: tb.Block) -> dict[str, np.ndarray]:
    """The base counts and the statistics of each document of a block."""
    data, n = block.data, block.n
    lead = tb.code_points(data)
    word_byte = ~tb.SPACE[data]
    words = tb.spans(block, word_byte)
    out = {"n_words": words.counts(n), "word_chars": block.per_doc(lead & word_byte), "n_symbols": block.per_doc(SYMBOLS[data])}

    lines = tb.spans(block, data != 10)
    filled = np.concatenate(([0], np.cumsum(word_byte)))
    has_word = filled[lines.end] > filled[lines.start]
    lines = tb.Spans(lines.start[has_word], lines.end[has_word], lines.doc[has_word])
    _, later = tb.repeated(tb.keyed(tb.span_hashes(data, lines.start, lines.end), lines.doc))
    out["n_dup_lines"] = np.bincount(lines.doc[later], minlength=n).astype(np.int64)

    h = tb.span_hashes(data, words.start, words.end)
    w, at = tb.windows(h, words.doc, WINDOW)
    twice, _ = tb.repeated(tb.keyed(w, words.doc[at]))
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(words.doc[np.cumsum(cover)[:-1] > 0], minlength=n).astype(np.int64)

    chars, count = np.maximum(out["word_chars"], 1), np.maximum(out["n_words"], 1)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
    out |= {
        "symbol_share": out["n_symbols"] / chars,
        "dup_line_share": out["n_dup_lines"] / np.maximum(lines.counts(n), 1),
        "repeat_share": out["n_repeat_words"] / count,
        "upper_share": block.per_doc(UPPER[data]) / chars,
        "mark_share": block.per_doc(MARKS[data]) / chars,
        "digit_share": block.per_doc(DIGITS[data]) / chars,
        "same_word_share": np.bincount(words.doc[same], minlength=n) / count,
        "long_words": out["word_chars"] / count,
    }
    return out


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), exactly summed."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def controlled_cutoffs(statistics: np.ndarray, words: np.ndarray, good: np.ndarray, proposing: np.ndarray, risk: float, delta: float) -> np.ndarray:
    """cutoffs[stratum, statistic] of labelled texts held in arrays; values above a cutoff are rejected, inf
    rejects nothing.  `proposing` marks the texts that propose rules; the others test them."""
    chains = rule_chains(histogram(statistics[proposing], words[proposing], good[proposing]), statistics.shape[1])
    rest = ~proposing
    stratum = np.searchsorted(STRATA, words[rest], "right")
    first = first_rules(statistics[rest], stratum, chains)
    return tested(chains, stratum, first, good[rest].astype(int), (~good[rest]).astype(int), risk, delta)


def cells(values: np.ndarray) -> np.ndarray:
    """The cells of values >= 0, in their order: 1024 to each power of two, so a cell is at most 0.1 % wide."""
    return (np.asarray(values, float) + 0.0).view(np.int64) >> 42


def histogram(statistics: np.ndarray, words: np.ndarray, good: np.ndarray, cell: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """For each stratum, statistic and cell the least and largest value and the numbers of good and bad texts.

    Without cells each value has its own."""
    n, kinds = statistics.shape
    stratum = np.repeat(np.searchsorted(STRATA, words, "right"), kinds)
    kind, value, ok = np.tile(np.arange(kinds), n), statistics.ravel().astype(float), np.repeat(good, kinds)
    cell = np.unique(value, return_inverse=True)[1] if cell is None else cell.ravel()
    order = np.lexsort((cell, kind, stratum))
    stratum, kind, cell, value, ok = stratum[order], kind[order], cell[order], value[order], ok[order]
    first = np.flatnonzero(np.diff(stratum, prepend=-1) | np.diff(kind, prepend=-1) | np.diff(cell, prepend=-1)) if len(value) else np.zeros(0, np.int64)
    add = lambda x: np.add.reduceat(x.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    least, most = (f.reduceat(value, first) if len(first) else np.zeros(0) for f in (np.minimum, np.maximum))
    return {"stratum": stratum[first], "kind": kind[first], "cell": cell[first], "least": least, "most": most, "good": add(ok), "bad": add(~ok)}


def rule_chains(counts: dict[str, np.ndarray], kinds: int) -> list[np.ndarray]:
    """For each stratum a chain of rules, chain[rule, statistic], from the histogram of the proposing texts.

    For each share of SHARES and each statistic the best cutoff that rejects at most that share of the good texts
    joins the rule, if it catches more bad texts than five times the good ones."""
    out = []
    for s in range(len(STRATA) + 1):
        now, chain = np.full(kinds, np.inf), []
        for share in SHARES:
            offers = []
            for j in range(kinds):
                own = np.flatnonzero((counts["stratum"] == s) & (counts["kind"] == j))
                own = own[np.argsort(-counts["least"][own])]
                least, most, good, bad = (counts[k][own] for k in ("least", "most", "good", "bad"))
                wrong, caught = np.cumsum(good)[:-1], np.cumsum(bad)[:-1]
                may = np.flatnonzero((wrong <= share * good.sum()) & (caught > 5 * wrong))
                if len(may) and good.sum():
                    middle, gap = (least[:-1] + most[1:]) / 2, least[:-1] - most[1:]
                    i = max(may.tolist(), key=lambda i: (caught[i] - 5 * wrong[i], gap[i]))
                    offers.append((-int(caught[i] - 5 * wrong[i]), j, middle[i]))
            for _, j, cutoff in sorted(offers):
                if cutoff < now[j]:
                    now[j] = cutoff
                    chain.append(now.copy())
        out.append(np.array(chain).reshape(-1, kinds))
    return out


def first_rules(statistics: np.ndarray, stratum: np.ndarray, chains: list[np.ndarray]) -> np.ndarray:
    """The place of the first rule of its stratum's chain that rejects each text; the chain's length if none does."""
    out = np.zeros(len(stratum), np.int64)
    for s, chain in enumerate(chains):
        own = np.flatnonzero(stratum == s)
        out[own] = len(chain)
        for r in range(len(chain) - 1, -1, -1):
            out[own[(statistics[own] > chain[r]).any(1)]] = r
    return out


def tested(chains: list[np.ndarray], stratum: np.ndarray, first: np.ndarray, good: np.ndarray, bad: np.ndarray, risk: float, delta: float) -> np.ndarray:
    """cutoffs[stratum, statistic] from the numbers of good and bad holdout texts by stratum and first rule."""
    out = np.full((len(chains), chains[0].shape[1]), np.inf)
    for s, chain in enumerate(chains):
        own = stratum == s
        n = int(good[own].sum())
        passed = []
        for r in range(len(chain)):
            wrong, caught = (int(x[own & (first <= r)].sum()) for x in (good, bad))
            if not n or binomial_tail(wrong, n, risk) > delta / len(chains):
                break
            passed.append((caught - 5 * wrong, -r))
        if passed and max(passed)[0] > 0:
            out[s] = chain[-max(passed)[1]]
    return out


def _measure(key: str, text: str, cutoffs: np.ndarray | None, mode: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [block_counts(b) for b in tb.blocks(batch.column(text))]
            if not parts:
                continue
            counts = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            failed = base_failed(counts)
            if mode == "statistics":
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(counts["n_words"]), pa.array(failed), *(pa.array(counts[k].astype(float)) for k in STATISTICS)], [key, "n_words", "base_failed", *STATISTICS])
                continue
            values = np.stack([counts[k] for k in STATISTICS], 1)
            above = values > cutoffs[np.searchsorted(STRATA, counts["n_words"], "right")]
            kept = ~failed & ~above.any(1)
            if mode == "filter":
                yield batch.filter(pa.array(kept))
                continue
            why = [",".join(STATISTICS[j] for j in np.flatnonzero(row)) for row in above]
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(counts[k]) for k in COUNTS), pa.array(failed), pa.array(kept), pa.array(why)], [key, *COUNTS, "base_failed", "kept", "broken_rules"])

    return run


def _cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.stack([batch.column(k).to_numpy() for k in STATISTICS], 1)
        found = histogram(values, batch.column("n_words").to_numpy(), batch.column("good").to_numpy(zero_copy_only=False).astype(bool), cells(values))
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in found.values()], list(found))


def _rule_counts(chains: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stratum = np.searchsorted(STRATA, batch.column("n_words").to_numpy(), "right")
            first = first_rules(np.stack([batch.column(k).to_numpy() for k in STATISTICS], 1), stratum, chains)
            yield pa.RecordBatch.from_arrays([pa.array(stratum), pa.array(first), batch.column("good")], ["stratum", "first", "good"])

    return run


def fit_cutoffs(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", risk: float = 0.01, delta: float = 0.05) -> np.ndarray:
    """Cutoffs from all labelled rows.

    Texts are measured once, where they stand, and only the numbers are joined with the labels and kept for the
    two steps; a histogram of fixed resolution and counts by rule come to the driver.  Texts that fail the
    base rules take no part."""
    known = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(key).agg((F.min("quality") == 1).alias("good"))
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, n_words long, base_failed boolean, " + ", ".join(f"{k} double" for k in STATISTICS)
    rows = docs.where(F.col(key).isNotNull()).select(key, text).mapInArrow(_measure(key, text, None, "statistics"), schema).where("not base_failed")
    shelf = Shelf(docs.sparkSession)
    rows = shelf.put(rows.join(known, key).select((F.pmod(F.xxhash64(key), F.lit(4)) == 0).alias("proposing"), "good", "n_words", *STATISTICS))
    found = rows.where("proposing").drop("proposing").mapInArrow(_cell_counts, "stratum long, kind long, cell long, least double, most double, good long, bad long")
    got = found.groupBy("stratum", "kind", "cell").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()
    chains = rule_chains({k: got.column(k).to_numpy() for k in got.column_names}, len(STATISTICS))
    held = rows.where("not proposing").drop("proposing").mapInArrow(_rule_counts(chains), "stratum long, first long, good boolean")
    got = held.groupBy("stratum", "first").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).toArrow()
    shelf.drop(rows)
    return tested(chains, *(got.column(k).to_numpy() for k in ("stratum", "first", "good", "bad")), risk, delta)


def judge(docs: DataFrame, cutoffs: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, base verdict, verdict and the statistics above their cutoff, for each row."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, kept boolean, broken_rules string"
    return docs.select(key, text).mapInArrow(_measure(key, text, cutoffs, "judge"), schema)


def keep_good(docs: DataFrame, cutoffs: np.ndarray, text: str = "text") -> DataFrame:
    """The rows that pass, with all their columns; judged where they stand, so nothing is shuffled."""
    return docs.mapInArrow(_measure("", text, cutoffs, "filter"), docs.schema)
