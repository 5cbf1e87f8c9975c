"""Chunks of whole sentences under a token budget, with overlap and exact places."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# White space, marks that end a sentence (those that need white space after them, those that do not), closers.
SPACE = r" \t\n\r\f\x0B"
ENDS, WIDE_ENDS = ".!?؟؛", "。！？"
CLOSERS = "\"'”’»›」』》)]}）】〕〉》"

_CLOSE = "[" + re.escape(CLOSERS) + "]*"
#: What a sentence ends with: a mark and white space, a wide mark, a blank line, or the text's end.
END = rf"[{ENDS}{WIDE_ENDS}]+{_CLOSE}[{SPACE}]+|[{WIDE_ENDS}]+{_CLOSE}|\n[ \t\r\f\x0B]*\n[{SPACE}]*"
#: Parts of a sentence that is over the budget: words with what follows them, long words in pieces.
WORD = rf"[^{SPACE}]{{1,%d}}[{SPACE}]*|[{SPACE}]+"
_END = re.compile(END)
_BLANK, _ASCII = np.zeros(128, bool), np.ones(128, bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_ASCII[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = False
#: White space beyond ASCII, which counts nothing.
_WIDE_BLANK = np.array([0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


def token_sums(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of what counts a quarter token (ASCII) and of what counts a whole one."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    narrow = codes < 128
    quarter = narrow & _ASCII[np.where(narrow, codes, 32)]
    whole = ~narrow if narrow.all() else ~narrow & ~np.isin(codes, _WIDE_BLANK)
    return np.concatenate(([0], np.cumsum(quarter))), np.concatenate(([0], np.cumsum(whole)))


def sentence_ends(text: str) -> list[int]:
    """Where the sentences of a text end; the last ends with the text."""
    ends = [m.end() for m in _END.finditer(text)]
    return ends if ends and ends[-1] == len(text) or not text else [*ends, len(text)]


def pieces(text: str, most: int) -> tuple[list[int], list[int], list[int]]:
    """Bounds of the pieces that are packed, and the two prefix sums there: sentences, or the words of one over the budget."""
    quarter, whole = token_sums(text)
    word, bounds = re.compile(WORD % most), [0]
    for end in sentence_ends(text):
        start = bounds[-1]
        over = (quarter[end] - quarter[start] + 3) // 4 + whole[end] - whole[start] > most
        bounds += [m.end() for m in word.finditer(text, start, end)] if over else [end]
    return bounds, quarter[bounds].tolist(), whole[bounds].tolist()


def packed(text: str, most: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the chunks of a text; see sentence_chunks."""
    bounds, quarter, whole = pieces(text, most)
    tokens = lambda i, j: (quarter[j] - quarter[i] + 3) // 4 + whole[j] - whole[i]
    out, first, last, n = [], 0, 0, len(bounds) - 1
    while last < n:
        end = bisect_right(range(n + 1), most, lo=last + 1, key=lambda j: tokens(first, j)) - 1
        out.append((bounds[first], bounds[end], tokens(first, end)))
        before, last = first, end
        # the longest tail within the overlap that leaves room for the next piece
        first = bisect_left(range(end), True, lo=before + 1, key=lambda i: tokens(i, end) <= overlap and (end == n or tokens(i, end + 1) <= most))
        first = min(first, end)
    return out


def sentence_chunks(docs: DataFrame, most: int = 300, overlap: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, chunk_index, prev_index, next_index, char_start, char_end, n_tokens, text.

    A chunk has as many whole sentences as fit `most` estimated tokens; the next one begins with the sentences at
    its end that have up to `overlap` tokens, if at least one new sentence still fits behind them.  A sentence over
    the budget is packed by its words, and a word with more than `most` characters by pieces of it, so no
    chunk is over the budget.  Chunks are exact slices and cover their text.  Null and empty texts have none; rows of
    one key are cut one by one; other columns are not read."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "chunk_index", "prev_index", "next_index", "char_start", "char_end", "n_tokens", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0

            def out() -> pa.RecordBatch:
                columns = list(zip(*rows, strict=True))
                return pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), *(pa.array(c, pa.int64()) for c in columns[1:7]), pa.array(columns[7], pa.string())], names)

            for row_key, value in zip(batch.column(0), batch.column(1), strict=True):
                body = value.as_py()
                if not body:
                    continue
                chunks = packed(body, most, overlap)
                for i, (start, end, n) in enumerate(chunks):
                    rows.append((row_key.as_py(), i, i - 1 if i else None, i + 1 if i + 1 < len(chunks) else None, start, end, n, body[start:end]))
                size += len(body)
                if size > 4_000_000:
                    yield out()
                    rows, size = [], 0
            if rows:
                yield out()

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, chunk_index long, prev_index long, next_index long, char_start long, char_end long, n_tokens long, text string")
