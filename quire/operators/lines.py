"""Lines with offsets, and predicates on lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from quire.functions.text import line_key, matches, strip

# Chinese characters, what ends a prose line, and lines of decoration alone.
CHINESE = r"[\u4e00-\u9fff]"
TERMINAL = "[.!?。！？]$"
DECORATION = r"^[-_=~*#\s]+$"
#: Ten words, found without counting the others; nothing is tried twice.
TEN_WORDS = "(?<![A-Za-z0-9])(?:[A-Za-z0-9]++[^A-Za-z0-9]++){9}[A-Za-z0-9]"
#: Lines that leave a task at once.
LINES_AT_ONCE = 50_000


def explode_lines(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, more columns, line_no, line, char_start and char_end (code points, end without the line break).

    A row is one text: its lines and offsets are made where it is, in Arrow batches, so texts are not shuffled."""
    own = ["doc_id", *more]
    schema = StructType([*(docs.schema[c] for c in own), *(StructField(*x) for x in (("line_no", IntegerType()), ("line", StringType()), ("char_start", LongType()), ("char_end", LongType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, at = pc.split_pattern(batch.column(len(own)), "\n"), 0
            counts = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(counts)
            while at < len(batch):  # a few texts at a time, so that batches stay small however many lines there are
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LINES_AT_ONCE, "right")))
                some, n = parts.slice(at, to - at), counts[at:to]
                line = some.flatten()
                size = pc.utf8_length(line).to_numpy(zero_copy_only=False).astype(np.int64)
                past = np.concatenate(([0], np.cumsum(size + 1)))
                first = np.cumsum(n) - n  # of each text, among these lines
                start = past[:-1] - np.repeat(past[first], n)
                number = np.arange(len(line)) - np.repeat(first, n)
                rows = pa.array(np.repeat(np.arange(at, to), n), pa.int64())
                kept = [batch.column(i).take(rows) for i in range(len(own))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(number, pa.int32()), line, pa.array(start), pa.array(start + size)], schema.names)
                at = to

    return docs.select(*own, "text").mapInArrow(run, schema)


def is_prose(line: Column) -> Column:
    """Body prose: long and ended like a sentence; in Latin script 60 characters and ten words, with Chinese characters 25."""
    text = strip(line)
    long = F.when(text.rlike(CHINESE), F.length(text) >= 25).otherwise((F.length(text) >= 60) & text.rlike(TEN_WORDS))
    return text.rlike(TERMINAL) & long


def is_heading_like(line: Column) -> Column:
    """No prose; at most twelve words and 90 characters or, with Chinese characters, at most 32 characters."""
    text, words = strip(line), matches(line, r"[A-Za-zÀ-ÖØ-öø-ÿ0-9]+")
    return ~is_prose(line) & F.when(text.rlike(CHINESE), F.length(text) <= 32).otherwise(words.between(1, 12) & (F.length(text) <= 90))


def is_meaningful(line: Column) -> Column:
    """Prose, or 40 characters (20 if Chinese) or eight words, and not decoration alone."""
    text = strip(line)
    long = F.when(text.rlike(CHINESE), F.length(text) >= 20).otherwise((F.length(text) >= 40) | (matches(text, "[A-Za-z0-9]+") >= 8))
    return (F.length(text) > 0) & ~text.rlike(DECORATION) & (is_prose(line) | long)


def prose_follows(lines: DataFrame, window: int = 3) -> DataFrame:
    """Adds whether prose stands in the next lines."""
    ahead = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(1, window)
    return lines.withColumn("prose_follows", F.coalesce(F.max(is_prose(F.col("line"))).over(ahead), F.lit(False)))


def evidence_lines(lines: DataFrame, most: int = 60, longest: int = 90) -> DataFrame:
    """The first distinct short lines of a document: doc_id, place, line.

    At most `most` rows of a document by definition of the report."""
    short = lines.withColumn("line", strip(F.col("line"))).where((F.length("line") > 0) & (F.length("line") <= longest))
    first = short.groupBy("doc_id", line_key(F.col("line")).alias("key")).agg(F.min(F.struct("line_no", "line")).alias("one")).select("doc_id", "one.line_no", "one.line")
    order = Window.partitionBy("doc_id").orderBy("line_no")
    return first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("doc_id", "place", "line_no", "line")
