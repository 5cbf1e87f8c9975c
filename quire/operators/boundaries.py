"""Candidate cuts of texts: the snippets around them, their semantic scores, and whether sections make a whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quire.functions.text import SPACES, cosine, strip

#: Cuts that leave a task at once.
CUTS_AT_ONCE = 5_000


def snippets(docs: DataFrame, places: Column, near: int = 220, wide: int = 700, least: int = 12) -> DataFrame:
    """doc_id, char_start, tail, head, before, after: what stands next to and around each cut, without white space at its ends.

    Cuts at the start, at the end and outside fall out, as do those with a snippet of fewer than `least` characters;
    null texts and null places have no rows.  Snippets are cut in Arrow batches, where a place costs the same wherever it is in a text."""
    near = max(40, near)
    wide = max(near, wide)
    sides = ("tail", "head", "before", "after")
    schema = StructType([docs.schema["doc_id"], StructField("char_start", LongType()), *(StructField(side, StringType()) for side in sides)])

    def cut(text: str | None, places: list[int | None] | None) -> Iterator[tuple]:
        for at in places or () if text is not None else ():
            if at is not None and 0 < at < len(text):
                own = [x.strip(SPACES) for x in (text[max(at - near, 0) : at], text[at : at + near], text[max(at - wide, 0) : at], text[at : at + wide])]
                if min(map(len, own)) >= least:
                    yield at, *own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, rows = [], []
            for i, (text, places) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                for one in cut(text.as_py(), places.as_py()):
                    found.append(one)
                    rows.append(i)
                    if len(found) == CUTS_AT_ONCE:
                        yield made(batch, rows, found)
                        found, rows = [], []
            if found:
                yield made(batch, rows, found)

    def made(batch: pa.RecordBatch, rows: list[int], found: list[tuple]) -> pa.RecordBatch:
        start, *texts = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(start, pa.int64()), *(pa.array(x, pa.string()) for x in texts)], schema.names)

    return docs.select("doc_id", "text", places.alias("_places")).mapInArrow(run, schema)


def semantic_scores(sides: DataFrame, embed: Callable[[Column], Column], weight: float = 1.0) -> DataFrame:
    """doc_id, char_start, score: high where the wider context changes and the text next to the cut does not go on.

    `embed` makes a vector of a text; vectors that are missing, zero or of another length count as unlike (cosine 0)."""
    vectors = sides.select("doc_id", "char_start", *(embed(F.col(side)).alias(side) for side in ("tail", "head", "before", "after")))
    shift = 1 - cosine(F.col("before"), F.col("after"))
    return vectors.select("doc_id", "char_start", (weight * (shift - cosine(F.col("tail"), F.col("head")))).alias("score"))


def whole(sections: DataFrame, docs: DataFrame, least: int = 2) -> DataFrame:
    """doc_id, accepted: whether the sections (section_index, char_start, char_end) of a document lie in order within its
    text, none empty, none over another, the last up to its end, and `least` of them with more than white space.

    Documents without sections or text are not accepted.  A document's sections are one array."""
    order = F.array_sort(F.collect_list(F.struct("section_index", "char_start", "char_end")))
    # few numbers a document, so these are hashed and the texts need no sort
    rows = docs.select("doc_id", "text").join(sections.groupBy("doc_id").agg(order.alias("parts")).hint("shuffle_hash"), "doc_id", "left")
    return rows.select("doc_id", makes_whole(F.col("parts"), F.col("text"), least).alias("accepted"))


def makes_whole(parts: Column, text: Column, least: int = 2) -> Column:
    """Whether an array of sections (char_start, char_end, ...) in their order makes a whole of a text; see `whole`."""
    size = F.length(text)
    inside = F.forall(parts, lambda x: (x["char_start"] >= 0) & (x["char_end"] <= size) & (x["char_end"] > x["char_start"]))
    after = F.forall(F.arrays_zip(F.slice(parts, F.lit(2), F.size(parts)).alias("b"), F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))).alias("a")), lambda z: z["b"]["char_start"] >= z["a"]["char_end"])
    said = F.filter(parts, lambda x: F.length(strip(F.substring(text, (x["char_start"] + 1).cast("int"), (x["char_end"] - x["char_start"]).cast("int")))) > 0)
    end = F.try_element_at(parts, F.lit(-1))["char_end"] == size
    return F.coalesce((F.size(parts) >= least) & inside & after & (F.size(said) >= least) & end, F.lit(False))
