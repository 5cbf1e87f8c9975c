"""Task units: paragraph packing, sentence-aware cuts, merging of short units."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from quire.functions.text import strip

# Characters that end, and that close, a sentence or clause.
TERMINAL, STRONG, CLAUSE = ".!?。！？؛؟", ";；", ",，:：、"
CLOSERS = "\"'”’»›」』》)]}）】〕〉》"


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph_no, text of the paragraphs between blank lines."""
    parts = F.filter(F.transform(F.split("text", r"\n[ \t\r\f]*\n\s*"), lambda x: strip(x)), lambda x: F.length(x) > 0)
    return docs.select("doc_id", F.posexplode(parts).alias("paragraph_no", "text"))


def pack_lines(docs: DataFrame, most: int = 1600, by: str = "\n") -> DataFrame:
    """doc_id, unit_no, n_chars, text: pieces of a text packed greedily up to `most` characters.

    A fold over the pieces of one text; a longer piece is a unit of its own."""
    start = F.expr("named_struct('done', cast(array() as array<string>), 'open', '')")
    size = len(by)

    def add(state, piece):
        fits = (F.length(state["open"]) == 0) | (F.length(state["open"]) + size + F.length(piece) <= most)
        joined = F.when(F.length(state["open"]) == 0, piece).otherwise(F.concat(state["open"], F.lit(by), piece))
        return F.struct(F.when(fits, state["done"]).otherwise(F.array_append(state["done"], state["open"])).alias("done"), F.when(fits, joined).otherwise(piece).alias("open"))

    pieces = F.filter(F.split("text", by), lambda x: F.length(strip(x)) > 0)
    units = F.aggregate(pieces, start, add, lambda s: F.when(F.length(s["open"]) > 0, F.array_append(s["done"], s["open"])).otherwise(s["done"]))
    rows = docs.select("doc_id", F.posexplode(units).alias("unit_no", "text"))
    return rows.select("doc_id", F.col("unit_no").cast("long").alias("unit_no"), F.length("text").cast("long").alias("n_chars"), "text")


def cut_kind(text: str, at: int) -> int:
    """How good a cut before text[at] is: 4 paragraph, 3 sentence, 2 strong mark, 1 clause, 0 none."""
    left = text[max(0, at - 6) : at]
    if "\n\n" in left + text[at : at + 6] and text[at - 1 : at].isspace():
        return 4
    tail = text[max(0, at - 10) : at].rstrip(" \t\n" + CLOSERS)
    last = tail[-1:]
    if text[at : at + 1] in CLOSERS and at < len(text):
        return 0
    return 3 if last and last in TERMINAL else 2 if last and last in STRONG else 1 if last and last in CLAUSE else 0


MARK = re.compile("([" + re.escape(TERMINAL + STRONG + CLAUSE) + "])[ \\t\\n" + re.escape(CLOSERS) + "]{0,9}")
KIND = {**dict.fromkeys(TERMINAL, 3), **dict.fromkeys(STRONG, 2), **dict.fromkeys(CLAUSE, 1)}


def best_cut(text: str, low: int, high: int, ideal: int) -> int | None:
    """The place of low..high of the best kind (see cut_kind) that is nearest to ideal, the earlier of two; None if
    there is no boundary.  Only places behind a mark or near a blank line are looked at."""
    best, n = None, len(text)

    def offer(kind: int, i: int) -> None:
        nonlocal best
        if best is None or (kind, -abs(i - ideal), -i) > best:
            best = (kind, -abs(i - ideal), -i)

    at = text.find("\n\n", max(0, low - 6), min(n, high + 6))
    while at >= 0:
        for i in range(max(low, at - 4, 1), min(high, at + 6) + 1):
            if text[i - 1].isspace():
                offer(4, i)
        at = text.find("\n\n", at + 1, min(n, high + 6))
    if best is None:
        for m in MARK.finditer(text, max(0, low - 10), min(n, high)):
            for i in range(max(low, m.start() + 1), min(high, m.end(), m.start() + 10) + 1):
                if i >= n or text[i] not in CLOSERS:
                    offer(KIND[m[1]], i)
    return -best[2] if best else None


def progressive_cuts(text: str, least: int, most: int) -> list[int]:
    """Ends of the units of a text: near `most` characters, at the best boundary in a window around it."""
    ends, at, n = [], 0, len(text)
    width = max(60, most // 5)
    while n - at > most:
        ideal = at + most
        low, high = max(at + least, ideal - width), min(n, ideal + width)
        best = best_cut(text, low, high, ideal)
        cut = ideal if best is None else best
        while cut < n and text[cut] in CLOSERS:
            cut += 1
        ends.append(cut)
        at = cut
    if n > at or not ends:
        ends.append(n)
    if len(ends) > 1 and ends[-1] - ends[-2] < least:
        del ends[-2]
    return ends


@F.pandas_udf(ArrayType(IntegerType()))
def _cuts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, least, most in batches:
        yield pd.Series([progressive_cuts(t or "", int(a), int(b)) for t, a, b in zip(texts, least, most, strict=True)])


def progressive_units(docs: DataFrame, least: int = 300, most: int = 1600) -> DataFrame:
    """doc_id, unit_no, char_start, char_end of sentence-aware units.

    The search for cuts depends on each cut before it, so it is an Arrow UDF over whole texts."""
    ends = docs.where(F.length("text") > 0).select("doc_id", _cuts("text", F.lit(least), F.lit(most)).alias("ends"))
    rows = ends.select("doc_id", F.posexplode("ends").alias("unit_no", "char_end"), "ends")
    start = F.when(F.col("unit_no") == 0, 0).otherwise(F.try_element_at("ends", F.greatest(F.lit(1), F.col("unit_no"))))
    return rows.select("doc_id", F.col("unit_no").cast("long").alias("unit_no"), start.cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"))


def merge_short(units: DataFrame, least: int = 300) -> DataFrame:
    """Adds merged_no: units of a document with fewer than `least` characters join a neighbour.

    A short unit joins the next one if both have the same container, else the one closed before if that has, else the
    next one, else the one before.  What it becomes then is measured again, with the two characters that part
    joined texts.  A column `container` is optional; null and blank are one container.  A fold over the units of
    one document."""
    rows = units if "container" in units.columns else units.withColumn("container", F.lit(None).cast("string"))
    unit = F.struct("unit_no", F.col("n_chars").cast("long").alias("n"), F.coalesce(strip(F.col("container")), F.lit("")).alias("box"))
    own = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(unit)).alias("u"))
    group = "struct<first:int,last:int,n:bigint,box:string>"
    start = F.struct(F.expr(f"cast(array() as array<{group}>)").alias("done"), F.lit(None).cast(group).alias("open"))

    def joined(a, b):
        return F.struct(a["first"].alias("first"), b["last"].alias("last"), (a["n"] + 2 + b["n"]).alias("n"), F.when(a["box"] == "", b["box"]).otherwise(a["box"]).alias("box"))

    def add(s, i):
        unit, after = F.get("u", i), F.get("u", i + 1)
        single = F.struct(i.alias("first"), i.alias("last"), unit["n"].alias("n"), unit["box"].alias("box"))
        now = F.when(s["open"].isNull(), single).otherwise(joined(s["open"], single))
        last = F.try_element_at(s["done"], F.lit(-1))
        more, some = i + 1 < F.size("u"), F.size(s["done"]) > 0
        closes = now["n"] >= least
        onward = more & (now["box"] == after["box"])
        back = F.coalesce(some & (now["box"] == last["box"]), F.lit(False))
        act = F.when(closes, "close").when(onward, "carry").when(back, "back").when(more, "carry").when(some, "back").otherwise("close")
        merged = F.concat(F.slice(s["done"], F.lit(1), F.greatest(F.lit(0), F.size(s["done"]) - 1)), F.array(joined(last, now)))
        done = F.when(act == "close", F.array_append(s["done"], now)).when(act == "back", merged).otherwise(s["done"])
        return F.struct(done.alias("done"), F.when(act == "carry", now).alias("open"))

    groups = own.select("doc_id", "u", F.aggregate(F.sequence(F.lit(0), F.size("u") - 1), start, add, lambda s: s["done"]).alias("g"))
    placed = groups.select("doc_id", "u", F.posexplode("g").alias("merged_no", "g"))
    placed = placed.select("doc_id", F.col("merged_no").cast("long").alias("merged_no"), F.explode(F.slice("u", F.col("g.first") + 1, F.col("g.last") - F.col("g.first") + 1)).alias("x"))
    return units.join(placed.select("doc_id", F.col("x.unit_no").alias("unit_no"), "merged_no"), ["doc_id", "unit_no"])


def document_unit_ids(units: DataFrame) -> DataFrame:
    """Adds unit_id, numbered through the document in order of section and unit."""
    order = Window.partitionBy("doc_id").orderBy("section_index", "unit_no")
    return units.withColumn("unit_id", F.concat(F.lit("task-unit-"), F.row_number().over(order) - 1))
