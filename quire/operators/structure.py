"""Headings, sections, chapters and statistics of the structure."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from quire.functions.text import SPACES, strip
from quire.operators.lines import explode_lines, is_meaningful, is_prose

# Words that number a heading, by language.
CHAPTER = {"en": "chapter|section|lesson|unit", "fr": "chapitre|section", "de": "kapitel|abschnitt", "es": "capítulo|sección"}
PART = {"en": "part|book", "fr": "partie|livre", "de": "teil|buch", "es": "parte|libro"}
REGIONS = {"toc": "contents|table of contents|sommaire|table des matières|inhalt|inhaltsverzeichnis|contenido|índice", "front_matter": "preface|foreword|introduction|prologue|préface|avant-propos|vorwort|einleitung|prolog|prólogo|prefacio|introducción", "appendix": "appendix|appendices|annexe|annexes|anhang|anhänge|apéndice|anexo|anexos", "back_matter": "afterword|epilogue|postscript|postface|épilogue|nachwort|epilog|epílogo|posfacio"}
#: Characters of the longest heading; of the texts that are cut at once.
LONGEST, CHARS_AT_ONCE = 90, 4_000_000
LONGEST_REGION = max(len(w) for words in REGIONS.values() for w in words.split("|")) + 1
NUMBER = "([0-9]+|[ivxlcdm]+|one|two|three|four|five|six|seven|eight|nine|ten)"


def numbered(lang: Column, words: dict[str, str], line: Column) -> Column:
    """A word of the language and its number, with or without a title."""
    out = F.lit(False)
    for code, alternatives in words.items():
        out = F.when(lang == code, line.rlike(f"(?iu)^({alternatives})[ ]+{NUMBER}([ .:].*)?$")).otherwise(out)
    return F.coalesce(out, F.lit(False))


def level_and_region(lang: Column, title: Column) -> tuple[Column, Column, Column]:
    """The level that a title would have as a heading, its region, and what words say that it is (a chapter, a part or null).

    Level 1: a numbered part or a region word; level 2: a numbered chapter or `1.`; level 3: `1.1`."""
    region = F.lit(None).cast("string")
    for role, words in REGIONS.items():
        region = F.when(title.rlike(f"(?iu)^({words})[:.]?$"), role).otherwise(region)
    region = F.when(F.length(title) <= LONGEST_REGION, region)
    chapter, part = numbered(lang, CHAPTER, title), numbered(lang, PART, title)
    level = F.when(chapter, 2).when(part, 1).when(title.rlike(r"^[0-9]+(\.[0-9]+)+[ .].{1,80}$"), 3).when(title.rlike(r"^[0-9]{1,3}\.[ ]+\p{Lu}.{1,80}$"), 2).when(region.isNotNull(), 1)
    return level, region, F.when(chapter, "chapter").when(part, "part")


def heading_flags(docs: DataFrame, *more: str) -> DataFrame:
    """Every line: doc_id, more columns, line_no, char_start, title, level (null if no heading), region, worded (a part, a
    chapter or null, where words say so), prose and meaningful; see level_and_region."""
    lines = explode_lines(docs, "lang", *more)
    title = strip(F.col("line"))
    level, region, worded = level_and_region(F.col("lang"), title)
    fits = (F.length(title) <= LONGEST) & ~is_prose(F.col("line"))
    rows = lines.select("doc_id", *more, "lang", "line_no", "char_start", title.alias("title"), F.when(fits, level).alias("level"), region.alias("region"), worded.alias("worded"), is_prose(F.col("line")).alias("prose"), is_meaningful(F.col("line")).alias("meaningful"))
    return rows.withColumn("worded", F.when(F.col("level").isNotNull(), F.col("worded")))


def marked_texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, more columns and marks: the headings (line_no, char_start, title, level, region) of each text, in an array in their order.

    Lines that are too long to be headings, or blank, fall out where texts are split, and nothing is shuffled."""
    own = ["doc_id", "lang", *more]
    lines = StructType([*(StructField(*x) for x in (("line_no", IntegerType()), ("char_start", LongType()), ("title", StringType())))])
    schema = StructType([*(docs.schema[c] for c in own), StructField("lines", ArrayType(lines))])
    taken = own if "text" in own else [*own, "text"]
    at = taken.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = pc.split_pattern(batch.column(at), "\n")
            n = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            line, before = parts.flatten(), np.cumsum(n) - n
            past = np.concatenate(([0], np.cumsum(pc.utf8_length(line).to_numpy(zero_copy_only=False).astype(np.int64) + 1)))
            title = pc.utf8_trim(line, characters=SPACES)
            size = pc.utf8_length(title).to_numpy(zero_copy_only=False)
            kept = np.flatnonzero((size > 0) & (size <= LONGEST))
            start = past[kept] - np.repeat(past[before], n)[kept]
            found = pa.StructArray.from_arrays([pa.array((np.arange(len(line)) - np.repeat(before, n))[kept].astype(np.int32)), pa.array(start), title.take(pa.array(kept))], ["line_no", "char_start", "title"])
            bounds = np.searchsorted(kept, np.concatenate((before, [len(line)])))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), found)], schema.names)

    def mark(x: Column) -> Column:
        level, region, _ = level_and_region(F.col("lang"), x["title"])
        return F.struct(x["line_no"].alias("line_no"), x["char_start"].alias("char_start"), x["title"].alias("title"), F.when(~is_prose(x["title"]), level).alias("level"), region.alias("region"))

    rows = docs.select(*taken).mapInArrow(run, schema)
    return rows.select("doc_id", *more, F.filter(F.transform("lines", mark), lambda x: x["level"].isNotNull()).alias("marks"))


def headings(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, char_start, title, level and region of the heading lines."""
    # outer, as a filter on the arrays' size, which comes with the inner form, would look for the headings twice
    return marked_texts(docs).select("doc_id", F.inline_outer("marks")).where("char_start is not null")


def role(region: Column, place: Column) -> Column:
    """Front roles stand in the first 45 % of a text, back roles after 60 %; all else is main body."""
    return F.when(region.isin("toc", "front_matter") & (place <= 0.45), region).when(region.isin("appendix", "back_matter") & (place >= 0.60), region).otherwise("main_body")


def sections(docs: DataFrame, content: bool = True) -> DataFrame:
    """Contiguous sections from heading to heading; a text without headings is one section.  Without `content` their texts are not cut."""
    return _cut(docs, content).drop("chapter_seq")


def chaptered_sections(docs: DataFrame, content: bool = True) -> DataFrame:
    """The sections of texts with their chapter_seq, as chapters(sections(docs)) has them, but told where each text is."""
    return _cut(docs, content)


def _cut(docs: DataFrame, content: bool) -> DataFrame:
    """A row is one text with its headings: they become sections where it is, so that neither texts nor sections are shuffled."""
    texts = docs.where("doc_id is not null").withColumn("size", F.length("text"))
    whole = F.struct(F.lit(0).cast("long").alias("char_start"), F.lit(None).cast("string").alias("title"), F.lit(1).alias("level"), F.lit(None).cast("string").alias("region"))
    rows = marked_texts(texts, "text", "size").withColumn("marks", F.transform("marks", lambda x: F.struct(*(x[n].alias(n) for n in ("char_start", "title", "level", "region")))))
    starts = F.when(F.get("marks", F.lit(0))["char_start"] == 0, F.col("marks")).otherwise(F.concat(F.array(whole), F.coalesce("marks", F.array())))
    placed = lambda x: F.struct(*(x[n].alias(n) for n in ("char_start", "title", "level")), role(x["region"], x["char_start"] / F.greatest(F.lit(1), F.col("size"))).alias("section_role"))
    rows = rows.select("doc_id", "text", "size", F.transform(starts, placed).alias("s"))
    opened = lambda x, i: F.struct(*(x[n].alias(n) for n in ("char_start", "title", "level", "section_role")), opens(x, F.get("s", i - 1)).alias("opens"))
    rows = rows.select("doc_id", *(["text"] if content else []), "size", F.transform("s", opened).alias("s"))
    names = ["section_id", "section_index", "title", "level", "char_start", "char_end", "section_role", *(["content"] if content else []), "chapter_seq"]
    kinds = {"level": IntegerType(), **dict.fromkeys(("section_index", "char_start", "char_end", "chapter_seq"), LongType())}
    schema = StructType([docs.schema["doc_id"], *(StructField(n, kinds.get(n, StringType())) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, at, held = batch.column("text") if content else None, 0, 0
            n = pc.list_value_length(batch.column("s")).to_numpy(zero_copy_only=False)
            for to in range(1, len(batch) + 1):  # a few texts at a time, so that batches stay small however long they are
                held += (batch.column("size")[to - 1].as_py() or 0) if content else int(n[to - 1])
                if held > CHARS_AT_ONCE or to == len(batch):
                    yield cut(batch.slice(at, to - at), n[at:to], text.slice(at, to - at) if content else None)
                    at, held = to, 0

    def cut(batch: pa.RecordBatch, n: np.ndarray, texts: pa.Array | None) -> pa.RecordBatch:
        s = batch.column("s").flatten()
        first = np.cumsum(n) - n
        number = np.arange(len(s)) - np.repeat(first, n)
        start, end = s.field("char_start").to_numpy(zero_copy_only=False), np.empty(len(s), object)
        end[:-1] = start[1:]
        end[np.cumsum(n) - 1] = batch.column("size").to_pylist()
        opened = np.cumsum(s.field("opens").to_numpy(zero_copy_only=False))
        chapter = opened - np.repeat(opened[first], n)  # the first section opens a chapter
        out = {"section_id": pa.array([f"section-{i}" for i in number]), "section_index": pa.array(number), "char_end": pa.array(end, pa.int64()), "chapter_seq": pa.array(chapter.astype(np.int64))}
        out |= {k: s.field(k) for k in ("title", "level", "char_start", "section_role")}
        if content:
            spans = iter(zip(start.tolist(), end.tolist(), strict=True))
            out["content"] = pa.array([None if t is None else t[a:b] for t, k in zip(texts.to_pylist(), n.tolist(), strict=True) for a, b in (next(spans) for _ in range(k))], pa.string())
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(batch)), n))), *(out[k] for k in names)], schema.names)

    return rows.mapInArrow(run, schema)


def opens(own: Column, before: Column) -> Column:
    """1 if a section (level, section_role) opens a chapter after the one before it (null for the first), else 0."""
    same_role = (own["section_role"] != "main_body") & (before["section_role"] == own["section_role"])
    return F.when(before["section_role"].isNull(), 1).when(same_role, 0).when((own["level"] <= 2) | (before["section_role"] != own["section_role"]), 1).otherwise(0)


def chapters(parts: DataFrame) -> DataFrame:
    """Adds chapter_seq: a section of level 1 or 2 opens a chapter, deeper ones attach to it, and
    neighbouring sections of one special role share a chapter."""
    order = Window.partitionBy("doc_id").orderBy("section_index")
    own = F.struct("level", "section_role")
    first = opens(own, F.lag(own).over(order))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("opens", first).withColumn("chapter_seq", (F.sum("opens").over(running) - 1).cast("long")).drop("opens")


def structure_stats(parts: DataFrame) -> DataFrame:
    """Counts, coverage and shape of each document's structure.

    A chapter's title is that of its first section; one that comes twice, whatever its case, is a sign of parts.  A
    section is implicit if it is the only one of its chapter."""
    size = F.length("content")
    one = parts.groupBy("doc_id", "chapter_seq").agg(
        F.count("*").alias("n"), F.lower(strip(F.min_by("title", "section_index"))).alias("title"), F.count_if(F.col("section_role") == "main_body").alias("main"),
        F.count_if(F.col("title").isNotNull()).alias("titled"), F.max(size).alias("most"), F.sum(size).alias("chars"),
    )
    rows = one.groupBy("doc_id").agg(
        F.sum("n").alias("n_sections"),
        F.count("*").alias("n_chapters"),
        F.sum("main").alias("n_main"),
        F.count_if(F.col("main") > 0).alias("main_chapters"),
        F.sum("titled").alias("n_titled"),
        F.count_if(F.col("n") == 1).alias("n_implicit"),
        (F.count_if(F.length("title") > 0) > F.count_distinct(F.when(F.length("title") > 0, F.col("title")))).alias("repeated"),
        F.max("most").cast("long").alias("max_chars"),
        (F.sum("chars") / F.sum("n")).alias("avg_chars"),
    )
    # The numbers of the shape rules.
    shape = F.expr("""case when n_sections = 0 then 'unknown'
        when n_chapters <= 1 and n_sections <= 1 then case when max_chars >= 6000 then 'flat_long_text' else 'essay_sections' end
        when n_sections > 100 and avg_chars < 500 then 'over_fragmented'
        when repeated and n_chapters >= 6 and n_sections / n_chapters <= 1.2 then 'part_chapter'
        when main_chapters >= 5 and n_sections / n_chapters <= 1.2 and n_implicit >= greatest(3, floor(n_sections * 0.6)) then 'chapter_only'
        when n_sections / n_chapters >= 2 then 'chapter_section'
        when n_chapters <= 5 and n_sections <= 8 and n_titled / n_sections >= 0.5 then 'essay_sections'
        else 'mixed' end""")
    return rows.select("doc_id", "n_sections", "n_chapters", "n_main", "n_titled", "n_implicit", "max_chars", F.round("avg_chars", 3).alias("avg_chars"), F.round(F.col("n_titled") / F.col("n_sections"), 4).alias("title_coverage"), shape.alias("structure_shape"))


def duplicate_titles(parts: DataFrame) -> DataFrame:
    """Titles that occur twice or more in a document, whatever their case, in their first spelling."""
    titled = parts.where("title is not null")
    return titled.groupBy("doc_id", F.lower("title").alias("key")).agg(F.count("*").alias("n"), F.min_by("title", "section_index").alias("title")).where("n > 1").select("doc_id", "title", "n")


def enhanced_parse_score(parts: DataFrame, texts: DataFrame, ratios: DataFrame | None = None) -> DataFrame:
    """doc_id, score, reasons, recommended: signs that a text should be parsed again; a score of 4 recommends it.

    `ratios` (doc_id, affected_ratio, fallback_ratio, n_units) adds the two signs of its ratios; numbers outside
    0..1 are taken to the nearer end, missing ones as 0."""
    whole = F.col("title").isNull() & (F.col("char_start") == 0)
    stats = parts.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.length(strip(F.col("title"))) > 0).alias("titled"), F.max(F.when(whole, F.col("char_end"))).alias("covered"))
    rows = texts.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("size")).join(stats, "doc_id", "left").na.fill(0, ["n", "titled"])
    if ratios is None:
        rows = rows.select("*", F.lit(0.0).alias("affected"), F.lit(0.0).alias("fallback"), F.lit(0).alias("units"))
    else:
        ratio = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0))))
        rows = rows.join(ratios.select("doc_id", ratio(F.col("affected_ratio")).alias("affected"), ratio(F.col("fallback_ratio")).alias("fallback"), F.col("n_units").alias("units")), "doc_id", "left").na.fill(0, ["affected", "fallback", "units"])
    # Scores and thresholds of the signs.
    signs = {
        "single_fallback_section": ("n = 1 and covered = size", 5),
        "low_title_coverage": ("n >= 3 and titled / n < 0.55", 3),
        "abnormal_section_structure": ("n < 3 or n > 220 or (size >= 2000 and n >= 3 and (size / n < 180 or size / n > 8000))", 3),
        "high_affected_section_ratio": ("n >= 8 and affected > 0.55", 1),
        "high_fallback_task_unit_ratio": ("units >= 8 and fallback > 0.55", 1),
    }
    holds = {name: F.coalesce(F.expr(rule), F.lit(False)) for name, (rule, _) in signs.items()}
    score = sum(F.when(holds[name], points).otherwise(0) for name, (_, points) in signs.items())
    reasons = F.concat_ws(",", *(F.when(holds[name], name) for name in signs))
    return rows.select("doc_id", score.cast("long").alias("score"), reasons.alias("reasons"), (score >= 4).alias("recommended"))
