"""Structured documents as nested records and as four flat tables; a reader for records of any age, and what it could not read."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.functions.text import blank_to_null
from quire.operators.chapters import chapter_table

UNIT = "struct<unit_id:string,title:string,content:string>"
SECTION = f"struct<section_id:string,title:string,level:int,content:string,char_start:long,char_end:long,section_role:string,task_units:array<{UNIT}>>"
CHAPTER = f"struct<chapter_id:string,title:string,level:int,sections:array<{SECTION}>>"
NODE = "struct<node_id:string,node_type:string,title:string,level:int,content:string,char_start:long,char_end:long,section_role:string>"
RECORD = f"document_id string, title string, language string, raw_text string, chapters array<{CHAPTER}>, sections array<{SECTION}>, structure_nodes array<{NODE}>, _bad string"
REQUIRED = ("document_id", "title", "raw_text")


class Tables(NamedTuple):
    """Documents, and what stands in them, with `place` for the order in its parent."""

    documents: DataFrame
    chapters: DataFrame
    sections: DataFrame
    units: DataFrame


def flatten(nested: DataFrame) -> Tables:
    """The four tables of nested documents (document_id, title, language, raw_text, chapters)."""
    chapters = nested.select("document_id", F.posexplode("chapters").alias("place", "c"))
    sections = chapters.select("document_id", F.col("c.chapter_id").alias("chapter_id"), F.posexplode("c.sections").alias("place", "s"))
    units = sections.select("document_id", F.col("s.section_id").alias("section_id"), F.posexplode("s.task_units").alias("place", "u"))
    return Tables(
        nested.select("document_id", "title", "language", "raw_text"),
        chapters.select("document_id", "place", "c.chapter_id", "c.title", "c.level"),
        sections.select("document_id", "chapter_id", "place", "s.section_id", "s.title", "s.level", "s.content", "s.char_start", "s.char_end", "s.section_role"),
        units.select("document_id", "section_id", "place", "u.unit_id", "u.title", "u.content"),
    )


def assemble(tables: Tables) -> DataFrame:
    """document_id, title, language, raw_text, chapters (ordered, with their sections and these with their units) and orphans
    (kind, id: rows whose parent is not there, and rows that repeat an id of their document after the first).

    The four tables are dealt by document once, as one; units then gather at their sections, these at their chapters and
    these at their document by grouping that needs no other shuffle.  A document that is only named by orphans has a
    row without a title.  Equal places are ordered by id."""
    empty = lambda kind: F.lit(None).cast(kind)
    unit, section, chapter = (f"struct<place:int,id:string,x:{x}>" for x in (UNIT, "struct<title:string,level:int,content:string,char_start:long,char_end:long,section_role:string>", "struct<title:string,level:int>"))
    document = "struct<title:string,language:string,raw_text:string>"

    def rows(df: DataFrame, level: int, key: str | None, parent: str | None, **own: F.Column) -> DataFrame:
        kinds = {"unit": unit, "section": section, "chapter": chapter, "document": document}
        return df.select(F.col("document_id"), F.lit(level).alias("level"), (F.col(key) if key else F.lit("")).alias("key"), (F.col(parent) if parent else F.lit("")).alias("parent"), *(own[k].cast(t).alias(k) if k in own else empty(t).alias(k) for k, t in kinds.items()))

    here = lambda id_, x: F.struct(F.col("place").cast("int").alias("place"), F.col(id_).alias("id"), x.alias("x"))
    parts = [
        rows(tables.units, 1, "section_id", None, unit=here("unit_id", F.struct("unit_id", "title", "content"))),
        rows(tables.sections, 1, "section_id", "chapter_id", section=here("section_id", F.struct("title", "level", "content", "char_start", "char_end", "section_role"))),
        rows(tables.chapters, 2, "chapter_id", None, chapter=here("chapter_id", F.struct("title", "level"))),
        rows(tables.documents, 3, None, None, document=F.struct("title", "language", "raw_text")),
    ]
    one = parts[0]
    for part in parts[1:]:
        one = one.unionByName(part)
    one = one.repartition("document_id")
    none, known = F.array().cast("array<struct<kind:string,id:string>>"), lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x["id"].alias("id"))
    listed = lambda c: F.array_sort(F.collect_list(c))
    # sections with their units
    got = one.groupBy("document_id", "level", "key").agg(listed("unit").alias("units"), listed(F.when(F.col("section").isNotNull(), F.struct("section", "parent"))).alias("own"), listed("chapter").alias("chapter"), F.first("document", ignorenulls=True).alias("document"))
    first = F.get("own", F.lit(0))
    got = got.withColumn("lost", F.when(F.col("level") == 1, F.concat(F.when(first.isNull(), F.transform("units", known("unit"))).otherwise(none), F.transform(F.slice("own", F.lit(2), F.greatest(F.lit(0), F.size("own") - 1)), lambda x: F.struct(F.lit("repeated_section").alias("kind"), x["section"]["id"].alias("id"))))).otherwise(none))
    s = first["section"]
    full = F.when(s.isNotNull(), F.struct(s["place"].alias("place"), s["id"].alias("id"), F.struct(s["id"].alias("section_id"), *(s["x"][n].alias(n) for n in ("title", "level", "content", "char_start", "char_end", "section_role")), F.transform("units", lambda u: u["x"]).alias("task_units")).alias("x")))
    got = got.select("document_id", F.when(F.col("level") == 3, 3).otherwise(2).alias("level"), F.when(F.col("level") == 1, F.coalesce(first["parent"], F.lit(""))).otherwise(F.col("key")).alias("key"), full.alias("section"), "chapter", "document", "lost")
    # chapters with their sections
    got = got.groupBy("document_id", "level", "key").agg(listed("section").alias("sections"), F.flatten(F.collect_list("chapter")).alias("own"), F.first("document", ignorenulls=True).alias("document"), F.flatten(F.collect_list("lost")).alias("lost"))
    first = F.get("own", F.lit(0))
    more = F.transform(F.slice("own", F.lit(2), F.greatest(F.lit(0), F.size("own") - 1)), known("repeated_chapter"))
    full = F.when(first.isNotNull(), F.struct(first["place"].alias("place"), first["id"].alias("id"), F.struct(first["id"].alias("chapter_id"), first["x"]["title"].alias("title"), first["x"]["level"].alias("level"), F.transform("sections", lambda x: x["x"]).alias("sections")).alias("x")))
    got = got.select("document_id", full.alias("chapter"), "document", F.concat("lost", more, F.when(first.isNull(), F.transform("sections", known("section"))).otherwise(none)).alias("lost"))
    # documents with their chapters
    got = got.groupBy("document_id").agg(listed("chapter").alias("chapters"), F.first("document", ignorenulls=True).alias("d"), F.flatten(F.collect_list("lost")).alias("lost"))
    lost = F.when(F.col("d").isNull(), F.concat("lost", F.transform("chapters", known("chapter")))).otherwise(F.col("lost"))
    return got.select("document_id", "d.*", F.transform("chapters", lambda c: c["x"]).alias("chapters"), F.array_sort(lost).alias("orphans"))


def read_records(spark: SparkSession, path: str) -> tuple[Tables, DataFrame]:
    """The four tables of the records (JSON, one a line) in a folder, whatever their form, and what could not be read: file, reason, record.

    Records with chapters are taken as they are; flat sections, or else a list of nodes, are given chapters; a record with text alone
    is one section.  A record is unreadable if it is no JSON object of these forms, or without a document_id, title or
    raw_text.  Blank lines are no records; every other line is in one of the two results."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("record")).where(blank_to_null(F.col("record")).isNotNull())
    rows = lines.withColumn("r", F.from_json("record", StructType.fromDDL(RECORD), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    missing = F.coalesce(*(F.when(blank_to_null(F.col(f"r.{n}")).isNull() if n != "raw_text" else F.col("r.raw_text").isNull(), F.lit(f"missing_{n}")) for n in REQUIRED))
    rows = rows.withColumn("reason", F.when(F.col("r._bad").isNotNull() | F.col("r").isNull(), "malformed").otherwise(missing))
    good = rows.where("reason is null").select("r.*").drop("_bad")
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    nested = flatten(good.where(some("chapters")))
    node = lambda n: F.struct(n["node_id"].alias("section_id"), *(n[k].alias(k) for k in ("title", "level", "content", "char_start", "char_end", "section_role")), F.array().cast(f"array<{UNIT}>").alias("task_units"))
    whole = F.array(F.struct(F.lit("section-0").alias("section_id"), F.lit(None).cast("string").alias("title"), F.lit(1).alias("level"), F.col("raw_text").alias("content"), F.lit(0).cast("long").alias("char_start"), F.length("raw_text").cast("long").alias("char_end"), F.lit("main_body").alias("section_role"), F.array().cast(f"array<{UNIT}>").alias("task_units")))
    parts = F.when(some("sections"), F.col("sections")).when(some("structure_nodes"), F.transform("structure_nodes", node)).otherwise(whole)
    older = good.where(~some("chapters")).withColumn("parts", parts)
    flat = older.select("document_id", F.posexplode("parts").alias("section_index", "s")).select("document_id", "section_index", "s.*")
    placed = chapter_table(flat.withColumnRenamed("document_id", "doc_id")).withColumnRenamed("doc_id", "document_id")
    sections = placed.select("document_id", "chapter_id", F.col("section_index").alias("place"), "section_id", "title", "level", "content", "char_start", "char_end", "section_role")
    chapters = placed.groupBy("document_id", "chapter_id").agg(F.min("section_index").alias("place"), F.min_by("chapter_title", "section_index").alias("title"), F.min_by("chapter_level", "section_index").alias("level"))
    units = flat.select("document_id", "section_id", F.posexplode("task_units").alias("place", "u")).select("document_id", "section_id", "place", "u.*")
    made = Tables(
        nested.documents.unionByName(older.select("document_id", "title", "language", "raw_text")),
        nested.chapters.unionByName(chapters.select("document_id", "place", "chapter_id", "title", "level")),
        nested.sections.unionByName(sections),
        nested.units.unionByName(units),
    )
    return made, rows.where("reason is not null").select("file", "reason", "record")
