"""Lookups in the hierarchy document, chapter, section, unit, and its validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import strip


def section_by_id(sections: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, section_id, found (rows) and status: found, missing or ambiguous."""
    n = sections.groupBy("doc_id", "section_id").agg(F.count("*").alias("n"))
    rows = wanted.join(n, ["doc_id", "section_id"], "left")
    return rows.select("doc_id", "section_id", F.coalesce("n", F.lit(0)).alias("found"), F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("found").alias("status"))


def chapter_target(chapters: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, target, chapter_id and status of a chapter named by its id or, failing that, its title."""
    by_id = chapters.select("doc_id", F.col("chapter_id").alias("target"), F.col("chapter_id").alias("own"))
    by_title = chapters.where("title is not null").groupBy("doc_id", strip(F.col("title")).alias("target")).agg(F.count("*").alias("n"), F.min("chapter_id").alias("titled"))
    rows = wanted.join(by_id, ["doc_id", "target"], "left").join(by_title, ["doc_id", "target"], "left")
    status = F.when(F.col("own").isNotNull(), "by_id").when(F.col("n") == 1, "by_title").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return rows.select("doc_id", "target", F.when(F.col("n") > 1, F.col("own")).otherwise(F.coalesce("own", "titled")).alias("chapter_id"), status.alias("status"))


def chapter_body(sections: DataFrame) -> DataFrame:
    """The section that stands for each chapter: its body, else its first one."""
    order = Window.partitionBy("doc_id", "chapter_seq").orderBy(F.when(F.col("section_kind") == "chapter_body", 0).otherwise(1), "section_index")
    return sections.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def section_kinds(sections: DataFrame) -> DataFrame:
    """Adds section_kind and is_implicit: a chapter's first section is its body, implicit if it is the only one."""
    own = Window.partitionBy("doc_id", "chapter_seq")
    rows = sections.withColumn("first", F.min("section_index").over(own)).withColumn("size", F.count("*").over(own))
    body = F.col("section_index") == F.col("first")
    return rows.withColumn("section_kind", F.when(body, "chapter_body").otherwise("subsection")).withColumn("is_implicit", body & (F.col("size") == 1)).drop("first", "size")


def unit_sections(units: DataFrame, sections: DataFrame) -> DataFrame:
    """Units joined with each section they come from, once."""
    ids = units.select("doc_id", "unit_id", F.explode(F.array_distinct("source_section_ids")).alias("section_id"))
    return ids.join(sections.select("doc_id", "section_id", "section_index"), ["doc_id", "section_id"])


def task_mode(sections: DataFrame, units: DataFrame) -> DataFrame:
    """doc_id, section_id, task_mode of each section by the units (doc_id, unit_id, source_section_ids) that have it.

    No unit: direct; a unit of several sections: merged; several units: split; one unit of this section alone: direct."""
    own = units.select("doc_id", "unit_id", F.size("source_section_ids").alias("sources"), F.explode(F.array_distinct("source_section_ids")).alias("section_id"))
    own = own.groupBy("doc_id", "section_id").agg(F.max("sources").alias("most"), F.count("*").alias("n"))
    mode = F.when(F.col("n").isNull(), "direct").when(F.col("most") > 1, "merged").when(F.col("n") > 1, "split").otherwise("direct")
    return sections.select("doc_id", "section_id").join(own, ["doc_id", "section_id"], "left").select("doc_id", "section_id", mode.alias("task_mode"))


def validate(chapters: DataFrame, sections: DataFrame, units: DataFrame) -> DataFrame:
    """doc_id, warning, subject, n: what is wrong with a document's hierarchy.

    Chapters have chapter_id; sections stand in one (chapter_id) and name one (parent_chapter_id), or in none, which is
    the old form; units stand in a section (section_id) and name one (parent_section_id) or none.  Each repeated id
    warns once for every row after its first."""

    def repeated(rows: DataFrame, key: str, warning: str) -> DataFrame:
        return rows.groupBy("doc_id", F.col(key).alias("subject")).agg((F.count("*") - 1).alias("n")).where("n > 0").select("doc_id", F.lit(warning).alias("warning"), "subject", "n")

    placed = sections.where("chapter_id is not null")
    parent = placed.where(~F.col("parent_chapter_id").eqNullSafe(F.col("chapter_id"))).groupBy("doc_id", F.col("section_id").alias("subject")).agg(F.count("*").alias("n")).select("doc_id", F.lit("section_parent_mismatch").alias("warning"), "subject", "n")
    strayed = units.where("parent_section_id is not null and parent_section_id <> section_id").groupBy("doc_id", F.col("unit_id").alias("subject")).agg(F.count("*").alias("n")).select("doc_id", F.lit("task_unit_parent_section_mismatch").alias("warning"), "subject", "n")
    old = sections.groupBy("doc_id").agg(F.count_if(F.col("chapter_id").isNull()).alias("legacy")).where("legacy > 0")
    old = old.join(chapters.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.lit("legacy_sections_present").alias("warning"), F.lit("").alias("subject"), F.lit(1).cast("long").alias("n"))
    out = [repeated(chapters, "chapter_id", "duplicate_chapter_id"), repeated(placed, "section_id", "duplicate_hierarchy_section_id"), parent, strayed, repeated(units, "unit_id", "duplicate_task_unit_id"), old]
    return reduce(DataFrame.union, out)


def replace_sections(sections: DataFrame, changed: DataFrame) -> DataFrame:
    """sections with the content of those that changed, by id."""
    new = changed.select("doc_id", "section_id", F.col("content").alias("new"))
    return sections.join(new, ["doc_id", "section_id"], "left").withColumn("content", F.coalesce("new", "content")).drop("new")
