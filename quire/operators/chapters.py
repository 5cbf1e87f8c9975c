"""Chapters of flat sections: which section opens one, and which it belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import strip

# Titles of chapters and of their subsections, and the names of special chapters.
CHAPTER = r"(?iU)^(chapter|chap\.)\s+([0-9]+|[ivxlcdm]+|one|two|three|four|five|six|seven|eight|nine|ten)\b|^第[一二三四五六七八九十百千万两兩〇零0-9]+章\b"
SUBSECTION = r"(?U)^[0-9]+(\.[0-9]+)+\b|^第[一二三四五六七八九十百千万两兩〇零0-9]+(节|節|部|篇)\b"
LABELS = {"front_matter": "Front Matter", "toc": "Table of Contents", "appendix": "Appendix", "back_matter": "Back Matter", "unknown_region": "Other Sections"}


def chapter_table(sections: DataFrame) -> DataFrame:
    """sections (doc_id, section_index, title, level, section_role, ...) with chapter_id, chapter_title, chapter_level, chapter_role,
    legacy_key, section_kind and is_implicit.

    A section of the main body (no role counts as it) opens a chapter if its title says so, if none is open, or if it is no subsection by
    its title and no deeper than the open chapter; else it belongs to that.  All others go to special chapters by
    role, which take sections of one role that follow one another and close the open chapter.

    No fold is needed: between two titles that open a chapter, or from a special section on, the open chapter's level is the least
    level so far of the sections that are no subsections, so a section opens a chapter if its level is no higher than that.  All
    windows share the document's partitioning.  Levels below 1, and null ones, count as 1."""
    order = Window.partitionBy("doc_id").orderBy("section_index")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    title = F.coalesce(strip(F.col("title")), F.lit(""))
    role = F.coalesce("section_role", F.lit("main_body"))
    rows = sections.withColumn("_level", F.greatest(F.lit(1), F.coalesce("level", F.lit(1)))).withColumn("_role", F.when(role == "main_body", role).when(role.isin(list(LABELS)), role).otherwise("unknown_region"))
    main = F.col("_role") == "main_body"
    changed = ~F.lag("_role").over(order).eqNullSafe(F.col("_role"))
    starts = changed | (main & title.rlike(CHAPTER))
    rows = rows.withColumn("_starts", starts).withColumn("_run", F.sum(F.when(F.col("_starts"), 1).otherwise(0)).over(so_far)).withColumn("_under", title.rlike(SUBSECTION))
    before = Window.partitionBy("doc_id", "_run").orderBy("section_index").rowsBetween(Window.unboundedPreceding, -1)
    least = F.min(F.when(F.col("_starts") | ~F.col("_under"), F.col("_level"))).over(before)
    rows = rows.withColumn("_opens", F.col("_starts") | (main & ~F.col("_under") & (F.col("_level") <= least)))
    rows = rows.withColumn("_place", F.sum(F.when(F.col("_opens"), 1).otherwise(0)).over(so_far) - 1)
    kind = Window.partitionBy("doc_id", "_role").orderBy("section_index").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_nth", F.sum(F.when(F.col("_opens"), 1).otherwise(0)).over(kind) - 1)
    chapter = Window.partitionBy("doc_id", "_place")
    first = chapter.orderBy("section_index")
    headed = title.rlike(CHAPTER)
    named = F.when(headed, F.col("title")).otherwise(F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Main Body "), F.col("_place") + 1)))
    label = F.coalesce(*(F.when(F.col("_role") == k, v) for k, v in LABELS.items()))
    opener = lambda value: F.first(value).over(first)
    rows = rows.withColumn("chapter_id", F.when(main, F.concat(F.lit("chapter-"), "_place")).otherwise(F.concat(F.translate("_role", "_", "-"), F.lit("-"), "_nth")))
    rows = rows.withColumn("chapter_title", opener(F.when(main, named).otherwise(label))).withColumn("chapter_level", opener(F.col("_level")))
    rows = rows.withColumn("chapter_role", opener(F.when(main & headed, F.col("section_role")).otherwise(F.col("_role"))))
    rows = rows.withColumn("legacy_key", F.concat(F.lit("chapter::"), strip(F.col("chapter_title"))))
    rows = rows.withColumn("section_kind", F.when(~main, F.coalesce("section_role", F.lit("unknown_region"))).when(F.col("_opens"), "chapter_body").otherwise("subsection"))
    rows = rows.withColumn("is_implicit", main & F.col("_opens") & (F.count("*").over(chapter) == 1))
    return rows.drop("_level", "_role", "_starts", "_run", "_under", "_opens", "_place", "_nth")


def is_chapter_title(title: Column) -> Column:
    return F.coalesce(strip(title).rlike(CHAPTER), F.lit(False))
