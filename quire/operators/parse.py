"""Sections of a text from end to end: body start, headings, parts as containers, weak headings where there are no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.body import body_start, is_weak
from quire.operators.structure import heading_flags, role


def sections(docs: DataFrame, signals: list[str], least: int = 2) -> DataFrame:
    """doc_id, section_id, section_index, title, level, container, section_role, char_start, char_end, content.

    Sections run from heading to heading, from the body's start to the text's end; what lies before the body is left out.  A part
    that holds nothing but a chapter is no section: its title is the container of that chapter and of all sections
    after it, up to the next such part.  Before the first heading there is a section without a title, unless nothing but parts'
    lines and other short lines stand there.  A body without headings is cut at `least` or more weak ones, or is one section.
    A null text has no sections, an empty one has one; rows that share an id are taken for one text."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    running, own = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("doc_id")
    texts = docs.where("text is not null")
    start = body_start(texts).select("doc_id", F.col("char_start").alias("start"))
    lines = heading_flags(texts).join(start, "doc_id").where("char_start >= start")
    blank, strong = F.col("title") == "", F.col("level").isNotNull()
    lines = lines.withColumn("alone", F.coalesce(F.lag(blank).over(order), F.lit(True)) & F.coalesce(F.lead(blank).over(order), F.lit(True)))
    lines = lines.withColumn("weak", F.coalesce(~strong & F.col("alone") & is_weak(F.col("title"), signals), F.lit(False)))
    lines = lines.withColumn("said", F.sum(F.when(F.col("meaningful") & ~strong, 1).otherwise(0)).over(running)).withColumn("before", F.sum(F.when(F.col("meaningful") | F.col("prose"), 1).otherwise(0)).over(running))
    lines = lines.withColumn("n_strong", F.count_if(strong).over(own)).withColumn("n_weak", F.count_if("weak").over(own))
    marks = lines.where(strong | ((F.col("n_strong") == 0) & (F.col("n_weak") >= least) & F.col("weak")))
    shell = (F.col("worded") == "part") & (F.lead("worded").over(order) == "chapter") & (F.lead("said").over(order) == F.col("said"))
    marks = marks.withColumn("shell", F.coalesce(shell, F.lit(False)))
    marks = marks.withColumn("container", F.last(F.when(F.lag("shell").over(order), F.lag("title").over(order)), ignorenulls=True).over(running)).where("not shell")
    heads = marks.select("doc_id", "char_start", "title", F.coalesce("level", F.lit(1)).alias("level"), "container", "region", F.when(strong & (F.col("before") - F.when(F.col("meaningful") | F.col("prose"), 1).otherwise(0) == 0), True).alias("opens"))
    lead = start.select("doc_id", F.col("start").alias("char_start"), *(F.lit(None).cast(t).alias(n) for n, t in (("title", "string"), ("level", "int"), ("container", "string"), ("region", "string"), ("opens", "boolean"))))
    # the section before the first heading goes where that heading stands at the body's start or opens it
    place = Window.partitionBy("doc_id").orderBy("char_start", F.col("title").isNotNull())
    rows = lead.unionByName(heads).withColumn("next", F.lead("char_start").over(place)).withColumn("next_opens", F.lead("opens").over(place))
    rows = rows.where(F.col("title").isNotNull() | F.col("next").isNull() | ((F.col("next") > F.col("char_start")) & F.col("next_opens").isNull()))
    rows = rows.withColumn("section_index", (F.row_number().over(place) - 1).cast("long")).join(texts.select("doc_id", "text"), "doc_id")
    end = F.coalesce("next", F.length("text")).cast("long")
    content = F.substring("text", (F.col("char_start") + 1).cast("int"), (end - F.col("char_start")).cast("int"))
    share = F.col("char_start") / F.greatest(F.lit(1), F.length("text"))
    return rows.select("doc_id", F.concat(F.lit("section-"), F.col("section_index")).alias("section_id"), "section_index", "title", F.coalesce("level", F.lit(1)).alias("level"), "container", role(F.col("region"), share).alias("section_role"), F.col("char_start").cast("long").alias("char_start"), end.alias("char_end"), content.alias("content"))
