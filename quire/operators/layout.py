"""Units of sections: which section has which, their order and content, and whether what was stored still holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import blank_to_null, strip
from quire.operators.artifacts import differs, validity

# Fixed value: the share of sections with units from which statistics of units count.
COVERED = 0.95


def assign_units(sections: DataFrame, units: DataFrame) -> DataFrame:
    """doc_id, section_id, unit_id, place: each unit (unit_id, unit_no, source_section_ids) under each known section that it
    names, once; places count from 0 in the order of unit_no."""
    named = F.array_distinct(F.transform("source_section_ids", strip))
    rows = units.select("doc_id", "unit_id", "unit_no", F.explode(named).alias("section_id"))
    rows = rows.join(sections.select("doc_id", "section_id"), ["doc_id", "section_id"], "left_semi")
    order = Window.partitionBy("doc_id", "section_id").orderBy("unit_no", "unit_id")
    return rows.select("doc_id", "section_id", "unit_id", (F.row_number().over(order) - 1).cast("long").alias("place"))


def ordered_units(sections: DataFrame, assigned: DataFrame) -> DataFrame:
    """doc_id, unit_id, unit_index: a document's units in the order of its sections, each at its first place."""
    first = assigned.join(sections.select("doc_id", "section_id", "section_index"), ["doc_id", "section_id"]).groupBy("doc_id", "unit_id").agg(F.min(F.struct("section_index", "place")).alias("at"))
    return first.select("doc_id", "unit_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "unit_id")) - 1).cast("long").alias("unit_index"))


def selected_unit(sections: DataFrame, assigned: DataFrame) -> DataFrame:
    """doc_id, section_id, unit_id, unit_index: each section's first unit and its place in the document; null without one."""
    first = assigned.where("place = 0").join(ordered_units(sections, assigned), ["doc_id", "unit_id"])
    return sections.select("doc_id", "section_id").join(first, ["doc_id", "section_id"], "left").select("doc_id", "section_id", "unit_id", "unit_index")


def containing_unit(sections: DataFrame, units: DataFrame) -> DataFrame:
    """doc_id, section_id, unit_id, unit_index: the first unit, in the order of unit_no, that names each section; null without one."""
    placed = units.withColumn("unit_index", (F.row_number().over(Window.partitionBy("doc_id").orderBy("unit_no", "unit_id")) - 1).cast("long"))
    named = placed.select("doc_id", "unit_id", "unit_index", F.explode(F.array_distinct("source_section_ids")).alias("section_id"))
    first = named.groupBy("doc_id", "section_id").agg(F.min_by("unit_id", "unit_index").alias("unit_id"), F.min("unit_index").alias("unit_index"))
    return sections.select("doc_id", "section_id").join(first, ["doc_id", "section_id"], "left").select("doc_id", "section_id", "unit_id", "unit_index")


def unit_content(wanted: DataFrame, assigned: DataFrame, units: DataFrame, sections: DataFrame, chapters: DataFrame) -> DataFrame:
    """doc_id, unit_id, status, section_id, section_title, chapter_id, chapter_title, content of wanted units.

    Status: missing, duplicate (in more than one section), empty (blank content) or found; only a found one has the rest."""
    within = assigned.groupBy("doc_id", "unit_id").agg(F.count("*").alias("n"), F.min("section_id").alias("section_id"))
    rows = wanted.join(within, ["doc_id", "unit_id"], "left").join(units.select("doc_id", "unit_id", "content"), ["doc_id", "unit_id"], "left")
    rows = rows.join(sections.select("doc_id", "section_id", F.col("title").alias("section_title"), F.col("parent_chapter_id").alias("chapter_id")), ["doc_id", "section_id"], "left")
    rows = rows.join(chapters.select("doc_id", "chapter_id", F.col("title").alias("chapter_title"), F.lit(True).alias("known")), ["doc_id", "chapter_id"], "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").when(F.coalesce(strip(F.col("content")), F.lit("")) == "", "empty").otherwise("found")
    own = lambda c: F.when(status == "found", c)
    return rows.select("doc_id", "unit_id", status.alias("status"), *(own(F.col(c)).alias(c) for c in ("section_id", "section_title")), own(F.when(F.col("known"), F.col("chapter_id"))).alias("chapter_id"), *(own(F.col(c)).alias(c) for c in ("chapter_title", "content")))


def unit_coverage(sections: DataFrame, assigned: DataFrame) -> DataFrame:
    """doc_id, n_sections, with_units, coverage, available: the share of sections that have units."""
    have = assigned.select("doc_id", "section_id", F.lit(1).alias("have")).distinct()
    rows = sections.join(have, ["doc_id", "section_id"], "left").groupBy("doc_id").agg(F.count("*").alias("n_sections"), F.count("have").alias("with_units"))
    share = F.round(F.col("with_units") / F.col("n_sections"), 4)
    return rows.select("doc_id", "n_sections", "with_units", share.alias("coverage"), (share >= COVERED).alias("available"))


def layout_validity(wanted: DataFrame, stored: DataFrame, sections: DataFrame, assigned: DataFrame) -> DataFrame:
    """doc_id, valid: a stored layout holds if every section with content has units and its source_hash, split_mode, top_k
    and resolver_version are those wanted now, nulls equal; without a stored one it does not."""
    bare = sections.where(strip(F.col("content")) != "").join(assigned, ["doc_id", "section_id"], "left_anti").select("doc_id", F.lit(True).alias("bare")).distinct()
    fields = ["source_hash", "split_mode", "top_k", "resolver_version"]
    rows = wanted.join(stored.select("doc_id", *(F.col(c).alias(f"a_{c}") for c in fields), F.lit(True).alias("present")), "doc_id", "left").join(bare, "doc_id", "left")
    same = F.lit(True)
    for c in fields:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(c))
    return rows.select("doc_id", (F.col("present").isNotNull() & F.col("bare").isNull() & same).alias("valid"))


def unit_summary_validity(artifacts: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, unit_id, status, reason: stored summaries of units against what is wanted of them now."""
    return validity(artifacts, wanted, ["doc_id", "unit_id"], lambda: (strip(F.coalesce("a_content", F.lit(""))) == "", "empty_content"), [("source_hash", "source_hash_mismatch"), ("language", "language_mismatch"), ("split_mode", "split_mode_mismatch"), ("top_k", "semantic_top_k_mismatch"), ("prompt_version", "prompt_version_mismatch")])


def availability(summaries: DataFrame, quizzes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, has_summary, has_quiz, whether each is valid and why not; things with neither have no row."""
    one = lambda rows, name: rows.where("status <> 'missing'").select(*keys, F.lit(True).alias(f"has_{name}"), (F.col("status") == "valid").alias(f"{name}_cache_valid"), F.col("reason").alias(f"{name}_invalid_reason"))
    rows = one(summaries, "summary").join(one(quizzes, "quiz"), keys, "full_outer")
    return rows.na.fill(False, ["has_summary", "has_quiz", "summary_cache_valid", "quiz_cache_valid"])


def title_risk(chapters: Column, sections: Column, repeated_chapters: Column, repeated_sections: Column, coverage: Column) -> Column:
    """How far titles fail to name one thing: by titles that repeat, else by how many things have one."""
    return (
        F.when((chapters == 0) & (sections == 0), "unknown").when((repeated_chapters > 0) | (repeated_sections >= 3), "high").when(repeated_sections > 0, "medium")
        .when(coverage.isNull(), "unknown").when(coverage < 0.4, "medium").when(coverage < 0.65, "low").otherwise("none")
    )


def title_uniqueness(parts: DataFrame) -> DataFrame:
    """doc_id, repeated_chapters, repeated_sections, title_coverage, risk of sections with chapter_seq.

    A chapter bears its first section's title.  A section that is its chapter's only one is the chapter itself and does
    not count among repeated section titles.  Titles compare in lower case."""
    titled = strip(F.col("title"))
    one = parts.groupBy("doc_id", "chapter_seq").agg(F.count("*").alias("n"), strip(F.min_by("title", "section_index")).alias("title"))
    rows = parts.join(one.select("doc_id", "chapter_seq", F.col("n").alias("size")), ["doc_id", "chapter_seq"]).select("doc_id", titled.alias("title"), F.lit(0).alias("chapter"), (F.col("size") > 1).alias("explicit"))
    rows = rows.union(one.select("doc_id", "title", F.lit(1), F.lit(True)))
    rows = rows.withColumn("key", F.nullif(F.lower("title"), F.lit("")))
    by_key = rows.groupBy("doc_id", "chapter", "key").agg(F.count("*").alias("n"), F.count_if("explicit").alias("explicit"))
    again = lambda chapter: F.count_if((F.col("chapter") == chapter) & F.col("key").isNotNull() & (F.col("explicit") > 1))
    sums = by_key.groupBy("doc_id").agg(
        again(1).alias("repeated_chapters"), again(0).alias("repeated_sections"), F.sum(F.when(F.col("chapter") == 1, F.col("n")).otherwise(0)).alias("chapters"), F.sum(F.when(F.col("chapter") == 0, F.col("n")).otherwise(0)).alias("sections"),
        F.round(F.sum(F.when(F.col("key").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("title_coverage"),
    )
    risk = title_risk(F.col("chapters"), F.col("sections"), F.col("repeated_chapters"), F.col("repeated_sections"), F.col("title_coverage"))
    return sums.select("doc_id", "repeated_chapters", "repeated_sections", "title_coverage", risk.alias("risk"))


def diagnostics(profile: DataFrame) -> DataFrame:
    """doc_id, requires_id, shape_mismatch, warnings, hint from parser_shape, post_shape, risk, coverage and repeated_local.

    Warnings are comma-joined in fixed order; coverage is the share of sections with units, null without sections."""
    parser, post, coverage = F.col("parser_shape"), F.col("post_shape"), F.col("coverage")
    vague = ["unknown", "mixed"]
    requires = F.coalesce(F.col("risk").isin("medium", "high"), F.lit(False))
    incomplete = ~F.coalesce(coverage >= COVERED, F.lit(False))
    mismatch = F.coalesce(~parser.isin(vague) & ~post.isin(vague) & differs(parser, post), F.lit(False))
    warnings = F.concat_ws(
        ",", F.when(requires, "chapter_or_section_titles_are_not_unique_use_id_targets"), F.when(incomplete, "task_unit_stats_not_available_or_incomplete"),
        F.when((coverage > 0) & (coverage < COVERED), "task_unit_stats_partially_available"), F.when(mismatch, "pre_structure_shape_differs_from_post_structure_shape"),
    )
    hint = F.when((post == "flat_long_text") & parser.isin("essay_sections", "chapter_section", "part_chapter"), "common_parser_may_undersegment").when((post == "part_chapter") & F.col("repeated_local"), "common_parser_may_have_flattened_parent_grouping")
    return profile.select("doc_id", requires.alias("requires_id"), mismatch.alias("shape_mismatch"), warnings.alias("warnings"), hint.alias("hint"))


def task_context(parts: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, section_id, document_title, section_title, container_title, valid, reason of sections or units (doc_id, section_id,
    title, container_title, content) and documents (doc_id, document_title).

    A blank title is none.  Parts without an id or content cannot be a task: they are invalid as empty_id and
    empty_content; others lack a document title (unknown_document) or their own (untitled_section)."""
    rows = parts.join(documents.select("doc_id", blank_to_null(F.col("document_title")).alias("document_title")), "doc_id", "left")
    rows = rows.select("doc_id", blank_to_null(F.col("section_id")).alias("section_id"), "document_title", blank_to_null(F.col("title")).alias("section_title"), blank_to_null(F.col("container_title")).alias("container_title"), blank_to_null(F.col("content")).isNull().alias("empty"))
    reason = F.when(F.col("section_id").isNull(), "empty_id").when(F.col("empty"), "empty_content").when(F.col("document_title").isNull(), "unknown_document").when(F.col("section_title").isNull(), "untitled_section")
    return rows.withColumn("valid", reason.isNull()).withColumn("reason", reason).drop("empty")
