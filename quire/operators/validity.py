"""Whether stored artifacts of chapters and units still hold, and what is available of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import blank_to_null, source_hash
from quire.operators.artifacts import chapter_keys, differs, first_reason, validity

FIELDS = [("language", "language_mismatch"), ("split_mode", "split_mode_mismatch"), ("top_k", "semantic_top_k_mismatch"), ("prompt_version", "prompt_version_mismatch")]
SCHEMA = ("schema_version", "quiz_schema_version_mismatch")
ITEM = ("question_id", "question_text", "answer_text")


def malformed(items: Column) -> Column:
    """A quiz without items, or with a blank field in one."""
    full = F.forall(items, lambda x: F.array_size(F.array_compact(F.array(*(blank_to_null(x[k]) for k in ITEM)))) == len(ITEM))
    return ~F.coalesce((F.size(items) > 0) & full, F.lit(False))


def chapter_validity(chapters: DataFrame, stored: DataFrame, sections: DataFrame, wanted: DataFrame, quiz: bool = False) -> DataFrame:
    """doc_id, chapter_id, status (valid, invalid, missing) and reason of each chapter's stored summary or quiz.

    `chapters` has doc_id, chapter_id, title, legacy_key and source_section_id; `stored` has doc_id, key, content (quizzes: items), source_hash, language,
    split_mode, top_k, prompt_version (quizzes: schema_version), scope, and what its maker noted: for_chapter_id, for_title, for_key,
    for_section_id; `sections` has doc_id, section_id, content (or its source_hash); `wanted` has for each document the fields that an artifact must have
    now.  An artifact is looked up under a chapter's keys, best first.  It was made of the section that it names, which must be
    there, else of the chapter's own; what it notes must be the chapter's, where it notes anything (its title always counts).
    Checks are in a fixed order, nulls are equal."""
    keys = chapter_keys(chapters)
    found = keys.join(stored.withColumn("_a", F.struct(*[c for c in stored.columns if c != "doc_id"])).select("doc_id", "key", "_a"), ["doc_id", "key"])
    best = found.groupBy("doc_id", "chapter_id").agg(F.min_by("_a", "place").alias("a"))
    own = keys.groupBy("doc_id", "chapter_id").agg(F.collect_set("key").alias("keys"))
    now_hash = F.coalesce("source_hash" if "source_hash" in sections.columns else source_hash(F.col("content")), source_hash(F.lit("")))
    hashes = sections.select("doc_id", F.col("section_id").alias("resolved_id"), now_hash.alias("now_hash"))
    rows = chapters.select("doc_id", "chapter_id", "title", "source_section_id").join(own, ["doc_id", "chapter_id"]).join(best, ["doc_id", "chapter_id"], "left")
    named = blank_to_null(F.col("a.for_section_id"))
    rows = rows.withColumn("resolved_id", F.coalesce(named, "source_section_id")).join(hashes, ["doc_id", "resolved_id"], "left").join(wanted, "doc_id", "left")
    noted = lambda name: blank_to_null(F.col(f"a.for_{name}"))
    fields = [*FIELDS, *([SCHEMA] if quiz else [])]
    reason = first_reason(
        (malformed(F.col("a.items")), "malformed_quiz_items") if quiz else (blank_to_null(F.col("a.content")).isNull(), "empty_content"),
        (F.col("now_hash").isNull(), "source_section_not_found"),
        (differs(F.col("a.source_hash"), F.col("now_hash")), "source_hash_mismatch"),
        *((differs(F.col(f"a.{k}"), F.col(k)), why) for k, why in fields),
        (differs(F.col("a.scope"), F.lit("chapter")), "scope_mismatch"),
        (noted("chapter_id") != F.col("chapter_id"), "chapter_id_mismatch"),
        (F.coalesce("a.for_title", F.lit("")) != F.coalesce("title", F.lit("")), "chapter_title_mismatch"),
        (~F.array_contains("keys", noted("key")), "chapter_key_mismatch"),
    )
    status = F.when(F.col("a").isNull(), "missing").when(reason.isNull(), "valid").otherwise("invalid")
    return rows.select("doc_id", "chapter_id", status.alias("status"), F.when(F.col("a").isNotNull(), reason).alias("reason"))


def unit_quiz_validity(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, unit_id, status and reason of stored quizzes of units (with items and schema_version) against what is wanted now."""
    return validity(stored, wanted, ["doc_id", "unit_id"], lambda: (malformed(F.col("a_items")), "malformed_quiz_items"), [("source_hash", "source_hash_mismatch"), *FIELDS, SCHEMA])
