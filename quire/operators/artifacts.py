"""Generated artifacts: keys, validity and upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import blank_to_null, strip


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The reason of the first check that holds; null if none does."""
    out = F.lit(None).cast("string")
    for check, reason in reversed(checks):
        out = F.when(F.coalesce(check, F.lit(False)), reason).otherwise(out)
    return out


def differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def _status(rows: DataFrame, keys: list[str], present: Column, reason: Column) -> DataFrame:
    state = F.when(~present, "missing").when(reason.isNull(), "valid").otherwise("invalid")
    return rows.select(*keys, state.alias("status"), F.when(present, reason).alias("reason"))


def _stored(artifacts: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """wanted with its stored artifact's columns as a_*; `a_present` marks those that have one."""
    own = artifacts.select(*keys, *(F.col(c).alias(f"a_{c}") for c in artifacts.columns if c not in keys), F.lit(True).alias("a_present"))
    return wanted.join(own, keys, "left")


def validity(artifacts: DataFrame, wanted: DataFrame, keys: list[str], first: Callable[[], tuple[Column, str]], fields: list[tuple[str, str]]) -> DataFrame:
    """keys, status, reason: a first check, then fields that must be the same, nulls equal, in order."""
    rows = _stored(artifacts, wanted, keys)
    return _status(rows, keys, F.col("a_present").isNotNull(), first_reason(first(), *((differs(F.col(f"a_{k}"), F.col(k)), why) for k, why in fields)))


def summary_validity(artifacts: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, section_id, status (valid, invalid, missing) and reason: stored summaries against what is wanted of them
    now; checks in fixed order.

    Both have source_hash, language, split_mode, top_k, prompt_version, scope and chapter_title; a stored one has its
    content and the source_section_id that it was made of.  A chapter's summary must also bear the chapter's title."""
    keys = ["doc_id", "section_id"]
    rows = _stored(artifacts, wanted, keys)
    fields = [("source_hash", "source_hash_mismatch"), ("language", "language_mismatch"), ("split_mode", "split_mode_mismatch"), ("top_k", "semantic_top_k_mismatch"), ("prompt_version", "prompt_version_mismatch"), ("scope", "scope_mismatch")]
    reason = first_reason(
        (blank_to_null(F.col("a_content")).isNull(), "empty_content"),
        *((differs(F.col(f"a_{k}"), F.col(k)), why) for k, why in fields),
        (differs(F.col("a_source_section_id"), F.col("section_id")), "section_id_mismatch"),
        ((F.col("scope") == "chapter") & (F.coalesce("a_chapter_title", F.lit("")) != F.coalesce("chapter_title", F.lit(""))), "chapter_title_mismatch"),
    )
    return _status(rows, keys, F.col("a_present").isNotNull(), reason)


def quiz_validity(artifacts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The same for stored quizzes, whose items (structs of question_id, question_text, answer_text) must all be full.

    Both also have schema_version; a quiz without items, or with a blank field in one, is malformed."""
    keys = ["doc_id", "section_id"]
    rows = _stored(artifacts, wanted, keys)
    fields = [("source_hash", "source_hash_mismatch"), ("language", "language_mismatch"), ("split_mode", "split_mode_mismatch"), ("top_k", "semantic_top_k_mismatch"), ("prompt_version", "prompt_version_mismatch"), ("schema_version", "quiz_schema_version_mismatch"), ("scope", "scope_mismatch")]
    full = F.forall("a_items", lambda x: blank_to_null(x["question_id"]).isNotNull() & blank_to_null(x["question_text"]).isNotNull() & blank_to_null(x["answer_text"]).isNotNull())
    reason = first_reason(
        (~F.coalesce((F.size("a_items") > 0) & full, F.lit(False)), "malformed_quiz_items"),
        *((differs(F.col(f"a_{k}"), F.col(k)), why) for k, why in fields),
        (differs(F.col("a_source_section_id"), F.col("section_id")), "section_id_mismatch"),
        ((F.col("scope") == "chapter") & (F.coalesce("a_chapter_title", F.lit("")) != F.coalesce("chapter_title", F.lit(""))), "chapter_title_mismatch"),
    )
    return _status(rows, keys, F.col("a_present").isNotNull(), reason)


def chapter_keys(chapters: DataFrame, by_id: str = "chapter_id::", by_title: str = "chapter::") -> DataFrame:
    """doc_id, chapter_id, place, key: the keys under which a chapter's artifact may be stored, best first, each once:
    by id, as it was stored earlier (legacy_key), and by title."""
    keys = F.array(F.concat(F.lit(by_id), strip(F.col("chapter_id"))), blank_to_null(F.col("legacy_key")), F.concat(F.lit(by_title), blank_to_null(F.col("title"))))
    return chapters.select("doc_id", "chapter_id", F.posexplode(F.array_distinct(F.array_compact(keys))).alias("place", "key")).withColumn("place", F.col("place").cast("long"))


def stored_for_chapters(chapters: DataFrame, stored: DataFrame) -> DataFrame:
    """doc_id, chapter_id, key and content of the artifact (doc_id, key, content) stored under each chapter's best key."""
    found = chapter_keys(chapters).join(stored, ["doc_id", "key"])
    return found.groupBy("doc_id", "chapter_id").agg(F.min_by(F.struct("key", "content"), "place").alias("one")).select("doc_id", "chapter_id", "one.*")


def upsert(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of updates in place of those with the same keys."""
    return base.join(updates.select(keys), keys, "left_anti").unionByName(updates, allowMissingColumns=True)


def assert_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows; reading them fails if a key occurs twice."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(F.assert_true(F.lit(False), F.lit("duplicate keys")).alias("x"))
    return rows.unionByName(n.where("x is not null").select(*(F.lit(None).cast(t).alias(c) for c, t in rows.dtypes)))


def stale(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """The documents whose fingerprint is not stored: what has to be built again."""
    return documents.join(stored.select("doc_id", "fingerprint"), ["doc_id", "fingerprint"], "left_anti")
