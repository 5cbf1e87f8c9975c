"""Queries of the validity of chapters' artifacts and of units' quizzes, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import source_hash
from quire.operators import layout, validity
from quire.plans.queries import STRIPPED, TITLED_SECTIONS, documents, titled_sections
from quire.sources import store


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chapters of titled texts, their sections, and what artifacts must have now."""
    sections = titled_sections(spark, sf_dir).select("doc_id", "section_index", "section_id", "title", "chapter_seq", source_hash(F.col("content")).alias("source_hash"))
    sections = store.parked(sections)  # texts are cut and hashed once, whatever reads their hashes
    first = lambda c: F.min_by(c, "section_index")
    chapters = sections.groupBy("doc_id", "chapter_seq").agg(first("title").alias("title"), first("section_id").alias("source_section_id"), first("source_hash").alias("source_hash"), F.max("section_id").alias("last_section_id"))
    chapters = chapters.withColumn("chapter_id", F.concat(F.lit("c"), "chapter_seq")).withColumn("legacy_key", F.lit(None).cast("string"))
    wanted = documents(spark, sf_dir).select("doc_id", F.col("lang").alias("language"), F.lit("semantic_safe").alias("split_mode"), F.lit(3).alias("top_k"), F.lit("v1").alias("prompt_version"), F.lit("s1").alias("schema_version"))
    return chapters, sections.select("doc_id", "section_id", "source_hash"), wanted


def _stored(chapters: DataFrame, wanted: DataFrame) -> DataFrame:
    """An artifact for most chapters, as its maker stored it; some were made of other texts, under other settings, or noted other things."""
    n = F.col("doc_id") * 31 + F.col("chapter_seq")
    rows = chapters.join(wanted, "doc_id").where(n % 11 != 0)
    by_title = F.concat(F.lit("chapter::"), "title")
    key = F.when((n % 3 == 1) & F.col("title").isNotNull(), by_title).otherwise(F.concat(F.lit("chapter_id::"), "chapter_id"))
    unless = lambda m, r, other, column: F.when(n % m == r, other).otherwise(column)
    item = lambda text: F.array(F.struct(F.lit("q1").alias("question_id"), F.lit("What?").alias("question_text"), text.alias("answer_text")))
    return rows.select(
        "doc_id", key.alias("key"), unless(13, 1, F.lit(" "), F.lit("Said")).alias("content"), item(unless(10, 3, F.lit(""), F.lit("That"))).alias("items"), unless(7, 2, F.lit("old"), F.col("source_hash")).alias("source_hash"),
        unless(17, 3, F.lit("xx"), F.col("language")).alias("language"), unless(19, 4, F.lit("progressive"), F.col("split_mode")).alias("split_mode"), unless(23, 5, F.lit(None).cast("int"), F.col("top_k")).alias("top_k"), unless(29, 6, F.lit("v0"), F.col("prompt_version")).alias("prompt_version"),
        unless(8, 7, F.lit("s0"), F.col("schema_version")).alias("schema_version"), unless(37, 8, F.lit("section"), F.lit("chapter")).alias("scope"), unless(6, 1, F.lit("c99"), unless(2, 0, F.lit(None).cast("string"), F.col("chapter_id"))).alias("for_chapter_id"), unless(43, 10, F.lit("Other"), F.col("title")).alias("for_title"),
        unless(9, 5, F.lit("zz"), unless(2, 1, key, F.lit(""))).alias("for_key"), unless(12, 11, F.lit("none"), unless(5, 0, F.col("last_section_id"), F.lit(None).cast("string"))).alias("for_section_id"),
    )


def chapter_summary_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters, sections, wanted = _tables(spark, sf_dir)
    return validity.chapter_validity(chapters, _stored(chapters, wanted), sections, wanted)


def chapter_quiz_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters, sections, wanted = _tables(spark, sf_dir)
    return validity.chapter_validity(chapters, _stored(chapters, wanted), sections, wanted, quiz=True)


def chapter_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters, sections, wanted = _tables(spark, sf_dir)
    stored = _stored(chapters, wanted)
    return layout.availability(*(validity.chapter_validity(chapters, stored, sections, wanted, quiz) for quiz in (False, True)), ["doc_id", "chapter_id"])


def unit_quiz_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections as units, most of which have a quiz."""
    sections, n = titled_sections(spark, sf_dir), F.col("doc_id") * 31 + F.col("section_index")
    units = sections.join(documents(spark, sf_dir).select("doc_id", "lang"), "doc_id").select("doc_id", F.concat(F.lit("u"), "section_index").alias("unit_id"), source_hash(F.col("content")).alias("source_hash"), F.col("lang").alias("language"), F.lit("semantic_safe").alias("split_mode"), F.lit(3).alias("top_k"), F.lit("v1").alias("prompt_version"), F.lit("s1").alias("schema_version"), n.alias("n"), "content")
    stored = units.where("n % 4 <> 0").select("doc_id", "unit_id", F.expr("case when n % 9 <> 2 then array(named_struct('question_id', 'q', 'question_text', 't', 'answer_text', case when n % 7 = 3 then ' ' else 'a' end)) end").alias("items"), F.expr("source_hash").alias("own"), *(F.col(c) for c in ("language", "split_mode", "top_k", "prompt_version")), F.expr("case when n % 6 = 1 then 's0' else schema_version end").alias("schema_version"), "n", "content")
    stored = stored.withColumn("source_hash", F.when(F.col("n") % 5 == 0, source_hash(F.concat("content", F.lit(" more")))).otherwise(F.col("own"))).drop("own", "n", "content")
    return validity.unit_quiz_validity(stored, units.drop("n", "content"))


QUERIES = {f.__name__: f for f in (chapter_summary_validity, chapter_quiz_validity, chapter_availability, unit_quiz_validity)}


def _chapters(quiz: bool) -> str:
    first = "not coalesce(len(items) > 0 and len(list_filter(items, lambda x: trim(x.a) = '')) = 0, false) then 'malformed_quiz_items'" if quiz else "trim(coalesce(content, '')) = '' then 'empty_content'"
    schema = "when schema_version is distinct from 's1' then 'quiz_schema_version_mismatch'" if quiz else ""
    return f"""with s as materialized (select doc_id, chapter_seq, section_index, section_id, title, content from {TITLED_SECTIONS}),
        c as materialized (select doc_id, chapter_seq, 'c' || chapter_seq chapter_id, x.title title, x.section_id source_id, x.content body, last_id, doc_id * 31 + chapter_seq n from (select doc_id, chapter_seq, arg_min({{'title': title, 'section_id': section_id, 'content': content}}, section_index) x, max(section_id) last_id from s group by all)),
        k as (select *, case when n % 3 = 1 and title is not null then 'chapter::' || title else 'chapter_id::' || chapter_id end as key from c),
        a as (select k.doc_id, key, case when n % 13 = 1 then ' ' else 'Said' end content, [{{'a': case when n % 10 = 3 then '' else 'That' end}}] items, case when n % 7 = 2 then 'old' else sha256(body) end source_hash, case when n % 17 = 3 then 'xx' else lang end as language, case when n % 19 = 4 then 'progressive' else 'semantic_safe' end split_mode,
            case when n % 23 <> 5 then 3 end top_k, case when n % 29 = 6 then 'v0' else 'v1' end prompt_version, case when n % 8 = 7 then 's0' else 's1' end schema_version, case when n % 37 = 8 then 'section' else 'chapter' end as scope, case when n % 6 = 1 then 'c99' when n % 2 = 1 then chapter_id end for_chapter_id,
            case when n % 43 = 10 then 'Other' else title end for_title, case when n % 9 = 5 then 'zz' when n % 2 = 1 then key else '' end for_key, case when n % 12 = 11 then 'none' when n % 5 = 0 then last_id end for_section_id from k join documents using (doc_id) where n % 11 <> 0),
        q as (select doc_id, chapter_id, 0 place, 'chapter_id::' || chapter_id as key from c union all select doc_id, chapter_id, 1, 'chapter::' || {STRIPPED.format('title')} from c where {STRIPPED.format('title')} <> ''),
        b as (select q.doc_id, chapter_id, arg_min(a, place) x from q join a on a.doc_id = q.doc_id and a.key = q.key group by all),
        r as (select c.doc_id, c.chapter_id, c.title, c.source_id, d.lang, b.x is not null present, unnest(b.x) from c join documents d using (doc_id) left join b on b.doc_id = c.doc_id and b.chapter_id = c.chapter_id),
        h as (select r.*, s.content now_content from r left join s on s.doc_id = r.doc_id and s.section_id = coalesce(nullif(for_section_id, ''), source_id)),
        j as (select doc_id, chapter_id, present, case when not present then null when {first} when now_content is null then 'source_section_not_found' when source_hash is distinct from sha256(now_content) then 'source_hash_mismatch' when language is distinct from lang then 'language_mismatch'
            when split_mode is distinct from 'semantic_safe' then 'split_mode_mismatch' when top_k is distinct from 3 then 'semantic_top_k_mismatch' when prompt_version is distinct from 'v1' then 'prompt_version_mismatch' {schema} when scope is distinct from 'chapter' then 'scope_mismatch' when nullif(for_chapter_id, '') <> chapter_id then 'chapter_id_mismatch'
            when coalesce(for_title, '') <> coalesce(title, '') then 'chapter_title_mismatch' when nullif(for_key, '') not in ('chapter_id::' || chapter_id, coalesce('chapter::' || nullif({STRIPPED.format('title')}, ''), '')) then 'chapter_key_mismatch' end reason from h)
        select doc_id, chapter_id, case when not present then 'missing' when reason is null then 'valid' else 'invalid' end status, reason from j"""


ORACLE = {
    "chapter_summary_validity": _chapters(False),
    "chapter_quiz_validity": _chapters(True),
    "chapter_availability": f"""select coalesce(a.doc_id, b.doc_id) doc_id, coalesce(a.chapter_id, b.chapter_id) chapter_id, a.status is not null has_summary, b.status is not null has_quiz, coalesce(a.status = 'valid', false) summary_cache_valid, coalesce(b.status = 'valid', false) quiz_cache_valid, a.reason summary_invalid_reason, b.reason quiz_invalid_reason
        from (select * from ({_chapters(False)}) where status <> 'missing') a full join (select * from ({_chapters(True)}) where status <> 'missing') b on a.doc_id = b.doc_id and a.chapter_id = b.chapter_id""",
    "unit_quiz_validity": f"""with u as (select doc_id, 'u' || section_index unit_id, doc_id * 31 + section_index n, content from {TITLED_SECTIONS}),
        r as (select *, n % 4 <> 0 present, case when n % 9 <> 2 then case when n % 7 = 3 then ' ' else 'a' end end answer, sha256(case when n % 5 = 0 then content || ' more' else content end) stored_hash, case when n % 6 = 1 then 's0' else 's1' end stored_schema from u),
        j as (select *, case when not present then null when coalesce(trim(answer), '') = '' then 'malformed_quiz_items' when stored_hash <> sha256(content) then 'source_hash_mismatch' when stored_schema <> 's1' then 'quiz_schema_version_mismatch' end reason from r)
        select doc_id, unit_id, case when not present then 'missing' when reason is null then 'valid' else 'invalid' end status, reason from j""",
}
