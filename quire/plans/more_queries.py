"""Queries of headings, hierarchy, plans, questions and parsed answers, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import parsing
from quire.functions import text as T
from quire.operators import artifacts, headings, hierarchy, lines, questions, retrieval, structure, units
from quire.plans import split_plans
from quire.plans.queries import CHUNKS, DISTANCE, HEADINGS, LINES, MERGED, MODE, TITLED, TITLED_SECTIONS, TOKENS, _pairs, _titled, boxed_units, chunks, documents, table, titled_sections
from quire.plans.queries import _nearest as nearest
from quire.sources import store


def heading_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.explode_lines(documents(spark, sf_dir), "lang")
    key = headings.comparison_key(headings.normalize(F.col("line"), F.col("lang")))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.md5(key).alias("key"))


def marker_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the titled texts that are a marker of their language."""
    rows = lines.explode_lines(_titled(spark, sf_dir), "lang").select("doc_id", "line_no", "lang", headings.comparison_key(F.col("line")).alias("key"))
    found = F.coalesce(*(F.when(F.col("lang") == lang, headings.marker_in(F.col("key"), markers)) for lang, markers in MARKERS.items()))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), found.alias("marker")).where("marker is not null")


# Markers looked for, by language.
MARKERS = {"en": ["contents", "preface", "chapter", "appendix"], "fr": ["sommaire", "préface", "chapitre", "annexe"], "de": ["inhalt", "vorwort", "kapitel", "anhang"], "es": ["contenido", "prólogo", "capítulo", "apéndice"]}


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of the form that validation and lookups take, one for each chunk."""
    rows = chunks(spark, sf_dir)
    return rows.select(
        "doc_id", F.concat(F.lit("section-"), F.expr("chunk_index % 5")).alias("section_id"), F.col("chunk_index").alias("section_index"), F.concat(F.lit(" Part "), F.expr("chunk_index % 3"), F.lit("  ")).alias("title"),
        "char_start", "char_end", F.col("text").alias("content"), F.expr("case when chunk_index % 7 = 6 then null else chunk_index div 2 end").alias("chapter_seq"),
    )


def hierarchy_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings on the sections of titled texts under ids that clash and parents that are wrong here and there."""
    rows = store.parked(titled_sections(spark, sf_dir, content=False).select("doc_id", "section_index", "chapter_seq"))
    chapters = rows.select("doc_id", "chapter_seq").distinct().select("doc_id", F.concat(F.lit("c"), F.col("chapter_seq") % 4).alias("chapter_id"))
    own = F.concat(F.lit("c"), F.col("chapter_seq") % 4)
    sections = rows.select("doc_id", F.concat(F.lit("s"), F.col("section_index") % 5).alias("section_id"), F.when(F.col("section_index") % 7 != 6, own).alias("chapter_id"), F.when(F.col("section_index") % 3 == 1, "cx").when(F.col("section_index") % 3 == 0, own).alias("parent_chapter_id"))
    units = rows.select("doc_id", F.concat(F.lit("u"), F.col("section_index") % 6).alias("unit_id"), F.concat(F.lit("s"), F.col("section_index") % 5).alias("section_id"), F.when(F.col("section_index") % 4 == 1, "s9").when(F.col("section_index") % 4 > 1, F.concat(F.lit("s"), F.col("section_index") % 5)).alias("parent_section_id"))
    return hierarchy.validate(chapters, sections, units)


def section_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = documents(spark, sf_dir).select("doc_id", F.concat(F.lit("section-"), F.expr("doc_id % 6")).alias("section_id"))
    return hierarchy.section_by_id(_sections(spark, sf_dir), wanted)


def chapter_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _sections(spark, sf_dir).where("chapter_seq is not null").select("doc_id", F.concat(F.lit("chapter-"), F.col("section_index")).alias("chapter_id"), "title")
    wanted = documents(spark, sf_dir).select("doc_id", F.expr("case when doc_id % 2 = 0 then concat('chapter-', doc_id % 4) else concat('Part ', doc_id % 3) end").alias("target"))
    return hierarchy.chapter_target(own, wanted)


def section_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.section_kinds(_sections(spark, sf_dir).where("chapter_seq is not null")).select("doc_id", "section_index", "section_kind", "is_implicit")


def chapter_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = hierarchy.section_kinds(_sections(spark, sf_dir).where("chapter_seq is not null"))
    return hierarchy.chapter_body(kinds).select("doc_id", "chapter_seq", "section_index")


def duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.duplicate_titles(_sections(spark, sf_dir))


def task_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = units.merge_short(boxed_units(spark, sf_dir))
    sections = merged.select("doc_id", F.col("unit_no").cast("string").alias("section_id"))
    # every fourth unit is told twice, as a unit that was split, and others are left out
    own = merged.groupBy("doc_id", "merged_no").agg(F.collect_list(F.col("unit_no").cast("string")).alias("source_section_ids")).select("doc_id", F.col("merged_no").cast("string").alias("unit_id"), "source_section_ids")
    twice = own.where("cast(unit_id as bigint) % 4 = 0").withColumn("unit_id", F.concat("unit_id", F.lit("b")))
    return hierarchy.task_mode(sections, own.where("cast(unit_id as bigint) % 5 <> 3").union(twice))


def document_unit_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).select("doc_id", F.expr("chunk_index div 3").alias("section_index"), F.expr("2 - chunk_index % 3").alias("unit_no"))
    return units.document_unit_ids(rows)


def question_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", questions.scope(F.col("text")).alias("s")).select("conv_id", "turn", "s.scope", "s.reason")


def dynamic_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = documents(spark, sf_dir).where("length(text) > 0").select("doc_id", F.expr("doc_id % 3").alias("hit_index"))
    return questions.dynamic_windows(hits, chunks(spark, sf_dir), 900)


def split_plan_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    part = lambda i: F.get_json_object(F.to_json(F.struct(F.get(F.split("text", "\n"), F.lit(i)).alias("x"))), "$.x")
    plan = F.to_json(F.struct(F.lit("llm").alias("parser_mode"), F.array(*(F.struct(F.lit(f"S{i}").alias("title"), F.lit(1).alias("level"), part(i).alias("start_anchor_text"), F.lit("exact").alias("anchor_match_mode"), F.lit(1).alias("anchor_occurrence")) for i in (0, 2, 3))).alias("sections")))
    answers = docs.select("doc_id", F.concat(F.lit("Here it is:\n```json\n"), plan, F.lit("\n```")).alias("answer"))
    return split_plans.apply(split_plans.parse(answers), docs)


def quiz_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(F.lit("q").alias("question_id"), F.lit("what").alias("question_text"), F.when(F.col("doc_id") % 3 != 0, "that").otherwise(" ").alias("answer_text"))
    rows = documents(spark, sf_dir).select("doc_id", F.concat(F.lit("Sure: "), F.to_json(F.slice(F.array(*[item] * 5), F.lit(1), (F.col("doc_id") % 6).cast("int")))).alias("answer"), "text")
    return rows.select("doc_id", F.coalesce(F.size(parsing.quiz_items(F.col("answer"))), F.lit(-1)).cast("long").alias("items"), F.coalesce(parsing.skip_reason(F.col("text")), F.lit("")).alias("skip_reason"))


# Reasons of failures.
REASONS = ["provider_error status=429 | slow down", "Section not found", "section_not_found", "provider_error status=299", "unsupported form", "title cannot be empty", "status=404 | Not Found", "odd"]


def failure_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.element_at(F.array(*map(F.lit, REASONS)), (F.col("doc_id") % len(REASONS) + 1).cast("int"))
    kinds = (parsing.http_status(reason, kind).cast("long").alias(kind) for kind in ("section_task", "unit_content", "reparse"))
    return documents(spark, sf_dir).select("doc_id", *kinds, parsing.provider_reason(F.when(F.col("doc_id") % 2 == 0, F.lit(500)), F.when(F.col("doc_id") % 3 == 0, F.lit("msg"))).alias("reason"))


def artifact_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    return rows.select("doc_id", parsing.artifact_key(F.lit("chapter"), F.col("doc_id").cast("string"), F.lit("summary")).alias("artifact_key"), parsing.clean_ratio(F.col("quality").cast("string")).alias("ratio"), parsing.allowed(F.when(F.col("toxic") == 1, " High ").otherwise("odd"), ["low", "high"]).alias("level"))


def boundary_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts of headings and of chunks over the titled texts; where both start, the heading's title stays."""
    rows = _titled(spark, sf_dir)
    return split_plans.union_boundaries(structure.headings(rows).select("doc_id", "char_start", "title"), retrieval.fixed_chunks(rows).select("doc_id", "char_start", F.lit("chunk").alias("title")))


def section_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).select("doc_id", F.concat(F.lit("section-"), F.col("chunk_index")).alias("section_id"), F.md5("text").alias("content"))
    return hierarchy.replace_sections(rows, rows.where("doc_id % 2 = 0").withColumn("content", F.lit("new")))


def unique_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return artifacts.assert_unique(rows, ["doc_id"])


def full_text_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("c"))
    return rows.select("doc_id", F.md5(F.array_join(F.transform("c", lambda x: x["text"]), "\n")).alias("text_md5"), T.estimate_tokens(F.array_join(F.transform("c", lambda x: x["text"]), " ")).alias("tokens"))


def answer_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = nearest(spark, sf_dir, 1).select("query_id", "score")
    mode = retrieval.answer_mode(F.col("score"))
    return best.select("query_id", F.round("score", 5).alias("best"), mode.alias("answer_mode"), T.near_chunk_threshold(F.col("score"), mode).cast("long").alias("threshold"))


QUERIES = {
    f.__name__: f
    for f in (
        heading_normalization, marker_lines, hierarchy_warnings, section_lookup, chapter_lookup, section_kinds, chapter_bodies, duplicate_titles, task_modes, document_unit_ids, question_scope,
        dynamic_windows, split_plan_sections, quiz_validation, failure_status, artifact_keys, boundary_union, section_replacement, unique_artifacts, full_text_in_order, answer_modes,
    )
}

SECTIONS = f"""(select doc_id, 'section-' || (chunk_index % 5) section_id, chunk_index section_index, ' Part ' || (chunk_index % 3) || '  ' title, char_start, char_end, text content,
    case when chunk_index % 7 = 6 then null else chunk_index // 2 end chapter_seq from {CHUNKS})"""
LABEL = r"^( *([0-9]{1,4}|[ivxlcdm]{1,7}|\pL)[.:)]?){1,3} *$"
GLOBAL = " or ".join(f"contains(lower(text), '{w}')" for w in questions.GLOBAL_WORDS)
LOCAL = " or ".join(f"contains(lower(text), '{w}')" for w in questions.LOCAL_WORDS)

ORACLE = {
    "heading_normalization": r"""select doc_id, line_no, md5(regexp_replace(lower(trim(regexp_replace(translate(line, '‐‑‒–—―−－─', '---------'), '[\s\x{A0}\x{3000}]+', ' ', 'g'))), '[.:：;；]+$', '')) as key from """ + LINES,
    "hierarchy_warnings": f"""with r as (select doc_id, section_index i, chapter_seq c from {TITLED_SECTIONS}),
        c as (select distinct doc_id, c from r), ch as (select doc_id, 'c' || (c % 4) id from c),
        s as (select doc_id, 's' || (i % 5) id, case when i % 7 <> 6 then 'c' || (c % 4) end own, case when i % 3 = 1 then 'cx' when i % 3 = 0 then 'c' || (c % 4) end parent from r),
        u as (select doc_id, 'u' || (i % 6) id, 's' || (i % 5) own, case when i % 4 = 1 then 's9' when i % 4 > 1 then 's' || (i % 5) end parent from r)
        select doc_id, 'duplicate_chapter_id' warning, id subject, count(*) - 1 n from ch group by all having count(*) > 1
        union all select doc_id, 'duplicate_hierarchy_section_id', id, count(*) - 1 from s where own is not null group by all having count(*) > 1
        union all select doc_id, 'section_parent_mismatch', id, count(*) from s where own is not null and parent is distinct from own group by all
        union all select doc_id, 'task_unit_parent_section_mismatch', id, count(*) from u where parent is not null and parent <> own group by all
        union all select doc_id, 'duplicate_task_unit_id', id, count(*) - 1 from u group by all having count(*) > 1
        union all select distinct doc_id, 'legacy_sections_present', '', 1 from s where own is null""",
    "marker_lines": f"""with l as (select doc_id, lang, regexp_replace(lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))), '[.:：;；]+$', '') k, line_no from (select doc_id, lang, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 line_no from {TITLED}))
        select doc_id, line_no, case {" ".join(f"when lang = '{lang}' and (k = '{m}' or (starts_with(k, '{m} ') and length(k) - {len(m)} <= 20 and regexp_matches(substring(k, {len(m) + 1}), '{LABEL}', 'i'))) then '{m}'" for lang, ms in MARKERS.items() for m in reversed(ms))} end marker from l where marker is not null""",
    "task_modes": f"""with m as {MERGED}, g as (select doc_id, merged_no::varchar unit_id, list(unit_no::varchar) ids from m group by doc_id, merged_no),
        u as (select doc_id, unit_id, unnest(ids) section_id, len(ids) sources from g where unit_id::bigint % 5 <> 3 union all select doc_id, unit_id || 'b', unnest(ids), len(ids) from g where unit_id::bigint % 4 = 0),
        o as (select doc_id, section_id, max(sources) most, count(*) n from u group by all)
        select m.doc_id, m.unit_no::varchar section_id, case when o.n is null then 'direct' when most > 1 then 'merged' when n > 1 then 'split' else 'direct' end task_mode from m left join o on o.doc_id = m.doc_id and o.section_id = m.unit_no::varchar""",
    "dynamic_windows": f"""with recursive c as (select doc_id, chunk_index, {TOKENS.format("text")}::bigint tokens from {CHUNKS}),
        g(doc_id, hit_index, step, low, high, used, l, r) as (select c.doc_id, chunk_index, 0, chunk_index, chunk_index, tokens, true, true from c join documents d on d.doc_id = c.doc_id and d.doc_id % 3 = chunk_index
            union all select doc_id, hit_index, step + 1, case when gl then low - 1 else low end, case when gr then high + 1 else high end, used + case when gl then lt else 0 end + case when gr then rt else 0 end, gl, gr
            from (select *, r and rt is not null and used + case when gl then lt else 0 end + rt <= 900 gr from (select g.*, a.tokens lt, b.tokens rt, g.l and a.tokens is not null and g.used + a.tokens <= 900 gl from g left join c a on a.doc_id = g.doc_id and a.chunk_index = g.low - 1 left join c b on b.doc_id = g.doc_id and b.chunk_index = g.high + 1 where g.l or g.r)))
        select doc_id, hit_index, arg_max(low, step) first_index, arg_max(high, step) last_index, max(used) tokens from g group by doc_id, hit_index""",
    "section_lookup": f"""with n as (select doc_id, section_id, count(*) n from {SECTIONS} group by all), w as (select doc_id, 'section-' || (doc_id % 6) section_id from documents)
        select doc_id, section_id, coalesce(n, 0) found, case when n is null then 'missing' when n > 1 then 'ambiguous' else 'found' end status from w left join n using (doc_id, section_id)""",
    "chapter_lookup": f"""with c as (select doc_id, 'chapter-' || section_index chapter_id, trim(title) title from {SECTIONS} where chapter_seq is not null),
        w as (select doc_id, case when doc_id % 2 = 0 then 'chapter-' || (doc_id % 4) else 'Part ' || (doc_id % 3) end target from documents),
        t as (select doc_id, title, count(*) n, min(chapter_id) titled from c group by all)
        select w.doc_id, target, case when n > 1 then c.chapter_id else coalesce(c.chapter_id, titled) end chapter_id, case when c.chapter_id is not null then 'by_id' when n = 1 then 'by_title' when n > 1 then 'ambiguous' else 'missing' end status
        from w left join c on c.doc_id = w.doc_id and c.chapter_id = target left join t on t.doc_id = w.doc_id and t.title = target""",
    "section_kinds": f"""select doc_id, section_index, case when section_index = min(section_index) over w then 'chapter_body' else 'subsection' end section_kind,
        section_index = min(section_index) over w and count(*) over w = 1 is_implicit from {SECTIONS} where chapter_seq is not null window w as (partition by doc_id, chapter_seq)""",
    "chapter_bodies": f"select doc_id, chapter_seq, min(section_index) section_index from {SECTIONS} where chapter_seq is not null group by all",
    "duplicate_titles": f"select doc_id, arg_min(title, section_index) title, count(*) n from {SECTIONS} group by doc_id, lower(title) having count(*) > 1",
    "document_unit_ids": f"""select doc_id, section_index, unit_no, 'task-unit-' || (row_number() over (partition by doc_id order by section_index, unit_no) - 1) unit_id
        from (select doc_id, chunk_index // 3 section_index, 2 - chunk_index % 3 unit_no from {CHUNKS})""",
    "question_scope": f"""select conv_id, turn, case when {GLOBAL} then 'global' else 'local' end as scope, case when {GLOBAL} then 'words' when {LOCAL} then 'local_words' else 'default' end reason
        from conversations where role = 'user'""",
    "quiz_validation": r"""with a as (select doc_id, text, 'Sure: [' || array_to_string(list_transform(range(0, doc_id % 6), lambda i: '{"question_id":"q","question_text":"what","answer_text":"' || case when doc_id % 3 <> 0 then 'that' else ' ' end || '"}'), ',') || ']' answer from documents),
        j as (select doc_id, text, regexp_extract(answer, '[\[{].*[\]}]', 0)::json j from a)
        select doc_id, case when json_array_length(j) >= 4 and len(list_filter(json_extract_string(j, '$[*].answer_text'), lambda x: trim(x) = '')) = 0 then json_array_length(j)::bigint else -1 end items, case when length(trim(text)) < 400 then 'content_too_short' else '' end skip_reason from j""",
    "failure_status": f"""with r as (select doc_id, lower(trim({[*REASONS]}[doc_id % {len(REASONS)} + 1])) r from documents), n as (select doc_id, r, try_cast(regexp_extract(r, 'status=(\\d{{3}})', 1) as bigint) n from r),
        k as (select doc_id, r, case when n between 400 and 599 then n end n, case when contains(r, 'not found') then 404 else 400 end::bigint missing from n)
        select doc_id, coalesce(n, missing) section_task, missing unit_content, coalesce(n, case when contains(r, 'bad_request') or contains(r, 'cannot be empty') or contains(r, 'unsupported') or contains(r, 'unknown parser_mode') then 400 else 500 end)::bigint reparse,
        concat_ws(' | ', case when doc_id % 2 = 0 then 'status=500' end, case when doc_id % 3 = 0 then 'msg' end) reason from k""",
    "artifact_keys": """select doc_id, 'chapter:' || doc_id || ':summary' artifact_key, coalesce(least(1.0, greatest(0.0, try_cast(quality::varchar as double))), 0.0)::double ratio,
        case when lower(trim(case when toxic = 1 then ' High ' else 'odd' end)) in ('low', 'high') then lower(trim(' High ')) else 'unknown' end as level from labels""",
    "boundary_union": f"""with h as (select doc_id, char_start, title from {HEADINGS}),
        c as (select doc_id, i * 1000 char_start from (select doc_id, unnest(range(0, cast(greatest(0, ceil((length(text) - 1200) / 1000.0)) as bigint) + 1)) i from {TITLED} where length(text) > 0))
        select * from h union all select doc_id, char_start, 'chunk' from c where not exists (select 1 from h where h.doc_id = c.doc_id and h.char_start = c.char_start)""",
    "section_replacement": f"select doc_id, 'section-' || chunk_index section_id, case when doc_id % 2 = 0 then 'new' else md5(text) end as content from {CHUNKS}",
    "unique_artifacts": "select doc_id, max(quality) quality from labels group by doc_id",
    "full_text_in_order": f"""with a as (select doc_id, string_agg(text, chr(10) order by chunk_index) lines, string_agg(text, ' ' order by chunk_index) words from {CHUNKS} group by doc_id)
        select doc_id, md5(lines) text_md5, {TOKENS.format('words')}::bigint tokens from a""",
    "answer_modes": f"""select query_id, round(score, 5) best, {MODE.format('score')} answer_mode, case when score < 1.00 then 3 when score <= 1.08 then 2 when score < 1.28 then 1 else 2 end::bigint threshold from {_pairs(DISTANCE, 1)}""",
    "split_plan_sections": f"""with l as (select doc_id, line_no, line, lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))) k from {LINES}),
        s as (select doc_id, line_no, line, k, (select coalesce(sum(length(b.line) + 1), 0) from l b where b.doc_id = l.doc_id and b.line_no < l.line_no)::bigint char_start from l),
        p as (select doc_id, line_no place, k, 'S' || line_no title from l where line_no in (0, 2, 3) and k <> ''),
        h as (select p.doc_id, p.place, p.title, min(s.line_no) line_no from p join s on s.doc_id = p.doc_id and s.k = p.k group by all),
        r as (select h.doc_id, s.char_start, arg_min(h.title, h.place) title from h join s on s.doc_id = h.doc_id and s.line_no = h.line_no group by all)
        select doc_id, row_number() over w - 1 section_index, title, char_start, coalesce(lead(char_start) over w, length(text)) char_end from r join documents using (doc_id)
        where doc_id in (select doc_id from r group by doc_id having count(*) >= 2) window w as (partition by doc_id order by char_start)""",
}
