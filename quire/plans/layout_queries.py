"""Queries of body starts, headings, unit layouts and language rules, and their SQL.

The tables have neither headings nor units, so texts get headings by expression and lines are packed into units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import artifacts, body, layout, parse, structure, units
from quire.plans.queries import MERGED, PROSE, STRIPPED, TITLED, TITLED_SECTIONS, TITLES, TOKENS, _numbered, _titled, _validity, _word, boxed_units, documents, table, titled_sections

# The word for a part, by language, that texts get.
PART_WORD = {"en": "Part", "fr": "Partie", "de": "Teil", "es": "Parte"}
SIGNALS = ["summary", "notes"]
# Words that evidence lines open with.
KEYWORDS = {"en": ["contents", "preface", "chapter", "appendix", "part"], "fr": ["sommaire", "préface", "chapitre", "annexe"], "de": ["inhalt", "vorwort", "kapitel", "anhang"], "es": ["contenido", "prólogo", "capítulo", "apéndice"]}


def _named(words: dict[str, str]):
    return F.coalesce(*(F.when(F.col("lang") == code, word) for code, word in words.items()), F.lit(words["en"]))


def listed(docs: DataFrame) -> DataFrame:
    """Of three documents one has titled text with a list of its chapters after the word for contents, one has it without
    the list, and one has its own text alone."""
    contents, chapter = _named({c: w[0] for c, w in TITLES.items()}), _named({c: w[2] for c, w in TITLES.items()})
    n = F.floor((F.size(F.split("plain", "\n")) + 3) / 6)
    names = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(chapter, F.lit(" "), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    with_list = F.array_join(F.concat(F.array(contents), names, F.array(F.substring("text", F.length(contents) + 2, F.length("text")))), "\n")
    kind = F.col("doc_id") % 3
    return docs.select("doc_id", "lang", F.when(kind == 0, with_list).when(kind == 1, F.col("text")).otherwise(F.col("plain")).alias("text"))


def _between(spark: SparkSession, sf_dir: str, said) -> DataFrame:
    """The documents with lines before every sixth line of the text: said(line, place)."""
    docs = documents(spark, sf_dir).select("doc_id", "lang", "text")
    return docs.withColumn("text", F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 6 == 2, F.concat(said(x, i), x)).otherwise(x)), "\n"))


def body_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = documents(spark, sf_dir).select("doc_id", F.col("text").alias("plain"))
    return body.body_start(listed(_titled(spark, sf_dir).join(own, "doc_id")))


def _weak_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of up to eleven words, some after a signal word, between blank lines."""
    words = lambda x, i: F.array_join(F.slice(F.split(x, " "), F.lit(1), (i % 12).cast("int")), " ")
    return _between(spark, sf_dir, lambda x, i: F.concat(F.lit("\n"), F.when(F.col("doc_id") % 2 == 0, "Summary ").otherwise(""), words(x, i + F.col("doc_id") % 7), F.lit("\n\n")))


def weak_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return body.weak_headings(_weak_texts(spark, sf_dir), SIGNALS).withColumn("line_no", F.col("line_no").cast("long"))


def _part_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part before every second chapter; before every fourth one something is said between them."""
    def said(x, i):
        n = F.floor(i / 6) + 1
        part = F.concat(_named(PART_WORD), F.lit(" "), n.cast("string"), F.lit("\n"))
        between = F.when(n % 4 == 3, F.concat(x, F.lit("\n"))).otherwise("")
        return F.concat(F.when(n % 2 == 1, F.concat(part, between)).otherwise(""), _named({c: w[2] for c, w in TITLES.items()}), F.lit(" "), n.cast("string"), F.lit("\n"))

    return _between(spark, sf_dir, said)


def headings_without_shells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return body.without_shells(_part_texts(spark, sf_dir)).withColumn("line_no", F.col("line_no").cast("long"))


def parsed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of texts with contents, with weak headings and with parts, in turn."""
    own = documents(spark, sf_dir).select("doc_id", F.col("text").alias("plain"))
    texts = listed(_titled(spark, sf_dir).join(own, "doc_id")).where("doc_id % 9 < 3")
    texts = texts.unionByName(_weak_texts(spark, sf_dir).where("doc_id % 9 between 3 and 5")).unionByName(_part_texts(spark, sf_dir).where("doc_id % 9 > 5"))
    return parse.sections(texts, SIGNALS).withColumn("content", F.sha2("content", 256))


def keyword_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = body.evidence(_titled(spark, sf_dir), KEYWORDS)
    return rows.select("doc_id", F.col("place").cast("long").alias("place"), F.col("line_no").cast("long").alias("line_no"), "line")


def _layout(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sections and the units merged of them; every fifth unit is left out, every fourth is there twice."""
    merged = units.merge_short(boxed_units(spark, sf_dir))
    sections = merged.select("doc_id", F.col("unit_no").cast("string").alias("section_id"), F.col("unit_no").alias("section_index"), F.concat(F.lit("s"), "unit_no").alias("title"), F.concat(F.lit("c"), F.expr("unit_no div 4")).alias("parent_chapter_id"), F.expr("case when unit_no % 6 = 5 then ' ' else 'x' end").alias("content"))
    own = merged.groupBy("doc_id", "merged_no").agg(F.array_sort(F.collect_list(F.col("unit_no").cast("string"))).alias("source_section_ids"))
    own = own.select("doc_id", F.col("merged_no").cast("string").alias("unit_id"), (F.col("merged_no") * 2).alias("unit_no"), "source_section_ids").where("unit_no % 10 <> 6")
    twice = own.where("unit_no % 8 = 0").select("doc_id", F.concat("unit_id", F.lit("b")).alias("unit_id"), (F.col("unit_no") + 1).alias("unit_no"), F.transform("source_section_ids", lambda x: F.concat(F.lit(" "), x)).alias("source_section_ids"))
    return sections, own.union(twice)


def section_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.assign_units(*_layout(spark, sf_dir))


def selected_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections, own = _layout(spark, sf_dir)
    return layout.selected_unit(sections, layout.assign_units(sections, own))


def containing_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.containing_unit(*_layout(spark, sf_dir))


def unit_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections, own = _layout(spark, sf_dir)
    return layout.unit_coverage(sections, layout.assign_units(sections, own))


def unit_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit, and one for each document that is not there."""
    sections, own = _layout(spark, sf_dir)
    chapters = sections.where("section_index % 4 = 0 and section_index % 8 <> 4").select("doc_id", F.col("parent_chapter_id").alias("chapter_id"), F.concat(F.lit("Chapter "), "parent_chapter_id").alias("title"))
    own = own.withColumn("source_section_ids", F.when(F.expr("unit_no div 2 % 3 = 0"), F.col("source_section_ids")).otherwise(F.slice("source_section_ids", 1, 1)))
    content = own.withColumn("content", F.when(F.col("unit_no") % 6 == 4, " ").otherwise(F.col("unit_id")))
    wanted = own.select("doc_id", "unit_id").union(documents(spark, sf_dir).select("doc_id", F.lit("absent")))
    return layout.unit_content(wanted, layout.assign_units(sections, own), content, sections, chapters)


def layout_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every thirteenth document has no stored layout, of eleven others four have one fault each."""
    sections, own = _layout(spark, sf_dir)
    wanted = documents(spark, sf_dir).select("doc_id", T.source_hash(F.col("text")).alias("source_hash"), F.lit("semantic_safe").alias("split_mode"), F.when(F.col("doc_id") % 2 == 0, 3).alias("top_k"), F.lit("r1").alias("resolver_version"))
    fault = lambda i, other, name: F.expr(f"case when doc_id % 11 = {i} then {other} else {name} end").alias(name)
    stored = wanted.where("doc_id % 13 <> 0").select("doc_id", fault(1, "'old'", "source_hash"), fault(2, "'progressive'", "split_mode"), fault(3, "5", "top_k"), fault(4, "'r0'", "resolver_version"))
    return layout.layout_validity(wanted, stored, sections.where("doc_id % 3 = 0"), layout.assign_units(sections, own))


def _unit_artifacts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    wanted = documents(spark, sf_dir).select("doc_id", F.lit("u0").alias("unit_id"), T.source_hash(F.col("text")).alias("source_hash"), F.col("lang").alias("language"), F.lit("semantic_safe").alias("split_mode"), F.lit(3).alias("top_k"), F.lit("v1").alias("prompt_version"))
    fault = lambda i, other, name: F.expr(f"case when doc_id % 7 = {i} then {other} else {name} end").alias(name)
    stored = wanted.where("doc_id % 5 <> 0").select("doc_id", "unit_id", fault(1, "'old'", "source_hash"), fault(2, "null", "language"), fault(3, "'progressive'", "split_mode"), fault(4, "5", "top_k"), fault(5, "'v0'", "prompt_version"), F.expr("case when doc_id % 7 = 6 then ' ' else 'that' end").alias("content"))
    return stored, wanted


def unit_summary_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.unit_summary_validity(*_unit_artifacts(spark, sf_dir))


def artifact_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries and quizzes of one unit a document; a quiz is stored for every fourth one and is always valid."""
    stored, wanted = _unit_artifacts(spark, sf_dir)
    quizzes = wanted.select("doc_id", "unit_id", F.expr("case when doc_id % 4 = 0 then 'valid' else 'missing' end").alias("status"), F.lit(None).cast("string").alias("reason"))
    return layout.availability(layout.unit_summary_validity(stored, wanted), quizzes, ["doc_id", "unit_id"])


def title_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of titled texts; of every third document chapters bear one of four titles, of others every second none."""
    bare = (F.col("doc_id") % 3 == 1) & (F.col("section_index") % 2 == 1)
    rows = titled_sections(spark, sf_dir).withColumn("title", F.when((F.col("doc_id") % 3 == 0) & (F.col("section_index") > 2), F.concat(F.lit("T"), F.col("section_index") % 4)).when(~bare, F.col("title")))
    return layout.title_uniqueness(rows)


def structure_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes, risks and shares that go round by the id."""
    pick = lambda names, step: F.element_at(F.array(*map(F.lit, names)), (F.expr(f"doc_id div {step}") % len(names) + 1).cast("int"))
    rows = documents(spark, sf_dir).select(
        "doc_id", pick(SHAPES, 1).alias("parser_shape"), pick(SHAPES, 7).alias("post_shape"), pick(RISKS, 3).alias("risk"), F.when(F.col("doc_id") % 11 != 0, (F.col("doc_id") % 11 - 1) / 9.0).alias("coverage"), (F.col("doc_id") % 2 == 0).alias("repeated_local"),
    )
    return layout.diagnostics(rows)


SHAPES = ["unknown", "mixed", "flat_long_text", "essay_sections", "chapter_section", "part_chapter", None]
RISKS = ["unknown", "none", "low", "medium", "high"]


def languages_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.infer_language(F.col("text")).alias("language"))


def languages_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a detector in several forms; a text's language as its profile has it, else as the document."""
    answer = F.concat(F.lit(" "), F.element_at(F.array(*map(F.lit, ANSWERS)), (F.col("doc_id") % len(ANSWERS) + 1).cast("int")))
    code = T.detector_language(answer)
    return documents(spark, sf_dir).select("doc_id", code.alias("language"), F.coalesce(F.nullif(code, F.lit("unknown")), T.blank_to_null(F.col("lang"))).alias("summary_language"))


ANSWERS = ["English.", "zh_Hans", "FR", "deu", "pt-BR is it", "Ukrainian", "klingon", "en-gb"]


def request_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, MODES)), (F.col("doc_id") % len(MODES) + 1).cast("int"))
    asked, scope = F.expr("case when doc_id % 6 > 0 then doc_id % 6 end"), F.expr("case when doc_id % 2 = 0 then 'local' else 'global' end")
    mode = T.split_mode(name)
    return documents(spark, sf_dir).select("doc_id", mode.alias("split_mode"), T.split_mode(name, True).alias("strict_mode"), T.candidates_wanted(asked, mode, 5).alias("candidates"), T.effective_k(asked, scope).cast("long").alias("k"))


MODES = ["semantic-safe", "Window", "LLM", " progressive ", "odd", "", "llm_enhanced", "safe"]


def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(T.preview(F.col("text"), 400)).alias("preview_md5"), F.length(T.preview(F.col("text"), 400)).cast("long").alias("n_chars"), F.md5(T.preview(F.col("text"), 40)).alias("short_md5"))


def context_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens left for context beside a conversation's turn as question, and whether the turn fits."""
    tokens = T.estimate_tokens(F.col("text"))
    left = T.context_budget(F.lit(1500), F.lit(2000), tokens * 40, F.lit(300))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", left.cast("long").alias("left_tokens"), (tokens <= left).alias("fits"))


QUERIES = {
    f.__name__: f
    for f in (
        body_starts, weak_headings, headings_without_shells, parsed_sections, keyword_lines, section_units, selected_units, containing_units, unit_coverage, unit_contents, layout_validity, unit_summary_validity,
        artifact_availability, title_uniqueness, structure_diagnostics, languages_inferred, languages_detected, request_options, previews, context_budgets,
    )
}


def _lines(texts: str) -> str:
    """Lines of texts (doc_id, lang, text) with what body rules ask of them."""
    return rf"""(select *, regexp_replace(lower(regexp_replace(title, '\s+', ' ', 'g')), '[.:：;；]+$', '') as key, level is not null and worded <> '' strong from (select *, case when not prose and length(title) <= 90 then case when worded <> '' then 1 when regexp_matches(title, '^[0-9]+(\.[0-9]+)+[ .].{{1,80}}$') or regexp_matches(title, '^[0-9]{{1,3}}\. +\p{{Lu}}.{{1,80}}$') or {REGION} then 1 end end as level
        from (select *, case when {_numbered(structure.CHAPTER)} then 'chapter' when {_numbered(structure.PART)} then 'part' else '' end worded, {PROSE} prose,
        title <> '' and not regexp_matches(title, '^[-_=~*#\s]+$') and (length(title) >= 40 or len(regexp_extract_all(title, '[A-Za-z0-9]+')) >= 8) meaningful
        from (select *, {STRIPPED.format("line")} title, coalesce(sum(length(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint char_start
        from (select doc_id, lang, length(text) size, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 line_no from {texts} where text is not null)))))"""


def _is_marker(region: str) -> str:
    words = "|".join(sorted(structure.REGIONS[region].split("|"), key=len, reverse=True))
    rest = f"regexp_extract(key, '^({words})( .*)?$', 2)"
    return rf"(regexp_matches(key, '^({words})( .*)?$') and ({rest} = '' or (length({rest}) <= 20 and regexp_matches({rest}, '^( *([0-9]{{1,4}}|[ivxlcdm]{{1,7}}|\pL)[.:)]?){{1,3}} *$', 'i'))))"


REGION = "(" + " or ".join(f"regexp_matches(title, '^({words})[:.]?$', 'i')" for words in structure.REGIONS.values()) + ")"
CHAPTER_WORD, PART_SQL = _word(2), "(case lang " + " ".join(f"when '{code}' then '{word}'" for code, word in PART_WORD.items()) + " else 'Part' end)"
LISTED = f"""(select t.doc_id, t.lang, case t.doc_id % 3 when 0 then array_to_string(list_concat([{_word(0).replace("lang", "t.lang")}], list_transform(range(1, (len(string_split(d.text, chr(10))) + 3) // 6 + 1), lambda i: {_word(2).replace("lang", "t.lang")} || ' ' || i), [substring(t.text, length({_word(0).replace("lang", "t.lang")}) + 2)]), chr(10))
    when 1 then t.text else d.text end as text from {TITLED} t join documents d using (doc_id))"""


def _said(what: str) -> str:
    return f"(select doc_id, lang, array_to_string(list_transform(string_split(text, chr(10)), lambda x, j: case when (j - 1) % 6 = 2 then {what} || x else x end), chr(10)) as text from documents)"


WEAK = _said("chr(10) || case when doc_id % 2 = 0 then 'Summary ' else '' end || array_to_string(string_split(x, ' ')[1:(j - 1 + doc_id % 7) % 12], ' ') || chr(10) || chr(10)")
SHELLS = _said(f"case when ((j - 1) // 6 + 1) % 2 = 1 then {PART_SQL} || ' ' || ((j - 1) // 6 + 1) || chr(10) || case when ((j - 1) // 6 + 1) % 4 = 3 then x || chr(10) else '' end else '' end || {CHAPTER_WORD} || ' ' || ((j - 1) // 6 + 1) || chr(10)")
MIXED = f"""(select doc_id, lang, text from {LISTED} where doc_id % 9 < 3 union all select doc_id, lang, text from {WEAK} where doc_id % 9 between 3 and 5 union all select doc_id, lang, text from {SHELLS} where doc_id % 9 > 5)"""
LAYOUT = f"""m as materialized {MERGED}, s as (select doc_id, unit_no::varchar section_id, unit_no i from m), g as (select doc_id, merged_no, list(unit_no::varchar) ids from m group by all having merged_no % 5 <> 3),
    u as materialized (select doc_id, merged_no::varchar unit_id, merged_no * 2 unit_no, ids from g union all select doc_id, merged_no || 'b', merged_no * 2 + 1, ids from g where merged_no % 4 = 0),
    e as materialized (select doc_id, unit_id, unit_no, unnest(ids) section_id from u), a as materialized (select doc_id, section_id, unit_id, row_number() over (partition by doc_id, section_id order by unit_no) - 1 place from e)"""
UNIT = f"""(with w as (select doc_id, sha256(text) h, lang, 'semantic_safe' split, 3 top, 'v1' prompt from documents),
    s as (select doc_id, case when doc_id % 7 = 6 then ' ' else 'that' end content, case when doc_id % 7 = 1 then 'old' else h end h, case when doc_id % 7 <> 2 then lang end lang, case when doc_id % 7 = 3 then 'progressive' else split end split, case when doc_id % 7 = 4 then 5 else top end top, case when doc_id % 7 = 5 then 'v0' else prompt end prompt from w where doc_id % 5 <> 0)
    select w.doc_id, 'u0' unit_id, s.doc_id is not null present, case when s.doc_id is null then null when trim(content) = '' then 'empty_content' when s.h is distinct from w.h then 'source_hash_mismatch' when s.lang is distinct from w.lang then 'language_mismatch' when s.split <> w.split then 'split_mode_mismatch'
    when s.top <> w.top then 'semantic_top_k_mismatch' when s.prompt <> w.prompt then 'prompt_version_mismatch' end reason from w left join s using (doc_id))"""
_HINTS = " ".join("when " + " or ".join(f"contains(t, '{w}')" for w in words) + f" then '{code}'" for code, words in T.HINTS.items())
_SCRIPTS = " ".join(f"when regexp_matches(t, '{pattern}') then '{code}'" for code, pattern in T.SCRIPTS.items())


def _coded(tag: str) -> str:
    return f"(case {tag} " + " ".join(f"when '{name}' then '{code}'" for name, code in T.LANGUAGES.items()) + " end)"


def _picked(names: list, index: str) -> str:
    return "([" + ", ".join("null" if n is None else f"'{n}'" for n in names) + f"])[{index} % {len(names)} + 1]"


def _body_starts(texts: str) -> str:
    return f"""with l as materialized (select *, coalesce(bool_or(prose and not strong) over (partition by doc_id order by line_no rows between 1 following and 3 following), false) follows from {_lines(texts)}),
        t as (select doc_id, min(line_no) mark from l where {_is_marker('toc')} and char_start <= greatest(1500, floor(size * 0.35)) group by doc_id),
        e as (select l.doc_id, mark, least(mark + 181, min(line_no) filter (prose and line_no > mark)) stop from l join t using (doc_id) group by l.doc_id, mark),
        i as (select l.doc_id, l.key from l join e using (doc_id) where strong and line_no > mark and line_no < stop), n as (select doc_id from i group by doc_id having count(*) >= 3),
        o as (select l.doc_id, l.key, char_start, follows, row_number() over (partition by l.doc_id, l.key order by line_no) seen from l join e using (doc_id) where strong and line_no > mark),
        b as (select o.doc_id, min(char_start) s from o join n using (doc_id) where seen > 1 and follows and (o.doc_id, o.key) in (select doc_id, key from i) group by all),
        f as (select doc_id, min(line_no) mark from l where {_is_marker('front_matter')} and char_start <= greatest(1500, floor(size * 0.45)) group by doc_id),
        c as (select l.doc_id, min(char_start) s from l join f using (doc_id) where strong and follows and line_no between mark + 1 and mark + 360 group by all)
        select d.doc_id, coalesce(b.s, c.s, 0)::bigint char_start, case when b.s is not null then 'contents' when c.s is not null then 'front_matter' else 'none' end reason from (select distinct doc_id from l) d left join b using (doc_id) left join c using (doc_id)"""


ORACLE = {
    "body_starts": _body_starts(LISTED),
    "parsed_sections": rf"""with s as materialized ({_body_starts(MIXED)}),
        b as (select l.*, s.char_start as start, coalesce(lag(title = '') over w, true) and coalesce(lead(title = '') over w, true) alone, contains(lower(title), 'summary') or contains(lower(title), 'notes') signal, len(regexp_extract_all(title, '[A-Za-z0-9]+')) n from {_lines(MIXED)} l join s on s.doc_id = l.doc_id and l.char_start >= s.char_start window w as (partition by l.doc_id order by line_no)),
        c as (select *, level is null and alone and title <> '' and length(title) <= case when signal then 60 else 40 end and not regexp_matches(title, '^[-_=~*#\s]+$') and not regexp_matches(title, '[。！？!?;；,.，:]$') and n between 1 and case when signal then 12 else 8 end weak,
            sum((meaningful and level is null)::int) over w said, coalesce(sum((meaningful or prose)::int) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) earlier from b window w as (partition by doc_id order by line_no)),
        m as (select *, coalesce(worded = 'part' and lead(worded) over w = 'chapter' and lead(said) over w = said, false) shell from (select *, count(level) over (partition by doc_id) strongs, count(*) filter (weak) over (partition by doc_id) weaks from c) where level is not null or (strongs = 0 and weaks >= 2 and weak) window w as (partition by doc_id order by line_no)),
        k as (select *, last_value(held ignore nulls) over (partition by doc_id order by line_no) container from (select *, case when lag(shell) over (partition by doc_id order by line_no) then lag(title) over (partition by doc_id order by line_no) end held from m)),
        h as (select doc_id, char_start, title, case when level is null then 1 when worded = 'chapter' then 2 when worded = 'part' then 1 when regexp_matches(title, '^[0-9]+(\.[0-9]+)+[ .].{{1,80}}$') then 3 when regexp_matches(title, '^[0-9]{{1,3}}\. +\p{{Lu}}.{{1,80}}$') then 2 else 1 end as level, container,
            case {" ".join(f"when regexp_matches(title, '^({words})[:.]?$', 'i') then '{region}'" for region, words in structure.REGIONS.items())} end region, level is not null and earlier = 0 opens from k where not shell),
        f as (select doc_id, min(char_start) first, arg_min(opens, char_start) opens from h group by doc_id),
        a as (select doc_id, char_start, title, level, container, region from h union all select s.doc_id, s.char_start, null, 1, null, null from s left join f using (doc_id) where f.first is null or (f.first > s.char_start and not opens)),
        r as (select a.*, text, row_number() over v - 1 section_index, coalesce(lead(char_start) over v, length(text)) char_end from a join {MIXED} using (doc_id) window v as (partition by doc_id order by char_start))
        select doc_id, 'section-' || section_index section_id, section_index, title, level, container, case when region in ('toc', 'front_matter') and char_start / greatest(1, length(text)) <= 0.45 then region when region in ('appendix', 'back_matter') and char_start / greatest(1, length(text)) >= 0.60 then region else 'main_body' end section_role,
        char_start, char_end, sha256(substring(text, char_start + 1, char_end - char_start)) as content from r""",
    "weak_headings": rf"""with l as (select *, coalesce(lag(title = '') over w, true) and coalesce(lead(title = '') over w, true) alone, contains(lower(title), 'summary') or contains(lower(title), 'notes') signal, len(regexp_extract_all(title, '[A-Za-z0-9]+')) n from {_lines(WEAK)} window w as (partition by doc_id order by line_no)),
        k as (select doc_id, line_no, char_start, title, count(*) over (partition by doc_id) c from l where level is null and alone and title <> '' and length(title) <= case when signal then 60 else 40 end and not regexp_matches(title, '^[-_=~*#\s]+$') and not regexp_matches(title, '[。！？!?;；,.，:]$') and n between 1 and case when signal then 12 else 8 end)
        select doc_id, line_no, char_start, title from k where c >= 2""",
    "headings_without_shells": rf"""with l as (select *, sum((meaningful and level is null)::int) over (partition by doc_id order by line_no) said from {_lines(SHELLS)}),
        h as (select *, coalesce(worded = 'part' and lead(worded) over w = 'chapter' and lead(said) over w = said, false) shell from l where level is not null window w as (partition by doc_id order by line_no)),
        k as (select *, case when lag(shell) over w then lag(title) over w end container from h window w as (partition by doc_id order by line_no))
        select doc_id, line_no, char_start, title, case when worded = 'chapter' then 2 when worded = 'part' then 1 when regexp_matches(title, '^[0-9]+(\.[0-9]+)+[ .].{{1,80}}$') then 3 when regexp_matches(title, '^[0-9]{{1,3}}\. +\p{{Lu}}.{{1,80}}$') then 2 else 1 end::int as level, container from k where not shell""",
    "keyword_lines": f"""with l as (select doc_id, lang, line_no, {STRIPPED.format('line')} line from (select doc_id, lang, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 line_no from {TITLED})),
        h as (select * from l where length(line) <= 90 and case lang {" ".join(f"when '{c}' then regexp_matches(line, '^({'|'.join(sorted(w, key=len, reverse=True))})($|[ :：–—.{chr(9)}-])', 'i') or regexp_matches(line, '^ *[（(]?([0-9]+|[ivxlcdm]+)[）)]?[、.．:：–—)-] *({'|'.join(sorted(w, key=len, reverse=True))})($|[ :：–—（(【-])', 'i')" for c, w in KEYWORDS.items())} else false end),
        f as (select doc_id, min(line_no) line_no, arg_min(line, line_no) line from h group by doc_id, lower(line))
        select * from (select doc_id, row_number() over (partition by doc_id order by line_no) place, line_no, line from f) where place <= 60""",
    "section_units": f"with {LAYOUT} select doc_id, section_id, unit_id, place from a",
    "selected_units": f"""with {LAYOUT}, o as (select doc_id, unit_id, row_number() over (partition by doc_id order by i, place) - 1 unit_index from (select doc_id, unit_id, min(i) i, arg_min(place, i) place from a join s using (doc_id, section_id) group by all))
        select s.doc_id, s.section_id, f.unit_id, o.unit_index from s left join (select * from a where place = 0) f using (doc_id, section_id) left join o on o.doc_id = s.doc_id and o.unit_id = f.unit_id""",
    "containing_units": f"""with {LAYOUT}, n as (select doc_id, unit_id, row_number() over (partition by doc_id order by unit_no) - 1 unit_index from u)
        select s.doc_id, s.section_id, f.unit_id, f.unit_index from s left join (select e.doc_id, e.section_id, arg_min(n.unit_id, unit_index) unit_id, min(unit_index) unit_index from e join n using (doc_id, unit_id) where not ends_with(unit_id, 'b') group by all) f using (doc_id, section_id)""",
    "unit_coverage": f"""with {LAYOUT}, c as (select doc_id, count(*) n, count(*) filter ((doc_id, section_id) in (select doc_id, section_id from a)) k from s group by doc_id)
        select doc_id, n n_sections, k with_units, round(k / n, 4) coverage, round(k / n, 4) >= 0.95 available from c""",
    "unit_contents": f"""with {LAYOUT}, w as (select doc_id, unit_id from u union all select doc_id, 'absent' from documents), k as (select doc_id, unit_id, unit_no, case when unit_no // 2 % 3 = 0 then len(ids) else 1 end n, list_sort(ids)[1] section_id from u),
        r as (select w.doc_id, w.unit_id, k.section_id, s.i, case when n is null then 'missing' when n > 1 then 'duplicate' when k.unit_no % 6 = 4 then 'empty' else 'found' end status from w left join k using (doc_id, unit_id) left join s on s.doc_id = w.doc_id and s.section_id = k.section_id),
        h as (select *, case when status = 'found' and i // 4 % 2 = 0 then 'c' || (i // 4) end chapter_id from r)
        select doc_id, unit_id, status, case when status = 'found' then section_id end section_id, case when status = 'found' then 's' || i end section_title, chapter_id, 'Chapter ' || chapter_id chapter_title, case when status = 'found' then unit_id end as content from h""",
    "layout_validity": f"""with {LAYOUT}, b as (select distinct doc_id from s where doc_id % 3 = 0 and i % 6 <> 5 and (doc_id, section_id) not in (select doc_id, section_id from a))
        select doc_id, doc_id % 13 <> 0 and doc_id not in (select doc_id from b) and doc_id % 11 not between 1 and 4 valid from documents""",
    "unit_summary_validity": f"select doc_id, unit_id, case when not present then 'missing' when reason is null then 'valid' else 'invalid' end status, reason from {UNIT}",
    "artifact_availability": f"""select doc_id, unit_id, present has_summary, doc_id % 4 = 0 has_quiz, present and reason is null summary_cache_valid, doc_id % 4 = 0 quiz_cache_valid, reason summary_invalid_reason, null::varchar quiz_invalid_reason from {UNIT} where present or doc_id % 4 = 0""",
    "title_uniqueness": f"""with p as (select doc_id, chapter_seq, section_index, case when doc_id % 3 = 0 and section_index > 2 then 'T' || (section_index % 4) when doc_id % 3 <> 1 or section_index % 2 <> 1 then title end title from {TITLED_SECTIONS}),
        q as (select *, count(*) over (partition by doc_id, chapter_seq) size, row_number() over (partition by doc_id, chapter_seq order by section_index) r, nullif(lower(trim(title)), '') k from p),
        c as (select doc_id, count(*) n, count(k) t from q where r = 1 group by doc_id), s as (select doc_id, count(*) n, count(k) t from q group by doc_id),
        rc as (select doc_id, count(*) n from (select doc_id, k from q where r = 1 and k is not null group by all having count(*) > 1) group by doc_id),
        rs as (select doc_id, count(*) n from (select doc_id, k from q where size > 1 and k is not null group by all having count(*) > 1) group by doc_id),
        f as (select s.doc_id, coalesce(rc.n, 0) repeated_chapters, coalesce(rs.n, 0) repeated_sections, round((c.t + s.t) / (c.n + s.n), 4) title_coverage from s join c using (doc_id) left join rc using (doc_id) left join rs using (doc_id))
        select *, case when repeated_chapters > 0 or repeated_sections >= 3 then 'high' when repeated_sections > 0 then 'medium' when title_coverage < 0.4 then 'medium' when title_coverage < 0.65 then 'low' else 'none' end risk from f""",
    "structure_diagnostics": f"""with p as (select doc_id, {_picked(SHAPES, 'doc_id')} parser, {_picked(SHAPES, '(doc_id // 7)')} post, {_picked(RISKS, '(doc_id // 3)')} risk, case when doc_id % 11 <> 0 then (doc_id % 11 - 1) / 9.0::double end coverage from documents),
        f as (select *, risk in ('medium', 'high') r, coalesce(coverage < 0.95, true) i, coalesce(parser not in ('unknown', 'mixed') and post not in ('unknown', 'mixed') and parser <> post, false) m from p)
        select doc_id, r requires_id, m shape_mismatch, concat_ws(',', case when r then 'chapter_or_section_titles_are_not_unique_use_id_targets' end, case when i then 'task_unit_stats_not_available_or_incomplete' end, case when coverage > 0 and coverage < 0.95 then 'task_unit_stats_partially_available' end,
        case when m then 'pre_structure_shape_differs_from_post_structure_shape' end) warnings, case when post = 'flat_long_text' and parser in ('essay_sections', 'chapter_section', 'part_chapter') then 'common_parser_may_undersegment' when post = 'part_chapter' and doc_id % 2 = 0 then 'common_parser_may_have_flattened_parent_grouping' end hint from f""",
    "languages_inferred": f"select doc_id, case when t is null then 'unknown' {_SCRIPTS} when regexp_matches(t, '[a-z]') then case {_HINTS} else 'en' end else 'unknown' end as language from (select doc_id, lower(trim(text)) t from documents)",
    "languages_detected": f"""with a as (select doc_id, lang, regexp_replace(replace(lower(split_part(replace(trim({_picked(ANSWERS, 'doc_id')}), '.', ''), ' ', 1)), '_', '-'), '[^a-z-]', '', 'g') t from documents),
        c as (select doc_id, lang, coalesce({_coded('t')}, {_coded("split_part(t, '-', 1)")}, 'unknown') c from a)
        select doc_id, c as language, coalesce(nullif(c, 'unknown'), nullif(trim(lang), '')) summary_language from c""",
    "request_options": f"""with a as (select doc_id, replace(lower(trim({_picked(MODES, 'doc_id')})), '-', '_') m, case when doc_id % 6 > 0 then doc_id % 6 end k from documents),
        b as (select *, case when m in ('progressive', 'window') then 'progressive' when m in ('llm_enhanced', 'enhanced', 'llm') then 'llm_enhanced' else 'semantic_safe' end s from a)
        select doc_id, s split_mode, case when m in ('semantic_safe', 'progressive', 'llm_enhanced') then m end strict_mode, case when s = 'semantic_safe' then k end::bigint candidates, case when doc_id % 2 = 0 then k else greatest(k, 8) end::bigint k from b""",
    "previews": """with p as (select doc_id, text, case when length(text) <= 400 then text else substring(text, 1, 241) || chr(10) || chr(10) || '[... middle omitted ...]' || chr(10) || chr(10) || right(text, 131) end p from documents)
        select doc_id, md5(p) preview_md5, length(p) n_chars, md5(substring(text, 1, 40)) short_md5 from p""",
    "context_budgets": f"""with t as (select conv_id, turn, {TOKENS.format('text')}::bigint t from conversations), b as (select *, greatest(0, least(1500, 2000 - t * 40 - 300))::bigint b from t)
        select conv_id, turn, b left_tokens, t <= b fits from b""",
}
