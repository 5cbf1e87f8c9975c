"""Queries of the document engine by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import artifacts, lines, profile, retrieval, structure, units
from quire.streaming import sessions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def dealt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text and lang, dealt by id: a file is read by no more tasks than it has row groups, of which it may have one."""
    return documents(spark, sf_dir).select("doc_id", "text", "lang").repartition("doc_id")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fixed_chunks(documents(spark, sf_dir))


def _nearest(spark: SparkSession, sf_dir: str, k: int, measure: str = "distance") -> DataFrame:
    """The k nearest vectors of every query; queries are the rows whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.search(vectors, vectors.where("vec_id % 100 = 0"), k, measure)


def vector_topk_answer_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _nearest(spark, sf_dir, 8)
    best = F.min("score").over(Window.partitionBy("query_id"))
    return hits.select("query_id", "place", "vec_id", F.round("score", 5).alias("score"), retrieval.answer_mode(best).alias("answer_mode"))


def cosine_to_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, 8, "cosine").select("query_id", "place", "vec_id", F.round(1 - F.col("score"), 5).alias("cosine"))


def unit_vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = T.unit(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(T.dot(unit, unit), 6).alias("squared_norm"), F.round(F.element_at(unit, 1), 6).alias("first"))


def coverage_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _nearest(spark, sf_dir, 12).select("query_id", F.col("place").alias("rank"), F.expr("vec_id div 10").alias("place"))
    return retrieval.coverage(hits, "query_id", "rank", "place")


def doc_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"))


def exact_duplicate_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_fingerprint(spark, sf_dir).groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def stale_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = doc_fingerprint(spark, sf_dir)
    return artifacts.stale(now, now.where("doc_id % 3 = 0"))


def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.explode_lines(documents(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "char_start", "char_end", F.md5("line").alias("line_md5"))


def line_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.prose_follows(lines.explode_lines(documents(spark, sf_dir)))
    line = F.col("line")
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), lines.is_prose(line).alias("prose"), lines.is_heading_like(line).alias("heading_like"), "prose_follows")


def evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.evidence_lines(lines.explode_lines(documents(spark, sf_dir))).select("doc_id", F.col("place").cast("long").alias("place"), F.col("line_no").cast("long").alias("line_no"), "line")


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


def token_totals_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("docs"), F.sum(T.estimate_tokens(F.col("text"))).alias("tokens"))


def language_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"en": "en", "english": "en", "fr": "fr", "french": "fr", "de": "de", "german": "de", "es": "es", "spanish": "es"}
    return documents(spark, sf_dir).select("doc_id", T.language_alias(F.concat(F.upper("lang"), F.lit("_XX")), names).alias("language"))


def script_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.script_system(documents(spark, sf_dir)).select("doc_id", "latin", "cjk", "cyrillic", "script_system")


def line_break_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.line_break_quality(documents(spark, sf_dir))


def ocr_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.ocr_noise(documents(spark, sf_dir))


def dialogue_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.dialogue_density(documents(spark, sf_dir))


def region_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.region_likelihoods(documents(spark, sf_dir))


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.excerpts(documents(spark, sf_dir)).select("doc_id", *(F.md5(k).alias(f"{k}_md5") for k in ("head", "middle", "tail")))


def chunk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.link_chunks(chunks(spark, sf_dir)).select("doc_id", "chunk_index", "char_start", "char_end", "prev_index", "next_index", F.md5("text").alias("text_md5"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where("length(text) > 0").select("doc_id", F.expr("doc_id % 5").alias("hit_index"))


def local_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.local_window(_hits(spark, sf_dir), chunks(spark, sf_dir)).select("doc_id", "hit_index", "chunk_index", F.md5("text").alias("text_md5"))


def merged_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir)
    return retrieval.merge_windows(retrieval.local_window(hits.union(hits.withColumn("hit_index", F.col("hit_index") + 1)), chunks(spark, sf_dir)))


def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.budget_prefix(chunks(spark, sf_dir), 1500).withColumn("text", F.md5("text"))


def context_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"), F.expr("(doc_id % 17) / 10.0D + 0.5D").alias("best"), F.expr("case when doc_id % 3 = 0 then 'global' else 'local' end").alias("scope"), F.expr("doc_id % 7").alias("distance"))
    mode = retrieval.answer_mode(F.col("best"))
    near = T.near_chunk_threshold(F.col("best"), mode)
    return rows.select("doc_id", mode.alias("answer_mode"), near.cast("long").alias("threshold"), retrieval.context_mode(F.col("tokens"), F.lit(1500), F.col("scope"), F.col("distance"), near, mode).alias("context_mode"))


# The headings that `titled` writes into texts, by language.
TITLES = {"en": ("Contents", "Preface", "Chapter", "Appendix"), "fr": ("Sommaire", "Préface", "Chapitre", "Annexe"), "de": ("Inhalt", "Vorwort", "Kapitel", "Anhang"), "es": ("Contenido", "Prólogo", "Capítulo", "Apéndice")}


def titled(docs: DataFrame) -> DataFrame:
    """The documents with headings written into their texts, which have none: contents and a preface before the first
    line, a numbered chapter before every sixth, an appendix after the last."""
    word = lambda i: F.coalesce(*(F.when(F.col("lang") == code, words[i]) for code, words in TITLES.items()), F.lit(TITLES["en"][i]))
    line = lambda x, i: F.when(i % 6 == 2, F.concat(word(2), F.lit(" "), (F.floor(i / 6) + 1).cast("string"), F.lit("\n"), x)).otherwise(x)
    text = F.array_join(F.concat(F.array(word(0), word(1)), F.transform(F.split("text", "\n"), line), F.array(word(3))), "\n")
    return docs.withColumn("text", text)


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titled(dealt_documents(spark, sf_dir))


def titled_sections(spark: SparkSession, sf_dir: str, content: bool = True) -> DataFrame:
    return structure.chaptered_sections(_titled(spark, sf_dir), content)


def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.headings(_titled(spark, sf_dir)).withColumn("line_no", F.col("line_no").cast("long"))


def section_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titled_sections(spark, sf_dir).withColumn("content", F.sha2("content", 256))


def structure_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.structure_stats(titled_sections(spark, sf_dir))


def enhanced_parse_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _titled(spark, sf_dir)
    ratios = docs.select("doc_id", F.expr("(doc_id % 5) / 3.0D").alias("affected_ratio"), F.expr("(doc_id % 7) / 6.0D").alias("fallback_ratio"), F.expr("doc_id % 11").alias("n_units"))
    return structure.enhanced_parse_score(structure.sections(docs), docs, ratios)


def paragraph_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.pack_lines(documents(spark, sf_dir)).select("doc_id", "unit_no", "n_chars", F.md5("text").alias("text_md5"))


def progressive_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.progressive_units(documents(spark, sf_dir))


def boxed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.pack_lines(documents(spark, sf_dir), 400).select("doc_id", "unit_no", "n_chars", F.concat(F.lit("box"), F.expr("(unit_no div 3) % 2")).alias("container"))


def merged_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.merge_short(boxed_units(spark, sf_dir)).select("doc_id", "unit_no", "n_chars", "merged_no")


def _wanted_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        "doc_id", F.lit("section-0").alias("section_id"), T.source_hash(F.col("text")).alias("source_hash"), F.col("lang").alias("language"), F.lit("semantic_safe").alias("split_mode"), F.lit(3).alias("top_k"), F.lit("v1").alias("prompt_version"),
        F.expr("case when doc_id % 2 = 0 then 'chapter' else 'section' end").alias("scope"), F.lit("One").alias("chapter_title"), F.lit("q1").alias("schema_version"),
    )


def _stored_artifacts(wanted: DataFrame) -> DataFrame:
    """What is wanted with one fault in most rows, by the id, and some missing."""
    fault = lambda i, other, name: F.expr(f"case when doc_id % 11 = {i} then {other} else {name} end").alias(name)
    return wanted.where("doc_id % 13 <> 0").select(
        "doc_id", "section_id", fault(1, "'old'", "source_hash"), fault(2, "null", "language"), fault(3, "'progressive'", "split_mode"), fault(4, "5", "top_k"), fault(5, "'v0'", "prompt_version"), fault(6, "'document'", "scope"),
        F.expr("case when doc_id % 11 = 7 then 'section-9' else section_id end").alias("source_section_id"), fault(8, "'Two'", "chapter_title"), F.expr("case when doc_id % 11 = 9 then ' \n' else 'summary' end").alias("content"), fault(10, "'q0'", "schema_version"),
    )


def summary_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _wanted_artifacts(spark, sf_dir)
    return artifacts.summary_validity(_stored_artifacts(wanted), wanted)


def quiz_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _wanted_artifacts(spark, sf_dir)
    item = lambda answer: F.struct(F.lit("1").alias("question_id"), F.lit("what").alias("question_text"), answer.alias("answer_text"))
    stored = _stored_artifacts(wanted).withColumn("items", F.array(item(F.lit("that")), item(F.col("content")))).drop("content")
    return artifacts.quiz_validity(stored, wanted)


def chapter_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = titled_sections(spark, sf_dir).groupBy("doc_id", "chapter_seq").agg(F.min_by("title", "section_index").alias("title"))
    chapters = chapters.select("doc_id", F.concat(F.lit("c"), "chapter_seq").alias("chapter_id"), F.when(F.col("chapter_seq") % 4 == 1, F.lit("old-key")).alias("legacy_key"), "title")
    keys = artifacts.chapter_keys(chapters)
    stored = keys.where("place = doc_id % 3").select("doc_id", "key", F.md5("key").alias("content")).dropDuplicates(["doc_id", "key"])
    return artifacts.stored_for_chapters(chapters, stored)


def artifact_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return artifacts.upsert(base, base.where("doc_id % 2 = 0").withColumn("quality", 1 - F.col("quality")), ["doc_id"])


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("turn"), F.col("event_type").alias("doc_name"), F.expr("case when event_id % 4 = 0 then null else event_id % 50 end").alias("best_chunk"))


def session_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.replay(_turns(spark, sf_dir))


def conversation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(T.estimate_tokens(F.col("text"))).alias("tokens"), F.count_if(F.col("role") == "user").alias("questions"))


QUERIES = {
    f.__name__: f
    for f in (
        vector_topk_answer_mode, cosine_to_query, unit_vector_norms, coverage_hits, doc_fingerprint, exact_duplicate_docs, stale_documents, line_offsets, line_flags,
        evidence_lines, token_estimate, token_totals_by_lang, language_alias, script_system, line_break_quality, ocr_noise, dialogue_density, region_likelihoods, excerpts,
        chunk_links, local_windows, merged_windows, budget_prefix, context_routing, heading_lines, section_table, structure_stats, enhanced_parse_score, paragraph_units,
        progressive_units, merged_units, summary_validity, quiz_validity, chapter_artifacts, artifact_upsert, session_replay, conversation_totals,
    )
}

STRIPPED = r"regexp_replace({0}, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g')"
ENDED = r"""[.!?。！？؛؟]["''”’»›」』》)\]}）】〕〉》]*$"""
WORDS = "[A-Za-zÀ-ÖØ-öø-ÿ0-9]+"
LINES = "(select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 line_no from documents)"
TOKENS = r"""(case when length(coalesce({0}, '')) = 0 then 0 else greatest(1,
    (length(regexp_replace({0}, '\s', '', 'g')) - len(regexp_extract_all({0}, '[\x21-\x7e]')))
    + cast(floor((len(regexp_extract_all({0}, '[\x21-\x7e]')) + 3) / 4.0) as bigint)) end)"""
CHUNKS = """(select doc_id, i chunk_index, i * 1000 char_start, least(i * 1000 + 1200, length(text)) char_end, substring(text, i * 1000 + 1, 1200) text
    from (select doc_id, text, unnest(range(0, cast(greatest(0, ceil((length(text) - 1200) / 1000.0)) as bigint) + 1)) i from documents where length(text) > 0))"""
BARE = "[。！？.!?]$"
PROSE = r"""(regexp_matches({0}, '[.!?。！？]$') and case when regexp_matches({0}, '[\x{{4e00}}-\x{{9fff}}]') then length({0}) >= 25 else length({0}) >= 60 and len(regexp_extract_all({0}, '[A-Za-z0-9]+')) >= 10 end)""".format(STRIPPED.format("line"))
BREAKS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def _split(text: str) -> str:
    """Lines at every kind of line break, none after the last."""
    parts = f"string_split_regex({text}, '{BREAKS}')"
    return f"(case when {parts}[-1] = '' then {parts}[:-2] else {parts} end)"


NOISE = r"""(least(1.0::double, len(regexp_extract_all({0}, '�')) / 20) + least(1.0::double, len(regexp_extract_all({0}, '[\x00-\x08\x0b\x0c\x0e-\x1f]')) / 30)
    + least(1.0::double, 10 * len(regexp_extract_all({0}, '  ')) / greatest(1, length({0}))) + case when len(regexp_extract_all({0}, '[。！？；,.!?;:：，、]')) / greatest(1, length({0})) < 0.002 then 0.5::double else 0.0::double end)"""


def _pairs(score: str, k: int) -> str:
    """The k nearest rows of each query by a score of e (row) and q (query)."""
    return f"""(select * from (select q.vec_id query_id, e.vec_id, {score} score, row_number() over (partition by q.vec_id order by {score}, e.vec_id) place
        from embeddings e join (select * from embeddings where vec_id % 100 = 0) q on e.vec_id <> q.vec_id) where place <= {k})"""


PRODUCT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::double * z[2]::double))"
DISTANCE = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))"
COSINE = f"({PRODUCT.format('e.embedding', 'q.embedding')} / sqrt({PRODUCT.format('e.embedding', 'e.embedding')} * {PRODUCT.format('q.embedding', 'q.embedding')}))"
MODE = "case when {0} < 1.10 then 'strict' when {0} < 1.28 then 'cautious' else 'reject' end"


def _word(i: int) -> str:
    return "(case lang " + " ".join(f"when '{code}' then '{words[i]}'" for code, words in TITLES.items()) + f" else '{TITLES['en'][i]}' end)"


TITLED = f"""(select doc_id, lang, array_to_string(list_concat([{_word(0)}, {_word(1)}], list_transform(string_split(text, chr(10)), lambda x, i: case when (i - 1) % 6 = 2 then {_word(2)} || ' ' || ((i - 1) // 6 + 1) || chr(10) || x else x end), [{_word(3)}]), chr(10)) as text from documents where text is not null
    union all select doc_id, lang, null from documents where text is null)"""
NUMBERED = "^({0}) +([0-9]+|[ivxlcdm]+|one|two|three|four|five|six|seven|eight|nine|ten)([ .:].*)?$"


def _numbered(words: dict[str, str]) -> str:
    return "(case lang " + " ".join(f"when '{code}' then regexp_matches(title, '{NUMBERED.format(alternatives)}', 'i')" for code, alternatives in words.items()) + " else false end)"


REGION = "(case " + " ".join(f"when regexp_matches(title, '^({words})[:.]?$', 'i') then '{role}'" for role, words in reversed(structure.REGIONS.items())) + " end)"
HEADINGS = rf"""(select doc_id, line_no, char_start, title, level, region from (select *, {REGION} region,
    case when {_numbered(structure.CHAPTER)} then 2 when {_numbered(structure.PART)} then 1 when regexp_matches(title, '^[0-9]+(\.[0-9]+)+[ .].{{1,80}}$') then 3 when regexp_matches(title, '^[0-9]{{1,3}}\. +\p{{Lu}}.{{1,80}}$') then 2 when {REGION} is not null then 1 end as level
    from (select *, {STRIPPED.format("line")} title, coalesce(sum(length(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint char_start
    from (select doc_id, lang, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 line_no from {TITLED})) where not {PROSE} and length(title) <= 90) where level is not null)"""
TITLED_SECTIONS = f"""(select *, (sum(opens) over (partition by doc_id order by section_index) - 1)::bigint chapter_seq from (select *, case when lag(section_role) over w is null then 1 when section_role <> 'main_body' and lag(section_role) over w = section_role then 0
    when level <= 2 or lag(section_role) over w <> section_role then 1 else 0 end opens from (select doc_id, 'section-' || section_index section_id, section_index, title, level, char_start, char_end,
    case when region in ('toc', 'front_matter') and char_start / greatest(1, length(text)) <= 0.45 then region when region in ('appendix', 'back_matter') and char_start / greatest(1, length(text)) >= 0.60 then region else 'main_body' end section_role,
    substring(text, char_start + 1, char_end - char_start) as content
    from (select s.*, text, row_number() over v - 1 section_index, coalesce(lead(char_start) over v, length(text)) char_end from (select doc_id, char_start, x.title title, x.level as level, x.region region from (select doc_id, char_start, arg_min({{'title': title, 'level': level, 'region': region}}, weak) x
    from (select doc_id, char_start, title, level, region, 0 weak from {HEADINGS} union all select doc_id, 0, null, 1, null, 1 from documents) group by all)) s join {TITLED} using (doc_id) window v as (partition by doc_id order by char_start))) window w as (partition by doc_id order by section_index)))"""


def _packed(most: int) -> str:
    """Pieces of texts packed up to `most` characters: doc_id, unit_no, open."""
    return f"""(with recursive p as (select doc_id, line, row_number() over (partition by doc_id order by line_no) n from (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) line_no from documents) where trim(line, chr(32) || chr(9) || chr(13)) <> ''),
        g(doc_id, n, unit_no, open) as (select doc_id, n, 0::bigint, line from p where n = 1
            union all select p.doc_id, p.n, case when length(g.open) + 1 + length(p.line) <= {most} then g.unit_no else g.unit_no + 1 end, case when length(g.open) + 1 + length(p.line) <= {most} then g.open || chr(10) || p.line else p.line end
            from g join p on p.doc_id = g.doc_id and p.n = g.n + 1)
        select doc_id, unit_no, arg_max(open, n) open from g group by doc_id, unit_no)"""


GROUP = "struct(first bigint, last bigint, n bigint, box varchar)"
MERGED = f"""(with recursive u as (select doc_id, unit_no i, length(open)::bigint n, 'box' || (unit_no // 3 % 2) box, lead('box' || (unit_no // 3 % 2)) over (partition by doc_id order by unit_no) after from {_packed(400)}),
    g(doc_id, i, done, open) as (select distinct doc_id, -1::bigint, []::{GROUP}[], null::{GROUP} from u
        union all select doc_id, i, case act when 'close' then list_append(done, now) when 'back' then list_append(done[:-2], {{'first': done[-1].first, 'last': now.last, 'n': done[-1].n + 2 + now.n, 'box': done[-1].box}}::{GROUP}) else done end, case when act = 'carry' then now end
        from (select *, case when now.n >= 300 then 'close' when now.box = after then 'carry' when len(done) > 0 and done[-1].box = now.box then 'back' when after is not null then 'carry' when len(done) > 0 then 'back' else 'close' end act
            from (select u.doc_id, u.i, g.done, u.after, case when g.open is null then {{'first': u.i, 'last': u.i, 'n': u.n, 'box': u.box}}::{GROUP} else {{'first': g.open.first, 'last': u.i, 'n': g.open.n + 2 + u.n, 'box': g.open.box}}::{GROUP} end now from g join u on u.doc_id = g.doc_id and u.i = g.i + 1))),
    d as (select doc_id, unnest(done) x, generate_subscripts(done, 1) - 1 merged_no from (select doc_id, arg_max(done, i) done from g group by doc_id))
    select d.doc_id, u.i unit_no, u.n n_chars, d.merged_no::bigint merged_no from d join u on u.doc_id = d.doc_id and u.i between d.x.first and d.x.last)"""
ARTIFACTS = """(select w.*, s.doc_id is not null present, s.* exclude (doc_id, section_id) from (select doc_id, 'section-0' section_id, sha256(text) h, lang, case when doc_id % 2 = 0 then 'chapter' else 'section' end sc from documents) w left join
    (select doc_id, 'section-0' section_id, case when doc_id % 11 = 1 then 'old' else sha256(text) end a_h, case when doc_id % 11 = 2 then null else lang end a_lang, case when doc_id % 11 = 3 then 'progressive' else 'semantic_safe' end a_split, case when doc_id % 11 = 4 then 5 else 3 end a_top, case when doc_id % 11 = 5 then 'v0' else 'v1' end a_prompt,
    case when doc_id % 11 = 6 then 'document' when doc_id % 2 = 0 then 'chapter' else 'section' end a_scope, case when doc_id % 11 = 7 then 'section-9' else 'section-0' end a_source, case when doc_id % 11 = 8 then 'Two' else 'One' end a_title, case when doc_id % 11 = 9 then ' ' || chr(10) else 'summary' end a_content, case when doc_id % 11 = 10 then 'q0' else 'q1' end a_schema
    from documents where doc_id % 13 <> 0) s using (doc_id, section_id))"""


def _validity(first: str, schema: str = "") -> str:
    reason = f"""case when not present then null when {first} when a_h is distinct from h then 'source_hash_mismatch' when a_lang is distinct from lang then 'language_mismatch' when a_split <> 'semantic_safe' then 'split_mode_mismatch' when a_top <> 3 then 'semantic_top_k_mismatch'
        when a_prompt <> 'v1' then 'prompt_version_mismatch' {schema} when a_scope <> sc then 'scope_mismatch' when a_source <> section_id then 'section_id_mismatch' when sc = 'chapter' and a_title <> 'One' then 'chapter_title_mismatch' end"""
    return f"select doc_id, section_id, case when not present then 'missing' when reason is null then 'valid' else 'invalid' end status, reason from (select *, {reason} reason from {ARTIFACTS})"


def _windows(hits: str) -> str:
    return f"(select h.doc_id, h.hit_index, c.chunk_index, c.text from {hits} h join {CHUNKS} c on c.doc_id = h.doc_id and c.chunk_index between h.hit_index - 1 and h.hit_index + 1)"


_HITS = "(select doc_id, doc_id % 5 hit_index from documents where length(text) > 0)"


def _markers(text: str, markers: dict[str, list[str]]) -> str:
    """Number of markers contained, by language."""
    quoted = lambda w: w.replace("'", "''")
    return "(case lang " + " ".join(f"when '{code}' then " + " + ".join(f"contains({text}, '{quoted(w)}')::int" for w in words) for code, words in markers.items()) + " else 0 end)"


ORACLE = {
    "vector_topk_answer_mode": f"select query_id, place, vec_id, round(score, 5) score, {MODE.format('min(score) over (partition by query_id)')} answer_mode from {_pairs(DISTANCE, 8)}",
    "cosine_to_query": f"select query_id, place, vec_id, round(1 - score, 5) cosine from {_pairs(f'(1 - {COSINE})', 8)}",
    "unit_vector_norms": f"""select vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 6) squared_norm, round(u[1], 6) as first
        from (select vec_id, list_transform(embedding, lambda x: x::double / sqrt({PRODUCT.format("embedding", "embedding")})) u from embeddings)""",
    "coverage_hits": f"""with recursive o as (select query_id, place as rank, vec_id // 10 place, place n from {_pairs(DISTANCE, 12)}),
        g(query_id, n, kept) as (select distinct query_id, 0::bigint, []::struct(rank bigint, place bigint)[] from o
            union all select o.query_id, o.n, case when len(list_filter(g.kept, lambda k: abs(k.place - o.place) <= 2)) > 0 then g.kept else list_append(g.kept, {{'rank': o.rank, 'place': o.place}}) end from g join o on o.query_id = g.query_id and o.n = g.n + 1)
        select query_id, k.rank as rank, k.place as place from (select query_id, unnest(kept) k from (select query_id, arg_max(kept, n) kept from g group by query_id))""",
    "doc_fingerprint": f"select doc_id, md5({STRIPPED.format('text')}) fingerprint from documents",
    "exact_duplicate_docs": f"select md5({STRIPPED.format('text')}) fingerprint, count(*) n, min(doc_id) first_id from documents group by 1 having count(*) > 1",
    "stale_documents": f"select doc_id, md5({STRIPPED.format('text')}) fingerprint from documents where doc_id % 3 <> 0",
    "line_offsets": f"""select doc_id, line_no, s char_start, s + length(line) char_end, md5(line) line_md5
        from (select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint s from {LINES})""",
    "line_flags": f"""select doc_id, line_no, prose, not prose and case when chinese then size <= 32 else n between 1 and 12 and size <= 90 end heading_like,
        coalesce(bool_or(prose) over (partition by doc_id order by line_no rows between 1 following and 3 following), false) prose_follows
        from (select doc_id, line_no, {PROSE} prose, len(regexp_extract_all({STRIPPED.format('line')}, '{WORDS}')) n, length({STRIPPED.format('line')}) size, regexp_matches(line, '[\\x{{4e00}}-\\x{{9fff}}]') chinese from {LINES})""",
    "evidence_lines": f"""with s as (select doc_id, line_no, {STRIPPED.format('line')} line from {LINES}),
        f as (select doc_id, min(line_no) line_no, arg_min(line, line_no) line from s where length(line) between 1 and 90 group by doc_id, lower(regexp_replace(line, '\\s+', ' ', 'g')))
        select * from (select doc_id, row_number() over (partition by doc_id order by line_no) place, line_no, line from f) where place <= 60""",
    "token_estimate": f"select doc_id, {TOKENS.format('text')}::bigint tokens from documents",
    "token_totals_by_lang": f"select lang, count(*) docs, sum({TOKENS.format('text')})::bigint tokens from documents group by lang",
    "language_alias": """with b as (select doc_id, lower(split_part(replace(upper(lang) || '_XX', '_', '-'), '-', 1)) b from documents)
        select doc_id, case when b in ('en', 'english') then 'en' when b in ('fr', 'french') then 'fr' when b in ('de', 'german') then 'de' when b in ('es', 'spanish') then 'es' else 'unknown' end as language from b""",
    "script_system": """with c as (select doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]'))::bigint latin, len(regexp_extract_all(coalesce(text, ''), '[一-鿿]'))::bigint cjk, len(regexp_extract_all(coalesce(text, ''), '[Ѐ-ӿ]'))::bigint cyrillic,
        len(regexp_extract_all(coalesce(text, ''), '[Ͱ-Ͽ]'))::bigint greek, len(regexp_extract_all(coalesce(text, ''), '[぀-ヿ]'))::bigint kana, len(regexp_extract_all(coalesce(text, ''), '[가-힯]'))::bigint hangul, len(regexp_extract_all(coalesce(text, ''), '[؀-ۿ]'))::bigint arabic from documents),
        r as (select *, latin + cjk + cyrillic + greek + kana + hangul + arabic total, list_reverse_sort([{'n': latin, 's': 'latin'}, {'n': cjk, 's': 'cjk'}, {'n': cyrillic, 's': 'cyrillic'}, {'n': greek, 's': 'greek'}, {'n': kana, 's': 'kana'}, {'n': hangul, 's': 'hangul'}, {'n': arabic, 's': 'arabic'}]) k from c)
        select doc_id, latin, cjk, cyrillic, case when total = 0 then 'unknown' when k[1].n / total < 0.45 or k[2].n / total > 0.28 then 'mixed' else k[1].s end script_system from r""",
    "line_break_quality": f"""with s as (select doc_id, coalesce(text, '') as text, list_transform({_split("coalesce(text, '')")}, lambda x: {STRIPPED.format("x")}) l from documents),
        a as (select doc_id, text, len(l) n_lines, list_filter(l, lambda x: x <> '') f from s),
        r as (select doc_id, text, n_lines, len(f) n_full, (n_lines - len(f)) / greatest(1, n_lines) empty_ratio, coalesce(list_sum(list_transform(f, lambda x: length(x))), 0) / greatest(1, len(f)) avg_chars, len(list_filter(f, lambda x: length(x) <= 26)) / greatest(1, len(f)) short_ratio, len(list_filter(f, lambda x: regexp_matches(x, '{BARE}'))) / greatest(1, len(f)) ended_ratio from a)
        select doc_id, n_lines, round(empty_ratio, 4) empty_ratio, round(avg_chars, 4) avg_chars, round(short_ratio, 4) short_ratio, round(ended_ratio, 4) ended_ratio,
        case when text = '' then 'unknown' when n_lines <= 2 then 'minimal' when n_full = 0 then 'unknown' when empty_ratio >= 0.10 and avg_chars >= 35 then 'paragraph_like' when short_ratio >= 0.60 and avg_chars <= 38 and empty_ratio <= 0.06 then 'hard_wrapped'
        when ended_ratio >= 0.70 and avg_chars <= 40 then 'line_per_sentence' when not contains(text, chr(10)) then 'minimal' when short_ratio > 0.7 and {NOISE.format("left(text, 12000)")} >= 1.0 then 'broken_ocr' else 'unknown' end line_break_quality from r""",
    "ocr_noise": f"""with s as (select doc_id, text, {NOISE.format("left(text, 12000)")} noise from documents)
        select doc_id, round(noise, 4) noise, case when coalesce(text, '') = '' then 'unknown' when noise >= 1.8 then 'high' when noise >= 1.0 then 'medium' when noise >= 0.35 then 'low' else 'none' end noise_level from s""",
    "dialogue_density": f"""with s as (select doc_id, lang, left(coalesce(text, ''), 12000) t, case lang {" ".join(f"when '{k}' then '{v}'" for k, v in profile.QUOTES.items() if k)} else '{profile.QUOTES[""]}' end marks from documents),
        a as (select *, list_filter(list_transform({_split("t")}, lambda x: {STRIPPED.format("x")}), lambda x: x <> '') l from s),
        c as (select doc_id, length(t) size, length(t) - length(translate(t, marks, '')) quotes, greatest(1, len(l)) n, len(list_filter(l, lambda x: regexp_matches(x, '^[-–—]') and length(x) <= 50 and regexp_matches(x, '{BARE}'))) dash,
        len(list_filter(l, lambda x: length(x) <= 90 and ((contains(marks, left(x, 1)) and length(x) - length(translate(x, marks, '')) >= 2) or (length(x) - length(translate(x, marks, '')) >= 4 and length(x) <= 60)))) quoted,
        len(list_filter(l, lambda x: case lang {" ".join(f"when '{k}' then regexp_matches(lower(x), '{'|'.join(v)}')" for k, v in profile.SPEECH.items())} else false end)) verbs from a)
        select doc_id, dash dash_lines, quoted quote_lines, verbs speech_lines, case when size = 0 then 'unknown' when dash >= 4 or dash / n >= 0.18 or (quoted >= 8 and quoted / n >= 0.25 and verbs >= 3) or (dash >= 2 and quoted >= 3) then 'high'
        when dash >= 1 or quoted >= 3 or quoted / n >= 0.10 or verbs >= 2 or quotes / greatest(1, size) >= 0.012 then 'medium' else 'low' end dialogue_density from c""",
    "region_likelihoods": f"""with t as (select doc_id, lang, lower(left(coalesce(text, ''), 5000)) h, lower(left(coalesce(text, ''), 8000)) f, lower(right(coalesce(text, ''), 9000)) e from documents),
        n as (select doc_id, {_markers("h", profile.TOC)} toc, {_markers("f", profile.FRONT)} front, {_markers("e", profile.TERMINAL)} terminal, len(regexp_extract_all(h, '\\.{{3,}}\\s*\\d{{1,4}}')) dotted from t)
        select doc_id, case when toc >= 2 or dotted >= 4 then 'high' when toc >= 1 or dotted >= 2 then 'medium' when dotted = 1 then 'low' else 'none' end toc_likelihood,
        case when front >= 3 then 'high' when front = 2 then 'medium' when front = 1 then 'low' else 'none' end front_likelihood,
        case when terminal >= 3 then 'high' when terminal = 2 then 'medium' when terminal = 1 then 'low' else 'none' end terminal_likelihood from n""",
    "excerpts": "select doc_id, md5(left(text, 4000)) head_md5, md5(substring(text, greatest(0, (length(text) - 2200) // 2) + 1, 2200)) middle_md5, md5(right(text, 2500)) tail_md5 from documents",
    "chunk_links": f"""select doc_id, chunk_index, char_start, char_end, lag(chunk_index) over w prev_index, lead(chunk_index) over w next_index, md5(text) text_md5
        from {CHUNKS} window w as (partition by doc_id order by chunk_index)""",
    "local_windows": f"select doc_id, hit_index, chunk_index, md5(text) text_md5 from {_windows(_HITS)}",
    "merged_windows": f"""with w as {_windows(f"(select * from {_HITS} union all select doc_id, hit_index + 1 from {_HITS})")},
        f as (select doc_id, min({{'h': hit_index, 'c': chunk_index}}) one from w group by doc_id, lower({STRIPPED.format(r"regexp_replace(text, '\s+', ' ', 'g')")}))
        select doc_id, one.h hit_index, one.c chunk_index, row_number() over (partition by doc_id order by one.h, one.c) place from f""",
    "budget_prefix": f"""select doc_id, chunk_index, tokens, running, md5(text) as text from (select doc_id, chunk_index, text, tokens, sum(tokens) over (partition by doc_id order by chunk_index)::bigint running
        from (select doc_id, chunk_index, text, {TOKENS.format('text')}::bigint tokens from {CHUNKS})) where running <= 1500""",
    "context_routing": f"""with r as (select doc_id, {TOKENS.format('text')} tokens, (doc_id % 17) / 10.0::double + 0.5::double best, doc_id % 3 = 0 wide, doc_id % 7 distance from documents),
        m as (select *, case when best < 1.10 then 'strict' when best < 1.28 then 'cautious' else 'reject' end answer_mode, case when best < 1.0 then 3 when best <= 1.08 then 2 when best < 1.28 then 1 else 2 end::bigint threshold from r)
        select doc_id, answer_mode, threshold, case when answer_mode = 'reject' then 'reject' when wide and tokens <= 1500 then 'full_text' when not wide and distance <= threshold then 'local_window' else 'retrieval' end context_mode from m""",
    "paragraph_units": f"select doc_id, unit_no, length(open) n_chars, md5(open) text_md5 from {_packed(1600)}",
    "summary_validity": _validity("trim(a_content, ' ' || chr(10)) = '' then 'empty_content'"),
    "quiz_validity": _validity("trim(a_content, ' ' || chr(10)) = '' then 'malformed_quiz_items'", "when a_schema <> 'q1' then 'quiz_schema_version_mismatch'"),
    "chapter_artifacts": f"""with c as (select doc_id, 'c' || chapter_seq chapter_id, case when chapter_seq % 4 = 1 then 'old-key' end legacy, arg_min_null(title, section_index) title from {TITLED_SECTIONS} group by doc_id, chapter_seq),
        l as (select doc_id, chapter_id, list_distinct(list_filter(['chapter_id::' || chapter_id, legacy, 'chapter::' || nullif(trim(title), '')], lambda x: x is not null)) raw, ['chapter_id::' || chapter_id, legacy, 'chapter::' || nullif(trim(title), '')] ordered from c),
        k as (select doc_id, chapter_id, unnest(list_filter(ordered, lambda x: x is not null)) as key, generate_subscripts(list_filter(ordered, lambda x: x is not null), 1) - 1 place from l),
        s as (select distinct doc_id, key from k where place = doc_id % 3),
        f as (select k.doc_id, k.chapter_id, arg_min(k.key, k.place) as key from k join s on s.doc_id = k.doc_id and s.key = k.key group by all)
        select doc_id, chapter_id, key, md5(key) as content from f""",
    "merged_units": f"select * from {MERGED}",
    "heading_lines": f"select * from {HEADINGS}",
    "section_table": f"select doc_id, section_id, section_index, title, level, char_start, char_end, section_role, chapter_seq, sha256(content) as content from {TITLED_SECTIONS}",
    "structure_stats": f"""with c as (select doc_id, chapter_seq, count(*) n, lower({STRIPPED.format("arg_min(title, section_index)")}) title, count(*) filter (section_role = 'main_body') main, count(title) titled, max(length(content)) most, sum(length(content)) chars from {TITLED_SECTIONS} group by all),
        d as (select doc_id, sum(n)::bigint n_sections, count(*) n_chapters, sum(main)::bigint n_main, count(*) filter (main > 0) main_chapters, sum(titled)::bigint n_titled, count(*) filter (n = 1) n_implicit, count(*) filter (title <> '') > count(distinct title) filter (title <> '') repeated, max(most) max_chars, sum(chars) / sum(n) avg_chars from c group by doc_id)
        select doc_id, n_sections, n_chapters, n_main, n_titled, n_implicit, max_chars, round(avg_chars, 3) avg_chars, round(n_titled / n_sections, 4) title_coverage, case when n_chapters <= 1 and n_sections <= 1 then case when max_chars >= 6000 then 'flat_long_text' else 'essay_sections' end
        when n_sections > 100 and avg_chars < 500 then 'over_fragmented' when repeated and n_chapters >= 6 and n_sections / n_chapters <= 1.2 then 'part_chapter' when main_chapters >= 5 and n_sections / n_chapters <= 1.2 and n_implicit >= greatest(3, floor(n_sections * 0.6)) then 'chapter_only'
        when n_sections / n_chapters >= 2 then 'chapter_section' when n_chapters <= 5 and n_sections <= 8 and n_titled / n_sections >= 0.5 then 'essay_sections' else 'mixed' end structure_shape from d""",
    "enhanced_parse_score": f"""with s as (select doc_id, count(*) n, count(*) filter (trim(title) <> '') titled, max(char_end) filter (title is null and char_start = 0) covered from {TITLED_SECTIONS} group by doc_id),
        r as (select doc_id, coalesce(length(text), 0) size, n, titled, covered, least(1.0, (doc_id % 5) / 3.0::double) affected, least(1.0, (doc_id % 7) / 6.0::double) fallback, doc_id % 11 units from {TITLED} left join s using (doc_id)),
        b as (select doc_id, coalesce(n = 1 and covered = size, false) a, n >= 3 and titled / n < 0.55 b, n < 3 or n > 220 or (size >= 2000 and n >= 3 and (size / n < 180 or size / n > 8000)) c, n >= 8 and affected > 0.55 d, units >= 8 and fallback > 0.55 e from r)
        select doc_id, (a::int * 5 + b::int * 3 + c::int * 3 + d::int + e::int)::bigint score, concat_ws(',', case when a then 'single_fallback_section' end, case when b then 'low_title_coverage' end, case when c then 'abnormal_section_structure' end, case when d then 'high_affected_section_ratio' end, case when e then 'high_fallback_task_unit_ratio' end) reasons,
        (a::int * 5 + b::int * 3 + c::int * 3 + d::int + e::int) >= 4 recommended from b""",
    "artifact_upsert": "select doc_id, case when doc_id % 2 = 0 then 1 - quality else quality end quality from labels",
    "session_replay": """with t as (select user_id session_id, event_id turn, event_type doc_name, case when event_id % 4 = 0 then null else event_id % 50 end best_chunk from events),
        c as (select *, case when lag(doc_name) over (partition by session_id order by turn) is not distinct from doc_name then 0 else 1 end changed from t),
        s as (select *, sum(changed) over (partition by session_id order by turn)::bigint segment from c)
        select session_id, turn, segment, last_value(best_chunk ignore nulls) over (partition by session_id, segment order by turn rows between unbounded preceding and current row) active_chunk,
        count(*) over (partition by session_id, segment order by turn rows between 9 preceding and current row) n_recent_questions,
        least(10, count(best_chunk) over (partition by session_id, segment order by turn rows between unbounded preceding and current row)) n_recent_chunks from s""",
    "conversation_totals": f"select conv_id, count(*) turns, sum({TOKENS.format('text')})::bigint tokens, count(*) filter (role = 'user') questions from conversations group by conv_id",
}
