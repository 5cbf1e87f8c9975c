"""Queries of sentence chunks, cut sections and heading rules, and their SQL where SQL can express them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.heading_words import rules
from quire.operators import chunks, cuts, heading_rules, retrieval, structure, terms
from quire.operators.lines import explode_lines
from quire.plans.boundary_queries import _COUNTS, _cosine, _letters
from quire.plans.queries import DISTANCE, LINES, STRIPPED, TITLED, _nearest, _pairs, _titled, dealt_documents, documents

LETTERS = "etaoinsr"


def letter_counts(texts: list[str]) -> np.ndarray:
    """Vectors of texts without a model: how often each of eight letters stands in them."""
    return np.array([[t.count(letter) for letter in LETTERS] for t in texts], float).reshape(len(texts), len(LETTERS))


def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in chunks of whole sentences."""
    return chunks.sentence_chunks(documents(spark, sf_dir)).select("doc_id", "chunk_index", "prev_index", "next_index", "char_start", "char_end", "n_tokens", F.md5("text").alias("text_md5"))


def _cut(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    sections = structure.sections(dealt_documents(spark, sf_dir))
    sections = sections.select("doc_id", "section_index", "title", F.lit(None).cast("string").alias("container_title"), F.col("content").alias("text"))
    return cuts.split_sections(sections, mode, score=cuts.BySnippets(letter_counts))


def semantic_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir, "semantic_safe").select("doc_id", "section_index", "part_no", "unit_id", "title", "is_split", "n_chars", F.md5("text").alias("text_md5"))


def windowed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir, "progressive").select("doc_id", "section_index", "part_no", "unit_id", "title", "is_split", "n_chars", F.md5("text").alias("text_md5"))


def cut_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuts.cut_counters(_cut(spark, sf_dir, "semantic_safe"))


def ruled_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the texts, with headings written into them, that meet a rule of their language."""
    return heading_rules.marked_lines(_titled(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "char_start", "title", "strong", "region", "level")


#: Rules whose terms occur in the texts, the first of which counts.
LINE_RULES = {"licence": ("license", "CC BY"), "secret": ("password", "token", "api_key", "secret"), "address": ("@", "http"), "number": ("0", "1", "2", "3"), "marks": ("!", "?", ";", "#")}


def line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule of every line that meets one."""
    lines = explode_lines(documents(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")
    return lines.select("doc_id", "line_no", terms.first_rule(F.col("line"), LINE_RULES).alias("rule")).where("rule is not null")


def topic_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three words of each text as its topic, a word of a rule in every seventh."""
    words = F.array_join(F.slice(F.split("text", " ", 4), 1, 3), " ")
    topic = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit(" Annual REPORT "), words)).otherwise(words)
    vectors = {w: letter_counts([w])[0].tolist() for own in terms.TOPICS.values() for w in own}
    rows = documents(spark, sf_dir).select("doc_id", topic.alias("topic")).withColumn("rule", terms.topic_rule(F.col("topic"), embed=_letters, vectors=vectors))
    return rows.select("doc_id", "rule", terms.guidance(F.col("topic"), F.col("rule")).alias("guidance"))


def retrieved_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the twelve nearest vectors of each query; a document's language and source stand for its text."""
    docs = documents(spark, sf_dir)
    records = docs.select((F.col("doc_id") * 2).alias("vec_id"), F.concat(F.upper("lang"), F.lit("  "), "source").alias("text"), F.col("n_chars").alias("position"))
    return retrieval.hit_records(_nearest(spark, sf_dir, 12), records).withColumn("score", F.round("score", 5))


QUERIES = {f.__name__: f for f in (retrieved_records, sentence_chunks, semantic_units, windowed_units, cut_counters, ruled_headings, line_rules, topic_guidance)}

_RULES = ", ".join(f"""('{lang}', {[*heading_rules.STRONG, *heading_rules.REGIONS].index(rule)}, '{rule}', '(?i){pattern.replace("'", "''")}')""" for lang, rule, pattern in rules())

_TOKENS = "((q[{1} + 1] - q[{0} + 1] + 3) // 4 + w[{1} + 1] - w[{0} + 1])"
_QUARTER = r"length(regexp_replace({0}, '[^\x21-\x7e\x00-\x08\x0e-\x1b\x7f]+', '', 'g'))"
_WHOLE = r"length(regexp_replace({0}, '[\x00-\x7f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', '', 'g'))"
_MOST, _OVERLAP = 300, 50
_STOP = f"({{1}} + len(list_filter(range({{1}} + 1, n + 1), lambda j: {_TOKENS.format('{0}', 'j')} <= {_MOST})))"
_WORDS = ", ".join(f"({i}, '{rule}', '{w}')" for i, (rule, w) in enumerate((r, w) for r, own in terms.TOPICS.items() for w in own))
_TOLD = "case rule " + " ".join(f"when '{k}' then '{v}'" for k, v in terms.GUIDANCE.items()) + " end"
ORACLE = {
    "retrieved_records": f"""with h as (select query_id, place, vec_id, round(score, 5) score, upper(lang) || '  ' || source as text, n_chars as position from {_pairs(DISTANCE, 12)} p join documents d on d.doc_id * 2 = p.vec_id),
        k as (select *, row_number() over (partition by query_id, coalesce(text, 'null ' || vec_id) order by place) n from h)
        select query_id, place, vec_id, score, text, position, row_number() over (partition by query_id order by place) as rank from k where n = 1""",
    "line_rules": f"""with l as (select doc_id, line_no, lower(line) x from {LINES}), r as (select *, case {" ".join("when " + " or ".join(f"contains(x, '{t.lower()}')" for t in own) + f" then '{rule}'" for rule, own in LINE_RULES.items())} end rule from l)
        select doc_id, line_no, rule from r where rule is not null""",
    "topic_guidance": f"""with w(k, rule, word) as (values {_WORDS}), t as (select doc_id, case when doc_id % 7 = 0 then ' Annual REPORT ' else '' end || array_to_string(string_split(text, ' ')[1:3], ' ') topic from documents),
        n as (select *, lower({STRIPPED.format('topic')}) x from t), v as (select *, {_COUNTS.format('x')} a from n), k as (select k, rule, word, {_COUNTS.format('word')} b from w),
        f as (select v.doc_id, topic, x, arg_min(rule, k) filter (contains(x, word)) found, arg_max(rule, ({_cosine('a', 'b')}, -k)) best, max({_cosine('a', 'b')}) similarity from v, k group by all),
        r as (select *, coalesce(found, case when x <> '' and similarity >= 0.78 then best end) rule from f)
        select doc_id, rule, case when coalesce(x, '') = '' then 'Topic Guidance: None' else coalesce({_TOLD}, 'Topic Guidance: align style with topic ' || chr(39) || topic || chr(39) || '.') end guidance from r""",
    "ruled_headings": f"""with r(lang, k, rule, pattern) as (values {_RULES}),
        l as (select doc_id, lang, line_no, sum(length(line) + 1) over (partition by doc_id order by line_no)::bigint - length(line) - 1 char_start, {STRIPPED.format('line')} title from (select doc_id, lang, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 line_no from {TITLED})),
        m as (select doc_id, line_no, char_start, title, arg_min(rule, k) filter (k < 3) strong, arg_min(rule, k) filter (k >= 3) region from l join r using (lang) where length(title) between 1 and 200 and regexp_matches(title, pattern) group by all)
        select *, case when strong = 'chapter' then 2 else 1 end as level from m""",
    "sentence_chunks": rf"""with recursive s as (select doc_id, unnest(string_split(regexp_replace(text, '{chunks.END.replace("'", "''")}', '\0' || chr(57344), 'g'), chr(57344))) s, generate_subscripts(string_split(regexp_replace(text, '{chunks.END.replace("'", "''")}', '\0' || chr(57344), 'g'), chr(57344)), 1) i from documents),
        o as (select doc_id, i, unnest(case when ({_QUARTER.format('s')} + 3) // 4 + {_WHOLE.format('s')} > {_MOST} then regexp_extract_all(s, '{chunks.WORD % _MOST}') else [s] end) x, generate_subscripts(case when ({_QUARTER.format('s')} + 3) // 4 + {_WHOLE.format('s')} > {_MOST} then regexp_extract_all(s, '{chunks.WORD % _MOST}') else [s] end, 1) k from s where s <> ''),
        c as (select doc_id, row_number() over own j, sum(length(x)) over own b, sum({_QUARTER.format('x')}) over own q, sum({_WHOLE.format('x')}) over own w from o window own as (partition by doc_id order by i, k)),
        l as materialized (select doc_id, list_prepend(0, list(b::bigint order by j)) b, list_prepend(0, list(q::bigint order by j)) q, list_prepend(0, list(w::bigint order by j)) w, count(*) n from c group by doc_id),
        r as (select doc_id, 0::bigint i, 0::bigint a, {_STOP.format('0', '0')}::bigint e from l
            union all select doc_id, i + 1, f, {_STOP.format('f', 'e')}::bigint from (select r.*, q, w, n, coalesce(list_min(list_filter(range(a + 1, e), lambda x: {_TOKENS.format('x', 'e')} <= {_OVERLAP} and {_TOKENS.format('x', 'e + 1')} <= {_MOST})), e) f from r join l using (doc_id) where e < n))
        select r.doc_id, i chunk_index, nullif(i - 1, -1) prev_index, case when e < n then i + 1 end next_index, b[a + 1] char_start, b[e + 1] char_end, {_TOKENS.format('a', 'e')}::bigint n_tokens, md5(substring(text, b[a + 1] + 1, b[e + 1] - b[a + 1])) text_md5 from r join l using (doc_id) join documents using (doc_id)""",
}
