"""Queries of cuts, neighbours, labels, task contexts and split plans with a fallback, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import boundaries, layout, retrieval
from quire.plans import split_plans
from quire.plans.queries import CHUNKS, LINES, PRODUCT, STRIPPED, chunks, documents, table

LETTERS = "etaoinsr"
#: Directions that stand for labels, in the order in which ties fall.
LABELS = {name: [1.0 if i % 4 == k else -0.5 for i in range(64)] for k, name in enumerate(("north", "east", "south"))}


def _letters(text: F.Column) -> F.Column:
    """A vector of a text without a model: how often each of eight letters stands in it."""
    return F.array(*(T.count_chars(text, letter).cast("double") for letter in LETTERS))


def boundary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts at every 500 characters."""
    sides = boundaries.snippets(documents(spark, sf_dir), F.sequence(F.lit(0), F.length("text"), F.lit(500)))
    return boundaries.semantic_scores(sides, _letters).select("doc_id", "char_start", F.round("score", 6).alias("score"))


def chunk_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three chunks one links two chunks away, one to a node that is not there, and one to none."""
    link = lambda step: F.when(F.col("chunk_index") % 3 == 0, F.concat(F.lit("n"), F.col("chunk_index") + step)).when(F.col("chunk_index") % 3 == 1, "x")
    records = chunks(spark, sf_dir).select("doc_id", F.concat(F.lit("n"), "chunk_index").alias("node_id"), "chunk_index", link(-2).alias("prev_id"), link(2).alias("next_id"))
    return retrieval.neighbours(records)


def best_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = table(spark, sf_dir, "embeddings").select("vec_id", retrieval.best_label(F.col("embedding"), LABELS).alias("best"))
    return best.select("vec_id", "best.label", F.round("best.similarity", 5).alias("similarity"))


def task_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as sections: some ids, titles and contents are blank, every seventh document has no title."""
    i = F.col("chunk_index") + F.col("doc_id")
    parts = chunks(spark, sf_dir).select("doc_id", F.when(i % 11 == 0, " ").otherwise(F.concat(F.lit(" c"), "chunk_index")).alias("section_id"), F.when(i % 3 == 0, "\t").otherwise(F.concat(F.lit("T"), "chunk_index", F.lit(" "))).alias("title"), F.when(i % 2 == 0, "Part").alias("container_title"), F.when(i % 5 == 0, "\n").otherwise(F.col("text")).alias("content"))
    titles = documents(spark, sf_dir).where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat_ws(" ", "lang", "source")).alias("document_title"))
    return layout.task_context(parts, titles)


def _plans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Plans that name lines by their numbers: of five documents two have the lines 2 and 3, one the first two, one line 1 only, one no plan; and
    the sections that stand in for them: up to the middle of the text, and from there on."""
    docs = documents(spark, sf_dir)
    lines = F.when(F.col("doc_id") % 5 < 2, F.array(F.lit(2), F.lit(3))).when(F.col("doc_id") % 5 == 2, F.array(F.lit(0), F.lit(1))).when(F.col("doc_id") % 5 == 3, F.array(F.lit(1)))
    rows = docs.select("doc_id", F.split("text", "\n", 5).alias("l"), F.explode(lines).alias("place"))
    plan = rows.select("doc_id", "place", F.concat(F.lit("S"), "place").alias("title"), F.lit(1).alias("level"), T.line_key(F.get("l", F.col("place"))).alias("anchor"), F.lit("exact").alias("match_mode"), F.lit(1).alias("occurrence")).where("anchor is not null")
    middle = F.expr("length(text) div 2")
    part = lambda i, title, low, high: F.struct(F.lit(i).cast("long").alias("section_index"), F.lit(title).alias("title"), low.cast("long").alias("char_start"), high.cast("long").alias("char_end"))
    halves = docs.where("length(text) > 1").select("doc_id", F.explode(F.array(part(0, " ", F.lit(0), middle), part(1, "Half", middle, F.length("text")))).alias("p")).select("doc_id", "p.*")
    return plan, halves


def planned_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, halves = _plans(spark, sf_dir)
    return split_plans.apply_or_keep(plan, documents(spark, sf_dir), halves)


def whole_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as sections: they overlap unless they are cut short; every third document lacks its last ones."""
    parts = chunks(spark, sf_dir).where("doc_id % 3 <> 0 or chunk_index < 3")
    end = F.when((F.col("doc_id") % 2 == 0) & (F.col("char_end") == F.col("char_start") + 1200), F.col("char_start") + 1000).otherwise(F.col("char_end"))
    return boundaries.whole(parts.select("doc_id", F.col("chunk_index").alias("section_index"), "char_start", end.alias("char_end")), documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (boundary_scores, chunk_neighbours, best_labels, task_contexts, planned_sections, whole_sections)}

_COUNTS = "list_transform([" + ", ".join(f"'{letter}'" for letter in LETTERS) + "], lambda letter: (length({0}) - length(replace({0}, letter, '')))::double)"


def _cosine(a: str, b: str) -> str:
    both = f"sqrt({PRODUCT.format(a, a)} * {PRODUCT.format(b, b)})"
    return f"(case when {both} > 0 then greatest(-1, least(1, {PRODUCT.format(a, b)} / {both})) else 0 end)"


def _snippet(low: str, size: str) -> str:
    return STRIPPED.format(f"substring(text, ({low} + 1)::bigint, ({size})::bigint)")


def _link(step: str) -> str:
    return f"case chunk_index % 3 when 0 then 'n' || (chunk_index {step} 2) when 1 then 'x' end"


_PARTS = f"""(select doc_id, case when (chunk_index + doc_id) % 11 <> 0 then 'c' || chunk_index end section_id, case when (chunk_index + doc_id) % 3 <> 0 then 'T' || chunk_index end section_title,
    case when (chunk_index + doc_id) % 2 = 0 then 'Part' end container_title, (chunk_index + doc_id) % 5 = 0 or {STRIPPED.format('text')} = '' as nothing from {CHUNKS})"""
ORACLE = {
    "boundary_scores": f"""with t as (select doc_id, text, unnest(range(500, length(text), 500)) p from documents),
        s as (select doc_id, p, {_snippet('greatest(p - 220, 0)', 'least(p, 220)')} a, {_snippet('p', '220')} b, {_snippet('greatest(p - 700, 0)', 'least(p, 700)')} c, {_snippet('p', '700')} d from t),
        v as (select doc_id, p, {_COUNTS.format('a')} a, {_COUNTS.format('b')} b, {_COUNTS.format('c')} c, {_COUNTS.format('d')} d from s where least(length(a), length(b), length(c), length(d)) >= 12)
        select doc_id, p char_start, round(1 - {_cosine('c', 'd')} - {_cosine('a', 'b')}, 6) score from v""",
    "chunk_neighbours": f"""with r as (select doc_id, chunk_index i, 'n' || chunk_index node_id, {_link('-')} prev_id, {_link('+')} next_id from {CHUNKS}),
        w as (select doc_id, node_id, 'prev' side, prev_id link, i - 1 as wanted from r union all select doc_id, node_id, 'next', next_id, i + 1 from r)
        select w.doc_id, w.node_id, side, coalesce(a.node_id, b.node_id) neighbour_id from w left join r a on a.doc_id = w.doc_id and a.node_id = w.link left join r b on b.doc_id = w.doc_id and b.i = w.wanted
        where coalesce(a.node_id, b.node_id) is not null""",
    "best_labels": f"""with l(k, name, point) as (values {', '.join(f"({i}, '{name}', {point})" for i, (name, point) in enumerate(LABELS.items()))}),
        s as (select vec_id, k, name, {_cosine('embedding', 'point')} c from embeddings, l where list_bool_or(list_transform(embedding, lambda x: x <> 0)))
        select vec_id, arg_max(name, (c, -k)) as label, round(max(c), 5) similarity from s group by vec_id""",
    "task_contexts": f"""with p as (select p.*, case when p.doc_id % 7 <> 0 and p.doc_id % 4 <> 0 then nullif({STRIPPED.format("concat_ws(' ', lang, source)")}, '') end document_title from {_PARTS} p join documents using (doc_id)),
        r as (select *, case when section_id is null then 'empty_id' when nothing then 'empty_content' when document_title is null then 'unknown_document' when section_title is null then 'untitled_section' end reason from p)
        select doc_id, section_id, document_title, section_title, container_title, reason is null as valid, reason from r""",
    "planned_sections": f"""with l as (select doc_id, line_no, lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))) k, sum(length(line) + 1) over (partition by doc_id order by line_no) - length(line) - 1 as char_start from {LINES}),
        a as (select doc_id, line_no place, k, 'S' || line_no title from l where k <> '' and case doc_id % 5 when 2 then line_no < 2 when 3 then line_no = 1 when 4 then false else line_no in (2, 3) end),
        f as (select doc_id, place, title, min(char_start) char_start from a join l using (doc_id, k) group by all),
        r as (select doc_id, char_start, arg_min(title, place) title from f group by all), n as (select doc_id, count(*) n from r group by doc_id),
        d as (select doc_id, length(text) size, length(text) // 2 middle, text from documents where length(text) > 1),
        b as (select * from r union all select doc_id, middle, 'Half' from d join n using (doc_id) where n.n = 1 and not exists (from r where r.doc_id = d.doc_id and r.char_start = middle)),
        m as (select doc_id from b group by doc_id having count(*) >= 2), c as (select * from b where doc_id in (from m) union all select doc_id, 0, null from b where doc_id in (from m) group by doc_id having min(char_start) > 0),
        s as (select doc_id, row_number() over w - 1 section_index, title, char_start, coalesce(lead(char_start) over w, size) char_end, text from c join d using (doc_id) window w as (partition by doc_id order by char_start)),
        g as (select doc_id from s group by doc_id having count(*) filter ({_snippet('char_start', 'char_end - char_start')} <> '') >= 2)
        select doc_id, section_index::bigint section_index, title, char_start::bigint char_start, char_end::bigint char_end from s where doc_id in (from g)
        union all select doc_id, 0, ' ', 0, middle from d where doc_id not in (from g) union all select doc_id, 1, 'Half', middle, size from d where doc_id not in (from g)""",
    "whole_sections": f"""with p as (select doc_id, chunk_index i, char_start, case when doc_id % 2 = 0 and char_end = char_start + 1200 then char_start + 1000 else char_end end e from {CHUNKS} where doc_id % 3 <> 0 or chunk_index < 3),
        q as (select p.*, text, lag(e) over w as before, lead(i) over w is null as final from p join documents using (doc_id) window w as (partition by doc_id order by i)),
        g as (select doc_id, count(*) >= 2 and bool_and(char_start >= coalesce(before, 0) and e > char_start and e <= length(text)) and bool_or(final and e = length(text)) and count(*) filter ({_snippet('char_start', 'e - char_start')} <> '') >= 2 ok from q group by doc_id)
        select doc_id, coalesce(ok, false) accepted from documents left join g using (doc_id)""",
}
