"""Queries of chapters, of split plans of sections and of structured records, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import strip
from quire.operators import chapters, structure
from quire.plans import unit_plans
from quire.plans.queries import STRIPPED, TITLED_SECTIONS, _titled, documents, titled_sections
from quire.sources import store, structured


def chapter_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of the texts with headings written into them, a quarter of them deeper than they were."""
    sections = structure.sections(_titled(spark, sf_dir), content=False)
    level = F.col("level") + F.when(F.crc32(F.concat_ws(":", "doc_id", "section_index").cast("binary")) % 4 == 0, 1).otherwise(0)
    return chapters.chapter_table(sections.withColumn("level", level)).drop("char_start", "char_end", "section_id")


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.lit(0).cast("long").alias("section_index"), F.concat(F.lit(" "), "source").alias("title"), F.lit(None).cast("string").alias("container_title"), "text")


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four instructions for each text: its third line, the second line that holds its fifth line's beginning, a pattern, and one that is broken."""
    docs = documents(spark, sf_dir).withColumn("l", F.split(strip(F.col("text")), "\n"))
    say = lambda place, anchor, mode, nth: F.struct(F.lit(place).alias("place"), F.lit(f"Unit {place}").alias("title"), anchor.alias("anchor"), F.lit(mode).alias("match_mode"), F.lit(nth).alias("occurrence"))
    told = F.array(say(0, F.get("l", F.lit(2)), "exact", 1), say(1, F.substring(strip(F.get("l", F.lit(4))), 1, 3), "contains", 2), say(2, F.lit(r"^[A-Z][a-z]+ [a-z]+ .*[.,]$"), "regex", 5), say(3, F.lit("(["), "regex", 1))
    return docs.select("doc_id", F.lit(0).cast("long").alias("section_index"), F.explode(told).alias("x")).select("doc_id", "section_index", "x.*")


def plan_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_plans.anchors(_plans(spark, sf_dir), _sections(spark, sf_dir))


def planned_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, _ = unit_plans.planned_units(_plans(spark, sf_dir), _sections(spark, sf_dir))
    return units.withColumn("text", F.md5("text"))


def unplanned_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_plans.planned_units(_plans(spark, sf_dir), _sections(spark, sf_dir))[1]


def _tables(spark: SparkSession, sf_dir: str) -> structured.Tables:
    """The sections of titled texts in their chapters, with one unit for each 900 characters of a section."""
    s = store.parked(titled_sections(spark, sf_dir)).withColumn("document_id", F.col("doc_id").cast("string")).withColumn("chapter_id", F.concat(F.lit("c"), "chapter_seq"))
    text = F.col("content")
    cuts = F.sequence(F.lit(0), F.expr("length(content) div 900"))
    return structured.Tables(
        _titled(spark, sf_dir).select(F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("D"), "doc_id").alias("title"), F.col("lang").alias("language"), F.col("text").alias("raw_text")),
        s.groupBy("document_id", "chapter_id").agg(F.min("section_index").alias("place"), F.min_by("title", "section_index").alias("title"), F.min_by("level", "section_index").alias("level")),
        s.select("document_id", "chapter_id", F.col("section_index").alias("place"), "section_id", "title", "level", "content", "char_start", "char_end", "section_role"),
        s.select("document_id", "section_id", F.explode(cuts).alias("place"), text.alias("content")).select("document_id", "section_id", "place", F.concat("section_id", F.lit("-"), "place").alias("unit_id"), F.lit(None).cast("string").alias("title"), F.substring("content", F.col("place") * 900 + 1, F.lit(900)).alias("content")),
    )


def assembled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's shape: its chapters with their sections and these with the hash of their units' text; every tenth chapter is missing, so that its sections are orphans."""
    t = _tables(spark, sf_dir)
    t = t._replace(chapters=t.chapters.where("cast(substring(chapter_id, 2) as int) % 10 <> 9"))
    units = lambda s: F.concat(s["section_id"], F.lit(":"), F.md5(F.array_join(F.transform(s["task_units"], lambda u: u["content"]), "|")))
    shape = F.array_join(F.transform("chapters", lambda c: F.concat(c["chapter_id"], F.lit("["), F.array_join(F.transform(c["sections"], units), " "), F.lit("]"))), " ")
    orphans = F.array_join(F.transform("orphans", lambda o: F.concat(o["kind"], F.lit(":"), o["id"])), " ")
    return structured.assemble(t).select(F.col("document_id").cast("long").alias("doc_id"), "title", "language", F.md5(shape).alias("shape"), orphans.alias("orphans"))


def records_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of six forms, written from the documents and read again: the sections of each, and how many could not be read for which reason."""
    folder = store.scratch_folder(spark)
    i = F.col("doc_id")
    sections = titled_sections(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section_index", "section_id", "title", "level", "content", "char_start", "char_end", "section_role"))).alias("s"))
    docs = _titled(spark, sf_dir).join(sections, "doc_id")
    head = [i.cast("string").alias("document_id"), F.concat(F.lit("D"), i).alias("title"), F.col("text").alias("raw_text")]
    chapter = F.array(F.struct(F.lit("c0").alias("chapter_id"), F.lit("All").alias("title"), F.lit(1).alias("level"), F.col("s").alias("sections")))
    forms = [F.to_json(F.struct(*head, chapter.alias("chapters"))), F.to_json(F.struct(*head, F.col("s").alias("sections"))), F.to_json(F.struct(*head, F.transform("s", lambda x: F.struct(x["section_id"].alias("node_id"), x["title"].alias("title"), x["level"].alias("level"), x["content"].alias("content"))).alias("structure_nodes"))), F.to_json(F.struct(*head)), F.substring(F.to_json(F.struct(*head)), 1, 40), F.to_json(F.struct(*head[1:], i.alias("id")))]
    record = F.coalesce(*(F.when(i % 6 == k, form) for k, form in enumerate(forms)))
    docs.select(record.alias("value")).write.text(f"{folder}/records")
    tables, unread = structured.read_records(spark, f"{folder}/records")
    read = structured.assemble(tables).select("document_id", F.aggregate("chapters", F.lit(0), lambda n, c: n + F.size(c["sections"])).alias("sections"))
    lost = unread.groupBy("reason").agg(F.count("*").alias("sections")).select(F.col("reason").alias("document_id"), F.col("sections").cast("int").alias("sections"))
    return read.unionByName(lost)


QUERIES = {f.__name__: f for f in (chapter_table, plan_anchors, planned_units, unplanned_sections, assembled_documents, records_read)}

_EDGE = r"([^\pL\pN_]|$)"
_CHAPTER = rf"^(chapter|chap\.)\s+([0-9]+|[ivxlcdm]+|one|two|three|four|five|six|seven|eight|nine|ten){_EDGE}|^第[一二三四五六七八九十百千万两兩〇零0-9]+章{_EDGE}"
_SUB = rf"^[0-9]+(\.[0-9]+)+{_EDGE}|^第[一二三四五六七八九十百千万两兩〇零0-9]+(节|節|部|篇){_EDGE}"
_LABEL = "case role " + " ".join(f"when '{k}' then '{v}'" for k, v in chapters.LABELS.items()) + " end"
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length({0}) + 1), lambda i: ord(substr({0}, i, 1))::bigint)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"
_ANCHORS = rf"""with t as (select doc_id, {STRIPPED.format('text')} x from documents where text is not null),
    l as (select doc_id, line_no, {STRIPPED.format('line')} line, coalesce(sum(length(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint char_start from (select doc_id, unnest(string_split(x, chr(10))) line, generate_subscripts(string_split(x, chr(10)), 1) line_no from t)),
    p as (select doc_id, 0 place, 'exact' mode, {STRIPPED.format('string_split(x, chr(10))[3]')} a, 1 nth from t union all select doc_id, 1, 'contains', {STRIPPED.format(f"substring({STRIPPED.format('string_split(x, chr(10))[5]')}, 1, 3)")}, 2 from t union all select doc_id, 2, 'regex', '^[A-Z][a-z]+ [a-z]+ .*[.,]$', 5 from t),
    k as (select *, lower(regexp_replace(line, '\s+', ' ', 'g')) lk, lower(regexp_replace(a, '\s+', ' ', 'g')) ak from l join p using (doc_id) where line <> '' and a <> ''),
    f as (select *, row_number() over (partition by doc_id, place order by line_no) n, count(*) over (partition by doc_id, place) m from k where case mode when 'regex' then regexp_matches(line, a) when 'contains' then contains(lk, ak) else lk = ak end),
    g as (select doc_id, place::int place, 'Unit ' || place title, char_start from f where n = least(nth, m))"""
_UNITS = f"""{_ANCHORS}, i as (select doc_id, char_start, arg_min(title, place) title from g join t using (doc_id) where char_start > 0 and char_start < length(x) group by all),
    b as (select * from i union all select doc_id, 0, nullif({STRIPPED.format("' ' || source")}, '') from documents where doc_id in (select doc_id from i)),
    u as (select doc_id, char_start, b.title, x, {STRIPPED.format("substring(x, char_start + 1, coalesce(lead(char_start) over w, length(x)) - char_start)")} part from b join t using (doc_id) window w as (partition by doc_id order by char_start)),
    v as (select * from u where part <> ''), j as (select doc_id, count(*) n, sum(length(part)) >= greatest(1, floor(max(length(x)) * 0.7)) and max(length(part)) <= 3200 and count(*) filter (length(part) < 75) <= greatest(1, count(*) // 3) sound from v group by doc_id)"""
ORACLE = {
    "assembled_documents": f"""with s as (select *, 'c' || chapter_seq c from {TITLED_SECTIONS}), u as (select doc_id, section_index, c, section_id, string_agg(substring(content, i * 900 + 1, 900), '|' order by i) joined from (select *, unnest(range(0, length(content) // 900 + 1)) i from s) group by all),
        k as (select doc_id, c, min(section_index) place, string_agg(section_id || ':' || md5(joined), ' ' order by section_index, section_id) told from u group by all),
        d as (select doc_id, string_agg(c || '[' || told || ']', ' ' order by place, c) filter (substring(c, 2)::int % 10 <> 9) shape from k group by doc_id),
        o as (select doc_id, string_agg('section:' || section_id, ' ' order by section_id) orphans from u where substring(c, 2)::int % 10 = 9 group by doc_id)
        select doc_id, 'D' || doc_id title, lang as language, md5(coalesce(shape, '')) shape, coalesce(orphans, '') orphans from documents left join d using (doc_id) left join o using (doc_id) where text is not null""",
    "records_read": f"""with s as (select doc_id, count(*) n from {TITLED_SECTIONS} group by doc_id)
        select doc_id::varchar document_id, case when doc_id % 6 = 3 then 1 else n end::int sections from s where doc_id % 6 < 4 union all
        select case doc_id % 6 when 4 then 'malformed' else 'missing_document_id' end, count(*)::int from documents where text is not null and doc_id % 6 > 3 group by 1""",
    "chapter_table": rf"""with recursive code as materialized (select list(list_reduce(list_prepend(i, range(8)), lambda c, b: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from range(256) r(i)),
        s as materialized (select doc_id, section_index i, title, level + ({_CRC.format("(doc_id || ':' || section_index)")} % 4 = 0)::int as level, section_role role from {TITLED_SECTIONS}, code),
        m as materialized (select *, role = 'main_body' main, coalesce(regexp_matches({STRIPPED.format('title')}, '(?i){_CHAPTER}'), false) headed, coalesce(regexp_matches({STRIPPED.format('title')}, '{_SUB}'), false) under from s),
        r as (select doc_id, i, true opens, case when main then level end open_level, case when not main then role end special from m where i = 0
            union all select m.doc_id, m.i, opens, case when main then case when opens then m.level else open_level end end, case when not main then role end
            from (select m.*, open_level, case when main then headed or open_level is null or (not under and m.level <= open_level) else special is distinct from role end opens from r join m on m.doc_id = r.doc_id and m.i = r.i + 1) m),
        p as (select m.*, opens, sum(opens::int) over (partition by m.doc_id order by m.i) - 1 place, sum(opens::int) over (partition by m.doc_id, role order by m.i) - 1 nth from m join r on r.doc_id = m.doc_id and r.i = m.i),
        c as (select *, first_value(case when not main then {_LABEL} when headed then title else coalesce(nullif(title, ''), 'Main Body ' || (place + 1)) end) over w chapter_title, first_value(level) over w chapter_level, first_value(role) over w chapter_role, count(*) over (partition by doc_id, place) n from p window w as (partition by doc_id, place order by i))
        select doc_id, i section_index, title, level, role section_role, case when main then 'chapter-' || place else replace(role, '_', '-') || '-' || nth end chapter_id, chapter_title, chapter_level, chapter_role, 'chapter::' || {STRIPPED.format('chapter_title')} legacy_key,
        case when not main then role when opens then 'chapter_body' else 'subsection' end section_kind, main and opens and n = 1 is_implicit from c""",
    "plan_anchors": f"{_ANCHORS} select doc_id, 0 section_index, place, title, char_start from g",
    "planned_units": f"""{_UNITS} select doc_id, 0 section_index, unit_no, 'task-unit-0-' || unit_no unit_id, coalesce(title, nullif({STRIPPED.format("' ' || source")}, '') || ' (Part ' || (unit_no + 1) || ')', 'Task Unit ' || (unit_no + 1)) title, null::varchar container_title, md5(part) as text
        from (select *, row_number() over (partition by doc_id order by char_start) - 1 unit_no from v) join documents using (doc_id) where doc_id in (select doc_id from j where n >= 2 and sound)""",
    "unplanned_sections": f"""{_UNITS}, d as (select d.doc_id, coalesce(x, '') x, (select count(*) from g where g.doc_id = d.doc_id) resolved, j.n, sound from documents d left join t using (doc_id) left join j using (doc_id))
        select doc_id, 0 section_index, reason from (select *, case when x = '' then 'empty_section_content' when resolved = 0 then 'no_resolved_boundaries' when n is null then 'resolved_boundaries_too_few' when n < 2 then 'resolved_chunks_too_few' when not sound then 'abnormal_units_output' end reason from d) where reason is not null""",
}
