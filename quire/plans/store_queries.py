"""Queries of what is kept: builds of what changed, updates of artifacts, session histories; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import structure
from quire.plans.queries import TITLED_SECTIONS, _titled, documents, table, titled_sections
from quire.sources import store
from quire.streaming import histories

LANGUAGES = ["en", "fr", "es"]
BUCKETS = 16


def _sections(docs: DataFrame) -> dict[str, DataFrame]:
    return {"sections": structure.chaptered_sections(docs)}


def _refreshed(spark: SparkSession, sf_dir: str, docs: DataFrame) -> store.Store:
    """A store of the sections of earlier texts (one document of twenty was shorter, some were not there, others are gone), brought up to date."""
    tables = store.Store(spark, store.scratch_folder(spark), BUCKETS)
    i = F.col("doc_id")
    earlier = docs.where("doc_id % 31 <> 5").withColumn("text", F.when(i % 20 == 0, F.substring("text", 1, 200)).otherwise(F.col("text")))
    earlier = earlier.unionByName(docs.where("doc_id % 50 = 7").withColumn("doc_id", -1 - i))
    failure = store.unready(docs, LANGUAGES)
    store.refresh(tables, earlier, _sections, failure)
    store.refresh(tables, docs, _sections, failure)
    return tables


def incremental_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a full build would have them; documents in a language that is not supported fail."""
    return _refreshed(spark, sf_dir, _titled(spark, sf_dir)).read("sections").withColumn("content", F.sha2("content", 256))


def build_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each document, some of which have no text or no language."""
    i = F.col("doc_id")
    docs = documents(spark, sf_dir).select("doc_id", F.when(i % 9 == 4, F.lit(" \n")).otherwise(F.col("text")).alias("text"), F.when(i % 7 == 3, F.lit("")).otherwise(F.col("lang")).alias("lang"))
    tables = _refreshed(spark, sf_dir, docs)
    built = tables.read("built").select("doc_id", F.lit("built").alias("outcome"))
    return built.unionByName(tables.read("failures").select("doc_id", F.col("reason").alias("outcome")))


def artifact_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of every second section, then quizzes of every third one, then new summaries of every fourth: each update keeps the other artifact."""
    tables = store.Store(spark, store.scratch_folder(spark), BUCKETS)
    sections = tables.park(titled_sections(spark, sf_dir, content=False).select("doc_id", "section_index"))
    made = lambda step, name: sections.where(F.col("section_index") % step == 0).select("doc_id", "section_index", F.concat(F.lit(name), "section_index").alias(name))
    keys = ["doc_id", "section_index"]
    tables.put("artifacts", made(2, "summary").withColumn("quiz", F.lit(None).cast("string")), keys)
    tables.update("artifacts", made(3, "quiz"), keys, fields=["quiz"])
    tables.update("artifacts", made(4, "summary").withColumn("summary", F.concat(F.lit("new "), "summary")), keys, fields=["summary"], must_exist=True)
    return tables.read("artifacts")


def _turns(events: DataFrame) -> DataFrame:
    """Events as turns: three types are read as one document, every fourth turn has no hit, every fifth no question."""
    question = F.when(F.col("event_id") % 5 != 0, F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")))
    return events.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("turn"), F.when(F.col("event_type").isin("click", "view", "scroll"), "book").otherwise(F.col("event_type")).alias("doc_name"), question.alias("question"), F.expr("case when event_id % 4 <> 0 then event_id % 50 end").alias("best_chunk"))


def session_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histories.replay(_turns(table(spark, sf_dir, "events")))


def streamed_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream, in one trigger."""
    folder, schema = store.scratch_folder(spark), table(spark, sf_dir, "events").schema
    turns = _turns(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*"))
    query = histories.stream(turns).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(histories.OUTPUT).parquet(f"{folder}/out")


QUERIES = {f.__name__: f for f in (incremental_sections, build_outcomes, artifact_updates, session_histories, streamed_histories)}

HISTORIES = """with t as (select user_id session_id, event_id turn, case when event_type in ('click', 'view', 'scroll') then 'book' else event_type end doc_name, case when event_id % 5 <> 0 then event_type || ' ' || event_id else '' end question, case when event_id % 4 <> 0 then event_id % 50 end best_chunk from events),
    c as (select *, case when lag(doc_name) over w is not distinct from doc_name and lag(true) over w then 0 else 1 end changed from t window w as (partition by session_id order by turn)),
    s as (select *, sum(changed) over (partition by session_id order by turn)::bigint segment from c)
    select session_id, turn, doc_name, segment, last_value(best_chunk ignore nulls) over w::bigint active_chunk, list(question) over (partition by session_id, segment order by turn rows between 9 preceding and current row) recent_questions,
    coalesce(list(best_chunk::bigint) filter (best_chunk is not null) over w, [])[-10:] recent_chunks from s window w as (partition by session_id, segment order by turn rows between unbounded preceding and current row)"""
ORACLE = {
    "session_histories": HISTORIES,
    "streamed_histories": HISTORIES,
    "incremental_sections": f"select t.* exclude (opens) replace (sha256(content) as content) from {TITLED_SECTIONS} t join documents d using (doc_id) where lang in ('en', 'fr', 'es')",
    "build_outcomes": """with d as (select doc_id, case when doc_id % 9 = 4 then '' else text end x, case when doc_id % 7 = 3 then '' else lang end l from documents)
        select doc_id, case when trim(coalesce(x, ''), chr(9) || chr(10) || chr(13) || ' ') = '' then 'missing_raw_text' when coalesce(l, '') = '' then 'missing_language' when l in ('en', 'fr', 'es') then 'built' else 'unsupported_language:' || l end outcome from d""",
    "artifact_updates": f"""select doc_id, section_index, case when section_index % 4 = 0 then 'new summary' || section_index when section_index % 2 = 0 then 'summary' || section_index end summary, case when section_index % 3 = 0 then 'quiz' || section_index end quiz
        from {TITLED_SECTIONS} where section_index % 2 = 0 or section_index % 3 = 0""",
}
