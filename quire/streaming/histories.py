"""What a reading session remembers: its active chunk, its last questions and the last chunks that answered them.

In batch by windows; as a stream by a stateful processor, whose lists and values lie in the state store and survive a restart.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RECENT = 10
OUTPUT = "session_id long, turn long, doc_name string, segment long, active_chunk long, recent_questions array<string>, recent_chunks array<long>"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replay(turns: DataFrame, recent: int = RECENT) -> DataFrame:
    """Turns (session_id, turn, doc_name, question, best_chunk) with what the session remembers after each.

    Another document begins a new segment with empty memory.  A turn without a hit (null) adds its question only; a null question counts
    as an empty one.  Of lists only the last `recent` entries are kept, so a row's size is bounded."""
    order = Window.partitionBy("session_id").orderBy("turn")
    changed = F.when(F.lag("doc_name").over(order).eqNullSafe(F.col("doc_name")) & F.lag(F.lit(True), 1, False).over(order), 0).otherwise(1)
    rows = turns.withColumn("changed", changed).withColumn("segment", F.sum("changed").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("session_id", "segment").orderBy("turn")
    hits = Window.partitionBy("session_id", "segment", F.col("best_chunk").isNull()).orderBy("turn").rowsBetween(1 - recent, 0)
    rows = rows.withColumn("hits", F.when(F.col("best_chunk").isNotNull(), F.collect_list("best_chunk").over(hits)))
    before = own.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        F.col("session_id").cast("long").alias("session_id"),
        F.col("turn").cast("long").alias("turn"),
        "doc_name",
        F.col("segment").cast("long").alias("segment"),
        F.last("best_chunk", ignorenulls=True).over(before).cast("long").alias("active_chunk"),
        F.collect_list(F.coalesce("question", F.lit(""))).over(own.rowsBetween(1 - recent, 0)).alias("recent_questions"),
        F.coalesce(F.last("hits", ignorenulls=True).over(before), F.array().cast("array<long>")).cast("array<long>").alias("recent_chunks"),
    )


class Memory(StatefulProcessor):
    """One session's state: a value for its place, two lists for what it remembers, and a timer that forgets it."""

    def __init__(self, recent: int, idle_ms: int | None):
        self.recent, self.idle_ms = recent, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "doc_name string, segment long, active_chunk long")
        self.questions = handle.getListState("questions", "question string")
        self.chunks = handle.getListState("chunks", "chunk long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        doc, segment, active = self.place.get() if self.place.exists() else (None, 0, None)
        questions = [q[0] for q in self.questions.get()]
        chunks = [c[0] for c in self.chunks.get()]
        out = []
        for row in sorted(rows, key=lambda r: r.turn):  # a session's turns of one trigger
            if segment == 0 or row.doc_name != doc:
                doc, segment, active, questions, chunks = row.doc_name, segment + 1, None, [], []
            questions = [*questions, row.question or ""][-self.recent :]
            if row.best_chunk is not None:
                active, chunks = row.best_chunk, [*chunks, row.best_chunk][-self.recent :]
            out.append(Row(session_id=key[0], turn=row.turn, doc_name=doc, segment=segment, active_chunk=active, recent_questions=questions, recent_chunks=chunks))
        self.place.update((doc, segment, active))
        for state, values in ((self.questions, questions), (self.chunks, chunks)):
            state.put([(v,) for v in values]) if values else state.clear()
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for state in (self.place, self.questions, self.chunks):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream(turns: DataFrame, recent: int = RECENT, idle_ms: int | None = None) -> DataFrame:
    """The same as replay() over a stream of turns, which come in their order between triggers; a session that is idle for `idle_ms`
    is forgotten, so that its next turn begins its first segment again.

    The state is kept in RocksDB: this sets the session's state store.  Timers need a query that goes on: with `idle_ms`, use a
    processing-time trigger."""
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = turns.select(F.col("session_id").cast("long").alias("session_id"), F.col("turn").cast("long").alias("turn"), "doc_name", "question", F.col("best_chunk").cast("long").alias("best_chunk"))
    return rows.groupBy("session_id").transformWithState(Memory(recent, idle_ms), OUTPUT, "append", "none" if idle_ms is None else "processingTime")
