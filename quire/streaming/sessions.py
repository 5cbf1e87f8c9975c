"""Reading sessions: a batch replay over turns, and the same state kept by a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HISTORY = 10


def replay(turns: DataFrame) -> DataFrame:
    """Turns (session_id, turn, doc_name, best_chunk) with their reading state after each turn.

    A change of document starts a new segment with empty state; a turn without a hit keeps the active chunk."""
    order = Window.partitionBy("session_id").orderBy("turn")
    changed = F.when(F.lag("doc_name").over(order).eqNullSafe(F.col("doc_name")), 0).otherwise(1)
    rows = turns.withColumn("changed", changed).withColumn("segment", F.sum("changed").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("session_id", "segment").orderBy("turn")
    running, recent = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(1 - HISTORY, 0)
    return rows.select("session_id", "turn", F.col("segment").cast("long").alias("segment"), F.last("best_chunk", ignorenulls=True).over(running).alias("active_chunk"), F.count("*").over(recent).alias("n_recent_questions"), F.least(F.lit(HISTORY), F.count("best_chunk").over(running)).cast("long").alias("n_recent_chunks"))


STATE = "doc_name string, segment long, active_chunk long, questions long, chunks long"
OUTPUT = "session_id long, turn long, segment long, active_chunk long, n_recent_questions long, n_recent_chunks long"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    doc, segment, active, questions, chunks = state.get if state.exists else (None, 0, None, 0, 0)
    for batch in batches:
        out = []
        for row in batch.sort_values("turn").itertuples():
            if row.doc_name != doc or segment == 0:
                doc, segment, active, questions, chunks = row.doc_name, segment + 1, None, 0, 0
            questions = min(HISTORY, questions + 1)
            if row.best_chunk is not None and not pd.isna(row.best_chunk):
                active, chunks = int(row.best_chunk), min(HISTORY, chunks + 1)
            out.append((key[0], row.turn, segment, active, questions, chunks))
        state.update((doc, segment, active, questions, chunks))
        frame = pd.DataFrame(out, columns=["session_id", "turn", "segment", "active_chunk", "n_recent_questions", "n_recent_chunks"])
        yield frame.astype({"active_chunk": "Int64"})


def stream(turns: DataFrame) -> DataFrame:
    """The same state as replay(), kept by session over a stream of turns; no timeout."""
    return turns.groupBy("session_id").applyInPandasWithState(_advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
