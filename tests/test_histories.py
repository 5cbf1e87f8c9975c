"""Session histories: batch against a plain version, stream against batch across a restart, and forgetting."""

import random
import time

from quire.streaming import histories

SCHEMA = "session_id long, turn long, doc_name string, question string, best_chunk long"


def turns(n=40):
    rng = random.Random(7)
    out = []
    for s in range(6):
        doc = "d0"
        for t in range(n):
            doc = rng.choice(["d0", "d1", None]) if rng.random() < 0.08 else doc
            out.append((s, t, doc, None if t % 13 == 5 else f"q{s}-{t}", rng.randint(0, 50) if rng.random() < 0.6 else None))
    return out


def plain(rows, recent=10):
    out, state = [], {}
    for s, t, doc, question, chunk in sorted(rows, key=lambda r: (r[0], r[1])):
        known = state.get(s)
        if known is None or known[0] != doc:
            known = state[s] = [doc, (known[1] if known else 0) + 1, None, [], []]
        known[3] = [*known[3], question or ""][-recent:]
        if chunk is not None:
            known[2], known[4] = chunk, [*known[4], chunk][-recent:]
        out.append((s, t, doc, known[1], known[2], list(known[3]), list(known[4])))
    return sorted(map(str, out))


def told(rows):
    return sorted(str(tuple(r)) for r in rows)


def test_replay_equals_the_plain_version(spark):
    rows = turns()
    assert told(histories.replay(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()) == plain(rows)
    assert told(histories.replay(spark.createDataFrame(rows, SCHEMA), recent=1).collect()) == plain(rows, 1)
    assert histories.replay(spark.createDataFrame([], SCHEMA)).collect() == []


def run(spark, source, state, out, **more):
    query = histories.stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), **more).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def test_stream_equals_batch_after_a_restart(spark, tmp_path):
    rows, source, state, out = turns(), *(str(tmp_path / x) for x in ("in", "state", "out"))
    part = lambda low, high: spark.createDataFrame([r for r in rows if low <= r[1] < high], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    for low, high in ((0, 7), (7, 21)):
        part(low, high)
        run(spark, source, state, out)
    part(21, 40)
    run(spark, source, state, out)  # a new query, which finds its state in the checkpoint
    assert told(spark.read.parquet(out).collect()) == plain(rows)


def test_idle_sessions_are_forgotten(spark, tmp_path):
    source, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    row = lambda t: spark.createDataFrame([(1, t, "d", f"q{t}", t)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    row(0)
    query = histories.stream(spark.readStream.schema(SCHEMA).parquet(source), idle_ms=1).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(processingTime="200 milliseconds").start()
    try:
        got = lambda: spark.read.schema(histories.OUTPUT).parquet(out).collect()
        for t in (0, 1):
            until = time.time() + 30
            while not any(r.turn == t for r in got()) and time.time() < until:
                time.sleep(0.3)
            time.sleep(2)  # triggers without rows, in which the timer expires
            if t == 0:
                row(1)
        assert sorted((r.turn, r.segment, r.recent_questions) for r in got()) == [(0, 1, ["q0"]), (1, 1, ["q1"])]
    finally:
        query.stop()
