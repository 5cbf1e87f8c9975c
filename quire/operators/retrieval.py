"""Chunks, windows around hits, vector top-k, coverage and token budgets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import dot, doubles, estimate_tokens, line_key, squeeze


def fixed_chunks(docs: DataFrame, size: int = 1200, step: int = 1000) -> DataFrame:
    """doc_id, chunk_index, char_start, char_end, text: overlapping windows that cover each text."""
    last = F.greatest(F.lit(0), F.ceil((F.length("text") - size) / step)).cast("int")
    rows = docs.where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    start = F.col("chunk_index") * step
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), start.cast("long").alias("char_start"), F.least(start + size, F.length("text")).cast("long").alias("char_end"), F.substring("text", start + 1, F.lit(size)).alias("text"))


def link_chunks(chunks: DataFrame) -> DataFrame:
    """Adds the indexes of the previous and the next chunk."""
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    return chunks.withColumn("prev_index", F.lag("chunk_index").over(order)).withColumn("next_index", F.lead("chunk_index").over(order))


def neighbours(records: DataFrame) -> DataFrame:
    """doc_id, node_id, side (prev or next), neighbour_id of records (doc_id, node_id, chunk_index, prev_id, next_id).

    The node that a link names, or where the document has no such node the one at the next chunk index on that side; of
    several nodes at an index the smallest id.  Sides without a neighbour have no row."""
    side = lambda name, step: F.struct(F.lit(name).alias("side"), F.col(f"{name}_id").alias("link"), (F.col("chunk_index") + step).alias("at"))
    wanted = records.select("doc_id", "node_id", F.explode(F.array(side("prev", -1), side("next", 1))).alias("s")).select("doc_id", "node_id", "s.*")
    linked = records.select("doc_id", F.col("node_id").alias("link"), F.col("node_id").alias("linked")).distinct()
    placed = records.groupBy("doc_id", F.col("chunk_index").alias("at")).agg(F.min("node_id").alias("placed"))
    found = wanted.join(linked, ["doc_id", "link"], "left").join(placed, ["doc_id", "at"], "left")
    return found.select("doc_id", "node_id", "side", F.coalesce("linked", "placed").alias("neighbour_id")).where("neighbour_id is not null")


def best_label(vector: Column, labels: dict[str, list[float]]) -> Column:
    """label and similarity of the label whose vector has the highest cosine, ties to the first; null for a vector that is
    missing, zero or of another length than the labels'.

    Labels are a short fixed list, so their vectors are literals and rows are not joined."""
    known = [(name, F.array(*map(F.lit, map(float, point))), sum(float(x) * float(x) for x in point)) for name, point in labels.items()]
    width = len(next(iter(labels.values())))

    def alike(own: Column, squared: Column, point: Column, size: float) -> Column:
        both = squared * size
        return F.when(both > 0, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(own, point) / F.sqrt(both)))).otherwise(0.0)

    def best(v: Column) -> Column:
        options = F.array(*(F.struct(alike(v["own"], v["squared"], point, size).alias("similarity"), F.lit(-i).alias("order"), F.lit(name).alias("label")) for i, (name, point, size) in enumerate(known)))
        return F.when((F.size(v["own"]) == width) & F.exists(v["own"], lambda x: x != 0), F.array_max(options))

    # each step is bound by a lambda, so that the vector's expression stands once in the plan and is computed once for a row
    measured = F.transform(F.array(doubles(vector)), lambda own: F.struct(own.alias("own"), dot(own, own).alias("squared")))
    told = F.transform(F.transform(measured, best), lambda b: F.when(b.isNotNull(), F.struct(b["label"].alias("label"), b["similarity"].alias("similarity"))))
    return F.get(told, F.lit(0))


def local_window(hits: DataFrame, chunks: DataFrame, radius: int = 1) -> DataFrame:
    """For each hit (doc_id, hit_index) the chunks within the radius: doc_id, hit_index, chunk_index, text.

    The range join becomes an equi-join: each hit names the few indexes it wants."""
    wanted = hits.select("doc_id", "hit_index", F.explode(F.sequence(F.col("hit_index") - radius, F.col("hit_index") + radius)).alias("chunk_index"))
    return wanted.join(chunks, ["doc_id", "chunk_index"]).select("doc_id", "hit_index", "chunk_index", "text")


def merge_windows(windows: DataFrame) -> DataFrame:
    """Windows of all hits of a document in order, each distinct text at its first place."""
    first = windows.groupBy("doc_id", F.md5(line_key(F.col("text"))).alias("key")).agg(F.min(F.struct("hit_index", "chunk_index")).alias("one"))
    order = Window.partitionBy("doc_id").orderBy("hit_index", "chunk_index")
    rows = first.select("doc_id", "one.hit_index", "one.chunk_index")
    return rows.withColumn("place", F.row_number().over(order).cast("long"))


def search(vectors: DataFrame, queries: DataFrame, k: int, measure: str = "distance", block: int = 4000) -> DataFrame:
    """query_id, vec_id, score, place: the k nearest rows of each query, ties by id, without the query itself.

    The measure is the squared distance or 1 - cosine.  Rows and queries are dealt into blocks of about `block`; each pair of
    blocks is one task's group, which keeps k rows for each of its queries, and those are merged by query.
    Within a pair, a matrix product gives all measures nearly; rows that may be among the k nearest are then measured exactly.
    All rows with the query's own id are left out, also where ids repeat.  Rows or queries without a vector, or with another
    length than the other side's, match nothing."""
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    own = vectors.where(usable & F.col("vec_id").isNotNull()).select("vec_id", "embedding", F.size("embedding").alias("d"))
    asked = queries.where(usable & F.col("vec_id").isNotNull()).select(F.col("vec_id").alias("query_id"), "embedding", F.size("embedding").alias("d"))
    rows, wanted = max(1, -(-own.count() // block)), max(1, -(-asked.count() // block))
    left = own.withColumn("r", F.pmod(F.xxhash64("vec_id"), F.lit(rows)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(wanted - 1))))
    right = asked.withColumn("q", F.pmod(F.xxhash64("query_id"), F.lit(wanted)).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))

    def nearest(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(x) and len(y):
            ids, points = x.vec_id.to_numpy(), np.stack(x.embedding.to_numpy()).astype(float)
            asked_ids, asked_points = y.query_id.to_numpy(), np.stack(y.embedding.to_numpy()).astype(float)
            size = np.sqrt((points * points).sum(1))
            for at in range(0, len(asked_ids), 256):
                some, own = asked_points[at : at + 256], asked_ids[at : at + 256]
                length = np.sqrt((some * some).sum(1))
                product = some @ points.T
                if measure == "distance":
                    rough = length[:, None] ** 2 + size[None] ** 2 - 2 * product
                    slack = 1e-9 * (length.max() + size.max()) ** 2
                else:
                    both = length[:, None] * size[None]
                    rough, slack = -np.divide(product, both, out=np.zeros_like(product), where=both > 0), 1e-9
                rough[own[:, None] == ids[None]] = np.inf
                last = np.partition(rough, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
                for i, query in enumerate(own.tolist()):
                    may = np.flatnonzero((rough[i] <= last[i] + slack) & (rough[i] < np.inf))
                    if measure == "distance":
                        score = ((points[may] - some[i]) ** 2).sum(1)
                    else:
                        both = size[may] * length[i]
                        score = 1 - np.clip(np.where(both > 0, points[may] @ some[i] / np.where(both > 0, both, 1), 0), -1, 1)
                    near = np.lexsort((ids[may], score))[:k]
                    out["query_id"] += [query] * len(near)
                    out["vec_id"] += ids[may[near]].tolist()
                    out["score"] += score[near].tolist()
        return pd.DataFrame(out)

    found = left.groupBy("r", "q", "d").cogroup(right.groupBy("r", "q", "d")).applyInPandas(nearest, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k)


def hit_records(hits: DataFrame, records: DataFrame) -> DataFrame:
    """Hits (query_id, place, vec_id, score) with the columns of their records (vec_id, text, ...), and rank from 1.

    Hits without a record fall out; of a query's hits whose texts are equal, but for white space, the first by place stays.  The
    number of hits was limited before, so a query may have fewer.  Where records repeat an id, the one with the least text counts;
    a null text equals no other."""
    one = records.groupBy("vec_id").agg(F.min(F.struct(F.col("text").isNull(), "text", *(c for c in records.columns if c not in ("vec_id", "text")))).alias("r")).select("vec_id", *(F.col(f"r.{c}").alias(c) for c in records.columns if c != "vec_id"))
    rows = hits.select("query_id", "place", "vec_id", "score").join(one, "vec_id").withColumn("_key", F.coalesce(F.md5(squeeze(F.col("text"))), F.concat(F.lit("null "), "vec_id")))
    first = Window.partitionBy("query_id", "_key").orderBy("place")
    kept = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_key")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place")).cast("long"))


def coverage(hits: DataFrame, by: str, rank: str, place: str, gap: int = 2) -> DataFrame:
    """Hits in rank order, each kept if it is more than gap away from all kept ones.

    A fold over the hits of one query, which are a top-k report and so few."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), F.col(place).alias("place"))))
    rows = hits.groupBy(by).agg(ordered.alias("hits"))
    kept = F.aggregate("hits", F.expr("cast(array() as array<struct<rank:bigint,place:bigint>>)"), lambda got, x: F.when(F.exists(got, lambda y: F.abs(y["place"] - x["place"]) <= gap), got).otherwise(F.array_append(got, F.struct(x["rank"].cast("long").alias("rank"), x["place"].cast("long").alias("place")))))
    return rows.select(by, F.explode(kept).alias("kept")).select(by, F.col("kept.rank").alias("rank"), F.col("kept.place").alias("place"))


def answer_mode(best: Column) -> Column:
    """strict below 1.10, cautious below 1.28, else (or without hits) reject."""
    return F.when(best < 1.10, "strict").when(best < 1.28, "cautious").otherwise("reject")


def clip_to_tokens(text: Column, budget: Column) -> Column:
    """The longest start of a text within a token budget, by bisection over its length, without white space at the end."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.length(text) + 2)).cast("int"))
    bounds = F.struct(F.lit(0).alias("low"), F.length(text).alias("high"))

    def halve(at, _):
        middle = F.floor((at["low"] + at["high"] + 1) / 2).cast("int")
        fits = estimate_tokens(F.substring(text, F.lit(1), middle)) <= budget
        return F.struct(F.when(fits, middle).otherwise(at["low"]).alias("low"), F.when(fits, at["high"]).otherwise(F.greatest(at["low"], middle - 1)).alias("high"))

    size = F.aggregate(steps, bounds, halve, lambda at: at["low"])
    return F.when(budget <= 0, "").when(estimate_tokens(text) <= budget, text).otherwise(F.regexp_replace(F.substring(text, F.lit(1), size), r"(?U)\s+$", ""))


def budget_prefix(chunks: DataFrame, budget: int) -> DataFrame:
    """doc_id, chunk_index, tokens, running, text: the chunks of each document, in order, whose tokens together stay
    within the budget.  A first chunk over the budget is clipped to it.

    A budget of 0 means the default of 1500, as an unset one does."""
    most = budget or 1500
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    rows = chunks.withColumn("tokens", estimate_tokens(F.col("text"))).withColumn("place", F.row_number().over(order))
    clipped = (F.col("place") == 1) & (F.col("tokens") > most)
    rows = rows.withColumn("running", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("running") <= most) | clipped)
    rows = rows.withColumn("text", F.when(clipped, clip_to_tokens(F.col("text"), F.lit(most))).otherwise(F.col("text")))
    rows = rows.withColumn("tokens", F.when(clipped, estimate_tokens(F.col("text"))).otherwise(F.col("tokens"))).withColumn("running", F.when(clipped, F.col("tokens")).otherwise(F.col("running")))
    return rows.where("length(text) > 0").select("doc_id", "chunk_index", "tokens", "running", "text")


def context_mode(total_tokens: Column, budget: Column, scope: Column, distance: Column, threshold: Column, mode: Column) -> Column:
    """reject, full_text, local_window or retrieval, in this order of precedence."""
    return F.when(mode == "reject", "reject").when((scope == "global") & (total_tokens <= budget), "full_text").when((scope == "local") & (distance <= threshold), "local_window").otherwise("retrieval")
