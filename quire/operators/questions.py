"""Questions: scope, and the window of chunks that fits a budget around a hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import estimate_tokens

# Parts of words that mark a question about a whole text or a place in it.
GLOBAL_WORDS = ["overall", "summary", "summarize", "whole", "entire", "main idea", "theme", "in general"]
LOCAL_WORDS = ["this", "here", "which", "paragraph", "sentence", "page", "line"]


def scope(question: Column, similarity: Column | None = None) -> DataFrame:
    """global, local and the reason: by words, then by similarity to anchors of 0.78 or more, else local."""
    text = F.lower(question)
    wide = F.exists(F.array(*map(F.lit, GLOBAL_WORDS)), lambda w: F.contains(text, w))
    near = F.exists(F.array(*map(F.lit, LOCAL_WORDS)), lambda w: F.contains(text, w))
    alike = F.lit(False) if similarity is None else F.coalesce(similarity >= 0.78, F.lit(False))
    return F.when(wide, F.struct(F.lit("global").alias("scope"), F.lit("words").alias("reason"))).when(alike, F.struct(F.lit("global").alias("scope"), F.lit("similarity").alias("reason"))).when(near, F.struct(F.lit("local").alias("scope"), F.lit("local_words").alias("reason"))).otherwise(F.struct(F.lit("local").alias("scope"), F.lit("default").alias("reason")))


def dynamic_windows(hits: DataFrame, chunks: DataFrame, budget: int) -> DataFrame:
    """doc_id, hit_index, first_index, last_index, tokens: the chunks around each hit, taken left and right in turn while
    they fit the budget; a side ends at its first chunk that is missing or does not fit.

    What a side may take depends on what the other took, so it is a fold, over as many steps as the document has
    chunks.  A document's token counts are one array; hits without a chunk of their own have no row."""
    sizes = chunks.select("doc_id", F.struct("chunk_index", estimate_tokens(F.col("text")).alias("tokens")).alias("c"))
    sizes = sizes.groupBy("doc_id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    rows = hits.join(sizes, "doc_id").withColumn("at", F.array_position(F.transform("c", lambda x: x["chunk_index"]), F.col("hit_index"))).where("at > 0")
    most = F.lit(budget or 1500)
    c = lambda i: F.try_element_at("c", i.cast("int"))
    at = F.col("at").cast("int")
    start = F.struct(at.alias("low"), at.alias("high"), c(at)["tokens"].alias("used"), F.lit(True).alias("left"), F.lit(True).alias("right"))

    def step(s, _):
        low = F.greatest(F.lit(1), s["low"] - 1)
        left = s["left"] & (s["low"] > 1) & (c(low)["chunk_index"] == c(s["low"])["chunk_index"] - 1) & (s["used"] + c(low)["tokens"] <= most)
        used = F.when(left, s["used"] + c(low)["tokens"]).otherwise(s["used"])
        high = F.least(F.size("c"), s["high"] + 1)
        right = s["right"] & (s["high"] < F.size("c")) & (c(high)["chunk_index"] == c(s["high"])["chunk_index"] + 1) & (used + c(high)["tokens"] <= most)
        return F.struct(F.when(left, low).otherwise(s["low"]).alias("low"), F.when(right, high).otherwise(s["high"]).alias("high"), F.when(right, used + c(high)["tokens"]).otherwise(used).alias("used"), left.alias("left"), right.alias("right"))

    grown = rows.select("doc_id", "hit_index", "c", F.aggregate(F.sequence(F.lit(1), F.size("c")), start, step).alias("s"))
    return grown.select("doc_id", "hit_index", c(F.col("s.low"))["chunk_index"].alias("first_index"), c(F.col("s.high"))["chunk_index"].alias("last_index"), F.col("s.used").alias("tokens"))
