"""Corpus pipeline: quality rules, quality classifier, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each stage's
rows to the shared folder before the next one reads them, so no stage is computed twice.  Thresholds and
models come from the labelled rows of the input tables, so they do not depend on what earlier
stages left over; only the secret scan's field is fitted on the documents it masks.

Defined results, at every stage: a null text is an empty one (the base rules reject it, as they do every text of fewer
than 20 words); rows with a null doc_id are judged like others and no near-duplicate of any row; of rows that
repeat a doc_id one stays; extra columns pass through the filters unread, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import near_dedup, packing, quality_model, quality_rules, secrets
from quire.llm.cluster import Shelf, table


def reject_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a risk-controlled threshold go."""
    return quality_rules.keep_good(docs, quality_rules.fit_cutoffs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def reject_by_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores below 0.5 go."""
    return quality_model.keep_good(docs, quality_model.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by similarity 0.8 or more of their five-word shingles one stays."""
    return near_dedup.keep_one_of_each(docs, shingle=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text."""
    masked = secrets.mask(docs, secrets.fit(docs))
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(masked.schema["n_chars"].dataType))) if "n_chars" in masked.columns else masked


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids and their places in the sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, packing.special_tokens(public_tokenizers.path("byte_bpe_50k.json"))).select("doc_id", "sequence_id", "offset", "start", "length", "doc_tokens", "ids")


STAGES = [
    ("quality_rules", reject_by_rules),
    ("quality_model", reject_by_model),
    ("near_dedup", keep_one_of_each_group),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]
#: Models and similarity joins are not expressible in SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shelf, docs = Shelf(spark), table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, shelf.put(stage(spark, docs, sf_dir))
        shelf.drop(before)
    return docs
