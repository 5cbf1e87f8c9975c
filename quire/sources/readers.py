"""Sources and sinks of documents, chunks and structured documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import strip

SECTION = "struct<section_id:string,section_index:long,title:string,level:int,content:string,char_start:long,char_end:long,section_role:string>"
STRUCTURED = f"document_id string, title string, language string, raw_text string, chapters array<struct<chapter_id:string,title:string,level:int,sections:array<{SECTION}>>>"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each text file: doc_name (without folder and extension) and text."""
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.[^.]+$", "")
    return spark.read.text(path, wholetext=True).select(name.alias("doc_name"), F.col("value").alias("text"))


def read_structured(spark: SparkSession, path: str) -> DataFrame:
    """Structured documents in JSON lines; reading one without chapters fails."""
    rows = spark.read.schema(STRUCTURED).json(path)
    checked = F.when(F.size("chapters") > 0, F.col("chapters")).otherwise(F.raise_error(F.concat(F.lit("document without chapters: "), F.col("document_id"))).cast(rows.schema["chapters"].dataType))
    return rows.withColumn("chapters", checked)


def write_structured(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A chunk table; fails if a place column is missing."""
    rows = spark.read.parquet(path)
    missing = {"doc_id", "chunk_index", "char_start", "char_end", "text"} - set(rows.columns)
    if missing:
        raise ValueError(f"chunk table without {sorted(missing)}")
    return rows


def storage_name(name: F.Column) -> F.Column:
    """A document's name without a known extension; `default` if nothing is left."""
    return F.coalesce(F.nullif(strip(F.regexp_replace(name, r"(?i)\.(txt|pdf|json)$", "")), F.lit("")), F.lit("default"))
