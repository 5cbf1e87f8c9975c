"""Heading rules that come as a table: which rule of its document's language a line meets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.heading_words import REGIONS, rules
from quire.functions.text import strip
from quire.operators.lines import explode_lines

STRONG = ("chapter", "numbered", "single")
#: A language's patterns are one row of a broadcast table, so there must be few and short ones.
MOST_RULES, LONGEST = 2_000, 20_000


def rule_table(spark: SparkSession, table: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """lang and a pattern for each rule; of several patterns of one rule any may match."""
    table = rules() if table is None else table
    if len(table) > MOST_RULES or any(len(p) > LONGEST for _, _, p in table):
        raise ValueError(f"at most {MOST_RULES} rules of {LONGEST} characters")
    rows = {}
    for lang, rule, pattern in table:
        rows.setdefault(lang, {}).setdefault(rule, []).append(f"({pattern})")
    names = [*STRONG, *REGIONS]
    return spark.createDataFrame([(lang, *("(?iuU)" + "|".join(own[n]) if n in own else None for n in names)) for lang, own in rows.items()], "lang string, " + ", ".join(f"{n}_rule string" for n in names))


def marked_lines(docs: DataFrame, table: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """doc_id, line_no, char_start, title, strong (chapter, numbered, single), region (toc, front_matter, appendix, back_matter)
    and level (2: chapter, else 1) of the lines that meet a rule of their document's language.

    Rules are (language, rule, pattern), by default those of nineteen languages.  Patterns come to each line by a broadcast
    join on the language, so the plan does not grow with the languages, and a task compiles a pattern when
    its documents' language changes.  Of rules that a line meets, the first one counts, in the order above.  Documents
    without a language, or of one without rules, have no marked lines; null texts have no lines."""
    lines = explode_lines(docs, "lang").select("doc_id", "lang", "line_no", "char_start", strip(F.col("line")).alias("title")).where(F.length("title").between(1, 200))
    lines = lines.join(F.broadcast(rule_table(docs.sparkSession, table)), "lang")
    first = lambda names: F.coalesce(*(F.when(F.regexp_like("title", F.col(f"{n}_rule")), n) for n in names))
    met = lines.select("doc_id", "line_no", "char_start", "title", first(STRONG).alias("strong"), first(REGIONS).alias("region"))
    return met.where("strong is not null or region is not null").withColumn("level", F.when(F.col("strong") == "chapter", 2).otherwise(1))
