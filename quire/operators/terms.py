"""Many terms at once: registries of terms by language, and the first rule one of whose terms a text holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.functions.text import strip
from quire.operators.retrieval import best_label

#: Characters that the terms of an automaton may have together; it is sent to every task.
MOST_CHARS = 4_000_000
# Topics and their key words, in order of priority, and what guidance they give.
TOPICS = {
    "literature": ("literary", "novel", "fiction", "literature"), "finance": ("financial", "report", "finance", "earnings"),
    "technical": ("technical", "documentation", "manual", "api"), "history": ("biography", "history", "historical"),
}
GUIDANCE = {
    "literature": "Topic Guidance: emphasize characters, relationships, and key events.", "finance": "Topic Guidance: emphasize entities, periods, and concrete financial points.",
    "technical": "Topic Guidance: emphasize definitions, procedures, and constraints.", "history": "Topic Guidance: emphasize people, timeline, and turning points.",
}
ALIKE = 0.78


def strong_terms(registry: DataFrame, weak: DataFrame) -> DataFrame:
    """The rows of a registry (language, place, term) whose term is no weak one (language, term) of its language, whatever the case."""
    out = weak.select("language", F.lower("term").alias("key")).distinct()
    return registry.withColumn("key", F.lower("term")).join(out, ["language", "key"], "left_anti").drop("key")


def ordered_union(registry: DataFrame, languages: list[str]) -> DataFrame:
    """place, term: the terms of all languages, in the order of the languages and then of their places, each where it comes first."""
    number = F.coalesce(*(F.when(F.col("language") == code, i) for i, code in enumerate(languages)))
    rows = registry.withColumn("at", F.struct(number.alias("n"), "place")).where(number.isNotNull())
    first = rows.groupBy("term").agg(F.min("at").alias("at"))
    return first.select(F.row_number().over(F.Window.orderBy("at") if hasattr(F, "Window") else _ordered("at")).alias("place"), "term")


def _ordered(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)  # over a registry, which is small by definition


def automaton(rules: dict[str, tuple[str, ...]]) -> ahocorasick.Automaton:
    """Finds all terms in one pass over a text; a term's value is the place of the first rule that has it."""
    if sum(len(t) for terms in rules.values() for t in terms) > MOST_CHARS:
        raise ValueError(f"terms of more than {MOST_CHARS} characters")
    out = ahocorasick.Automaton()
    for place, terms in reversed(list(enumerate(rules.values()))):
        for term in terms:
            if term:
                out.add_word(term.lower(), place)
    if len(out):
        out.make_automaton()
    return out


def first_rule(text: Column, rules: dict[str, tuple[str, ...]]) -> Column:
    """The name of the first rule one of whose terms the text holds, whatever the case; null if there is none.

    A task builds one automaton of all terms, so a text is read once however many terms there are."""
    names = list(rules)
    automaton(rules)  # refuses too many terms here, not in the tasks

    @F.pandas_udf(StringType())
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = automaton(rules)

        def first(value: str | None) -> str | None:
            best = len(names)
            if value and len(machine):
                for _, place in machine.iter(value.lower()):
                    if place < best:
                        best = place
                        if not best:
                            break
            return names[best] if best < len(names) else None

        for texts in batches:
            yield texts.map(first)

    return find(text)


def topic_rule(topic: Column, rules: dict[str, tuple[str, ...]] = TOPICS, embed: Callable[[Column], Column] | None = None, vectors: dict[str, list[float]] | None = None, alike: float = ALIKE) -> Column:
    """The rule of a topic: the first that has a word in it; else that of the most similar word (`vectors`, made as `embed`
    makes a topic's), if it is as similar as `alike`; else null, as for a blank topic."""
    name = F.lower(strip(topic))
    found = first_rule(name, rules)
    if embed is not None:
        of = F.create_map(*(F.lit(x) for rule, terms in rules.items() for term in reversed(terms) for x in (term, rule)))
        near = F.transform(F.array(best_label(embed(name), vectors)), lambda best: F.when(best["similarity"] >= alike, F.element_at(of, best["label"])))
        found = F.coalesce(found, F.when(F.length(name) > 0, F.get(near, F.lit(0))))
    return found


def guidance(topic: Column, rule: Column) -> Column:
    """What is said to guide a task on a topic."""
    told = F.element_at(F.create_map(*(F.lit(x) for pair in GUIDANCE.items() for x in pair)), rule)
    own = F.concat(F.lit("Topic Guidance: align style with topic '"), topic, F.lit("'."))
    return F.when(F.coalesce(F.length(strip(topic)) == 0, F.lit(True)), "Topic Guidance: None").otherwise(F.coalesce(told, own))
