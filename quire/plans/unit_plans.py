"""Split plans of single sections: anchors that may be patterns, and the units that a plan gives."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.functions.text import SPACES, blank_to_null, line_key, strip

#: Instructions that a plan may have; seconds that a pattern may take on one line.
MOST_INSTRUCTIONS, SECONDS = 32, 0.2
KEYS = ["doc_id", "section_index"]
#: White space within lines: runs of it, and what says that there are others than single spaces.
_WIDE, _ODD = re.compile(f"[{SPACES.replace('\n', '')}]+"), re.compile(f"  |[{SPACES.replace('\n', '').replace(' ', '')}]")


def finder(seconds: float = SECONDS) -> Callable[[str, str], bool]:
    """What tells whether a pattern is found in a line.

    Patterns come as data: each is compiled once, an invalid one matches nothing, and so does one on a line
    where it takes longer than `seconds`, so that no pattern holds up a task."""
    known: dict[str, regex.Pattern | None] = {}

    def found(source: str, line: str) -> bool:
        if source not in known:
            if len(known) > 10_000:
                known.clear()
            try:
                known[source] = regex.compile(source)
            except regex.error:
                known[source] = None
        try:
            return known[source] is not None and known[source].search(line, timeout=seconds) is not None
        except TimeoutError:
            return False

    return found


def followed(plans: DataFrame, sections: DataFrame, cut: str = "") -> DataFrame:
    """sections (with texts that are stripped) with n_instructions (null without a plan), found (place, title, char_start: where its instructions begin)
    and, as `cut` says, the parts (title, text) that these make of the text or only their sizes (null if none begins within it).

    A plan's instructions gather beside its section's text, so a text is shuffled once and its lines not at all."""
    pattern = strip(F.col("anchor"))
    told = F.struct("place", F.col("title").alias("title"), pattern.alias("pattern"), line_key(pattern).alias("key"), F.coalesce("match_mode", F.lit("exact")).alias("mode"), F.greatest(F.lit(1), F.coalesce("occurrence", F.lit(1))).alias("nth"))
    own = plans.groupBy(*KEYS).agg(F.count("*").alias("n_instructions"), F.collect_list(F.when(pattern != "", told)).alias("wanted"))
    rows = sections.join(own.hint("shuffle_hash"), KEYS, "left")
    keys = F.when(F.size("wanted") > 0, F.lower("text"))  # Spark's lower case, as that of the anchors
    kept = [*sections.columns, "n_instructions"]
    found = f"array<struct<place:{plans.schema['place'].dataType.simpleString()},title:string,char_start:bigint>>"
    rows = rows.select(*kept, keys.alias("keys"), "wanted", F.lit(None).cast(found).alias("found"), *([F.lit(None).cast({"parts": "array<struct<title:string,text:string>>", "sizes": "array<int>"}[cut]).alias(cut)] if cut else []))
    schema = StructType([rows.schema[c] for c in [*kept, "found", *([cut] if cut else [])]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = finder()
        for batch in batches:
            starts, pieces = [], []
            for text, keys, wanted in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("text", "keys", "wanted")), strict=True):
                text, wanted = text.as_py(), wanted.as_py()
                starts.append(list(begun(text, line_keys(keys.as_py()), wanted, has)) if text and wanted else [])
                if cut:
                    own = divided(text, starts[-1])
                    pieces.append([len(x["text"]) for x in own] if own is not None and cut == "sizes" else own)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            made = [pa.array(x, batch.schema.field(c).type) for c, x in (("found", starts), *([(cut, pieces)] if cut else []))]
            yield pa.RecordBatch.from_arrays([*columns, *made], schema.names)

    return rows.mapInArrow(run, schema)


def line_keys(lower: str) -> list[str]:
    """The keys of a text's lines, as functions.text.line_key makes them, from the text in lower case."""
    return [x.strip(SPACES) for x in (_WIDE.sub(" ", lower) if _ODD.search(lower) else lower).split("\n")]


def begun(text: str, keys: list[str], wanted: list[dict], has: Callable[[str, str], bool]) -> Iterator[dict]:
    """Where each instruction begins: at the wanted line of those that match, or at the last of them if they are fewer."""
    lines = [x.strip(SPACES) for x in text.split("\n")]
    start = [0, *accumulate(len(x) + 1 for x in text.split("\n"))]
    for w in wanted:
        at, left = None, w["nth"]
        for i, line in enumerate(lines):
            if line and (has(w["pattern"], line) if w["mode"] == "regex" else w["key"] in keys[i] if w["mode"] == "contains" else w["key"] == keys[i]):
                at, left = start[i], left - 1
                if not left:
                    break
        if at is not None:
            yield {"place": w["place"], "title": w["title"], "char_start": at}


def divided(text: str | None, found: list[dict]) -> list[dict] | None:
    """The parts between the places found within a text, of equal ones the first; blank parts fall out."""
    inner: dict[int, dict] = {}
    for x in found:
        if 0 < x["char_start"] < len(text) and (x["char_start"] not in inner or x["place"] < inner[x["char_start"]]["place"]):
            inner[x["char_start"]] = x
    if not inner:
        return None
    starts = [0, *sorted(inner)]
    parts = ((a, text[a:b].strip(SPACES)) for a, b in zip(starts, [*starts[1:], len(text)], strict=True))
    return [{"title": inner[a]["title"] if a else None, "text": part} for a, part in parts if part]


def anchors(plans: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_id, section_index, place, title, char_start: where the instructions of plans begin in the sections' texts (stripped).

    `plans` has doc_id, section_index, place, title, anchor, match_mode (exact, contains, regex) and occurrence.  The lines
    that match are counted from 1, and a number beyond the last means the last; anchors without a line fall out.  Exact and contained
    anchors are compared in lower case with squeezed white space, patterns are searched for in the stripped line."""
    return followed(plans, sections.select(*KEYS, strip(F.col("text")).alias("text"))).select(*KEYS, F.inline("found"))


def planned_units(plans: DataFrame, sections: DataFrame, least: int = 300, most: int = 1600) -> tuple[DataFrame, DataFrame]:
    """The units (doc_id, section_index, unit_no, unit_id, title, container_title, text) of sections (with title, container_title, text) whose
    plan is good; and doc_id, section_index, reason of the others, which are to be cut by rule.

    A plan has 1 to MOST_INSTRUCTIONS instructions; anchors at a text's start fall out, and of equal ones the first stays.  Its
    units, of which there must be two, must hold 70 % of the text, none may be much too long, and few much too short."""
    named = sections.select(*KEYS, blank_to_null(F.col("title")).alias("title"), blank_to_null(F.col("container_title")).alias("container_title"), strip(F.col("text")).alias("text"))
    # who only asks for reasons gets no texts of parts
    whole = followed(plans, named, cut="parts").withColumn("sizes", F.transform("parts", lambda x: F.length(x["text"])))
    sized = followed(plans, named, cut="sizes")
    n = F.array_size("sizes")
    size = F.length("text")
    short, long = max(32, int(least * 0.25)), max(2 * most, 2400)
    held, n_short = F.aggregate("sizes", F.lit(0), lambda s, x: s + x), F.size(F.filter("sizes", lambda x: x < short))
    sound = (held >= F.greatest(F.lit(1), F.floor(size * 0.7))) & (F.array_max("sizes") <= long) & (n_short <= F.greatest(F.lit(1), F.floor(n / 3)))
    reason = (
        F.when(F.coalesce(size, F.lit(0)) == 0, "empty_section_content")
        .when(F.col("n_instructions").isNull(), "empty_or_invalid_llm_plan")
        .when(F.col("n_instructions") > MOST_INSTRUCTIONS, F.concat(F.lit("too_many_plan_instructions:"), F.col("n_instructions").cast("string")))
        .when(F.size("found") == 0, "no_resolved_boundaries")
        .when(n.isNull(), "resolved_boundaries_too_few")
        .when(n < 2, "resolved_chunks_too_few")
        .when(~sound, "abnormal_units_output")
    )
    units = whole.where(reason.isNull()).select(*KEYS, F.col("title").alias("section_title"), "container_title", F.posexplode("parts").alias("unit_no", "part")).withColumn("unit_no", F.col("unit_no").cast("long"))
    # the part at a text's start bears the section's title
    title = F.coalesce(F.when(F.col("unit_no") == 0, F.col("section_title")), blank_to_null(F.col("part.title")), F.concat("section_title", F.lit(" (Part "), F.col("unit_no") + 1, F.lit(")")), F.concat(F.lit("Task Unit "), F.col("unit_no") + 1))
    units = units.select(*KEYS, "unit_no", F.concat(F.lit("task-unit-"), "section_index", F.lit("-"), "unit_no").alias("unit_id"), title.alias("title"), "container_title", F.col("part.text").alias("text"))
    return units, sized.select(*KEYS, reason.alias("reason")).where("reason is not null")
