"""Where a text's body starts, weak headings, and parts that only hold a chapter.

All windows are over one document's lines, so each operator shuffles the lines once, by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import matches, strip
from quire.operators.headings import comparison_key, marker_in
from quire.operators.lines import CHINESE, DECORATION, explode_lines
from quire.operators.structure import REGIONS, heading_flags

# How far contents and front matter reach, in lines and shares of the text.
TOC_LINES, FRONT_LINES, TOC_HEADINGS = 180, 360, 3
EARLY, FRONT_EARLY, EARLY_CHARS = 0.35, 0.45, 1500
# What ends a line that is no weak heading.
PUNCTUATED = "[。！？!?;；,.，:]$"


def _own(*order: str):
    return Window.partitionBy("doc_id", *order)


def body_start(docs: DataFrame) -> DataFrame:
    """doc_id, char_start, reason: where the body starts, after contents or front matter; 0 (none) if nothing tells.

    Contents: a marker early in the text, three or more numbered headings after it and before the first prose; the body
    starts at the first of these headings that comes again and has prose after it.  Front matter: a marker early in the
    text; the body starts at the first numbered heading after it that has prose after it.  A null text has no row."""
    early = lambda share: F.greatest(F.lit(EARLY_CHARS), F.floor(F.col("size") * share))
    key = comparison_key(F.col("title"))
    rows = heading_flags(docs.withColumn("size", F.length("text")), "size").where("size is not null")
    rows = rows.withColumn("key", key).withColumn("strong", F.col("worded").isNotNull())
    ahead = _own().orderBy("line_no").rowsBetween(1, 3)
    rows = rows.withColumn("follows", F.coalesce(F.max(F.col("prose") & ~F.col("strong")).over(ahead), F.lit(False)))
    marker = lambda region, share: F.min(F.when(marker_in(F.col("key"), REGIONS[region].split("|")).isNotNull() & (F.col("char_start") <= early(share)), F.col("line_no"))).over(_own())
    rows = rows.withColumn("toc", marker("toc", EARLY)).withColumn("front", marker("front_matter", FRONT_EARLY))

    after = F.col("strong") & (F.col("line_no") > F.col("toc"))
    prose = F.min(F.when(F.col("prose") & (F.col("line_no") > F.col("toc")), F.col("line_no"))).over(_own())
    rows = rows.withColumn("stop", F.least(prose, F.col("toc") + TOC_LINES + 1))
    rows = rows.withColumn("listed", F.coalesce(after & (F.col("line_no") < F.col("stop")), F.lit(False)))
    rows = rows.withColumn("n_listed", F.count_if("listed").over(_own())).withColumn("in_list", F.max("listed").over(_own("key")))
    rows = rows.withColumn("time", F.sum(F.when(after, 1).otherwise(0)).over(_own("key").orderBy("line_no")))
    again = after & (F.col("n_listed") >= TOC_HEADINGS) & F.col("in_list") & (F.col("time") > 1) & F.col("follows")
    opens = F.col("strong") & F.col("line_no").between(F.col("front") + 1, F.col("front") + FRONT_LINES) & F.col("follows")
    starts = rows.groupBy("doc_id").agg(F.min(F.when(again, F.col("char_start"))).alias("by_toc"), F.min(F.when(opens, F.col("char_start"))).alias("by_front"))
    reason = F.when(F.col("by_toc").isNotNull(), "contents").when(F.col("by_front").isNotNull(), "front_matter").otherwise("none")
    return starts.select("doc_id", F.coalesce("by_toc", "by_front", F.lit(0)).cast("long").alias("char_start"), reason.alias("reason"))


def is_weak(title: Column, signals: list[str]) -> Column:
    """A short line without a stop at its end, in few words; one that holds a signal may be longer."""
    signal = F.lit(False)
    for word in signals:
        signal = signal | F.lower(title).contains(word)
    words = matches(title, "[A-Za-z0-9]+")
    short = F.when(title.rlike(CHINESE), F.length(title) <= F.when(signal, 30).otherwise(20)).otherwise(words.between(1, F.when(signal, 12).otherwise(8)))
    return (F.length(title) > 0) & (F.length(title) <= F.when(signal, 60).otherwise(40)) & ~title.rlike(DECORATION) & ~title.rlike(PUNCTUATED) & short


def weak_headings(docs: DataFrame, signals: list[str], least: int = 2) -> DataFrame:
    """doc_id, line_no, char_start, title: short lines between blank ones that are no headings by their form; they count
    only where a document has two or more."""
    rows, order = heading_flags(docs), _own().orderBy("line_no")
    blank = F.col("title") == ""
    rows = rows.withColumn("alone", F.coalesce(F.lag(blank).over(order), F.lit(True)) & F.coalesce(F.lead(blank).over(order), F.lit(True)))
    weak = rows.where(F.col("level").isNull() & F.col("alone") & is_weak(F.col("title"), signals))
    return weak.withColumn("n", F.count("*").over(_own())).where(F.col("n") >= least).select("doc_id", "line_no", "char_start", "title")


def without_shells(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, char_start, title, level, container: the headings without parts that only hold a chapter.

    A part followed by a chapter with nothing meaningful between them is such a shell; the chapter bears its title as
    its container."""
    running = _own().orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = heading_flags(docs).withColumn("said", F.sum(F.when(F.col("meaningful") & F.col("level").isNull(), 1).otherwise(0)).over(running)).where("level is not null")
    order = _own().orderBy("line_no")
    shell = (F.col("worded") == "part") & (F.lead("worded").over(order) == "chapter") & (F.lead("said").over(order) == F.col("said"))
    rows = rows.withColumn("shell", F.coalesce(shell, F.lit(False)))
    rows = rows.withColumn("container", F.when(F.lag("shell").over(order), F.lag("title").over(order)))
    return rows.where("not shell").select("doc_id", "line_no", "char_start", "title", "level", "container")


def evidence(docs: DataFrame, keywords: dict[str, list[str]], most: int = 60, longest: int = 90) -> DataFrame:
    """doc_id, place, line_no, line: the first distinct short lines that open with a keyword of their language, which may
    stand behind a number.  At most `most` rows a document, by definition of the report."""
    line = F.col("line")
    hit = F.lit(False)
    for lang, words in keywords.items():
        either = "|".join(sorted(words, key=len, reverse=True))
        number = r"[ ]*[（(]?([0-9]+|[ivxlcdm]+|[一二三四五六七八九十百千万〇零两兩]+)[）)]?[、.．:：\-–—)\]]\s*"
        hit = F.when(F.col("lang") == lang, line.rlike(rf"(?iu)^({either})($|[ :：\-–—.\t])") | line.rlike(rf"(?iu)^{number}({either})($|[\s:：\-–—（(【\[])")).otherwise(hit)
    rows = explode_lines(docs, "lang").withColumn("line", strip(line)).where((F.length("line") <= longest) & hit)
    first = rows.groupBy("doc_id", F.lower("line").alias("key")).agg(F.min(F.struct("line_no", "line")).alias("one")).select("doc_id", "one.line_no", "one.line")
    return first.withColumn("place", F.row_number().over(_own().orderBy("line_no"))).where(F.col("place") <= most).select("doc_id", "place", "line_no", "line")
