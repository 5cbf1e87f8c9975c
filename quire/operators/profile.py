"""Document profile: deterministic metadata of a text, one row a document and no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import count_chars, count_class, matches, strip

# Markers of table of contents, front and back matter by language.
TOC = {"en": ["contents", "table of contents", "contents page"], "fr": ["sommaire", "table des matières"], "de": ["inhalt", "inhaltsverzeichnis"], "es": ["contenido", "índice", "tabla de contenido", "tabla de contenidos"]}
FRONT = {"en": ["preface", "foreword", "introduction", "prologue", "author's note", "authors note"], "fr": ["préface", "avant-propos", "introduction", "prologue"], "de": ["vorwort", "einleitung", "prolog"], "es": ["prólogo", "prefacio", "introducción"]}
TERMINAL = {"en": ["appendix", "appendices", "appendix a", "afterword", "epilogue", "postscript"], "fr": ["annexe", "annexes", "postface", "épilogue"], "de": ["anhang", "anhänge", "nachwort", "epilog"], "es": ["apéndice", "anexo", "anexos", "epílogo", "posfacio"]}


# Quote characters, dashes that open speech, and words of speech, by language.
QUOTES = {"": "\"“”「」『』‘’", "fr": "\"“”「」『』‘’«»", "de": "\"“”「」『』‘’«»„", "es": "\"“”「」『』‘’«»"}
SPEECH = {
    "en": ["he said", "she said", "i said", "they said", "he asked", "she asked", "i asked", "they asked", "he replied", "she replied", "i replied", "they replied"],
    "fr": ["dit-il", "dit-elle", "demanda", "répondit"],
    "de": ["sagte er", "sagte sie", "fragte", "antwortete"],
    "es": ["dijo", "preguntó", "respondió"],
}
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\u0085\u2028\u2029]"
#: White space that holds a line break.
LINE_GAP = r"(?U)[\s\x1C-\x1E]*[\n\r\x0B\f\x1C-\x1E\u0085\u2028\u2029][\s\x1C-\x1E]*"
BARE_END = "[。！？.!?]$"
NOISE_MARKS = "。！？；,.!?;:：，、"
SAMPLE = 12_000


def split_lines(text: Column) -> Column:
    """Lines at every kind of line break; none after the last break."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def _noise_score(text: Column) -> Column:
    head = F.substring(text, 1, SAMPLE)
    size = F.greatest(F.lit(1), F.length(head))
    return (
        F.least(F.lit(1.0), count_chars(head, "\ufffd") / 20)
        + F.least(F.lit(1.0), count_class(head, r"[\x00-\x08\x0b\x0c\x0e-\x1f]") / 30)
        + F.least(F.lit(1.0), 10 * matches(head, "  ") / size)
        + F.when(count_chars(head, NOISE_MARKS) / size < 0.002, 0.5).otherwise(0.0)
    )


def _noise_level(score: Column) -> Column:
    return F.when(score >= 1.8, "high").when(score >= 1.0, "medium").when(score >= 0.35, "low").otherwise("none")


def line_break_quality(docs: DataFrame) -> DataFrame:
    """Shares of empty, short and sentence-ended lines, and the kind of line breaks.

    A null or empty text is unknown, and so is one of three or more lines that are all empty."""
    lines = F.transform(split_lines(F.coalesce("text", F.lit(""))), lambda x: strip(x))
    rows = docs.select("doc_id", "text", lines.alias("lines"))
    full = F.filter("lines", lambda x: F.length(x) > 0)
    rows = rows.select("doc_id", "text", F.size("lines").alias("n_lines"), F.size(full).alias("n_full"), F.aggregate(full, F.lit(0), lambda s, x: s + F.length(x)).alias("chars"), F.size(F.filter(full, lambda x: F.length(x) <= 26)).alias("short"), F.size(F.filter(full, lambda x: x.rlike(BARE_END))).alias("ended"))
    some, all_ = F.greatest(F.lit(1), F.col("n_full")), F.greatest(F.lit(1), F.col("n_lines"))
    rows = rows.select("doc_id", "text", "n_lines", "n_full", ((F.col("n_lines") - F.col("n_full")) / all_).alias("empty_ratio"), (F.col("chars") / some).alias("avg_chars"), (F.col("short") / some).alias("short_ratio"), (F.col("ended") / some).alias("ended_ratio"))
    broken = (F.col("short_ratio") > 0.7) & (_noise_score(F.col("text")) >= 1.0)
    kind = (
        F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, "unknown").when(F.col("n_lines") <= 2, "minimal").when(F.col("n_full") == 0, "unknown")
        .when((F.col("empty_ratio") >= 0.10) & (F.col("avg_chars") >= 35), "paragraph_like")
        .when((F.col("short_ratio") >= 0.60) & (F.col("avg_chars") <= 38) & (F.col("empty_ratio") <= 0.06), "hard_wrapped")
        .when((F.col("ended_ratio") >= 0.70) & (F.col("avg_chars") <= 40), "line_per_sentence")
        .when(~F.contains("text", F.lit("\n")), "minimal").when(broken, "broken_ocr").otherwise("unknown")
    )
    return rows.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), *(F.round(k, 4).alias(k) for k in ("empty_ratio", "avg_chars", "short_ratio", "ended_ratio")), kind.alias("line_break_quality"))


def ocr_noise(docs: DataFrame) -> DataFrame:
    """Noise score of the first characters, the report's own window, and its level; a null or empty text is unknown."""
    rows = docs.select("doc_id", F.length("text").alias("size"), _noise_score(F.col("text")).alias("noise"))
    level = F.when(F.coalesce("size", F.lit(0)) == 0, "unknown").otherwise(_noise_level(F.col("noise")))
    return rows.select("doc_id", F.round("noise", 4).alias("noise"), level.alias("noise_level"))


def script_system(docs: DataFrame) -> DataFrame:
    """Characters by script, and the dominant one; mixed if it has under 45 % or the next over 28 %."""
    classes = {"cyrillic": r"[Ѐ-ӿ]", "greek": r"[Ͱ-Ͽ]", "cjk": r"[一-鿿]", "kana": r"[぀-ヿ]", "hangul": r"[가-힯]", "arabic": r"[؀-ۿ]"}
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.length(text).alias("size"), F.regexp_replace(text, "[A-Za-z]+", "").alias("rest"))
    # all other scripts lie beyond Latin's extensions, so their classes search only what is left of those
    rows = rows.select("doc_id", (F.col("size") - F.length("rest")).cast("long").alias("latin"), F.regexp_replace("rest", r"[\x00-\u036F]+", "").alias("far"))
    rows = rows.select("doc_id", "latin", *(count_class(F.col("far"), p).cast("long").alias(k) for k, p in classes.items()))
    names = ["latin", *classes]
    ranked = F.sort_array(F.array(*(F.struct(F.col(k).alias("n"), F.lit(k).alias("script")) for k in names)), asc=False)
    rows = rows.withColumn("ranked", ranked).withColumn("total", sum(F.col(k) for k in names))
    label = F.when(F.col("total") == 0, "unknown").when((F.col("ranked")[0]["n"] / F.col("total") < 0.45) | (F.col("ranked")[1]["n"] / F.col("total") > 0.28), "mixed").otherwise(F.col("ranked")[0]["script"])
    return rows.select("doc_id", *names, label.alias("script_system"))


def _quoted(marks: str) -> str:
    """Lines of up to 90 characters that open with a mark and have another, or of up to 60 with four."""
    other = f"[^{marks}\\n]*[{marks}]"
    up_to = lambda n: f"(?=[^\\n]{{1,{n}}}(?:\\n|\\z))"
    return f"\\n{up_to(90)}(?:[{marks}]{other}|{up_to(60)}(?:{other}){{4}})[^\\n]*"


def dialogue_density(docs: DataFrame) -> DataFrame:
    """Lines of speech by dash, by short quotes and by words of speech in the first characters, the report's own
    window, and the level; quotes alone never make it high.  A null or empty text is unknown."""
    sample = F.substring(F.coalesce("text", F.lit("")), 1, SAMPLE)
    # one string of the lines that are not empty, without white space at their ends, each after a line break; rules count
    # matches in it, which begin with that break or, for words of speech, go on to the line's end
    flat = F.regexp_replace(F.regexp_replace(sample, LINE_GAP, "\n"), r"(?U)^[\s\x1C-\x1E]+|[\s\x1C-\x1E]+$", "")
    flat = F.concat(F.lit("\n"), F.regexp_replace(flat, r"(?U)[^\S\n]*\n[^\S\n]*", "\n"))
    of = lambda by_code, default: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in by_code.items() if k for x in (k, v))), F.col("lang")), F.lit(default))
    said, quoted = of({k: "(?:" + "|".join(v) + r")[^\n]*" for k, v in SPEECH.items()}, "(?!)"), of({k: _quoted(v) for k, v in QUOTES.items()}, _quoted(QUOTES[""]))

    def verbs(x: Column) -> Column:
        """Most texts have no such word, which a plain search tells sooner than the pattern."""
        held = F.lit(False)
        for code, words in SPEECH.items():
            held = F.when(F.col("lang") == code, reduce(Column.__or__, (F.contains(x, F.lit(w)) for w in words))).otherwise(held)
        return F.when(held, F.regexp_count(x, said)).otherwise(0)

    def counts(x: Column) -> Column:
        dash = F.regexp_count(x, F.lit(r"\n[-–—][^\n]{0,48}[。！？.!?](?=\n|\z)"))
        n = F.greatest(F.lit(1), F.regexp_count(x, F.lit("\n")))
        return F.struct(n.alias("n"), dash.alias("dash"), F.regexp_count(x, quoted).alias("quoted"), F.transform(F.array(F.lower(x)), verbs)[0].alias("verbs"))

    quotes = F.length(sample) - F.length(F.call_function("translate", sample, of(QUOTES, QUOTES[""]), F.lit("")))
    # within a lambda, so that the string is made once and not for each count
    rows = docs.select("doc_id", F.length(sample).alias("size"), quotes.alias("quotes"), F.transform(F.array(flat), counts)[0].alias("c")).select("doc_id", "size", "quotes", "c.*")
    return rows.select("doc_id", F.col("dash").cast("long").alias("dash_lines"), F.col("quoted").cast("long").alias("quote_lines"), F.col("verbs").cast("long").alias("speech_lines"), F.expr("""case when size = 0 then 'unknown'
        when dash >= 4 or dash / n >= 0.18 or (quoted >= 8 and quoted / n >= 0.25 and verbs >= 3) or (dash >= 2 and quoted >= 3) then 'high'
        when dash >= 1 or quoted >= 3 or quoted / n >= 0.10 or verbs >= 2 or quotes / greatest(1, size) >= 0.012 then 'medium' else 'low' end""").alias("dialogue_density"))


def _hits(text: Column, lang: Column, markers: dict[str, list[str]]) -> Column:
    out = F.lit(0)
    for code, words in markers.items():
        out = F.when(lang == code, sum(text.contains(w).cast("int") for w in words)).otherwise(out)
    return out


def region_likelihoods(docs: DataFrame, contents: int = 5000, front: int = 8000, tail: int = 9000) -> DataFrame:
    """Likelihoods of a table of contents, front matter and terminal matter, by markers contained in the first and last
    characters and by dots that lead to a page number."""
    text = F.coalesce("text", F.lit(""))
    start, head, end = F.lower(F.substring(text, 1, contents)), F.lower(F.substring(text, 1, front)), F.lower(F.right(text, F.lit(tail)))
    rows = docs.select("doc_id", _hits(start, F.col("lang"), TOC).alias("toc"), _hits(head, F.col("lang"), FRONT).alias("front"), _hits(end, F.col("lang"), TERMINAL).alias("terminal"), matches(start, r"\.{3,}\s*\d{1,4}").alias("dotted"))
    level = lambda n: F.expr(f"case when {n} >= 3 then 'high' when {n} = 2 then 'medium' when {n} = 1 then 'low' else 'none' end")
    toc = F.expr("case when toc >= 2 or dotted >= 4 then 'high' when toc >= 1 or dotted >= 2 then 'medium' when dotted = 1 then 'low' else 'none' end")
    return rows.select("doc_id", toc.alias("toc_likelihood"), level("front").alias("front_likelihood"), level("terminal").alias("terminal_likelihood"))


def excerpts(docs: DataFrame, head: int = 4000, tail: int = 2500, middle: int = 2200) -> DataFrame:
    """Head, middle and tail of each text."""
    half = F.greatest(F.lit(0), F.floor((F.length("text") - middle) / 2)).cast("int")
    return docs.select("doc_id", F.substring("text", 1, head).alias("head"), F.substring("text", half + 1, F.lit(middle)).alias("middle"), F.right("text", F.lit(tail)).alias("tail"))
