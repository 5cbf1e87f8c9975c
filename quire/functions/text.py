"""Scalar text and vector functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[ \t\n\r\f\x0B]"
#: Unicode's white space, as `\\s` has it.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Character classes of the token estimate.
CJK_KANA = r"[㐀-䶿一-鿿豈-﫿぀-ヿ]"
HANGUL = r"[가-힯]"


def strip(text: Column) -> Column:
    """Text without white space at both ends, Unicode's included; only the ends are looked at."""
    return F.trim(text, F.lit(SPACES))


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U) *+[\s&&[^ ]]\s*+|  ++", " "))  # single spaces stay as they are


def line_key(text: Column) -> Column:
    return F.lower(squeeze(text))


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def matches(text: Column, pattern: str) -> Column:
    """Number of matches of a pattern that consumes something."""
    return F.regexp_count(text, F.lit(pattern))


def count_chars(text: Column, chars: str) -> Column:
    """Number of characters of a set; one alone is searched for, which is cheaper than looking up each character."""
    if len(chars) == 1:
        return F.length(text) - F.length(F.replace(text, F.lit(chars), F.lit("")))
    return F.length(text) - F.length(F.translate(text, chars, ""))


def count_class(text: Column, pattern: str) -> Column:
    """Number of characters of a class, taken out in runs, which is cheaper than matching them one by one."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))


def estimate_tokens(text: Column) -> Column:
    """Four ASCII characters count one, all others one each, white space nothing; at least 1 unless empty.

    CJK, kana and hangul are among the others, so one class is enough."""
    text = F.coalesce(text, F.lit(""))
    rest = F.regexp_replace(text, r"[\x21-\x7e\x00-\x08\x0e-\x1b\x7f]+", "")
    solid = F.length(F.regexp_replace(rest, r"(?U)[\s\x1c-\x1f]+", ""))
    total = F.floor((F.length(text) - F.length(rest) + 3) / 4) + solid
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), total)).cast("long")


def fingerprint(text: Column) -> Column:
    return F.md5(strip(text))


def source_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    size = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; 0 if one is missing, zero or of another length."""
    value = dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    fits = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (dot(a, a) * dot(b, b) > 0)
    return F.when(fits, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), value))).otherwise(0.0)


# Names and tags of languages, and their codes.
LANGUAGES = {
    "english": "en", "en-us": "en", "en-gb": "en", "chinese": "zh", "zh-cn": "zh", "zh-tw": "zh", "zh-hans": "zh", "zh-hant": "zh", "japanese": "ja", "french": "fr", "german": "de", "spanish": "es", "portuguese": "pt",
    "italian": "it", "russian": "ru", "korean": "ko", "arabic": "ar", "hindi": "hi", "turkish": "tr", "dutch": "nl", "polish": "pl", "ukrainian": "uk", "indonesian": "id", "vietnamese": "vi", "thai": "th",
    "en": "en", "zh": "zh", "ja": "ja", "fr": "fr", "de": "de", "es": "es", "pt": "pt", "it": "it", "ru": "ru", "ko": "ko", "ar": "ar", "hi": "hi", "tr": "tr", "nl": "nl", "pl": "pl", "uk": "uk", "id": "id", "vi": "vi", "th": "th",
}
# Scripts, and words of Latin-script languages, in the order in which they are looked for.
SCRIPTS = {"zh": "[\u4e00-\u9fff]", "ja": "[\u3040-\u30ff]", "ko": "[\uac00-\ud7af]", "ar": "[\u0600-\u06ff]", "hi": "[\u0900-\u097f]", "th": "[\u0e00-\u0e7f]", "uk": "[іїєґ]", "ru": "[а-яё]"}
HINTS = {
    "es": (" cuáles", " qué ", " tema", " relaciones", " razones"), "pt": (" quais", " resumo", " temas", " relações"), "fr": (" quels", " résumé", " thèmes", " relations"), "de": (" welche", " zusammenfassung", " themen", " beziehungen"),
    "it": (" quali", " riassunto", " temi", " relazioni"), "nl": (" welke", " samenvatting", " relaties", " thema"), "pl": (" które", " podsumowanie", " relacje", " tematy"), "id": (" yang ", " ringkasan", " hubungan", " tema"), "vi": (" những", " tóm tắt", " mối quan hệ", " chủ đề"),
}


def language_alias(code: Column, aliases: dict[str, str] = LANGUAGES) -> Column:
    """The code of a language name or tag, else that of the tag's first part; unknown names are 'unknown'."""
    tag = F.regexp_replace(F.translate(F.lower(strip(code)), "_", "-"), "[^a-z-]", "")
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.element_at(known, tag), F.element_at(known, F.split(tag, "-")[0]), F.lit("unknown"))


def detector_language(answer: Column) -> Column:
    """The code in a detector's answer, which is its first word."""
    return language_alias(F.split(F.translate(F.lower(strip(answer)), ".", ""), r"(?U)\s+")[0])


def infer_language(text: Column) -> Column:
    """A text's language by its script or, in Latin script, the first language one of whose words it holds, else English.

    The lowered text is bound by a lambda: it is made once for a row, not once for each script and word."""

    anywhere = "[" + "".join(p[1:-1] for p in SCRIPTS.values()) + "]"  # most texts have none of them and are searched once

    def told(lowered: Column) -> Column:
        out = latin = F.when(lowered.rlike("[a-z]"), F.coalesce(*(F.when(_holds(lowered, words), code) for code, words in HINTS.items()), F.lit("en"))).otherwise("unknown")
        for code, pattern in reversed(SCRIPTS.items()):
            out = F.when(lowered.rlike(pattern), code).otherwise(out)
        return F.coalesce(F.when(lowered.rlike(anywhere), out).otherwise(latin), F.lit("unknown"))

    return F.get(F.transform(F.array(F.lower(strip(text))), told), F.lit(0))


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    out = text.contains(words[0])
    for word in words[1:]:
        out = out | text.contains(word)
    return out


def preview(text: Column, size: int, share: float = 0.65, mark: str = "\n\n[... middle omitted ...]\n\n") -> Column:
    """A text's head and tail around a mark, within `size` characters; the head gets its share of what the mark leaves."""
    if size <= 0:
        return F.when(text.isNotNull(), "")
    if size <= len(mark) + 20:
        return F.substring(text, 1, size)
    head = max(20, int((size - len(mark)) * share))
    tail = max(20, size - len(mark) - head)
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(mark), F.substring(text, -tail, tail)))


# Names of the ways to split a section.
SPLIT_MODES = {"semantic_safe": "semantic_safe", "semantic": "semantic_safe", "safe": "semantic_safe", "progressive": "progressive", "window": "progressive", "llm_enhanced": "llm_enhanced", "enhanced": "llm_enhanced", "llm": "llm_enhanced"}


def split_mode(name: Column, strict: bool = False) -> Column:
    """The way to split that a name means; other names mean the safe one or, if strict, are null, as are short names."""
    key = F.translate(F.lower(strip(name)), "-", "_")
    if strict:
        return F.when(key.isin(sorted(set(SPLIT_MODES.values()))), key)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in SPLIT_MODES.items() for x in pair]), key), F.lit("semantic_safe"))


def candidates_wanted(asked: Column, mode: Column, most: int) -> Column:
    """How many candidates a request's semantic split weighs: its number within 1..most; null in other modes or without one.

    Reading a number beyond those bounds fails."""
    wrong = asked.isNotNull() & ~asked.between(1, most)
    return F.when(wrong, F.raise_error(F.lit(f"candidates must be within 1..{most}")).cast("long")).when(mode == "semantic_safe", asked.cast("long"))


def effective_k(k: Column, scope: Column, least: int = 8) -> Column:
    """Hits to fetch: as asked for a local question, at least `least` for others."""
    return F.when(scope == "local", k).otherwise(F.greatest(k, F.lit(least)))


def budget(window: int, target: int, share: float) -> int:
    """A token budget: the target, within its share of the model's window."""
    return max(1, min(target, int(window * share)))


def near_chunk_threshold(score: Column, mode: Column, base: int = 2, low: int = 1, high: int = 4) -> Column:
    """How near a chunk must be to count as the same place, by the best score and the answer mode, within bounds.

    A strict answer gets one more below 1.00 and one less over 1.08, a cautious one always one less; a rejected one, or
    one without hits (score null), keeps the base."""
    step = F.when((mode == "strict") & (score < 1.00), 1).when((mode == "strict") & (score > 1.08), -1).when((mode == "cautious") & score.isNotNull(), -1).otherwise(0)
    return F.least(F.lit(high), F.greatest(F.lit(low), F.lit(base) + step))


def context_budget(context_tokens: Column, prompt_tokens: Column, fixed_tokens: Column, reserved: Column) -> Column:
    """Tokens left for context: its own limit, or what the prompt's limit leaves beside fixed parts and the answer."""
    return F.greatest(F.lit(0), F.least(context_tokens, prompt_tokens - fixed_tokens - reserved))
