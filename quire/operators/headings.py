"""Heading typography, and how titles are compared."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.functions.text import squeeze

# Dashes that are read as a hyphen.
DASHES = "‐‑‒–—―−－─"


@F.pandas_udf(StringType())
def _compatible(titles: pd.Series) -> pd.Series:
    return titles.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def typography(title: Column) -> Column:
    """Compatibility forms composed, dashes as hyphens, white space squeezed.

    Only titles with characters beyond ASCII go through Python."""
    composed = F.when(title.rlike(r"[^\x00-\x7F]"), _compatible(title)).otherwise(title)
    return squeeze(F.translate(composed, DASHES, "-" * len(DASHES)))


def chinese_numerals(title: Column, lang: Column) -> Column:
    """A dash after a ten in a Chinese chapter number is read as the one it was."""
    return F.when(lang == "zh", F.regexp_replace(title, r"^(第[〇零一二三四五六七八九百]*[十拾0])[-－—–─]([章节節回部篇])", "$1一$2")).otherwise(title)


def normalize(title: Column, lang: Column, plugins: tuple[Callable[[Column, Column], Column], ...] = (lambda t, _: typography(t), chinese_numerals)) -> Column:
    """The plugins one after the other; where one gives null, what it got stays."""
    for plugin in plugins:
        title = F.coalesce(plugin(title, lang), title)
    return title


def comparison_key(title: Column) -> Column:
    """Lower case, white space squeezed, no colon or stop at the end."""
    return F.regexp_replace(F.lower(squeeze(title)), "[.:：;；]+$", "")


def label_suffix(rest: Column) -> Column:
    """What follows a marker is a label: up to three numbers, roman numerals or single letters, 20 characters."""
    return (F.length(rest) <= 20) & rest.rlike(r"(?iu)^([ ]*([0-9]{1,4}|[ivxlcdm]{1,7}|\p{L})[.:)]?){1,3}[ ]*$")


def marker_matches(line: Column, marker: str) -> Column:
    """A line is a marker, alone or with a label, whatever its case and closing colon."""
    key = comparison_key(line)
    return (key == marker) | (key.startswith(marker + " ") & label_suffix(F.substring(key, len(marker) + 1, 200)))


def marker_in(key: Column, markers: list[str]) -> Column:
    """The marker that a line's comparison key is, alone or with a label; null if none."""
    pattern = "^(" + "|".join(sorted(markers, key=len, reverse=True)) + ")( .*)?$"
    found, rest = F.regexp_extract(key, pattern, 1), F.regexp_extract(key, pattern, 2)
    return F.when((found != "") & ((rest == "") | label_suffix(rest)), found)
