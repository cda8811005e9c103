"""Text functions as columns; only NFKD needs an Arrow UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as JavaScript sees it, but for the blank, as a class of Java's regular expressions.
ODD_BLANK = r"[\t-\r   -     　﻿]"


def squeezed(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends; null is empty.

    Two simple patterns are read far faster than one that tells runs from single blanks.
    """
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), ODD_BLANK, " "), " {2,}", " "))


@F.pandas_udf(StringType())
def keyword_text(texts: pd.Series) -> pd.Series:
    """NFKD without the combining marks U+0300 to U+036F, in lower case; null is empty."""
    marks = {c: None for c in range(0x300, 0x370)}
    return texts.map(lambda t: unicodedata.normalize("NFKD", t).translate(marks).lower() if t else "")


def _bases() -> dict[str, str]:
    """Small letters that decompose into a letter of ASCII and marks, with that letter."""
    found = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base, *marks = unicodedata.normalize("NFKD", c)
        if c.islower() and base.isascii() and marks and all(map(unicodedata.combining, marks)):
            found[c] = base
    return found


_BASES = _bases()
_MARKS = "".join(map(chr, range(0x300, 0x370)))


def plain(text: Column) -> Column:
    """Lower case with the marks of Latin letters taken off, whether they are one character or more."""
    return F.translate(F.lower(text), "".join(_BASES) + _MARKS, "".join(_BASES.values()))


def scan_text(text: Column, most: int = 12_000) -> Column:
    return F.substring(squeezed(text), 1, most)


def words(text: Column) -> Column:
    return F.filter(F.split(squeezed(text), " "), lambda w: w != "")


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds half towards plus infinity; null counts as 0."""
    scale = float(10**digits)
    return F.floor(F.coalesce(x, F.lit(0.0)) * scale + 0.5) / scale


def statistics(clean: Column) -> dict[str, Column]:
    """Words, characters, sentences and mean word length (one decimal) of a ``squeezed`` text.

    Words are one more than blanks, and their letters are what is not blank, so no arrays are made.
    """
    blanks = F.length(clean) - F.length(F.replace(clean, F.lit(" "), F.lit("")))
    found = F.when(clean == "", 0).otherwise(blanks + 1)
    return {
        "text_word_count": found.cast("long"),
        "text_char_count": F.length(clean).cast("long"),
        "text_sentence_count": F.regexp_count(clean, F.lit(r"[^.!? ][^.!?]*+")).cast("long"),
        "avg_word_length": F.when(clean != "", half_up((F.length(clean) - blanks) / found, 1)).otherwise(0.0),
    }


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the ``statistics`` of a column, whose squeezed form is made once."""
    clean = df.withColumn("_clean", squeezed(F.col(text)))
    return clean.withColumns(statistics(F.col("_clean"))).drop("_clean")


def mark_counts(text: Column) -> dict[str, Column]:
    held = F.coalesce(text, F.lit(""))
    return {
        "mention_count": F.regexp_count(held, F.lit(r"@[A-Za-z0-9_]+")).cast("long"),
        "hashtag_count": F.regexp_count(held, F.lit(r"#[A-Za-z0-9_]+")).cast("long"),
        "question_mark_count": F.regexp_count(held, F.lit(r"\?")).cast("long"),
        "exclamation_mark_count": F.regexp_count(held, F.lit("!")).cast("long"),
    }


def emoji_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"))


def shortened(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last an ellipsis where some are cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def stripped_tags(html: Column) -> Column:
    """Text between tags with the common entities decoded."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), "(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return squeezed(out)


def title_of(html: Column, most: int = 200) -> Column:
    return F.substring(F.trim(F.regexp_extract(F.coalesce(html, F.lit("")), "(?is)<title[^>]*>(.*?)</title>", 1)), 1, most)


def search_terms(query: str, most: int = 5) -> list[str]:
    return query.split()[:most]
