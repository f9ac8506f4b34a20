"""Text functions as column expressions.

Spaces are those of ``\\s`` in the JVM (ASCII), plus U+3000 where it says so.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The two punctuation classes of the text features.
SEPARATORS = r"[^0-9A-Za-z\x{3040}-\x{30ff}\x{3400}-\x{9fff}]+"
PUNCTUATION = (
    r"[\s\x{3000}\x{3001}\x{3002}\x{ff01}\x{ff1f}\x{ff0c}\x{ff0e},.!?~\x{301c}"
    r"\x{30fc}\x{2010}-\x{2015}\x{300c}\x{300d}\x{300e}\x{300f}()\[\]{}]+"
)
KANA, KANJI, LATIN = r"[\x{3040}-\x{30ff}]", r"[\x{3400}-\x{9fff}]", "[0-9A-Za-z]"
# Display widths by character class.
WIDE_UNIT, ALNUM_UNIT, OTHER_UNIT = 1.0, 0.55, 0.35


def text(c: Column) -> Column:
    """Null as the empty text."""
    return F.coalesce(c, F.lit(""))


def clean(c: Column) -> Column:
    """Line ends and runs of space become one space; none at the ends."""
    return F.btrim(F.regexp_replace(text(c), r"[\s\x{3000}]+", " "))


def compact(c: Column) -> Column:
    """Only ASCII letters and digits, kana and kanji."""
    return F.regexp_replace(text(c), SEPARATORS, "")


def strip_punctuation(c: Column) -> Column:
    """Without white space and the common Western and CJK signs."""
    return F.regexp_replace(text(c), PUNCTUATION, "")


def letters_and_digits(c: Column) -> Column:
    """Only Unicode letters and numbers: what can be heard."""
    return F.regexp_replace(text(c), r"[^\p{L}\p{N}]", "")


def is_noise(c: Column) -> Column:
    """Blank, or without any letter or digit."""
    return F.length(letters_and_digits(c)) == 0


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(text(c), F.lit(pattern)).cast("long")


def distinct_chars(c: Column) -> Column:
    """Number of distinct code points."""
    return F.when(F.length(text(c)) == 0, 0).otherwise(F.size(F.array_distinct(F.split(text(c), "")))).cast("long")


def display_units(c: Column) -> Column:
    """Weighted width, times 100: wide 1, ASCII letters and digits 0.55, other ASCII 0.35; spaces count as other."""
    alnum = count_of(c, LATIN)
    ascii_ = count_of(c, r"[\x{00}-\x{7f}]")
    return (F.length(text(c)) - ascii_) * 100 + alnum * 55 + (ascii_ - alnum) * 35


def slug(c: Column) -> Column:
    """Lower case, runs of other characters than a-z 0-9 become one hyphen, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "-"), F.lit("-"))


def preview(c: Column, most: int = 40) -> Column:
    """Cleaned text cut to ``most`` characters, with an ellipsis if it was longer."""
    t = clean(c)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(t)


def tokens(c: Column) -> Column:
    """ASCII words, and every other character that is no space on its own."""
    return F.regexp_extract_all(text(c), F.lit(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]"), 0)


def markup_stripped(c: Column) -> Column:
    """Without tags, style overrides in braces and escaped line breaks."""
    t = F.regexp_replace(text(c), r"<[^>]*>|\{[^}]*\}", "")
    return clean(F.regexp_replace(t, r"\\[Nnh]", " "))


# Fixed value: what finished display text must not hold; a comma between digits is none.
BANNED = r"(?i)[，。⋯‥?!]|(?<!\p{Nd}),|,(?!\p{Nd})|\.{3,}|…{2,}|[？！]{2,}|</?\s*i\s*>"


def banned_punctuation(c: Column) -> Column:
    """Commas (not inside numbers), full stops, half-width ends, runs of ends and of dots, foreign ellipses, italics."""
    return count_of(c, BANNED)


def glossary_pair(line: Column) -> Column:
    """struct(source, target) of a line "source - target"; null without a hyphen, with an arrow, or with an empty side."""
    source = F.btrim(F.substring_index(line, "-", 1))
    target = F.btrim(F.regexp_replace(line, "^[^-]*-", ""))
    sides = F.contains(line, F.lit("-")) & ~F.contains(line, F.lit("->")) & (source != "") & (target != "")
    return F.when(sides, F.struct(source.alias("source"), target.alias("target")))


def token_budget(duration_ms: Column) -> Column:
    """Decode budget of a duration: max(64, ceil(10 per second) + 16)."""
    return F.greatest(F.lit(64).cast("long"), F.ceil(duration_ms * 10 / 1000.0) + 16)


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: "".join(unicodedata.normalize("NFKC", t).split()), na_action="ignore")


def nfkc(c: Column) -> Column:
    """NFKC without any white space; null stays null.  Spark SQL has no normalisation."""
    return F.pandas_udf(_nfkc, "string")(c)
