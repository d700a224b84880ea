"""Transliteration of chat Arabic (Latin letters and digits) to Arabic script, and the token rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The transliteration table.
PAIRS = {"3'": "غ", "7'": "خ", "2'": "خ", "9'": "ض"}
SINGLES = {
    "2": "أ", "3": "ع", "4": "ش", "5": "خ", "6": "ط", "7": "ح", "8": "ق", "9": "ص",
    "a": "ا", "b": "ب", "t": "ت", "g": "ج", "j": "ج", "h": "ه", "d": "د", "r": "ر", "z": "ز", "s": "س", "f": "ف", "q": "ق",
    "k": "ك", "l": "ل", "m": "م", "n": "ن", "w": "و", "y": "ي", "e": "ا", "i": "ي", "o": "و", "u": "و",
}

_FROM = "".join(SINGLES) + "".join(k.upper() for k in SINGLES if k.isalpha())
_TO = "".join(SINGLES.values()) + "".join(v for k, v in SINGLES.items() if k.isalpha())

#: White space and ASCII punctuation, which part tokens.
BREAKS = r"[ \t\n\x0B\f\r!-/:-@\[-`{-~]+"


def normalize(text: Column) -> Column:
    """Pairs of a digit and an apostrophe first, then single digits and letters; anything else, such as c p v x 0 1, stays.

    All targets are single characters that no later step replaces, so four
    replacements and one translation equal a scan from left to right.
    """
    for pair, target in PAIRS.items():
        text = F.replace(text, F.lit(pair), F.lit(target))
    return F.translate(text, _FROM, _TO)


def normalize_text(text: str) -> str:
    """The same for a Python string, as for lexicon entries on the driver."""
    for pair, target in PAIRS.items():
        text = text.replace(pair, target)
    return text.translate(str.maketrans(_FROM, _TO))


def normalize_sql(text: str) -> str:
    """The same as DuckDB SQL."""
    for pair, target in PAIRS.items():
        text = "replace({}, '{}', '{}')".format(text, pair.replace("'", "''"), target)
    return f"translate({text}, '{_FROM}', '{_TO}')"


def tokens(text: Column) -> Column:
    """Non-empty runs between white space and ASCII punctuation."""
    return F.filter(F.split(text, BREAKS), lambda t: t != "")
