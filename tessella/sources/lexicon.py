"""Lexicons: JSON of category -> patterns, as a table (category, ordinal, pattern)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.script import normalize_text

SCHEMA = "category string, ordinal int, pattern string"

#: An invented lexicon for tests and examples; the words are in the script that texts are normalised to.
NEUTRAL = {
    "DIALECT_A": [normalize_text(w) for w in ("worthless", "scum", "erche", "ation")],
    "DIALECT_B": [normalize_text(w) for w in ("pathetic", "moron", "ation", "tionthe", "the and attion")],
    "LATIN": ["worthless", "idiot"],
}


def parse_tolerant(text: str) -> list[tuple[str, int, str]] | None:
    """Entries up to the first malformation; None if the text is empty or no object.

    Escapes are \\" \\\\ \\/ \\b \\f \\n \\r \\t; after a backslash any other character stands
    for itself.  Empty patterns are left out; an empty key ends the lexicon.
    """
    at, out = 0, []
    escapes = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}

    class End(Exception):
        pass

    def skip() -> str:
        nonlocal at
        while at < len(text) and text[at] in " \t\n\r\v\f":
            at += 1
        return text[at] if at < len(text) else ""

    def expect(c: str) -> None:
        nonlocal at
        if skip() != c:
            raise End
        at += 1

    def string() -> str:
        nonlocal at
        expect('"')
        got = []
        while at < len(text) and text[at] != '"':
            if text[at] == "\\":
                at += 1
                if at >= len(text):
                    raise End
                got.append(escapes.get(text[at], text[at]))
            else:
                got.append(text[at])
            at += 1
        expect('"')
        return "".join(got)

    if skip() != "{":
        return None
    at += 1
    try:
        while skip() != "}":
            key = string()
            if not key:
                raise End
            expect(":")
            expect("[")
            n = 0
            while skip() != "]":
                pattern = string()
                if pattern:
                    out.append((key, n, pattern))
                    n += 1
                if skip() == ",":
                    at += 1
                elif skip() != "]":
                    raise End
            at += 1
            if skip() == ",":
                at += 1
            elif skip() != "}":
                raise End
    except End:
        pass
    return out


def from_dict(spark: SparkSession, lexicon: dict[str, list[str]]) -> DataFrame:
    rows = [(c, n, p) for c, ps in lexicon.items() for n, p in enumerate(p for p in ps if p)]
    return spark.createDataFrame(rows, SCHEMA)


def read_lexicon(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """A lexicon file as (category, ordinal, pattern).

    Well-formed JSON is parsed by Spark; tolerant keeps the entries before the first
    malformation instead.  Empty patterns are left out, repeated ones kept.
    """
    text = spark.read.text(path, wholetext=True)
    if tolerant:
        rows = [r for t in text.collect() for r in parse_tolerant(t[0]) or []]
        return spark.createDataFrame(rows, SCHEMA)
    return explode_json(text)


def explode_json(texts: DataFrame, column: str = "value") -> DataFrame:
    parsed = texts.select(F.from_json(column, "map<string,array<string>>").alias("m"))
    lists = parsed.select(F.explode("m").alias("category", "patterns"))
    kept = lists.select("category", F.filter("patterns", lambda p: p != "").alias("patterns"))
    return kept.select("category", F.posexplode("patterns").alias("ordinal", "pattern"))


def load_status(spark: SparkSession, path: str | None) -> bool:
    """False for a path that is empty or can't be opened; true for any file, even if it is malformed."""
    if not path:
        return False
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and not fs.getFileStatus(p).isDirectory()


def add_keywords(lexicon: DataFrame, words: list[str], category: str = "ADDED") -> DataFrame:
    """The lexicon and more patterns; empty ones are left out."""
    rows = [(category, n, w) for n, w in enumerate(w for w in words if w)]
    return lexicon.unionByName(lexicon.sparkSession.createDataFrame(rows, SCHEMA))
