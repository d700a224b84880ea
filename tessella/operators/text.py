"""Text moderation: multi-pattern matching on transliterated text, and vocabulary scores.

Texts are transliterated in the JVM and then pass once through an automaton and a
vocabulary over Arrow batches, row by row: nothing is shuffled, joined or read
twice, and the optimiser cannot write the transliteration out again for each use.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.script import BREAKS, normalize

#: Rows up to which a lexicon or vocabulary is taken to the driver and broadcast.
MOST_ENTRIES = 2_000_000
SEMANTIC_GATE = 0.5
_BREAKS = re.compile(BREAKS)


def pattern_list(lexicon: DataFrame, mode: str = "raw") -> list[str]:
    """All patterns in order, repeated ones too.

    mode: "raw" takes them as they stand, so Latin ones never match a transliterated
    text; "normalized" transliterates them as well.
    """
    column = F.col("pattern") if mode == "raw" else normalize(F.col("pattern"))
    rows = lexicon.where("pattern <> ''").select("category", "ordinal", column.alias("pattern")).limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"a lexicon of more than {MOST_ENTRIES} patterns is not broadcast")
    return [r["pattern"] for r in sorted(rows, key=lambda r: (r["category"], r["ordinal"], r["pattern"]))]


def weight_map(scores: DataFrame) -> dict[str, float]:
    """Weights of the words of a vocabulary (word, weight)."""
    rows = scores.select("word", F.col("weight").cast("double").alias("weight")).limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"a vocabulary of more than {MOST_ENTRIES} words is not broadcast")
    return {r["word"]: r["weight"] for r in rows}


def contains_any(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in dict.fromkeys(patterns):
        out = out | text.contains(p)
    return out


def _automaton(patterns: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for p in dict.fromkeys(patterns):
        a.add_word(p, p)
    a.make_automaton()
    return a


def all_matches(docs: DataFrame, patterns: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pattern, start_pos, end_pos) of every occurrence in the transliterated text, overlapping ones and repeated patterns too.

    Positions count bytes of the transliterated text; ends are exclusive.
    """
    times = {p: patterns.count(p) for p in dict.fromkeys(patterns)}
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(patterns) if patterns else None
        for batch in batches:
            rows: list[tuple] = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not t or automaton is None:
                    continue
                seen, at = 0, 0
                for end, p in automaton.iter(t):
                    seen, at = seen + len(t[at : end + 1].encode()), end + 1
                    rows += [(k, p, seen - len(p.encode()), seen)] * times[p]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*rows, strict=True), [batch.schema.types[0], pa.string(), pa.int64(), pa.int64()], strict=True)], names=[key, "pattern", "start_pos", "end_pos"])

    return docs.select(key, normalize(F.col(text)).alias("n")).mapInArrow(run, f"`{key}` {kind}, pattern string, start_pos long, end_pos long")


def _first_end(automaton, text: str) -> str | None:
    """The pattern with the earliest end, of several the longest; None without a match."""
    stop, best = None, None
    for end, p in automaton.iter(text):
        if stop is not None and end > stop:
            break
        if stop is None or len(p) > len(best):
            stop, best = end, p
    return best


def first_match(text: Column, patterns: list[str]) -> Column:
    """The pattern with the earliest end, of several the longest; null without a match."""
    shared = list(dict.fromkeys(patterns))
    if not shared:
        return F.lit(None).cast("string")

    @F.arrow_udf("string")
    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = _automaton(shared)
        for texts in batches:
            yield pa.array([_first_end(automaton, t) if t else None for t in texts.to_pylist()], pa.string())

    # A filter on the result would else be pushed below it, and texts matched twice.
    return match.asNondeterministic()(text)


def with_first_match(docs: DataFrame, patterns: list[str], text: str = "text", name: str = "matched_pattern") -> DataFrame:
    """Adds the first match in the transliterated text."""
    return docs.withColumn(name, first_match(normalize(F.col(text)), patterns))


def _judged(text: Column, patterns: list[str], weights: dict[str, float] | None, spark) -> Column:
    """(pattern, tokens, mean) of a transliterated text: its first match; without one, the number of its tokens and the mean weight of those in the vocabulary."""
    shared, known = list(dict.fromkeys(patterns)), spark.sparkContext.broadcast(weights)

    @F.arrow_udf("pattern string, tokens int, mean double")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton, get = _automaton(shared) if shared else None, (known.value or {}).get
        for texts in batches:
            found, sizes, means = [], [], []
            for t in texts.to_pylist():
                p = _first_end(automaton, t) if t and automaton is not None else None
                words = [w for w in _BREAKS.split(t) if w] if t and p is None and known.value is not None else []
                hits = [w for w in map(get, words) if w is not None]
                found.append(p)
                sizes.append(len(words))
                means.append(float(np.mean(hits)) if hits else None)
            yield pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(sizes, pa.int32()), pa.array(means, pa.float64())], ["pattern", "tokens", "mean"])

    return judge.asNondeterministic()(text)


def _scored(valid: Column, judged: str) -> Column:
    score = F.when(~valid | (F.col(f"{judged}.tokens") == 0), 0.0).when(F.col(f"{judged}.mean").isNull(), 0.001)
    return score.otherwise(1 / (1 + F.exp(-F.col(f"{judged}.mean"))))


def semantic_scores(docs: DataFrame, scores: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, is_valid, score): no score for empty texts, 0 without tokens, 0.001 without a known word, else the sigmoid of the mean weight of known tokens.

    Each row is scored by itself, so keys may repeat or be null.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    judged = docs.select(F.col(key).alias("k"), (F.length(t) > 0).alias("is_valid"), _judged(normalize(t), [], weight_map(scores), docs.sparkSession).alias("j"))
    return judged.select(F.col("k").alias(key), "is_valid", _scored(F.col("is_valid"), "j").alias("score"))


def semantic_gate(scored: DataFrame, threshold: float) -> DataFrame:
    """Adds flagged (score from 0.5 on) and category (from the model's own threshold on); both thresholds are independent."""
    flagged = F.col("is_valid") & (F.col("score") >= SEMANTIC_GATE)
    category = F.when(F.col("is_valid") & (F.col("score") >= threshold), "PROFANITY_SEMANTIC").otherwise("NONE")
    return scored.withColumns({"flagged": flagged, "category": category})


def moderate_text(docs: DataFrame, patterns: list[str], scores: DataFrame | None = None, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, is_safe, risk_score, violation_type, matched_pattern).

    An exact match is PROFANITY_EXACT with risk 1.  Other texts are scored if there is
    a vocabulary; those flagged have the score as risk and the category as type, which
    is NONE where the score is below the model's threshold.  Each row is judged by
    itself, so keys may repeat or be null; null and empty texts are safe.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    weights = None if scores is None else weight_map(scores)
    judged = docs.select(F.col(key).alias("k"), (F.length(t) > 0).alias("is_valid"), _judged(normalize(t), patterns, weights, docs.sparkSession).alias("j"))
    score = F.lit(0.0) if weights is None else _scored(F.col("is_valid"), "j")
    gated = semantic_gate(judged.select("k", "is_valid", "j.pattern", score.alias("score")), threshold)
    hit, flagged = F.col("pattern").isNotNull(), F.col("flagged")
    risk = F.when(hit, 1.0).when(flagged, F.col("score")).otherwise(0.0)
    kind = F.when(hit, "PROFANITY_EXACT").when(flagged, F.col("category")).otherwise("NONE")
    return gated.select(F.col("k").alias(key), (~hit & ~flagged).alias("is_safe"), risk.alias("risk_score"), kind.alias("violation_type"), F.col("pattern").alias("matched_pattern"))


def moderate_extracted(images: DataFrame, patterns: list[str], key: str, text: str = "extracted_text") -> DataFrame:
    """(key, has_violation, matched_pattern) for text taken from images; empty text has none."""
    out = with_first_match(images, patterns, text)
    return out.select(key, F.col("matched_pattern").isNotNull().alias("has_violation"), "matched_pattern")
