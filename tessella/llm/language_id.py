"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point.  An
n-gram's vector binds (multiplies) its letters' vectors, each permuted by its
place; a text's vector bundles (adds) the vectors of its n-grams.  The normalised
text vectors of a language's training texts, bundled, are its prototype; what all
prototypes have in common is taken off, and a text gets the language whose
prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as W
from ._spark import Table, columns_or_null, small_batches

DIMENSIONS = 1024
GRAM = 3
#: Training texts of a language, at about this number.
PER_LANGUAGE = 1500
#: Steepness of the score.
SHARPNESS = 12.0
_TOP = 0x110000
_TABLE: list[np.ndarray] = []
_VECTORS: dict[tuple[int, int], np.ndarray] = {}


def _folded() -> np.ndarray:
    """Lower-case letter of each code point of all planes, 0 for what is no letter by its category."""
    if not _TABLE:
        t = np.zeros(_TOP, dtype=np.uint32)
        for k in range(_TOP):
            if not 0xD800 <= k < 0xE000 and (c := chr(k)).isalpha():
                t[k] = ord(c.lower()[0])
        _TABLE.append(t)
    return _TABLE[0]


def letter_vectors(points: np.ndarray, dims: int) -> np.ndarray:
    """A row of +1 and -1 for each code point; 0 stands for a gap between words."""
    for p in points.tolist():
        if (p, dims) not in _VECTORS:
            if len(_VECTORS) > 50_000:
                _VECTORS.clear()
            _VECTORS[p, dims] = np.random.Generator(np.random.PCG64(p + 1)).integers(0, 2, dims, dtype=np.int8) * 2 - 1
    return np.stack([_VECTORS[p, dims] for p in points.tolist()])


def _symbols(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts with single gaps (0) between words, and each symbol's text."""
    raw = buf.tobytes()
    try:
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        lead = np.zeros(len(buf) + 1, dtype=np.int64)
        np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(lead[offsets]))
    except UnicodeDecodeError:
        texts = [np.frombuffer(raw[a:b].decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        points, text = np.concatenate(texts), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    s = _folded()[points]
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0) | (text[1:] != text[:-1])
    return s[keep], text[keep]


def bundles(buf: np.ndarray, offsets: np.ndarray, dims: int = DIMENSIONS, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one of all texts, and whether each has a letter; a text with fewer symbols than an n-gram bundles its letters."""
    n = len(offsets) - 1
    out = np.zeros((n, dims), dtype=np.float32)
    symbols, text = _symbols(buf, offsets)
    lettered = np.bincount(text[symbols != 0], minlength=n) > 0
    if not len(symbols):
        return out, lettered
    points, ids = np.unique(symbols, return_inverse=True)
    letters = letter_vectors(points, dims)
    long = np.bincount(text, minlength=n) >= gram
    m = len(points)
    code, own = np.zeros(max(0, len(ids) - gram + 1), dtype=np.int64), text[: max(0, len(ids) - gram + 1)]
    for k in range(gram):
        code = code * m + ids[k : k + len(code)]
    inside = own == text[gram - 1 :] if len(code) else np.zeros(0, dtype=bool)
    code, own = code[inside], own[inside]
    if m**gram <= 1 << 22:
        seen = np.flatnonzero(np.bincount(code, minlength=1))
        place = np.zeros(m**gram, dtype=np.int32)
        place[seen] = np.arange(len(seen))
        which = place[code]
    else:
        seen, which = np.unique(code, return_inverse=True)
    for a in range(0, len(seen), 4096):
        part = seen[a : a + 4096]
        bound = np.ones((len(part), dims), dtype=np.int8)
        rest = part.copy()
        for k in range(gram):
            bound *= np.roll(letters, k, axis=1)[rest % m]
            rest //= m
        here = (which >= a) & (which < a + 4096)
        for b in range(0, n, 512):
            rows = here & (own >= b) & (own < b + 512)
            size = min(512, n - b)
            counts = np.bincount((own[rows] - b) * len(part) + which[rows] - a, minlength=size * len(part)).reshape(size, len(part))
            out[b : b + size] += counts.astype(np.float32) @ bound.astype(np.float32)
    for k in np.flatnonzero(~long & lettered):
        out[k] += letters[ids[text == k]].sum(axis=0)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1), lettered


def _training(rows: DataFrame, per_language: int, key: str) -> DataFrame:
    """About `per_language` rows of each language, chosen by a hash of their key and text, so that a stage run again gets the same."""
    counts = Table(rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(per_language) / F.count("*")).alias("rate")), "rates")
    chance = F.pmod(F.xxhash64(key, "text"), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(counts.hinted(), "lang").where(chance < F.col("rate")).select("lang", "text")


def prototypes(rows: DataFrame, dims: int = DIMENSIONS, gram: int = GRAM, per_language: int = PER_LANGUAGE, key: str | None = None) -> dict[str, np.ndarray]:
    """Prototype of each language of (text, lang), from a bounded sample of its texts.

    All languages are learned, at 8 KB each.  Rows without a language or a text are left
    out, as are texts without a letter.  key: a column that tells equal texts apart.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for i, _, buf, offsets in W.slices(batch.column("text")):
                vectors, lettered = bundles(buf, offsets, dims, gram)
                for k in np.flatnonzero(lettered):
                    lang = langs[i + k]
                    sums[lang] = sums.get(lang, 0) + vectors[k].astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["lang", "v"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(v, dtype=np.float64) for v in rows["v"]], axis=0)
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "v": [total.tobytes()]})

    drawn = Table(_training(rows.where("lang is not null and text is not null"), per_language, key or "lang"), "training")
    parts = drawn.df.mapInArrow(run, "lang string, v binary").groupBy("lang").applyInPandas(add, "lang string, v binary").collect()
    total = {r["lang"]: np.frombuffer(r["v"], dtype=np.float64) for r in parts}
    return {k: v / np.linalg.norm(v) for k, v in sorted(total.items()) if np.linalg.norm(v) > 0}


def predict(docs: DataFrame, known: dict[str, np.ndarray], dims: int = DIMENSIONS, gram: int = GRAM, sharpness: float = SHARPNESS) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (share of the best language among all, by cosine).

    Null, empty and letterless texts are `und` with score 0, as is every text if no
    language is known.  Ties go to the first language by name.  Repeated rows each come
    back; other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    names = np.array([*known, "und"], dtype=object)
    table = np.stack(list(known.values())) if known else np.zeros((0, dims))
    if len(table) > 1:
        table = table - table.mean(axis=0)
    table = (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score = np.full(batch.num_rows, len(table)), np.zeros(batch.num_rows)
            for i, j, buf, offsets in W.slices(batch.column("text")):
                vectors, lettered = bundles(buf, offsets, dims, gram)
                if len(table) and j > i:
                    cos = (vectors @ table.T).astype(np.float64)
                    odds = np.exp(sharpness * (cos - cos.max(axis=1, keepdims=True)))
                    best[i:j] = np.where(lettered, cos.argmax(axis=1), len(table))
                    score[i:j] = np.where(lettered, 1 / odds.sum(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return columns_or_null(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, lang_pred string, score double")


def fold(doc_id: str, folds: int):
    """Remainder of crc32 of the decimal doc_id; null for a null doc_id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def op7_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = columns_or_null(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="long", text="string", lang="string")
    small_batches(spark)
    known = prototypes(docs.where(fold("doc_id", 3) != 1), key="doc_id")
    out = predict(docs, known)
    return out.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
