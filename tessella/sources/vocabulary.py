"""Binary vocabulary models: a 20-byte header, then words with int8 weights."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.script import normalize_text

# The file format.
MAGIC = b"KHM1"
HEADER = struct.Struct("<4sIIIf")
MOST_WORD_BYTES = 1024

#: An invented vocabulary for tests and examples.
NEUTRAL = {
    normalize_text(w): v
    for w, v in {"the": [-10, -5, 0, 2], "and": [-7, 3, 1, -1], "er": [20, 11, -2, 5], "scum": [90, 80, 70, 60], "que": [-9, -9, 4, 4], "de": [3, -3, 1, -1], "ation": [127, 0, -128, 1], "tion": [5, 5, 5, 5]}.items()
}
NEUTRAL_THRESHOLD = 0.6


def write_model(words: list[tuple[str, list[int]]], threshold: float, version: int = 1) -> bytes:
    dim = len(words[0][1]) if words else 0
    body = b"".join(struct.pack("<H", len(w := word.encode())) + w + struct.pack(f"<{dim}b", *weights) for word, weights in words)
    return HEADER.pack(MAGIC, version, len(words), dim, threshold) + body


def parse_model(data: bytes) -> tuple[dict, list[tuple[str, list[int]]]] | None:
    """Header and words in order; None for a wrong magic, a word length outside 1 to 1024, or missing bytes. Bytes that follow are ignored."""
    if len(data) < HEADER.size:
        return None
    magic, version, size, dim, threshold = HEADER.unpack_from(data)
    if magic != MAGIC:
        return None
    at, words = HEADER.size, []
    for _ in range(size):
        if at + 2 > len(data):
            return None
        (n,) = struct.unpack_from("<H", data, at)
        at += 2
        if not 1 <= n <= MOST_WORD_BYTES or at + n + dim > len(data):
            return None
        words.append((data[at : at + n].decode("utf-8", "replace"), list(struct.unpack_from(f"<{dim}b", data, at + n))))
        at += n + dim
    return {"version": version, "vocab_size": size, "embedding_dim": dim, "threshold": threshold}, words


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """(path, word, weights, threshold): of a word that stands twice the first counts; a bad file gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for name, content in zip(rows["path"], rows["content"], strict=True):
                if parsed := parse_model(content):
                    head, words = parsed
                    first = dict(reversed(words))
                    yield pd.DataFrame({"path": name, "word": list(first), "weights": list(first.values()), "threshold": head["threshold"]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, word string, weights array<tinyint>, threshold double")


def word_scores(model: DataFrame) -> DataFrame:
    """(word, weight): each word's summed weights over 127."""
    total = F.aggregate("weights", F.lit(0).cast("long"), lambda a, w: a + w)
    return model.select("word", (total / F.lit(127.0)).alias("weight"))


def neutral_scores(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w, sum(v) / 127.0) for w, v in NEUTRAL.items()], "word string, weight double")
