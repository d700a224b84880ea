"""Packing of documents into training sequences along a space-filling curve.

1. Documents are tokenized.  The distinct tokens of a document are its hashed
   vector; a fixed random projection takes it to a few dimensions, and the
   position of that point on a Hilbert curve is the document's key.  The low bits
   of a key are a hash of the doc_id, so any number of equal texts can be split.
2. A size-weighted sample of keys gives range boundaries; ranges are sorted by
   key, and exact token counts of the ranges give each document its place in
   one stream of all tokens.
3. The stream is cut every `length` tokens, so sequences hold documents that are
   neighbours on the curve, and only the last one can need padding.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import Table, columns_or_null, long_array, range_of, small_batches, splitters
from ._words import mix64

LENGTH = 2048
END = 1
DIMENSIONS, BITS, TIE_BITS = 4, 10, 22
#: Tokens of a range; with more ranges than AIM, ranges grow instead: at 25 trillion tokens to 200 MB of ids, which a task sorts on disk.
RANGE_TOKENS, AIM = 500_000, 262_144
#: Rows of the sample that range boundaries come from, at about this number, and at least so many for each range.
SAMPLE, RANGE_SAMPLE = 50_000, 16


def vocabulary(name: str) -> str:
    """Default place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of a byte-level BPE: by the fast library, or by `tokenizers` where that gives up.

    Both give the same ids from the same vocabulary; tests compare them.
    """

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str, special: str) -> None:
        self.json_path, self.fast, self.slow, self.special = json_path, None, None, {special}
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={special: len(ranks)})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return np.array(self.fast.encode(text, allowed_special=self.special), dtype=np.uint32)
            except BaseException as e:  # noqa: BLE001  the library panics on some very long runs
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json_path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (n, dimensions) with `bits` bits a coordinate."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray], dims: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of documents given by their token ids."""
    points = np.zeros((len(ids), dims))
    for k, x in enumerate(ids):
        u = np.unique(x).astype(np.uint64)
        if len(u):
            for d in range(dims):
                signs = (mix64(u + np.uint64((d + 1) << 40)) & np.uint64(1)).astype(np.float64) * 2 - 1
                points[k, d] = signs.sum() / np.sqrt(len(u))
    grid = np.floor((1 << bits) / (1 + np.exp(-1.702 * points))).astype(np.int64)
    return hilbert(np.clip(grid, 0, (1 << bits) - 1), bits)


def _tokens(encoder_args: tuple, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(*encoder_args)
        for batch in batches:
            ids = [encode(t.decode("utf-8", "replace") if t else "") for t in batch.column("text").to_pylist()]
            doc = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            keys = (curve_keys(ids) << TIE_BITS) | (mix64(doc) >> np.uint64(64 - TIE_BITS)).astype(np.int64)
            ids = [np.append(x, np.uint32(end)).astype("<u4") for x in ids]
            small = [x.astype("<u2").tobytes() if x.max() < 65536 else b"\0" + x.tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys), pa.array([len(x) for x in ids], pa.int64()), pa.array(small, pa.binary())], names=["doc_id", "key", "n", "ids"])

    return run


def unpack(ids: bytes) -> np.ndarray:
    """Token ids as stored: two bytes each, or four after a zero byte, which an even length rules out otherwise."""
    return np.frombuffer(ids, dtype="<u4", offset=1) if len(ids) % 2 else np.frombuffer(ids, dtype="<u2").astype("<u4")


def _pieces(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, place, ids in zip(batch.column("doc_id").to_pylist(), batch.column("place").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                x, at = unpack(ids), 0
                while at < len(x):
                    n = min(len(x) - at, length - (place + at) % length)
                    part = x[at : at + n].tobytes()
                    rows.append((doc, at, n, zlib.crc32(part), len(x), (place + at) // length, (place + at) % length, part))
                    at += n
            if rows:
                types = [pa.int64()] * 7 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return run


def pack(docs: DataFrame, length: int = LENGTH, end: int = END, json_path: str | None = None, ranks_path: str | None = None, pattern: str | None = None, special: str = "<|endoftext|>", sample: int = SAMPLE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (4 bytes each).

    A document is its token ids and then `end`; pieces of a document cover it without
    gaps, and pieces of a sequence fill it from 0 without gaps.  All sequences but the
    last are full.  Null and empty texts are the end token alone; bytes that are no
    UTF-8 count as U+FFFD.  Repeated rows are packed each; other columns are ignored;
    an empty table gives no rows.
    """
    if json_path is None:
        json_path, ranks_path = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")
    if ranks_path and pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    spark = docs.sparkSession
    small_batches(spark, 500)
    docs = columns_or_null(docs, doc_id="long", text="string").withColumn("text", F.col("text").cast("binary"))
    tokens = Table(docs.mapInArrow(_tokens((json_path, ranks_path, pattern or "", special), end), "doc_id long, key long, n long, ids binary"), "tokens").df
    rows, total = tokens.agg(F.count("*"), F.sum("n")).first()
    parts = min(AIM, -(-(total or 0) // RANGE_TOKENS))
    sample = max(sample, RANGE_SAMPLE * parts)
    drawn = tokens.select("key", "n").sample(min(1.0, sample / max(rows, 1)), seed=7).toPandas() if parts > 1 else None
    bounds = splitters(drawn["key"].tolist(), drawn["n"].tolist(), parts) if parts > 1 else []
    ranged = tokens.withColumn("range", F.expr(range_of("key", bounds)))
    sums = {r["range"]: r["n"] for r in ranged.select("range", "n").groupBy("range").agg(F.sum("n").alias("n")).collect()}
    starts = np.concatenate([[0], np.cumsum([sums.get(k, 0) for k in range(len(bounds) + 1)])])
    order = Window.partitionBy("range").orderBy("key", "doc_id", "ids").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.expr(f"{long_array(starts.tolist())}[range]") + F.sum("n").over(order) - F.col("n")
    placed = ranged.select("doc_id", place.alias("place"), "ids")
    return placed.mapInArrow(_pieces(length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def op2_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
