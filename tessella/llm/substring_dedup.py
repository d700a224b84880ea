"""Removal of word passages that repeat across documents, by recompression.

1. Rounds of recompression name runs and pairs of words, then pairs of the new
   symbols.  Names depend on content only, so equal passages get equal interior
   symbols in every document, and a document turns into fewer, longer symbols.
   Each symbol knows the range of words that determines it; where a window holds
   that range, every other occurrence of the window has the symbol too.
2. A symbol in one document only proves that no window around it repeats.  A
   fixed share of the symbols, chosen by name, is counted over all documents.
3. The windows that no such symbol rules out are verified: two hashes of their
   words, 96 bits from two independent names of each word, are grouped, and the
   smallest document of each group keeps the words.
4. Words of windows that also start in a smaller document are removed.

Documents with equal word sequences are one class; only its smallest document is
searched, as every other member loses all its words if it has a window at all.
Rows are told apart by doc_id and, where a doc_id stands in rows with different
texts, by a hash of the text besides, the variant; so repeated rows stay apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as W
from ._recompress import recompress
from ._spark import BROADCAST_IDS, BROADCAST_PAIRS, Table, columns_or_null, small_batches

WINDOW = 50
ROUNDS = 5
#: One of so many symbol names is counted.
SHARE = 2
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_WINDOW_COLUMNS = ["doc_id", "variant", "at", "h1", "h2", "text"]
#: What tells rows apart.
_ROW = ["doc_id", "variant"]


def _joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    raw = buf.tobytes()
    return b" ".join(raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, n_words, d1, d2, sha): the digest of each text's words, and their SHA-256 as kept whole."""
    for batch in batches:
        n, sha = [], []
        for i, j, buf, offsets in W.slices(batch.column("text")):
            starts, ends, firsts = W.spans(buf, offsets)
            for k in range(j - i):
                a, b = firsts[k], firsts[k + 1]
                n.append(b - a)
                sha.append(hashlib.sha256(_joined(buf, starts[a:b], ends[a:b])).digest())
        d = np.frombuffer(b"".join(sha), dtype=np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array([x.hex() for x in sha], pa.string())], names=["doc_id", "h", "n_words", "d1", "d2", "sha"])


def _parsed(batch: pa.RecordBatch, window: int, rounds: int, share: int):
    for i, j, buf, offsets in W.slices(batch.column("text")):
        starts, ends, firsts = W.spans(buf, offsets)
        words = W.word_hashes(buf, starts, ends)
        s = recompress(words, firsts, rounds)
        use = np.flatnonzero((s.cy - s.cx <= window) & ((s.name >> np.uint64(1)) % np.uint64(share) == 0))
        yield i, j, buf, starts, ends, firsts, words, s.name[use].astype(np.int64), s.cx[use], s.cy[use], s.text[use]


def _symbols(window: int, rounds: int, share: int):
    """(name, doc_id, variant): the distinct counted symbols of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, variants = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "variant"))
            for i, _, _, _, _, _, _, name, _, _, text in _parsed(batch, window, rounds, share):
                rows = pd.DataFrame({"name": name, "doc_id": ids[i + text], "variant": variants[i + text]}).drop_duplicates()
                yield pa.RecordBatch.from_pandas(rows, preserve_index=False)

    return run


def _windows(window: int, rounds: int, share: int):
    """Rows for windows that no symbol rules out (doc_id, variant, at, h1, h2), and one with the text for each document that has some.

    flags: per text, the names of its symbols that also occur in smaller (low) and in larger documents (high).
    """

    def lookup(names: np.ndarray, known: np.ndarray) -> np.ndarray:
        at = np.searchsorted(known, names)
        at[at == len(known)] = 0
        return known[at] == names if len(known) else np.zeros(len(names), dtype=bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, variants = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "variant"))
            texts, sides = batch.column("text"), [batch.column(c) for c in ("low", "high")]
            for i, j, buf, starts, ends, firsts, words, name, cx, cy, text in _parsed(batch, window, rounds, share):
                n = len(words)
                shut = []
                for side in sides:
                    ok = np.zeros(len(name), dtype=bool)
                    edge = np.searchsorted(text, np.arange(j - i + 1))
                    for k in range(j - i):
                        known = side[i + k].as_py()
                        if known:
                            ok[edge[k] : edge[k + 1]] = lookup(name[edge[k] : edge[k + 1]], np.sort(np.array(known, dtype=np.int64)))
                    first = firsts[:-1][text]
                    step = np.bincount(np.maximum(cy - window, first)[~ok], minlength=n + 2) - np.bincount((cx + 1)[~ok], minlength=n + 2)
                    shut.append(np.cumsum(step)[:n] > 0)
                open_ = ~(shut[0] & shut[1])
                for k in range(j - i):
                    open_[max(firsts[k], firsts[k + 1] - window + 1) : firsts[k + 1]] = False
                at = np.flatnonzero(open_)
                if not len(at):
                    continue
                owner = np.searchsorted(firsts, at, side="right") - 1
                h = [W.window_hashes(w, window, b)[at] for w, b in zip((words, W.word_hashes(buf, starts, ends, second=True)), _BASES, strict=True)]
                place = pa.array((at - firsts[owner]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(ids[i + owner]), pa.array(variants[i + owner]), place, pa.array(h[0].astype(np.int64)), pa.array((h[1] >> np.uint64(32)).astype(np.int32)), pa.nulls(len(at), pa.string())], names=_WINDOW_COLUMNS)
                losing = np.unique(owner[~shut[0][at]])
                if len(losing):
                    z = pa.array(np.full(len(losing), -1, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i + losing]), pa.array(variants[i + losing]), z, z.cast(pa.int64()), z, texts.take(pa.array(i + losing))], names=_WINDOW_COLUMNS)

    return run


def _kept(window: int):
    """(doc_id, variant, n_removed, kept): what is left of each text without the words of windows that start at `cut`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, removed, kept = batch.column("cut"), [], []
            for i, j, buf, offsets in W.slices(batch.column("text")):
                starts, ends, firsts = W.spans(buf, offsets)
                for k in range(j - i):
                    a, b = firsts[k], firsts[k + 1]
                    at = np.array(cuts[i + k].as_py(), dtype=np.int64)
                    step = np.bincount(at, minlength=b - a + 1) - np.bincount(at + window, minlength=b - a + 1)
                    gone = np.cumsum(step)[: b - a] > 0
                    removed.append(int(gone.sum()))
                    kept.append(_joined(buf, starts[a:b][~gone], ends[a:b][~gone]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("variant"), pa.array(removed, pa.int64()), W.strings(kept)], names=[*_ROW, "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, share: int = SHARE) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words left, joined by one space; null where it lost none or all), kept_sha256.

    A word is a run of bytes other than 0x20 and 0x09-0x0D.  Words covered by a window
    of `window` words whose sequence also starts in a document with a smaller doc_id
    are removed, judged on the input.  Repeats inside one document count for nothing.
    Null and empty texts have no words.  Rows that repeat a doc_id, with equal texts or
    others, each come back and are judged each on its own text; as their doc_id is
    not smaller they take no words from one another.  Rows without a doc_id come back
    whole and take no words either.  Other columns are ignored.  An empty table gives
    no rows.
    """
    small_batches(docs.sparkSession)
    docs = columns_or_null(docs, doc_id="long", text="string").withColumn("h", F.xxhash64("text"))
    all_docs = Table(docs.mapInArrow(_digests, "doc_id long, h long, n_words long, d1 long, d2 long, sha string"), "digests")
    several = all_docs.df.where("doc_id is not null").groupBy("doc_id").agg(F.min("h").alias("x"), F.max("h").alias("y")).where("x < y").select(F.col("doc_id").alias("several"))
    several = Table(several, "several")

    def told_apart(rows: DataFrame) -> DataFrame:
        if not several.rows:
            return rows.withColumn("variant", F.lit(0).cast("long")).drop("h")
        joined = rows.join(several.hinted(), F.col("doc_id") == F.col("several"), "left")
        return joined.withColumn("variant", F.when(F.col("several").isNotNull(), F.col("h")).otherwise(F.lit(0).cast("long"))).drop("h", "several")

    heads = all_docs.df.where("n_words > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("head"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    heads = Table(heads, "heads")
    named = told_apart(all_docs.df).join(heads.df, ["d1", "d2"], "left").select(*_ROW, "n_words", "sha", "head")
    named = Table(named, "named")
    all_docs.drop()
    heads.drop()
    is_copy = F.coalesce((F.col("head") < F.col("doc_id")) & (F.col("n_words") >= window), F.lit(False))
    copies = Table(named.df.where(is_copy).select(*_ROW).distinct(), "copies")
    searched = told_apart(docs.where("doc_id is not null"))
    few = copies.rows <= (BROADCAST_PAIRS if several.rows else BROADCAST_IDS)
    gone = copies.df if several.rows else copies.df.select("doc_id")
    searched = searched.join(F.broadcast(gone) if few else gone, gone.columns, "left_anti")
    symbols = searched.mapInArrow(_symbols(window, rounds, share), "name long, doc_id long, variant long")
    symbols = Table(symbols, "symbols").settle()
    shared = symbols.df.groupBy("name").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    low, high = F.col("least") < F.col("doc_id"), F.col("most") > F.col("doc_id")
    flags = symbols.df.join(shared, "name").groupBy(*_ROW).agg(F.collect_set(F.when(low, F.col("name"))).alias("low"), F.collect_set(F.when(high, F.col("name"))).alias("high"))
    flags = Table(flags, "flags").settle()
    symbols.drop()
    windows = searched.join(flags.df, _ROW, "left").select(*_ROW, "text", "low", "high").mapInArrow(_windows(window, rounds, share), "doc_id long, variant long, at int, h1 long, h2 int, text string")
    windows = Table(windows, "windows").settle()
    flags.drop()
    places = windows.df.where("at >= 0").select(*_ROW, "at", "h1", "h2")
    least = places.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    least = Table(least, "least").settle()
    cuts = places.join(least.df, ["h1", "h2"]).where("doc_id > least").groupBy(*_ROW).agg(F.collect_set("at").alias("cut"))
    cut = windows.df.where("at < 0").select(*_ROW, "text").join(cuts, _ROW).select(*_ROW, "text", "cut").mapInArrow(_kept(window), "doc_id long, variant long, n_removed long, kept string")
    cut = Table(cut.dropDuplicates(_ROW), "cut").settle()
    windows.drop()
    least.drop()
    out = named.df.join(cut.df, _ROW, "left")
    removed = F.when(is_copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    kept = F.when(is_copy, F.lit("")).otherwise(F.col("kept"))
    return out.select("doc_id", "n_words", removed.alias("n_removed"), kept.alias("kept"), F.coalesce(F.sha2(kept.cast("binary"), 256), F.col("sha")).alias("kept_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS pos, w FROM w WHERE len(w) >= 50),
h AS (SELECT doc_id, pos, md5(array_to_string(w[pos:pos+49], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS least FROM h GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, list(pos) AS cut FROM h JOIN m USING (h) WHERE doc_id > least GROUP BY 1),
g AS (SELECT doc_id, list_distinct(flatten(list_transform(cut, lambda a: range(a, a + 50)))) AS gone FROM c),
k AS (SELECT w.doc_id, len(w) AS n, coalesce(len(gone), 0) AS r, CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept FROM w LEFT JOIN g ON w.doc_id = g.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""
