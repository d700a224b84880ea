"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents may be long, so Jaccard says little; what
counts is the share of an item's word shingles that a document holds.

1. Items are partitioned by size (powers of two of their shingle count).  In a
   partition an item's sketch holds its smallest hash values under one hash
   function, just so many that a document with enough of the item's shingles
   must hold one of them; above `MOST` of them, all but surely.
2. A document's sketch for a partition is all its shingles' hashes up to the
   partition's threshold, its largest item sketch value.  It thus suits texts of
   any length, where a sketch of fixed size would miss a short item.
3. Items met in the sketches are verified by exact shingle containment.

An item with fewer words than a shingle is one shingle of its own width, and
documents are searched for runs of that width too.

Items are the query set; they meet the documents in blocks of bounded size, each
of which is broadcast and scans the documents once without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as W
from ._spark import Table, columns_or_null, small_batches

WIDTH = 5
PERCENT = 75
#: Largest sketch of an item; a quarter of the shingles missing, none of 20 is there with a chance of 1e-12.  None: as large as certainty takes.
MOST: int | None = 20
#: Shingles of items in one broadcast block: 16 MB.
BLOCK_SHINGLES = 1_000_000
_BITS = 20


class _Block:
    """Items of one block: their shingles in order of hash, and the sketches of each size partition."""

    def __init__(self, items: list[tuple[int | None, int, np.ndarray]], width: int, percent: int, most: int | None) -> None:
        self.ids = [i for i, _, _ in items]
        self.sets = [s for _, _, s in items]
        parts: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for k, (_, own, s) in enumerate(items):
            need = len(s) - -(-len(s) * percent // 100) + 1
            parts.setdefault((own, len(s).bit_length()), []).extend((int(v), k) for v in s[: need if most is None else min(need, most)])
        #: Of each shingle width, the sketches of the size partitions.
        self.parts: dict[int, list] = {width: []}
        for (own, _), pairs in sorted(parts.items()):
            pairs.sort()
            keys, owners = np.array([v for v, _ in pairs], dtype=np.uint64), np.array([k for _, k in pairs], dtype=np.int64)
            seen = np.zeros(1 << _BITS, dtype=bool)
            seen[keys & np.uint64((1 << _BITS) - 1)] = True
            self.parts.setdefault(own, []).append((keys[-1], seen, keys, owners))

    def candidates(self, shingles: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(position of a shingle, item) wherever a document's sketch meets an item's."""
        where, which = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for top, seen, keys, owners in self.parts[width]:
            at = np.flatnonzero(seen[shingles & np.uint64((1 << _BITS) - 1)])
            at = at[shingles[at] <= top]
            lo, hi = np.searchsorted(keys, shingles[at], side="left"), np.searchsorted(keys, shingles[at], side="right")
            n = hi - lo
            where.append(np.repeat(at, n))
            which.append(owners[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())])
        return np.concatenate(where), np.concatenate(which)


def _blocks(items: DataFrame, width: int, percent: int, limit: int, most: int | None) -> Iterator[_Block]:
    """Blocks of at most about `limit` shingles; never more than one block is on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, widths = [], []
            for i, j, buf, offsets in W.slices(batch.column("text")):
                starts, ends, firsts = W.spans(buf, offsets)
                words = W.word_hashes(buf, starts, ends, lower=True)
                s, at = W.shingle_hashes(words, firsts, width)
                for k in range(j - i):
                    n = int(firsts[k + 1] - firsts[k])
                    widths.append(min(n, width))
                    sets.append(np.unique(s[at[k] : at[k + 1]]) if n >= width or n == 0 else W.shingle_hashes(words[firsts[k] : firsts[k + 1]], np.array([0, n]), n)[0])
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(widths, pa.int32()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["item_id", "width", "n", "s"])

    found = Table(columns_or_null(items, item_id="long", text="string").mapInArrow(run, "item_id long, width int, n long, s binary").where("n > 0"), "items").df
    total = found.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // limit))
    for k in range(parts if total else 0):
        rows = found.where(F.pmod(F.xxhash64("item_id", "s"), F.lit(parts)) == k).select("item_id", "width", "s").collect()
        if rows:
            yield _Block([(r["item_id"], r["width"], np.frombuffer(r["s"], dtype=np.uint64)) for r in rows], width, percent, most)


def _search(batch: pa.RecordBatch, text: str, block: _Block, width: int, percent: int):
    """(row, item, common, first word, end word) of all items that rows of a batch contain."""
    for i, j, buf, offsets in W.slices(batch.column(text)):
        starts, ends, firsts = W.spans(buf, offsets)
        words = W.word_hashes(buf, starts, ends, lower=True)
        for wide in block.parts:
            shingles, at = W.shingle_hashes(words, firsts, wide)
            where, which = block.candidates(shingles, wide)
            row = np.searchsorted(at, where, side="right") - 1
            pairs = np.unique(np.stack([row, which], axis=1), axis=0)
            for k in np.unique(pairs[:, 0]):
                own = shingles[at[k] : at[k + 1]]
                for item in pairs[pairs[:, 0] == k, 1]:
                    wanted = block.sets[item]
                    inside = np.flatnonzero(np.isin(own, wanted))
                    common = len(np.unique(own[inside]))
                    if common * 100 >= len(wanted) * percent:
                        yield i + int(k), int(item), common, int(inside[0]), int(min(inside[-1] + wide, firsts[k + 1] - firsts[k]))


def contained_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES, most: int | None = MOST) -> DataFrame:
    """One row per document and test item it holds: doc_id, item_id, n_shingles, n_common, containment, first_word, end_word.

    Both sides' words are runs of bytes other than 0x20 and 0x09-0x0D with A-Z
    lower-cased.  An item is contained if the document has at least `percent` of its
    distinct `width`-word shingles, anywhere; the words between the first and the last
    of them are [first_word, end_word).  An item with fewer words is one shingle of
    its own width, contained wherever a document holds these words in a row.  Null and
    empty texts contain nothing and are contained nowhere.  Repeated documents and
    repeated items each come back, as do rows without an id; other columns are ignored;
    empty tables give no rows.
    """
    small_batches(docs.sparkSession)
    docs = columns_or_null(docs, doc_id="long", text="string")
    schema = "doc_id long, item_id long, n_shingles long, n_common long, containment double, first_word long, end_word long"
    names = [c.split()[0] for c in schema.split(", ")]
    out = None
    for block in _blocks(items, width, percent, block_shingles, most):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                hits = list(_search(batch, "text", block, width, percent))
                if hits:
                    row, item, common, first, end = map(np.array, zip(*hits, strict=True))
                    n = np.array([len(block.sets[k]) for k in item])
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array([block.ids[k] for k in item], pa.int64()), *map(pa.array, (n, common, common / n, first, end))], names=names)

        found = docs.mapInArrow(run, schema)
        out = found if out is None else out.unionAll(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES, most: int | None = MOST) -> DataFrame:
    """The documents, with all their columns, that contain no test item in the sense of contained_items().

    Rows with null or empty texts stay; repeated rows stay or go together; empty tables
    drop nothing.
    """
    small_batches(docs.sparkSession)
    for block in _blocks(items, width, percent, block_shingles, most):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for hit in _search(batch, "text", shared.value, width, percent):
                    clean[hit[0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("first_word", "end_word")


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_RUNS = "list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' ')))"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, least(len(w), 5) AS width, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE {_RUNS.format(n=5)} END AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
e AS (SELECT DISTINCT doc_id, width, unnest({_RUNS.format(n="width")}) AS g FROM d, (SELECT DISTINCT width FROM b) WHERE len(w) >= width),
i AS (SELECT item_id, width, len(s) AS n, unnest(s) AS g FROM b)
SELECT doc_id, item_id, CAST(any_value(n) AS BIGINT) AS n_shingles, count(*) AS n_common, count(*) / any_value(n) AS containment
FROM e JOIN i USING (width, g) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 75 * any_value(n)
"""
