"""Assignment of records to shards of nearly equal bytes, by sampled splitters.

Everything runs on DataFrame functions.  Records are ordered by a hash of their
text and then their doc_id, so equal texts lie together.

1. A size-weighted sample of keys gives quantile boundaries of many small ranges.
2. Exact sizes of the ranges are summed; a range over the limit is subdivided by
   boundaries sampled inside it, again and again.  Where a single text alone is
   over the limit, its records are subdivided by doc_id.
3. Neighbouring ranges make up the shards; a record's slot is the number of
   records in earlier ranges of its shard plus its row number in its own range.

A window never spans more than one range, so no task gets a whole shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import Table, columns_or_null, long_array, range_of, splitters

SHARDS = 40
#: Ranges are to hold at most this share of a shard's bytes.
FINENESS = 1 / 64
#: Keys drawn for a round of boundaries, at about this number.
SAMPLE = 40_000
#: Ranges aimed at, at most, unless the shards themselves are more than a quarter of it.
AIM = 16_384
ROW_BYTES = 16


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, h): size in UTF-8 bytes and ROW_BYTES more; equal texts have equal h."""
    docs = columns_or_null(docs, doc_id="long", text="string")
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"))


def _drawn(keys: DataFrame, key: str, rows: int, sample: int) -> tuple[list[int], list[int]]:
    """A sample of about `sample` keys with their sizes as weights; its bound doesn't depend on the data."""
    got = keys.select(F.col(key).alias("k"), "size").sample(min(1.0, sample / max(rows, 1)), seed=11).collect()
    return [r["k"] for r in got], [r["size"] for r in got]


def ranges(keys: DataFrame, shards: int = SHARDS, fineness: float = FINENESS, sample: int = SAMPLE, aim: int = AIM) -> tuple[str, str, list[tuple[int, int, int, int]]]:
    """SQL for a record's range and for its part of a range, and (range, part, rows, bytes) of all of these in order.

    With many shards ranges are a larger share of one, so that about `aim` ranges, or four a shard, do.
    Every range over its limit is subdivided until none is left but those of one single key.
    """
    rows, total = keys.agg(F.count("*"), F.sum("size")).first()
    total = total or 0
    fineness = max(fineness, min(0.5, 2 * shards / aim))
    limit = max(1, int(total / shards * fineness))
    sample = max(sample, int(4 / fineness * shards))
    bounds = splitters(*_drawn(keys, "h", rows, sample), int(2 / fineness * shards)) if total else []
    lot = 2 * limit
    hot: dict[int, tuple[int, int]] = {}
    while True:
        ranged = keys.withColumn("range", F.expr(range_of("h", bounds)))
        sums = ranged.groupBy("range").agg(F.sum("size").alias("b"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.count("*").alias("n")).collect()
        wide = [r for r in sums if r["b"] > limit and r["lo"] < r["hi"]]
        hot = {r["range"]: (r["b"], r["n"]) for r in sums if r["b"] > lot and r["lo"] == r["hi"] and r["n"] > 1}
        if not wide:
            break
        inside = ranged.where(f"array_contains({long_array([r['range'] for r in wide])}, cast(range as bigint))")
        k, w = (np.array(x, dtype=np.int64) for x in _drawn(inside, "h", sum(r["n"] for r in wide), sample))
        order = np.argsort(k, kind="stable")
        k, w = k[order], w[order]
        new = set(bounds)
        for r in wide:
            mine = slice(np.searchsorted(k, r["lo"]), np.searchsorted(k, r["hi"], side="right"))
            own = list(zip(k[mine].tolist(), w[mine].tolist(), strict=True))
            cut = splitters([a for a, _ in own], [b for _, b in own], int(2 * r["b"] / limit) + 2)
            new |= set(cut) | {a + d for a, _ in _heavy(own, r["b"] / 4) for d in (0, 1) if r["lo"] < a + d <= r["hi"]} | {r["lo"] + 1, (r["lo"] + r["hi"] + 1) // 2}
        bounds = sorted(new)
    part = _parts(keys.withColumn("range", F.expr(range_of("h", bounds))), hot, lot, sample)
    found = keys.withColumn("range", F.expr(range_of("h", bounds))).withColumn("part", F.expr(part))
    table = sorted((r["range"], r["part"], r["n"], r["b"]) for r in found.groupBy("range", "part").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect())
    return range_of("h", bounds), part, table


def _heavy(own: list[tuple[int, int]], least: float) -> list[tuple[int, int]]:
    """Keys with a good share of a sample's weight: a text that may need a range of its own."""
    sums: dict[int, int] = {}
    for k, w in own:
        sums[k] = sums.get(k, 0) + w
    whole = sum(sums.values()) or 1
    return [(k, w) for k, w in sums.items() if w / whole >= 0.05 or w >= least]


def _parts(ranged: DataFrame, hot: dict[int, tuple[int, int]], lot: int, sample: int) -> str:
    """SQL for the part of a record, by sampled boundaries of doc_ids inside the ranges of large single texts; no doc_id comes first."""
    if not hot:
        return "0"
    d = f"coalesce(doc_id, {-(1 << 62)}L)"
    own = ranged.where(f"array_contains({long_array(sorted(hot))}, cast(range as bigint))").select("range", F.expr(d).alias("d"), "size")
    rows = sum(n for _, n in hot.values())
    drawn: dict[int, list[tuple[int, int]]] = {k: [] for k in hot}
    for r in own.sample(min(1.0, sample / max(rows, 1)), seed=13).collect():
        drawn[r["range"]].append((r["d"], r["size"]))
    cases = [f"when {k} then {range_of(d, cut)}" for k, (b, _) in sorted(hot.items()) if (cut := splitters([x for x, _ in drawn[k]], [w for _, w in drawn[k]], -(-b // lot)))]
    return f"case range {' '.join(cases)} else 0 end" if cases else "0"


def assign(docs: DataFrame, shards: int = SHARDS, fineness: float = FINENESS, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Shards 0 to shards-1 have nearly equal sums of size; slots of a shard run from 0
    without gaps.  Equal texts share a shard unless they are larger than a range, a
    small share of a shard; then they fill neighbouring shards in the order of doc_id.  So
    shards differ by a range's bytes at most, or by those of one doc_id's equal texts.
    Null texts count as empty.  Repeated rows each get a slot; rows without a doc_id
    are placed by their text alone.  Other columns are ignored.  An empty table gives no rows.
    """
    keys = Table(keyed(docs), "keys").df
    place, shard_of, before = _places(keys, shards, fineness, sample)
    order = Window.partitionBy("place").orderBy("h", "doc_id", "text_crc32")
    slot = F.expr(f"{long_array(before)}[place]") + F.row_number().over(order) - 1
    return place(keys).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.expr(f"cast({long_array(shard_of)}[place] as int)").alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _places(keys: DataFrame, shards: int, fineness: float, sample: int):
    """A function that adds a row's place, the number of its range and part, to rows with h and doc_id; each place's shard, and the rows before it there."""
    range_sql, part_sql, table = ranges(keys, shards, fineness, sample)
    total = sum(t[3] for t in table)
    shard_of, before, done, count, last = [], [], 0, 0, -1
    for _, _, n, size in table:
        shard = min(shards - 1, int((done + size / 2) * shards / total)) if total else 0
        if shard != last:
            count, last = 0, shard
        shard_of.append(shard)
        before.append(count)
        count, done = count + n, done + size
    codes = [(r << 20) | p for r, p, _, _ in table]

    def place(rows: DataFrame) -> DataFrame:
        placed = rows.withColumn("range", F.expr(range_sql)).withColumn("part", F.expr(part_sql))
        return placed.withColumn("place", F.expr(range_of("(shiftleft(cast(range as bigint), 20) | cast(part as bigint))", codes)) - 1)

    return place, shard_of, before


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, column: str = "shard", fineness: float = FINENESS, sample: int = SAMPLE) -> None:
    """Writes the documents as Parquet, all rows and columns, a folder `column`=k for each shard, as assign() places them.

    A row's shard follows from its text and doc_id alone, so nothing is joined: repeated
    rows, null texts and rows without a doc_id are all written.  An empty table gives
    an empty folder.  A column named as the folders is an error.
    """
    if column.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the documents have a column {column}")
    place, shard_of, _ = _places(Table(keyed(docs), "keys").df, shards, fineness, sample)
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"))
    shard = F.expr(f"cast({long_array(shard_of)}[place] as int)") if shard_of else F.lit(0)
    place(own).select("row.*", shard.alias(column)).write.partitionBy(column).parquet(path)


def op6_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
