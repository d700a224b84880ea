"""MinHash near-duplicates: bottom-k sketches from one hash function.

1. Every text becomes the set of its distinct word shingles (63-bit hashes) and
   the k smallest of them, its sketch.  Texts with equal sets form a class, and
   only one member of each class goes on.
2. Inverted lists: a text is posted under its rarest retained values.  Two sets
   with Jaccard j share about j * k of the k smallest values of their union; at
   least `least_overlap` of them but for a chance below 1e-7, so posting all but
   that many (less one) of a sketch's values, rarest first, loses no link.
   Values seen once need no list.
3. In each list all texts are compared with the least edited one (a star, not
   all pairs): the union-sketch estimate filters, exact Jaccard on full sets
   decides, and components merge.  Lists that lie in one component are closed.
4. In open lists, a text too few of whose shingles occur in any other open text
   cannot link with any (exact bound) and goes.  What is left is compared across
   components, on full sets, in blocks bounded in texts and in shingles: blocks of
   one power of two of set sizes, or of neighbouring ones, as sizes further apart
   cannot link.  Only links that join components come out.

No list or group is gathered in one task and nothing is dropped for its size.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as W
from ._graph import components
from ._spark import Table, columns_or_null, small_batches

SKETCH = 64
WIDTH = 5
PERCENT = 75
#: Of SKETCH values of the union, pairs at the least similarity share fewer with a chance below 1e-7.
LEAST_OVERLAP = 28
#: Texts and shingles of a block, at about these numbers; two blocks are compared at a time.
BLOCK, BLOCK_SHINGLES = 192, 1 << 17


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    for i, j, buf, offsets in W.slices(batch.column("text")):
        starts, ends, firsts = W.spans(buf, offsets)
        shingles, at = W.shingle_hashes(W.word_hashes(buf, starts, ends, lower=True), firsts, width)
        shingles >>= np.uint64(1)
        for k in range(j - i):
            yield i + k, np.unique(shingles[at[k] : at[k + 1]]).astype(np.int64)


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.zeros(0, dtype=np.int64)])))


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, k: int = SKETCH, width: int = WIDTH) -> DataFrame:
    """(doc_id, h, n, d1, d2, sketch): a hash of each text, size and digest of its shingle set, and the set's k smallest values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, kept = [], [], []
            for _, s in _sets(batch, width):
                n.append(len(s))
                digests.append(_digest(s))
                kept.append(s[:k])
            d = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), _lists(kept)], names=["doc_id", "h", "n", "d1", "d2", "sketch"])

    return columns_or_null(docs, doc_id="long", text="string").withColumn("h", _text_hash()).mapInArrow(run, "doc_id long, h long, n long, d1 long, d2 long, sketch array<long>")


def _text_hash():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def full_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, d1, s): each text's sorted shingle set, and the first half of its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, s in _sets(batch, width)]
            d1 = np.frombuffer(b"".join(map(_digest, sets)), dtype=np.int64).reshape(-1, 2)[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(d1), _lists(sets)], names=["doc_id", "d1", "s"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, d1 long, s array<long>")


def _postings(reps: DataFrame, k: int, least: int) -> DataFrame:
    """(key, rep, n, alone): each class under its rarest retained values; alone: how many of them no other class has."""
    values = reps.select("rep", F.explode("sketch").alias("key"))
    often = Table(values.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"), "often")
    shared = values.join(often.df, "key").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("v"))
    shared = shared.join(reps.select("rep", "n", F.least("n", F.lit(k)).alias("m")), "rep")
    alone = F.col("m") - F.size("v")
    room = F.col("m") - F.greatest(F.lit(1), F.floor(F.col("m") * least / k)) + 1
    return shared.select("rep", "n", alone.alias("alone"), F.explode(F.slice("v", F.lit(1), F.greatest(F.lit(0), room - alone).cast("int"))).alias("v")).select(F.col("v.key").alias("key"), "rep", "n", "alone")


def _verified(pairs: DataFrame, sets: DataFrame, k: int, least: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose union sketch shows enough overlap and whose full sets are similar enough."""
    right = sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
    left = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa"))
    both = pairs.join(right, "b").join(left, "a")
    a, b = F.slice("sa", 1, k), F.slice("sb", 1, k)
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    overlap = F.size(F.array_intersect(F.array_intersect(a, b), union))
    near = both.where(overlap * k >= F.size(union) * least)
    common = F.size(F.array_intersect("sa", "sb"))
    return near.where(common * 100 >= (F.size("sa") + F.size("sb") - common) * percent).select("a", "b")


def _across(percent: int):
    """Links between components of one block pair, on full sets; of several that join the same two, one."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep")
        rep, comp, side = rows["rep"].to_numpy(), rows["component"].to_numpy(), rows["block"].to_numpy()
        size = np.array([len(s) for s in rows["s"]])
        flat = np.concatenate([np.asarray(s, dtype=np.int64) for s in rows["s"]])
        owner = np.repeat(np.arange(len(rep)), size)
        _, value, count = np.unique(flat, return_inverse=True, return_counts=True)
        keep = count[value] > 1
        names, value = np.unique(value[keep], return_inverse=True)
        owner = owner[keep]
        common = np.zeros((len(rep), len(rep)), dtype=np.float32)
        for at in range(0, len(names), 8192):
            inside = (value >= at) & (value < at + 8192)
            m = np.zeros((len(rep), min(8192, len(names) - at)), dtype=np.float32)
            m[owner[inside], value[inside] - at] = 1
            common += m @ m.T
        common = np.rint(common).astype(np.int64)
        own = side != side[:, None] if len(np.unique(side)) > 1 else np.ones_like(common, dtype=bool)
        link = (common * 100 >= (size[:, None] + size - common) * percent) & (common > 0) & (comp != comp[:, None]) & (rep != rep[:, None]) & own
        a, b = np.nonzero(np.triu(link, 1))
        out = pd.DataFrame({"a": rep[a], "b": rep[b], "p": np.minimum(comp[a], comp[b]), "q": np.maximum(comp[a], comp[b])})
        return out.drop_duplicates(["p", "q"])[["a", "b"]]

    return run


def near_duplicates(docs: DataFrame, k: int = SKETCH, width: int = WIDTH, percent: int = PERCENT, least_overlap: int = LEAST_OVERLAP) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are runs of bytes other than 0x20 and 0x09-0x0D with A-Z lower-cased; a
    text's set holds its distinct `width`-word shingles, or its whole word sequence
    if it has fewer words.  Texts with 100 * intersection >= percent * union are
    linked; component_id is the smallest doc_id reachable, and kept marks it.
    Null, empty and blank texts have empty sets and link with nothing.  Equal texts
    share a component.  Rows that repeat a doc_id each come back, each with the
    component of its own text; different texts whose equal texts have the same
    smallest doc_id share one.  Rows without a doc_id come back with a null component
    and are not kept.  Other columns are ignored.  An empty table gives no rows.
    """
    return _near_duplicates(docs, k, width, percent, least_overlap).drop("h")


def _near_duplicates(docs: DataFrame, k: int = SKETCH, width: int = WIDTH, percent: int = PERCENT, least_overlap: int = LEAST_OVERLAP) -> DataFrame:
    """The rows of near_duplicates(), and a hash `h` of each text."""
    small_batches(docs.sparkSession)
    docs = columns_or_null(docs, doc_id="long", text="string")
    all_sketches = Table(sketches(docs, k, width), "sketches")
    full = all_sketches.df.where("n > 0 and doc_id is not null")
    reps = Table(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    lists = Table(_postings(reps.df, k, least_overlap), "lists")
    pivots = lists.df.groupBy("key").agg(F.min(F.struct("alone", "rep")).alias("p"), F.count("*").alias("c")).where("c > 1").select("key", F.col("p.rep").alias("pivot"))
    pivots = Table(pivots, "pivots")
    stars = lists.df.join(pivots.hinted(), "key").where("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    stars = Table(stars, "stars")
    wanted = Table(stars.df.select(F.col("a").alias("doc_id")).unionAll(stars.df.select("b")).distinct(), "wanted")
    sets = full_sets(docs.join(wanted.hinted(), "doc_id", "left_semi"), width)
    if not full.groupBy("doc_id").count().where("count > 1").isEmpty():
        sets = sets.join(reps.df.select(F.col("rep").alias("doc_id"), "d1"), ["doc_id", "d1"], "left_semi").distinct()
    sets = Table(sets.drop("d1"), "sets")
    links = Table(_verified(stars.df, sets.df, k, least_overlap, percent), "links")
    first = components(links.df)
    mixed = _open(lists.df, first.df)
    loners = Table(_loners(mixed.df, sets.df, percent), "loners")
    open_lists = _open(mixed.df.join(loners.hinted(), "rep", "left_anti").select("key", "rep", "n"), first.df)
    more = _cross_links(open_lists.df, sets.df, percent)
    final = components(links.df.unionAll(more))
    for t in (lists, pivots, stars, wanted, sets, links, first, mixed, loners, open_lists):
        t.drop()
    classes = reps.df.join(final.df, reps.df.rep == final.df.node, "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    classes = Table(classes, "components")
    joined = all_sketches.df.drop("sketch").join(classes.df, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "h", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _open(lists: DataFrame, comps: DataFrame) -> Table:
    """(key, rep, n, component) of lists that lie in more than one component."""
    named = lists.join(comps, lists.rep == comps.node, "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("component"))
    mixed = Table(named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key"), "mixed")
    out = Table(named.join(mixed.hinted(), "key", "left_semi"), "open")
    mixed.drop()
    return out


def _loners(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(rep) of texts that share too few shingles with all other open texts together to link with any of them.

    A link needs common >= percent / (100 + percent) * (own size + partner's size), and the partner
    is at least as large as the smallest text of the own lists and as percent of the own size.
    """
    least = Table(lists.groupBy("key").agg(F.min("n").alias("least")), "least")
    reps = lists.join(least.hinted(), "key").groupBy("rep").agg(F.first("n").alias("n"), F.min("least").alias("least"))
    shingles = sets.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", F.explode("s").alias("v"))
    alone = shingles.groupBy("v").agg(F.count("*").alias("c"), F.min("doc_id").alias("rep")).where("c = 1").groupBy("rep").agg(F.count("*").alias("alone"))
    partner = F.greatest(F.col("least").cast("double"), F.col("n") * percent / 100)
    short = (F.col("n") - F.coalesce("alone", F.lit(0))) * (100 + percent) + 0.5 < (F.col("n") + partner) * percent
    return reps.join(alone, "rep", "left").where(short).select("rep")


def _cross_links(lists: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Links across components among texts that share an open list, by way of others or at once.

    A bundle of such texts is dealt into cells by the power of two of their set sizes and a
    block number; a cell is met by those of its own power and of the next ones up and down.
    """
    heads = Table(lists.groupBy("key").agg(F.min("rep").alias("head")), "heads")
    ties = Table(lists.join(heads.hinted(), "key").select(F.col("rep").alias("a"), F.col("head").alias("b")).distinct(), "ties")
    bundles = components(ties.df)
    members = lists.select("rep", "n", "component").distinct().join(bundles.df.select(F.col("node").alias("rep"), F.col("component").alias("bundle")), "rep")
    members = Table(members.withColumn("power", F.floor(F.log2("n")).cast("int")), "members")
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / block_shingles)).cast("int")
    sizes = Table(members.df.groupBy("bundle", "power").agg(blocks.alias("blocks")), "sizes")
    met = sizes.df.select("bundle", F.explode(F.array(*(F.struct((F.col("power") + d).alias("power"), F.col("power").alias("other_power"), F.col("blocks").alias("other_blocks")) for d in (-1, 0, 1)))).alias("m")).select("bundle", "m.*")
    met = Table(sizes.df.join(met, ["bundle", "power"]), "met")
    cell = lambda power, number: F.shiftleft(F.col(power).cast("long"), 32) + number
    dealt = members.df.join(met.hinted(), ["bundle", "power"]).withColumn("own", cell("power", F.pmod(F.xxhash64("rep"), F.col("blocks"))))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1))).withColumn("other", cell("other_power", F.col("other")))
    pairs = dealt.select("rep", "component", "bundle", F.col("own").alias("block"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = pairs.join(sets.select(F.col("doc_id").alias("rep"), "s"), "rep")
    found = Table(rows.groupBy("bundle", "i", "j").applyInPandas(_across(percent), "a long, b long"), "across")
    for t in (heads, ties, bundles, members, sizes, met):
        t.drop()
    return found.df


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, that near_duplicates() keeps.

    Of each group of near duplicates the smallest doc_id stays.  Rows that repeat a
    doc_id are judged each by its own text, and of equal rows by doc_id and text one
    stays; null counts as empty here.  Rows without a doc_id all stay; an empty table
    stays empty.
    """
    mark = uuid.uuid4().hex
    gone, again, text = f"gone_{mark}", f"again_{mark}", f"text_{mark}"
    told = Table(_near_duplicates(docs).where("doc_id is not null").select("doc_id", "h", "kept"), "told")
    several = Table(told.df.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(again)), "several")
    ids = Table(told.df.where("not kept").select(F.col("doc_id").alias(gone)).join(several.hinted(), F.col(gone) == F.col(again), "left_anti"), "gone")
    left = docs.join(ids.hinted(), F.col("doc_id") == F.col(gone), "left_anti")
    if not several.rows:
        return left
    stay = Table(told.df.where("kept").join(several.hinted(), F.col("doc_id") == F.col(again), "left_semi").select(F.col("doc_id").alias(gone), F.col("h").alias(again)).distinct(), "stay")
    rest = left.join(several.hinted(), F.col("doc_id") == F.col(again), "left_semi").withColumn(text, _text_hash())
    rest = rest.join(stay.hinted(), (F.col("doc_id") == F.col(gone)) & (F.col(text) == F.col(again)), "left_semi").dropDuplicates(["doc_id", text])
    return left.join(several.hinted(), F.col("doc_id") == F.col(again), "left_anti").unionAll(rest.select(*(F.col(f"`{c}`") for c in docs.columns)))


_WORDS8 = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS8} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c WHERE 100 * i >= 75 * (na + nb - i)),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m ON a = doc_id
"""
