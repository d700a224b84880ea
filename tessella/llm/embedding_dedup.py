"""Embedding near-duplicates by a forest of random-projection trees.

1. Equal vectors of one label form a class; one member stands for it.
2. Each label gets a few trees.  A node splits along a random direction (one for
   each tree and depth) near the median of a sample of its vectors, where the
   children are cheapest to compare; vectors within a margin of the cut go to both
   sides (spill overlap), so close pairs are seldom parted, and less so in every
   one of several trees.  A node that only a cut through a dense cluster could
   split stays whole.
3. Trees grow in rounds: every class is routed, leaves are counted, and each leaf
   over its size is split further by a sample of its own vectors, until none can.
   Nodes are fitted where their sample is, in parallel; only cuts, one for each
   node, come to the driver, for a bounded share of the labels at a time.
4. Classes are compared within leaves by cosine in double precision.  A leaf over a
   block's size is compared in pairs of blocks, all of it.
5. A pair that shares several leaves counts in the first only: each row carries
   its list of leaves.  Leaves hand on link counts and a spanning forest of their
   links, never the pairs, and the forests are united over all leaves.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import components
from ._spark import Table, small_batches
from ._words import mix64

COSINE = 0.98
TREES, BLOCK = 4, 1024
#: A leaf is to hold the square root of its label's classes, but neither fewer nor more than these.
LEAST_LEAF, MOST_LEAF = 16, 1024
#: Half-width of the overlap, in standard deviations of the projected difference of a pair at the least cosine.
SPILL = 1.0
#: Vectors that a node is fitted to, and the components they have in all; fitted nodes of fewer are leaves.
SAMPLE, SAMPLE_VALUES, LEAST_SAMPLE = 4096, 4_000_000, 12
#: Cuts on the driver at a time: 16 MB.
CUTS = 1_000_000
#: A split must bring the pairs to compare below this share.
WORTH = 0.9
_QUANTILES = (0.5, 0.4, 0.6, 0.3, 0.7)
#: Bits of a node's path in its code, and levels of a tree.
_TREE, _LEVELS = 48, 40


def unit(values: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision and safe from overflow."""
    x = values.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@functools.lru_cache(4096)
def direction(dim: int, tree: int, depth: int) -> np.ndarray:
    """A unit direction, the same on every executor."""
    d = np.random.default_rng([dim, tree, depth]).standard_normal(dim)
    return d / np.linalg.norm(d)


def root(tree: int) -> int:
    """The code of a tree's root; a node's children have twice its path, and one more on the right."""
    return tree << _TREE | 1


def children(code):
    tree, path = code >> _TREE, code & ((1 << _TREE) - 1)
    return tree << _TREE | path << 1, tree << _TREE | path << 1 | 1


def _depth(codes: np.ndarray) -> np.ndarray:
    return np.floor(np.log2((codes & ((1 << _TREE) - 1)).astype(np.float64))).astype(np.int64)


def grow(x: np.ndarray, code: int, size: float, limit: float, margin: float) -> list[tuple[int, float]]:
    """Cuts (code, place) of the nodes below a leaf of about `size` vectors, from a sample of unit vectors x; NaN where the node stays a leaf over its limit."""
    scale, out, todo = size / max(len(x), 1), [], [(code, np.arange(len(x)))]
    while todo:
        code, own = todo.pop()
        if len(own) * scale <= limit:
            continue
        if len(own) < LEAST_SAMPLE:
            continue
        depth = int(_depth(np.array([code]))[0])
        p = x[own] @ direction(x.shape[1], code >> _TREE, depth)
        cuts = np.quantile(p, _QUANTILES)
        left, right = (p[:, None] <= cuts + margin).sum(axis=0), (p[:, None] >= cuts - margin).sum(axis=0)
        cost = (left.astype(float) ** 2 + right.astype(float) ** 2) / len(own) ** 2
        best = int(cost.argmin())
        if cost[best] > WORTH or depth >= _LEVELS:
            out.append((code, math.nan))
            continue
        out.append((code, float(cuts[best])))
        a, b = children(code)
        todo += [(a, own[p <= cuts[best] + margin]), (b, own[p >= cuts[best] - margin])]
    return out


class Forest:
    """Cuts of the nodes of one label's trees, in order of code; whatever has none is a leaf."""

    def __init__(self) -> None:
        self.codes, self.cuts = np.zeros(0, dtype=np.int64), np.zeros(0)

    def add(self, codes: np.ndarray, cuts: np.ndarray) -> None:
        both, order = np.concatenate([self.codes, codes]), None
        order = np.argsort(both, kind="stable")
        self.codes, self.cuts = both[order], np.concatenate([self.cuts, cuts])[order]

    def cut(self, codes: np.ndarray) -> np.ndarray:
        """Each node's cut, NaN for leaves."""
        if not len(self.codes):
            return np.full(len(codes), math.nan)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.cuts[at], math.nan)

    def route(self, x: np.ndarray, trees: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for all leaves that unit vectors reach, ordered by both."""
        rows, codes = np.tile(np.arange(len(x)), trees), np.repeat([root(t) for t in range(trees)], len(x))
        done = []
        while len(rows):
            cut = self.cut(codes)
            leaf = np.isnan(cut)
            done.append((rows[leaf], codes[leaf]))
            rows, codes, cut = rows[~leaf], codes[~leaf], cut[~leaf]
            kind = (codes >> _TREE) << 8 | _depth(codes)
            gap = np.zeros(len(rows))
            for k in np.unique(kind):
                same = kind == k
                gap[same] = x[rows[same]] @ direction(x.shape[1], int(k >> 8), int(k & 255))
            gap -= cut
            left, right = children(codes)
            low, high = gap <= margin, gap >= -margin
            rows, codes = np.concatenate([rows[low], rows[high]]), np.concatenate([left[low], right[high]])
        rows, codes = (np.concatenate(c) for c in zip(*done, strict=True))
        order = np.lexsort((codes, rows))
        return rows[order], codes[order]


def leaf_limit(classes: int, least: int = LEAST_LEAF, most: int = MOST_LEAF) -> int:
    return min(most, max(least, math.isqrt(classes)))


def _margin(dim: int, cosine: float, spill: float) -> float:
    return spill * math.sqrt(max(0.0, 2 - 2 * cosine) / dim)


def _vectors(column: pa.Array) -> np.ndarray:
    """A list column of one length as a matrix."""
    return np.stack([np.asarray(v) for v in column.to_numpy(zero_copy_only=False)])


def _routed(batch: pa.RecordBatch, forests: dict, trees: int, cosine: float, spill: float):
    """(label, dim, rows, vectors, row, leaf) of each label of a batch."""
    labels, dims = batch.column("label").to_pylist(), batch.column("dim").to_pylist()
    groups: dict[tuple[str, int], list[int]] = {}
    for k, cell in enumerate(zip(labels, dims, strict=True)):
        groups.setdefault(cell, []).append(k)
    for (label, dim), rows in groups.items():
        raw = _vectors(batch.column("v").take(pa.array(rows)))
        row, leaf = forests.get((label, dim), _NONE).route(unit(raw), trees, _margin(dim, cosine, spill))
        yield label, dim, np.array(rows), raw, row, leaf


_NONE = Forest()
_CELL = ["label", "dim", "leaf"]


def _fit(wanted, limits, cosine: float, spill: float):
    """(label, dim, code, cut) for the nodes below one leaf, from its sample."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        label, dim, leaf = rows["label"].iloc[0], int(rows["dim"].iloc[0]), int(rows["leaf"].iloc[0])
        x = unit(np.stack([np.frombuffer(v) for v in rows["v"]]))
        found = grow(x, leaf, wanted.value[label, dim, leaf], limits.value[label, dim][1], _margin(dim, cosine, spill))
        return pd.DataFrame([(label, dim, *c) for c in found], columns=["label", "dim", "code", "cut"])

    return run


def forests_of(classes: DataFrame, cells: DataFrame, cosine: float = COSINE, trees: int = TREES, spill: float = SPILL, least: int = LEAST_LEAF, most: int = MOST_LEAF, sample: int = SAMPLE) -> tuple[dict[tuple[str, int], Forest], Table]:
    """Forests of the labels in cells (label, dim, classes) with more than a leaf, and the sizes of all leaves.

    They grow on classes (label, dim, node, v) until no leaf over its limit can be split.
    """
    spark = classes.sparkSession
    limited = cells.where(f"classes > {least}").withColumn("most", F.least(F.lit(most), F.greatest(F.lit(least), F.floor(F.sqrt("classes")))))
    limit = {(r["label"], r["dim"]): (r["classes"], r["most"]) for r in limited.collect()}
    forests, whole, counted = {cell: Forest() for cell in limit}, set(), None
    over = {(*cell, root(t)): n for cell, (n, top) in limit.items() for t in range(trees) if n > top}
    limits = spark.sparkContext.broadcast(limit)
    while over:
        shared, wanted = spark.sparkContext.broadcast(forests), spark.sparkContext.broadcast(over)

        def drawn(batches: Iterator[pa.RecordBatch], shared=shared, wanted=wanted) -> Iterator[pa.RecordBatch]:
            """The sampled vectors of leaves over their limit."""
            for batch in batches:
                nodes = batch.column("node").to_numpy(zero_copy_only=False)
                for label, dim, rows, raw, row, leaf in _routed(batch, shared.value, trees, cosine, spill):
                    known, which = np.unique(leaf, return_inverse=True)
                    most_drawn = max(LEAST_SAMPLE, min(sample, SAMPLE_VALUES // dim))
                    rate = np.array([min(1.0, most_drawn / wanted.value[label, dim, c]) if (label, dim, c) in wanted.value else 0.0 for c in known.tolist()])[which]
                    chance = mix64(nodes[rows[row]].astype(np.uint64) ^ mix64(leaf.astype(np.uint64))).astype(np.float64) / 2.0**64
                    kept = np.flatnonzero(chance < rate)
                    for a in range(0, len(kept), 4096):
                        at = kept[a : a + 4096]
                        yield pa.RecordBatch.from_arrays([pa.array([label] * len(at)), pa.array(np.full(len(at), dim), pa.int32()), pa.array(leaf[at]), pa.array([v.astype(np.float64).tobytes() for v in raw[row[at]]], pa.binary())], names=[*_CELL, "v"])

        found = classes.select("label", "dim", "node", "v").mapInArrow(drawn, "label string, dim int, leaf long, v binary").groupBy(*_CELL).applyInPandas(_fit(wanted, limits, cosine, spill), "label string, dim int, code long, cut double").toPandas()
        whole |= {(r.label, r.dim, r.code) for r in found[found["cut"].isna()].itertuples()}
        found = found[found["cut"].notna()]
        if not len(found):
            break
        for (label, dim), g in found.groupby(["label", "dim"]):
            forests[label, dim].add(g["code"].to_numpy(np.int64), g["cut"].to_numpy())
        counted = Table(leaf_sizes(classes, forests, trees, cosine, spill), "leaves")
        # A leaf is split again where the sample it had was too small, not for a few vectors over.
        rows = counted.df.join(limited.select("label", "dim", "most"), ["label", "dim"]).where("n > 2 * most").collect()
        over = {cell: r["n"] for r in rows if (cell := (r["label"], r["dim"], r["leaf"])) not in whole}
    return forests, counted or Table(leaf_sizes(classes, forests, trees, cosine, spill), "leaves")


def leaf_sizes(classes: DataFrame, forests: dict, trees: int = TREES, cosine: float = COSINE, spill: float = SPILL) -> DataFrame:
    """(label, dim, leaf, n): how many classes reach each leaf."""
    shared = classes.sparkSession.sparkContext.broadcast(forests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, dim, _, _, _, leaf in _routed(batch, shared.value, trees, cosine, spill):
                codes, n = np.unique(leaf, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(codes)), pa.array(np.full(len(codes), dim), pa.int32()), pa.array(codes), pa.array(n)], names=[*_CELL, "n"])

    return classes.select("label", "dim", "v").mapInArrow(run, "label string, dim int, leaf long, n long").groupBy(*_CELL).agg(F.sum("n").alias("n"))


_ROWS = "label string, dim int, leaf long, i int, j int, block int, node long, n long, leaves binary, v binary"


def _dealt(shared, blocks, trees: int, cosine: float, spill: float):
    """A row for each class, leaf and pair of blocks there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, counts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n"))
            for label, dim, rows, raw, row, leaf in _routed(batch, shared.value, trees, cosine, spill):
                edge = np.searchsorted(row, np.arange(len(rows) + 1))
                leaves = [leaf[edge[k] : edge[k + 1]].tobytes() for k in range(len(rows))]
                node, n, vectors = nodes[rows], counts[rows], [v.tobytes() for v in raw]
                known, which = np.unique(leaf, return_inverse=True)
                parts = np.array([blocks.value.get((label, dim, c), 1) for c in known.tolist()])[which]
                own = (mix64(node[row].astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
                many = np.repeat(np.arange(len(row)), parts)
                other = np.arange(len(many)) - np.repeat(np.cumsum(parts) - parts, parts)
                at, code, own = row[many], leaf[many], own[many]
                for a in range(0, len(at), 4096):
                    s = slice(a, a + 4096)
                    m = len(at[s])
                    cols = [code[s], np.minimum(own[s], other[s]), np.maximum(own[s], other[s]), own[s], node[at[s]], n[at[s]]]
                    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array([label] * m), pa.array(np.full(m, dim), pa.int32()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True)), pa.array([leaves[k] for k in at[s]], pa.binary()), pa.array([vectors[k] for k in at[s]], pa.binary())], names=[c.split()[0] for c in _ROWS.split(", ")])

    return run


def _met_before(lists: list[np.ndarray], leaf: int) -> np.ndarray:
    """Whether two rows also share a leaf with a smaller code, for all pairs."""
    out = np.zeros((len(lists), len(lists)), dtype=bool)
    size = np.array([len(v) for v in lists])
    codes, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), size)
    before = codes < leaf
    codes, owner = codes[before], owner[before]
    _, which, count = np.unique(codes, return_inverse=True, return_counts=True)
    keep = count[which] > 1
    if not keep.any():
        return out
    names, which = np.unique(which[keep], return_inverse=True)
    owner = owner[keep]
    for a in range(0, len(names), 2048):
        here = (which >= a) & (which < a + 2048)
        m = np.zeros((len(lists), min(2048, len(names) - a)), dtype=np.float32)
        m[owner[here], which[here] - a] = 1
        for r in range(0, len(lists), 512):
            out[r : r + 512] |= m[r : r + 512] @ m.T > 0
    return out


def _compare(cosine: float, kind: type, chunk: int = 512):
    """Link counts (of pairs that have no earlier leaf in common) and a root for each class of a pair of blocks."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        node, n, block, leaf = rows["node"].to_numpy(), rows["n"].to_numpy().astype(np.float64), rows["block"].to_numpy(), int(rows["leaf"].iloc[0])
        x = unit(np.stack([np.frombuffer(v, dtype=kind) for v in rows["v"]]))
        near = np.zeros((len(x), len(x)), dtype=bool)
        for a in range(0, len(x), chunk):
            near[a : a + chunk] = x[a : a + chunk] @ x.T >= cosine
        near |= near.T
        near[np.arange(len(x)), np.arange(len(x))] = False
        if rows["i"].iloc[0] != rows["j"].iloc[0]:
            near &= block[:, None] != block
        some = np.flatnonzero(near.any(axis=1))
        near = near[np.ix_(some, some)]
        if not len(some):
            return pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
        met = _met_before([np.frombuffer(rows["leaves"].iloc[k], dtype=np.int64) for k in some], leaf)
        links = np.concatenate([(near[a : a + chunk] & ~met[a : a + chunk]) @ n[some] for a in range(0, len(some), chunk)])
        own = np.arange(len(some))
        while True:
            least = np.concatenate([np.where(near[a : a + chunk], own, len(some)).min(axis=1) for a in range(0, len(some), chunk)])
            new = np.minimum(own, least)
            np.minimum.at(new, own, new.copy())
            new = new[new]
            if (new == own).all():
                break
            own = new
        return pd.DataFrame({"node": node[some], "links": np.rint(links).astype(np.int64), "root": node[some][own]})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAST_LEAF, block: int = BLOCK, spill: float = SPILL, sample: int = SAMPLE, cuts: int = CUTS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors (vec_id, embedding, label) link if their labels are equal and not null,
    their lengths are equal, and their cosine is at least `cosine`; labels of any type
    are compared as text.  Empty, null and zero vectors and those with null or
    non-finite components link with nothing.  n_links counts the other rows linked
    directly; component_id is the smallest vec_id reachable, and kept marks it.  Equal
    vectors link with each other.  Rows that repeat a vec_id, with equal vectors or
    others, each come back with their own vector's links.  Rows without a vec_id link
    with nothing and have no component.  Other columns are ignored.  An empty table
    gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2000)
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind, element = (np.float32, "float") if element == "float" else (np.float64, "double")
    v = F.col("embedding").cast(f"array<{element}>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.col("label").cast("string").alias("label"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False)))
    rows = rows.withColumn("d1", F.when(F.col("fine"), F.xxhash64("label", "v"))).withColumn("d2", F.when(F.col("fine"), F.xxhash64("v", "label", F.lit(1))))
    classes = rows.where("fine").groupBy("d1", "d2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    # The number is drawn once, as the table is stored.
    classes = Table(classes.withColumn("dim", F.size("v")).withColumn("node", F.monotonically_increasing_id()), "classes")
    cells = Table(classes.df.groupBy("label", "dim").agg(F.count("*").alias("classes")), "cells")
    growth = cells.df.where(f"classes > {leaf}").agg(F.sum(F.col("classes") * 4 * trees / leaf)).first()[0] or 0
    shares = max(1, math.ceil(growth / cuts))
    out = None
    for k in range(shares if cells.rows else 0):
        share = F.pmod(F.xxhash64("label", "dim"), F.lit(shares)) == k
        own, some = classes.df.where(share), cells.df.where(share)
        forests, leaves = forests_of(own, some, cosine, trees, spill, leaf, max(leaf, MOST_LEAF), sample)
        large = leaves.df.where(f"n > {block}").collect()
        shared, blocks = (spark.sparkContext.broadcast(x) for x in (forests, {(r["label"], r["dim"], r["leaf"]): -(-r["n"] // block) for r in large}))
        dealt = own.select("label", "dim", "node", "n", "v").mapInArrow(_dealt(shared, blocks, trees, cosine, spill), _ROWS)
        found = dealt.groupBy(*_CELL, "i", "j").applyInPandas(_compare(cosine, kind), "node long, links long, root long")
        out = found if out is None else out.unionAll(found)
    found = Table(spark.createDataFrame([], "node long, links long, root long") if out is None else out, "found")
    comps = components(found.df.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.df.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.df.select("d1", "d2", "rep", "n", "node").join(links, "node", "left").join(comps.df.withColumnRenamed("node", "k"), F.col("node") == F.col("k"), "left")
    named = Table(named.select("d1", "d2", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component"), "named")
    least = Table(named.df.where("component is not null").groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    named = named.df.join(least.df, "component", "left").select("d1", "d2", "n_links", F.coalesce("component_id", "rep").alias("component_id"))
    named = Table(named, "ids").df
    out = rows.select("vec_id", "d1", "d2").join(named, ["d1", "d2"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
