from __future__ import annotations

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import embedding_dedup, minhash_dedup, substring_dedup
from tessella.llm._graph import components
from tessella.llm._recompress import recompress

from .conftest import corpus, prose, words

SF = "/root/testdata/sf0.001"


def closure(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text):
    w = words(text, lower=True)
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def brute_near(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = closure(ids, links)
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in ids}


def test_near_duplicates(spark, odd_docs, no_docs):
    rows = minhash_dedup.near_duplicates(odd_docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == brute_near(corpus())
    assert minhash_dedup.near_duplicates(no_docs).count() == 0
    kept = minhash_dedup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["kept"]}


def test_large_near_group(spark):
    """Hundreds of different near copies, many of them on the border, and copies of copies."""
    rng = random.Random(4)
    base, rows = prose(rng, 120), []
    for k in range(260):
        b = list(base)
        for _ in range(rng.randrange(0, 9)):
            b[rng.randrange(len(b))] = rng.choice(["new", "other", f"w{rng.randrange(500)}"])
        rows.append((k * 3 + 1, " ".join(b)))
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute_near(rows)


def test_near_null_ids_and_repeated_rows(spark):
    text = " ".join(prose(random.Random(1), 40))
    rows = [(None, text), (None, None), (7, text), (7, text), (9, text + " more")]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == [("7", "7", True), ("7", "7", True), ("9", "7", False), ("None", "None", False), ("None", "None", False)]


def test_keep_one_of_repeated_rows(spark):
    text, other = (" ".join(prose(random.Random(k), 40)) for k in (1, 2))
    rows = [(1, text, "a"), (1, text, "a"), (2, text + " end", "b"), (2, text, "c"), (3, other, "d"), (3, text, "e"), (4, None, "f"), (4, "", "f"), (5, other, "g"), (5, other, "g"), (None, text, "h"), (None, text, "h"), (6, "x y", "i"), (6, "x y", "i"), (6, "z", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string").withColumnRenamed("doc", "kept")
    got = minhash_dedup.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"] or "", r["kept"]) for r in got.collect()) == sorted([("1", text, "a"), ("3", other, "d"), ("4", "", "f"), ("None", text, "h"), ("None", text, "h"), ("6", "x y", "i"), ("6", "z", "j")])


def test_two_texts_under_one_id(spark):
    """Each row has the component of its own text, also where lists span components."""
    rng = random.Random(23)
    base = prose(rng, 100)
    rows = []
    for k in range(60):
        b = list(base)
        for _ in range(rng.randrange(2, 8)):
            b[rng.randrange(len(b))] = rng.choice(["new", "other", f"w{rng.randrange(9)}"])
        rows.append((k % 40, " ".join(b)))
    rows += rows[:7] + [(50 + k, t) for k, (_, t) in enumerate(rows[5:45:4])]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [(i, shingles(t)) for i, t in rows]
    label = {}
    for i, s in sets:
        label[s] = min(i, label.get(s, i))
    each = list(label)
    links = [(label[s], label[t]) for a, s in enumerate(each) for t in each[a + 1 :] if 100 * len(s & t) >= 75 * len(s | t)]
    comp = closure(set(label.values()), links)
    want = [(i, len(s), comp[label[s]]) for i, s in sets]
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(want)


def test_blocks_are_bounded(spark, monkeypatch):
    """Texts of many sizes in one bundle, in small blocks: no link is lost."""
    rng = random.Random(31)
    base, rows = prose(rng, 400), []
    for k in range(300):
        b = base[: rng.choice([60, 90, 120, 200, 400])]
        for _ in range(rng.randrange(len(b) // 40, len(b) // 12)):
            b[rng.randrange(len(b))] = rng.choice(["new", "other", f"w{rng.randrange(5)}"])
        rows.append((k, " ".join(b)))
    met, cross = [], minhash_dedup._cross_links
    monkeypatch.setattr(minhash_dedup, "_cross_links", lambda lists, sets, percent: met.append(1) or cross(lists, sets, percent, block=20, block_shingles=4000))
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert met and {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute_near(rows)


def brute_repeats(rows, width=50):
    first = {}
    for i, t in sorted(rows):
        w = words(t)
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = {k + d for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for d in range(width)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring(spark, odd_docs, no_docs):
    for share, rounds in ((2, 5), (1, 3), (8, 6)):
        rows = substring_dedup.remove_repeats(odd_docs, share=share, rounds=rounds).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == brute_repeats(corpus())
    assert substring_dedup.remove_repeats(no_docs).count() == 0


def test_substring_texts_and_null_ids(spark):
    passage = [f"p{k}" for k in range(60)]
    rows = [(1, " ".join(passage)), (2, "a  b\n" + " ".join(passage) + " c"), (3, " ".join(passage)), (None, " ".join(passage))]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["n_removed"], r["kept"]) for r in got} == {(1, 0, None), (2, 60, "a b c"), (3, 60, ""), (None, 0, None)}


def test_substring_repeated_rows(spark):
    """Rows that share a doc_id, with equal texts or others, stay apart and take no words from one another."""
    rng = random.Random(15)
    passage, other = prose(rng, 60), prose(rng, 55)
    long = " ".join(prose(rng, 30) + passage + prose(rng, 9))
    rows = [(5, long), (5, long), (5, " ".join(passage)), (3, " ".join(other)), (3, " ".join(other)), (3, " ".join(other + passage)), (8, " ".join(prose(rng, 4) + other)), (8, " ".join(prose(rng, 4) + passage)), (9, long), (9, long), (9, None), (9, None), (4, ""), (4, "a b")]
    rows += [(6, " ".join(prose(rng, 80)))] * 3
    rows += [(None, long), (None, long)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 49):
            if i is not None:
                first[tuple(w[k : k + 50])] = min(i, first.get(tuple(w[k : k + 50]), i))
    want = []
    for i, t in rows:
        w = words(t)
        gone = {k + d for k in range(len(w) - 49) if i is not None and first[tuple(w[k : k + 50])] < i for d in range(50)}
        want.append((str(i), len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted(want)


def test_bad_utf8(spark):
    """Bytes that are no UTF-8 count as parts of words and are kept as they are."""
    passage = b" ".join(b"\xff%d" % k for k in range(60))
    frame = spark.createDataFrame([(1, bytearray(passage)), (2, bytearray(passage + b" \xfe end")), (3, bytearray(passage))], "doc_id long, b binary").selectExpr("doc_id", "cast(b as string) as text")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(frame).collect()}
    assert got == {1: (60, 0, hashlib.sha256(passage).hexdigest()), 2: (62, 60, hashlib.sha256(b"\xfe end").hexdigest()), 3: (60, 60, hashlib.sha256(b"").hexdigest())}
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(frame).collect()}
    assert near == {1: (56, 1), 2: (58, 1), 3: (56, 1)}


def test_symbols_depend_on_their_range_only():
    rng = np.random.default_rng(5)
    common = rng.integers(0, 6, 200).astype(np.uint64)
    for _ in range(20):
        a, b = (rng.integers(0, 6, n).astype(np.uint64) for n in rng.integers(0, 40, 2))
        one, two = np.concatenate([a, common, b]), np.concatenate([b, b, common, a])
        s, t = recompress(one, np.array([0, len(one)]), 5), recompress(two, np.array([0, len(two)]), 5)
        inside = lambda s, at: {(n, x - at, y - at) for n, x, y, cx, cy in zip(s.name, s.x, s.y, s.cx, s.cy, strict=True) if cx >= at and cy <= at + 200}
        got = inside(s, len(a))
        assert got and got == inside(t, 2 * len(b))


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1080)] + [(5000, k) for k in range(5001, 5100)] + [(3, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([*links, (None, 4)], "a long, b long")).df.collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: c for i, c in closure({x for p in links for x in p}, links).items() if i in linked}
    assert components(spark.createDataFrame([], "a long, b long")).df.count() == 0


def vectors(seed=3, n=700, dim=24):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((60, dim))
    rows = []
    for k in range(n):
        v = centres[rng.integers(60)] + rng.standard_normal(dim) * rng.choice([0.0, 0.05, 0.12, 0.2])
        rows.append((k * 2 + 1, (v * rng.choice([1.0, 3.0])).astype(np.float32).tolist(), int(rng.integers(3))))
    odd = [None, [], [0.0] * dim, [float("nan")] * dim, [None] * dim, [float("inf")] + [1.0] * (dim - 1), [1.0] * 3, [1.0] * 3]
    rows += [(5000 + k, v, 1) for k, v in enumerate(odd)] + [(6000, [1.0] * dim, None), (6001, [1.0] * dim, None)]
    return rows


def brute_vectors(rows, cosine=0.98):
    fine = [(i, np.array(v, dtype=float), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = []
    for k, (i, v, a) in enumerate(fine):
        for j, w, b in fine[k + 1 :]:
            if a == b and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= cosine:
                links.append((i, j))
    comp = closure([r[0] for r in rows], links)
    n = {r[0]: 0 for r in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], comp[i], comp[i] == i) for i in n}


def found_of(rows):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows}


def test_embeddings(spark):
    rows = vectors()
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep string")
    want = brute_vectors(rows)
    assert sum(v[0] for v in want.values()) > 500
    assert found_of(embedding_dedup.near_duplicates(frame).collect()) == want
    for more in ({"block": 16}, {"sample": 40}, {"cuts": 30}, {"leaf": 300}):
        got = found_of(embedding_dedup.near_duplicates(frame, **more).collect())
        found, there = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
        assert all(got[i][0] <= want[i][0] for i in want) and found >= 0.99 * there, more


def grown(spark, frame, **more):
    classes = frame.selectExpr("cast(label as string) as label", "size(embedding) as dim", "vec_id as node", "embedding as v")
    cells = classes.groupBy("label", "dim").agg(F.count("*").alias("classes"))
    return embedding_dedup.forests_of(classes, cells, **more)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_forest_on_the_smallest_table(spark):
    """Every label's trees all have several leaves, and recall of links at the defaults is whole."""
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    forests, sizes = grown(spark, frame)
    leaves = {}
    for r in sizes.df.collect():
        leaves.setdefault((r["label"], r["leaf"] >> 48), []).append(r["n"])
    assert len(forests) == frame.select("label").distinct().count() > 1
    assert len(leaves) == embedding_dedup.TREES * len(forests) and all(len(n) > 2 for n in leaves.values())
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in frame.collect()]
    want, got = brute_vectors(rows), found_of(embedding_dedup.near_duplicates(frame).collect())
    assert got == want


def test_forest_of_a_large_label(spark):
    """8,000 vectors around 1,500 centres and 2,000 in one dense spot: trees of many levels, grown in rounds, leave bounded leaves but for the spot."""
    rng = np.random.default_rng(8)
    dim = 32
    centres = rng.standard_normal((1500, dim))
    x = centres[rng.integers(1500, size=8000)] + 0.08 * rng.standard_normal((8000, dim))
    spot = rng.standard_normal(dim) + 0.03 * rng.standard_normal((2000, dim))
    both = np.concatenate([x, spot]).astype(np.float32)
    frame = spark.createDataFrame([(k, v.tolist(), "one") for k, v in enumerate(both)], "vec_id long, embedding array<float>, label string")
    _, sizes = grown(spark, frame, sample=300)
    n = np.array([r["n"] for r in sizes.df.collect()])
    assert len(n) > 4 * 30 and n.sum() < 4 * 8 * len(both) and np.sort(n)[-40:].max() < 7000 and np.median(n) <= 200
    rows = embedding_dedup.near_duplicates(frame, sample=300).collect()
    unit = both.astype(float) / np.linalg.norm(both.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    got = np.zeros(len(both), dtype=int)
    for r in rows:
        got[r["vec_id"]] = r["n_links"]
    assert (got <= near.sum(axis=1)).all() and got.sum() >= 0.99 * near.sum()
    comp = closure(range(len(both)), zip(*np.nonzero(np.triu(near))))
    assert np.mean([comp[r["vec_id"]] == r["component_id"] for r in rows]) >= 0.99


def test_embeddings_repeated_rows_and_labels_of_text(spark):
    """Rows that share a vec_id have their own vectors' links; labels are compared as text."""
    a, b, c = [1.0, 0.0, 2.0], [0.0, 1.0, 0.0], [1.0, 0.01, 2.0]
    rows = [(1, a, "x"), (1, a, "x"), (1, b, "x"), (2, c, "x"), (3, b, "x"), (4, b, "y"), (4, b, "y"), (5, a, None)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    want = [(1, 2, 1, True), (1, 2, 1, True), (1, 1, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 1, 4, True), (4, 1, 4, True), (5, 0, 5, True)]
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == sorted(want)


def test_embeddings_repeat_and_empty(spark):
    rows = [(None, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (4, [2.0, 4.0], 1), (5, [1.0, 2.0], 2)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got} == {(None, 0, None, False), (2, 2, 2, True), (3, 2, 2, False), (4, 2, 2, False), (5, 0, 5, True)}
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
