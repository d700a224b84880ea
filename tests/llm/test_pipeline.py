"""The corpus pipeline stage by stage against plain Python, and the registered queries on the smallest tables."""

from __future__ import annotations

import os
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tessella.llm import catalog, packing, quality

from .conftest import prose
from .test_dedup import brute_near, shingles

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def make(spark, folder):
    rng = random.Random(21)
    item = " ".join(prose(rng, 25))
    rows, labels = [], []
    for k in range(240):
        w = prose(rng, rng.randrange(20, 80))
        good = k % 5 != 0
        text = " ".join(w).capitalize() + "." if good else " | ".join(x.upper() for x in w)
        if k % 11 == 1:
            text += " " + item
        if k % 7 == 2:
            text += f" Mail u{k}@site.example.com now."
        rows.append((k, text, "en", f"src{k % 3}", len(text)))
        labels.append((k, int(good), 0))
    for k in range(240, 300):
        text = rows[rng.randrange(200)][1]
        rows.append((k, text if k % 2 else text + " tail.", "en", "src0", len(text)))
    rows += [(300, "", "en", "s", 0), (301, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels[:150], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "never seen in any of these texts at all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return item


def test_stages(spark, tmp_path):
    item, folder = make(spark, str(tmp_path)), str(tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, texts = docs.columns, [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        assert docs.columns == columns
        texts.append({r["doc_id"]: r["text"] for r in docs.collect()})
    raw, good, single, clean, private = texts
    model = quality.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    want = {r["doc_id"] for r in quality.score(spark.read.parquet(f"{folder}/documents.parquet"), model).collect() if r["predicted"]}
    junk = {i for i, t in raw.items() if " | " in (t or "")}
    assert set(good) == want and len(junk & want) <= 5 and len(set(raw) - junk - want) <= 30
    near = brute_near(list(good.items()))
    assert set(single) == {i for i, v in near.items() if v[2]} and len(single) < len(good)
    q = shingles(item)
    assert set(clean) == {i for i, t in single.items() if 100 * len(q & shingles(t)) < 75 * len(q)} and len(clean) < len(single)
    assert set(private) == set(clean) and not any("site.example" in (t or "") for t in private.values())
    assert all(private[i] == t for i, t in clean.items() if "@" not in (t or ""))
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, folder).collect()
    assert {r["doc_id"] for r in pieces} == set(private)
    encode = packing.Encoder(packing.vocabulary("byte_bpe_50k.json"), None, "", "<|endoftext|>")
    for i, t in private.items():
        own = sorted((r["start"], r["ids"]) for r in pieces if r["doc_id"] == i)
        assert np.frombuffer(b"".join(x for _, x in own), "<u4").tolist() == [*encode(t or ""), 1]


def test_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    """Repeated rows, null ids and texts, and columns with the names used inside pass every stage; empty tables stay empty."""
    folder = str(tmp_path)
    make(spark, folder)
    extra = odd_docs.limit(3).unionByName(odd_docs.limit(2).selectExpr("cast(null as bigint) as doc_id", *[f"`{c}`" for c in odd_docs.columns[1:]]))
    both = odd_docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, both, folder)
        assert out.columns == both.columns and 0 < out.count() <= both.count()
        if name in ("decontamination", "pii"):
            assert out.where("doc_id is null").count() == 2
        empty = stage(spark, no_docs, folder)
        assert empty.columns == no_docs.columns and empty.count() == 0
    last = corpus_pipeline.STAGES[4][1]
    assert last(spark, no_docs, folder).count() == 0 and last(spark, both, folder).where("start = 0").count() == both.count()


def test_run(spark, tmp_path):
    make(spark, str(tmp_path))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset", "ids"} <= set(out.columns)
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    plain = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "if" else v
    rows = lambda f: sorted(repr(tuple(plain(x) for x in r)) for r in f[sorted(want.columns)].astype(object).itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry_lists_all():
    numbers = {int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op")}
    assert numbers == set(range(1, 11)) and "pipeline" in entry.queries()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name, least", [("op7_hyperdimensional_language", 0.9), ("op10_pu_quality", 0.95)])
def test_held_out_accuracy(spark, name, least):
    SF = "/root/testdata/sf0.01"
    got = catalog.QUERIES[name](spark, SF).toPandas()
    held = got[got.held_out]
    if name.startswith("op7"):
        truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas().merge(held, on="doc_id")
        assert (truth.lang == truth.lang_pred).mean() >= least
    else:
        truth = spark.read.parquet(f"{SF}/labels.parquet").toPandas().merge(held, on="doc_id")
        assert (truth.quality == truth.predicted).mean() >= least
