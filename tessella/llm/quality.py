"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a small network by minimising the
non-negative unbiased risk: with class prior p and loss l,

    p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)]),

where a step that finds the second term negative goes up on it instead, as in the
paper by Kiryo and others (2017).  Labels of bad texts are not used at all: they
serve to measure the classifier.

The class prior is estimated from positives and unlabelled texts by the best bin
(Garg and others, 2021): of all cuts on a ranking score, that where the share of
unlabelled texts above it is the smallest multiple of the share of held-out
positives above it, with allowance for chance.  Networks fitted to one half of the
positives rank, the other half is held out, and the shares count all unlabelled
documents of the corpus.

A text's features come from its bytes alone: frequencies of pairs of character
classes, and how long, how varied and how repetitive its words and lines are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as W
from ._spark import Table, columns_or_null, small_batches
from .language_id import fold

#: Rows of the samples that the classifier is fitted to, at about these numbers.
LABELLED, UNLABELLED = 8_000, 8_000
HIDDEN, EPOCHS, BATCH, RATE = 24, 40, 512, 3e-3
#: Networks whose scores are averaged.
NETWORKS = 3
#: Cuts tried for the prior, the chance that the allowance is too small, and the bounds of the prior.
CUTS, DOUBT, PRIORS = 512, 0.1, (0.05, 0.99)
#: Small samples are gone over until this many steps.
LEAST_STEPS = 600
THRESHOLD = 0.3

_CLASS = np.full(256, 15, dtype=np.int64)
for _k, _chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\v\f\r", "\n", ".", ",;:", "|", "!?", "#", "$%", "&*", "\"'`", "()[]{}<>", "-_/\\@+=~^"]):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[128:] = 0
N_FEATURES = 256 + 12
_LINE_END = 10


def _line_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all non-empty lines, and the first of each text."""
    broken = np.where(buf == _LINE_END, np.uint8(32), np.uint8(97))
    return W.spans(broken, offsets)


def _distinct(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Number of distinct values of each text."""
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    return np.bincount(t[new], minlength=len(firsts) - 1)


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of N_FEATURES numbers for each text."""
    n = len(offsets) - 1
    out = np.zeros((n, N_FEATURES), dtype=np.float32)
    size = np.diff(offsets)
    if len(buf):
        c = _CLASS[buf]
        text = np.repeat(np.arange(n), size)
        inside = text[:-1] == text[1:]
        pair = (text[:-1] * 256 + c[:-1] * 16 + c[1:])[inside]
        counts = np.bincount(pair, minlength=n * 256).reshape(n, 256)
        out[:, :256] = np.sqrt(counts / np.maximum(size[:, None] - 1, 1))
    starts, ends, firsts = W.spans(buf, offsets)
    words = W.word_hashes(buf, starts, ends, lower=True)
    lo, hi, lines = _line_spans(buf, offsets)
    line = W.word_hashes(buf, lo, hi)
    n_words, n_lines = np.diff(firsts), np.diff(lines)
    owner = np.repeat(np.arange(n), n_words)
    length = (ends - starts).astype(np.float64)
    mean = np.bincount(owner, weights=length, minlength=n) / np.maximum(n_words, 1)
    square = np.bincount(owner, weights=length * length, minlength=n) / np.maximum(n_words, 1)
    repeat = np.zeros(n)
    if len(words) > 1:
        same = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        repeat = np.bincount(owner[1:][same], minlength=n) / np.maximum(n_words, 1)
    shingles, at = W.shingle_hashes(words, firsts, 5)
    n_shingles = np.diff(at)
    upper = (buf[starts] >= 65) & (buf[starts] <= 90) if len(starts) else np.zeros(0, dtype=bool)
    more = [
        np.log1p(n_words) / 8,
        mean / 10,
        np.sqrt(np.maximum(square - mean * mean, 0)) / 10,
        _distinct(words, firsts) / np.maximum(n_words, 1),
        _distinct(shingles, at) / np.maximum(n_shingles, 1),
        np.log1p(n_lines) / 5,
        _distinct(line, lines) / np.maximum(n_lines, 1),
        np.log1p(n_words / np.maximum(n_lines, 1)) / 5,
        repeat,
        np.bincount(owner, weights=upper, minlength=n) / np.maximum(n_words, 1),
        (n_words == 0).astype(float),
        (n_words < 5).astype(float),
    ]
    out[:, 256:] = np.stack(more, axis=1)
    return out


def feature_rows(rows: DataFrame, *keep: str) -> DataFrame:
    """The kept long columns of (text, ...), and `f`, the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(buf, offsets) for _, _, buf, offsets in W.slices(batch.column("text"))]
            if x:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([v.tobytes() for v in np.concatenate(x)], pa.binary())], names=[*keep, "f"])

    return rows.select(*(F.col(c).cast("long").alias(c) for c in keep), "text").mapInArrow(run, ", ".join([*(f"{c} long" for c in keep), "f binary"]))


@dataclass
class Model:
    """A network of one hidden layer on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(x).astype(np.float64))


@dataclass
class Committee:
    """Networks that differ in their random start; the score is their mean, an estimate of the chance that a text is good."""

    members: list[Model]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.mean([m.score(x) for m in self.members], axis=0)


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = HIDDEN, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = 1) -> Model:
    """Minimises the non-negative risk by Adam over mini-batches of both samples."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -6, 6).astype(np.float32) for x in (positive, unlabelled))
    d = p.shape[1]
    theta = [rng.standard_normal((d, hidden)).astype(np.float32) * np.sqrt(1 / d), np.zeros(hidden, np.float32), rng.standard_normal(hidden).astype(np.float32) * np.sqrt(1 / hidden), np.zeros(1, np.float32)]
    m, v, step = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta], 0
    rounds = max(1, -(-max(len(p), len(u)) // batch))
    for _ in range(max(epochs, -(-LEAST_STEPS // rounds))):
        at_p, at_u = np.resize(rng.permutation(len(p)), rounds * batch), np.resize(rng.permutation(len(u)), rounds * batch)
        for k in range(rounds):
            a, b = p[at_p[k * batch : (k + 1) * batch]], u[at_u[k * batch : (k + 1) * batch]]
            x = np.concatenate([a, b])
            h = np.maximum(x @ theta[0] + theta[1], 0)
            g = h @ theta[2] + theta[3][0]
            s, n = _sigmoid(g), len(a)
            down = np.logaddexp(0, g)
            negative = down[n:].mean() - prior * down[:n].mean()
            grad = np.zeros_like(g)
            if negative >= 0:
                grad[:n] = prior * ((s[:n] - 1) - s[:n]) / n
                grad[n:] = s[n:] / len(b)
            else:
                grad[:n], grad[n:] = prior * s[:n] / n, -s[n:] / len(b)
            back = (grad[:, None] * theta[2]) * (h > 0)
            slopes = [x.T @ back + 1e-4 * theta[0], back.sum(axis=0), h.T @ grad + 1e-4 * theta[2], np.array([grad.sum()])]
            step += 1
            for i, (t, q) in enumerate(zip(theta, slopes, strict=True)):
                m[i] = 0.9 * m[i] + 0.1 * q
                v[i] = 0.999 * v[i] + 0.001 * q * q
                t -= (rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(mean, scale, theta[0], theta[1], theta[2], float(theta[3][0]))


def best_bin(above_unlabelled: np.ndarray, above_positive: np.ndarray, unlabelled: int, positive: int) -> float:
    """The class prior from the shares of both kinds above each of the same cuts, and how many there are of each."""
    allowance = np.sqrt(np.log(4 / DOUBT) / (2 * max(unlabelled, 1))) + np.sqrt(np.log(4 / DOUBT) / (2 * max(positive, 1)))
    some = above_positive > 0
    share = np.where(some, above_positive, 1.0)
    bound = np.where(some, (above_unlabelled + allowance) / share, np.inf)
    at = int(bound.argmin())
    return float(np.clip(above_unlabelled[at] / share[at], *PRIORS))


def _cuts(scores: np.ndarray) -> np.ndarray:
    return np.unique(np.quantile(scores, np.linspace(0, 1, CUTS)))


def _above(scores: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many scores reach each of ascending cuts."""
    return len(scores) - np.searchsorted(np.sort(scores), cuts, side="left")


def _halves(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int) -> list[tuple[Model, np.ndarray, np.ndarray]]:
    """For each half of the positives: a network fitted to it, cuts, and the share of the other half above each."""
    out = []
    for k in (0, 1):
        model = fit(positive[k::2], unlabelled, prior=prior, hidden=hidden, seed=11 + k)
        held = model.raw(positive[1 - k :: 2])
        cuts = _cuts(held)
        out.append((model, cuts, _above(held, cuts) / len(held)))
    return out


def _counts(docs: DataFrame, labelled: DataFrame, rankers: list) -> list[np.ndarray]:
    """How many of all unlabelled documents reach each cut of each ranker; the last number is that of all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = []
            for _, _, buf, offsets in W.slices(batch.column("text")):
                x = features(buf, offsets)
                places.append(np.stack([np.searchsorted(cuts, m.raw(x), side="right") for m, cuts, _ in rankers]))
            if places:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(p, pa.int32()) for p in np.concatenate(places, axis=1))], names=["doc_id", *(f"p{k}" for k in range(len(rankers)))])

    placed = docs.mapInArrow(run, "doc_id long, " + ", ".join(f"p{k} int" for k in range(len(rankers)))).join(labelled, "doc_id", "left_anti")
    both = placed.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"p{k}").alias("p")) for k in range(len(rankers))))).alias("x"))
    out = [np.zeros(len(cuts) + 1, dtype=np.int64) for _, cuts, _ in rankers]
    for r in both.groupBy("x.k", "x.p").count().collect():
        out[r["k"]][r["p"]] = r["count"]
    # Place p reaches the first p cuts.
    return [np.append(n[::-1].cumsum()[::-1][1:], n.sum()) for n in out]


def _matrix(rows) -> np.ndarray:
    return np.stack([np.frombuffer(f, dtype=np.float32) for f in rows]) if len(rows) else np.zeros((0, N_FEATURES), np.float32)


def _chance(*columns: str):
    """A number from 0 to 1 drawn from a hash, the same whenever a stage runs again."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED, folds: int = 5, hidden: int = HIDDEN) -> Committee | None:
    """A classifier from labels (doc_id, quality) whose doc_id is not in fold 0, and from unlabelled documents; None without positives.

    Networks are fitted to about `labelled` positives and `unlabelled` documents without
    a label, both chosen by hash; the class prior counts all documents without a label
    (where all have one, these are the unlabelled ones).  Labels are 1 (good) or 0;
    others and nulls are left out, as are labels of bad texts, and of repeated labels the
    least holds.  Null and empty texts count as empty; documents without a doc_id have no
    label; other columns are ignored; without documents or positives there is no model.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = columns_or_null(docs, doc_id="long", text="string")
    ids = Table(columns_or_null(labels, doc_id="long", quality="int").where("doc_id is not null").groupBy("doc_id").agg(F.min(F.when(F.col("quality").isin(0, 1), F.col("quality"))).alias("quality")), "labels")
    good = ids.df.where("quality = 1").where(fold("doc_id", folds) != 0).select("doc_id")
    n_good, n_docs = good.count(), docs.count()
    if not n_good or not n_docs:
        return None
    chosen = Table(good.where(_chance("doc_id") < min(1.0, labelled / n_good)), "chosen")
    x = _matrix(feature_rows(docs.join(chosen.hinted(), "doc_id"), "doc_id").toPandas()["f"])
    rate = min(1.0, 2 * unlabelled / max(1, n_docs - ids.rows))
    some = docs.where(F.col("doc_id").isNull() | (_chance("doc_id", "text") < rate))
    some = Table(feature_rows(some, "doc_id"), "some")
    wanted = Table(some.df.select("doc_id").distinct(), "wanted")
    known = ids.df.join(wanted.hinted(), "doc_id", "left_semi").select("doc_id")
    free = some.df.join(known, "doc_id", "left_anti").orderBy(F.xxhash64("doc_id", "f")).limit(unlabelled).toPandas()["f"]
    everything = not len(free)
    u = _matrix(free if not everything else some.df.orderBy(F.xxhash64("doc_id", "f")).limit(unlabelled).toPandas()["f"])
    if not len(x):
        return None
    prior = 0.5
    if len(x) > 1:
        first = _halves(x, u, prior, hidden)
        prior = float(np.mean([best_bin(_above(m.raw(u), cuts) / len(u), share, len(u), len(x) // 2) for m, cuts, share in first]))
        rankers = _halves(x, u, prior, hidden)
        none = ids.df.select("doc_id").where("false")
        counts = _counts(docs, none if everything else ids.df.select("doc_id"), rankers)
        prior = float(np.mean([best_bin(n[:-1] / max(n[-1], 1), share, n[-1], len(x) // 2) for n, (_, _, share) in zip(counts, rankers, strict=True)]))
    return Committee([fit(x, u, prior=prior, hidden=hidden, seed=k + 1) for k in range(NETWORKS)], prior)


def score(docs: DataFrame, model: Committee | None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (1 from the threshold on).

    Null and empty texts are scored as empty ones.  Without a model every score is 1.
    Repeated rows each come back; other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.ones(batch.num_rows)
            if model is not None:
                for i, j, buf, offsets in W.slices(batch.column("text")):
                    s[i:j] = model.score(features(buf, offsets))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return columns_or_null(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Committee | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that the model doesn't reject; without a model, all.

    Null texts are judged as empty ones; repeated rows stay or go together; an empty table stays empty.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.ones(batch.num_rows, dtype=bool)
            if model is not None:
                for i, j, buf, offsets in W.slices(batch.column("text")):
                    good[i:j] = model.score(features(buf, offsets)) >= threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def op10_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
