"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents confirmed as toxic, everything else is unlabelled text. Features are the
distinct words of a text and their beginnings, hashed. Features that are significantly more frequent
among the positives are kept, however few positives hold them; logistic classifiers are then trained in numpy on the risk
``prior * R+(P) + max(0, R-(U) - prior * R-(P))`` and averaged.

The classifiers are fitted on at most ``POSITIVES`` documents (whole texts, the lowest by hash of the id) and
``UNLABELLED`` distinct texts (the lowest by hash), which one task holds; both bounds are parameters. The class prior is the
share of toxic texts among all distinct texts with a label that may be used, unless it is given.

Null and empty texts get the score of a text without features. Labels that are null or whose id is null or
unknown are ignored; several labels of one id count as toxic if one is. Without positives or without unlabelled
text every score is 0. Rows are scored one by one, repeated rows and ties alike; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, only, staged

POSITIVES, UNLABELLED, BITS = 4_000, 8_000, 18
_WORD = re.compile(r"[^\W\d_]+")
_STARTS = (3, 4, 5, 6)
_CACHE = 400_000


def word_features(word: str) -> list[int]:
    """Hashed features of one word: itself and its beginnings."""
    data = [f"={word}", *(f"^{word[:n]}" for n in _STARTS if len(word) >= n)]
    return [zlib.crc32(x.encode()) >> (32 - BITS) for x in data]


def text_features(text: str | None) -> np.ndarray:
    """Distinct features of a text."""
    found: set[int] = set()
    for w in set(_WORD.findall((text or "").lower())):
        found.update(word_features(w))
    return np.fromiter(found, dtype=np.int32, count=len(found))


@dataclass
class Model:
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -30.0

    def score(self, logit: float) -> float:
        return 0.0 if not self.weights else float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def pu_risk_gradient(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Non-negative risk estimate with logistic loss, and its gradient by the scores of P and U.
    Where the estimated negative risk is below 0 it counts as 0, and only the positive part is left."""
    sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
    pos = np.logaddexp(0, -zp).mean()
    neg = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    if neg < 0:
        return prior * pos, -prior * (1 - sp) / len(zp), np.zeros(len(zu))
    return prior * pos + neg, -prior * (1 - sp) / len(zp) - prior * sp / len(zp), su / len(zu)


def train(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, models: int = 3, rounds: int = 60, min_count: int = 3, min_z: float = 3.0, l2: float = 1e-5) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature ids, weights and bias of the mean of ``models`` classifiers."""
    size = 1 << BITS
    counts = [np.bincount(np.concatenate([*x, np.zeros(0, np.int32)]), minlength=size).astype(float) for x in (pos, unl)]
    rate = [(c + 0.5) / (len(x) + 1) for c, x in zip(counts, (pos, unl))]
    lift = rate[0] / rate[1]
    # neither bound asks for a share of the positives, so the vocabulary of a small group stays in
    least = lift * np.exp(-min_z * np.sqrt(1 / (counts[0] + 0.5) + 1 / (counts[1] + 0.5)))
    significant = (counts[0] >= min_count) & (least >= 1)
    # no lift passes 1 / (toxic share of the unlabelled texts): the bound stays below the largest one that is certain
    reach = least[significant].max(initial=1.0)
    chosen = np.flatnonzero(significant & (lift >= min(1.5, np.sqrt(reach))))
    at = np.full(size, -1, dtype=np.int32)
    at[chosen] = np.arange(len(chosen), dtype=np.int32)

    def matrix(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        cols = [c[c >= 0] for c in (at[d] for d in docs)]
        return np.concatenate([*cols, np.zeros(0, np.int32)]), np.cumsum([0, *map(len, cols)])

    def take(m: tuple[np.ndarray, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = m[1][rows + 1] - m[1][rows]
        row = np.repeat(np.arange(len(rows)), n)
        return m[0][np.repeat(m[1][rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)], row

    mats = matrix(pos), matrix(unl)
    total, total_bias = np.zeros(len(chosen)), 0.0
    for seed in range(models):
        rng = np.random.default_rng(seed)
        w = np.append(0.5 * np.log(lift[chosen]), 0.0)
        w[-1] = np.log(prior / (1 - prior))
        m1, m2, t = np.zeros_like(w), np.zeros_like(w), 0
        for _ in range(rounds):
            for rp, ru in zip(np.array_split(rng.permutation(len(pos)), 4), np.array_split(rng.permutation(len(unl)), 4)):
                if not len(rp) or not len(ru):
                    continue
                parts = [take(m, r) for m, r in zip(mats, (rp, ru))]
                z = [np.bincount(row, weights=w[col], minlength=len(r)) + w[-1] for (col, row), r in zip(parts, (rp, ru))]
                _, gp, gu = pu_risk_gradient(z[0], z[1], prior)
                g = l2 * w
                g[-1] = gp.sum() + gu.sum()
                for (col, row), d in zip(parts, (gp, gu)):
                    g[:-1] += np.bincount(col, weights=d[row], minlength=len(chosen))
                t += 1
                m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
                w -= 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        total += w[:-1] / models
        total_bias += w[-1] / models
    return chosen, total, total_bias


def fit(docs: DataFrame, labels: DataFrame, usable: Column, prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """``usable``: a condition on ``doc_id``; only such rows of either table are learned from."""
    texts = only(docs, doc_id="doc_id", text="text").where(usable)
    marks = only(labels, doc_id="doc_id", toxic="toxic").where(usable).where("toxic is not null")
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    text_hash = F.xxhash64("text").alias("h")
    if prior is None:
        known = texts.select("doc_id", text_hash).join(marks, "doc_id").groupBy("h").agg(F.max((F.col("toxic") == 1).cast("double")).alias("toxic"))
        prior = known.agg(F.avg("toxic")).first()[0]
    if not prior:
        return Model()
    prior = min(max(prior, 0.001), 0.9)
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    # both id tables are bounded by the parameters, so they can be broadcast
    p = marks.where("toxic = 1").select("doc_id").orderBy(*by_hash).limit(positives).withColumn("y", F.lit(1))
    # copies count once here as in the prior, whatever their number: one id for each distinct text
    u = texts.where("doc_id is not null").groupBy(text_hash).agg(F.min("doc_id").alias("doc_id"))
    u = u.orderBy("h").limit(unlabelled).select("doc_id").distinct().withColumn("y", F.lit(0))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                x = [text_features(t.as_py()) for t in part.column(1)]
                yield pa.record_batch([part.column(0), pa.array(x, pa.list_(pa.int32()))], names=["y", "x"])

    chosen = texts.join(F.broadcast(p.unionByName(u)), "doc_id").select("y", "text").dropDuplicates(["y", "text"])
    sample = staged(chosen.mapInArrow(featurise, "y int, x array<int>"), "pu-sample")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list, list] = ([], [])
        for batch in batches:
            for y, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                sides[y].append(x.values.to_numpy())
        ids, weights, bias = np.zeros(0, int), np.zeros(0), 0.0
        if sides[0] and sides[1]:
            order = lambda docs: sorted(docs, key=lambda d: d.tobytes())
            ids, weights, bias = train(order(sides[1]), order(sides[0]), prior)
        yield pa.record_batch([pa.array([-1, *ids.tolist()], pa.int64()), pa.array([bias, *weights.tolist()], pa.float64())], names=["id", "weight"])

    # one task holds the bounded sample, one row per feature comes back
    got = {r["id"]: r["weight"] for r in sample.coalesce(1).mapInArrow(learn, "id long, weight double").collect()}
    bias = got.pop(-1, 0.0)
    return Model({k: v for k, v in got.items() if v}, bias)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (or doc_id alone) with score and predicted."""
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 ** BITS weights
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weight = model.weights.get
        hits = Memo(lambda word: [f for f in word_features(word) if weight(f)], _CACHE)

        def logit(text: str | None) -> float:
            found: set[int] = set()
            for h in map(hits.__getitem__, set(_WORD.findall((text or "").lower()))):
                if h:
                    found.update(h)
            return model.bias + sum(map(weight, sorted(found)))

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                s = np.array([model.score(logit(t.as_py())) for t in part.column(n)])
                yield pa.record_batch(
                    [*part.columns[:n], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))],
                    names=[*[f"c{i}" for i in range(n)], "score", "predicted"],
                )

    picked = only(docs, **{f"c{i}": c for i, c in enumerate(keep)}, text="text")
    schema = ", ".join(f"c{i} {picked.schema[f'c{i}'].dataType.simpleString()}" for i in range(n))
    return picked.mapInArrow(run, f"{schema}, score double, predicted int").toDF(*keep, "score", "predicted")


def training_rows() -> Column:
    """Labels of documents whose crc32(id as text) mod 5 is not 0 may be learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 != 0
