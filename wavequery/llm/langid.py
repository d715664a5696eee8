"""Language identification, word first with backoff to character n-grams.

A word of the model's vocabulary is scored by its log frequency in each language. An unseen word falls
back to its known n-grams of the longest order that has any, from ``ORDERS[0]`` characters down to one. A
text's languages are compared by the sum over all its words; the score is the softmax of the mean
evidence per word times ``min(words, EVIDENCE)``.

The model is fitted on at most ``SAMPLE`` labelled documents (whole texts, the lowest by hash of
the id), a parameter; the model keeps every word and every n-gram of those, however rare, so that a small language beside a large
one loses none.

Null text, a text without a letter, or no model at all: ``und`` with score 0. Rows with a null id
or lang are not learned from. Ties between languages go to the first name, repeated rows are scored
once each, further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, staged

SAMPLE, ORDERS, SMOOTHING, EVIDENCE = 8_000, (5, 4, 3, 2, 1), 0.1, 20
UND = "und"
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 100_000


@dataclass
class Model:
    """``words`` and ``grams`` (one table per order in ORDERS) point at rows of ``evidence``: log
    frequencies in each language less their mean. One matrix is sent to the workers, not an array per key."""

    langs: list[str]
    evidence: np.ndarray
    words: dict[str, int] = field(default_factory=dict)
    grams: list[dict[str, int]] = field(default_factory=list)

    def word(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is not None:
            return self.evidence[known]
        padded = f" {word} "
        for n, table in zip(ORDERS, self.grams):
            found = [table[g] for k in range(len(padded) - n + 1) if (g := padded[k : k + n]) in table]
            if found:
                return self.evidence[found].mean(axis=0)
        return np.zeros(len(self.langs))


def _evidence(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    v = np.log((counts + SMOOTHING) / (totals + SMOOTHING * len(counts)))
    return (v - v.mean(axis=1, keepdims=True)).astype(np.float32)


def build(rows: list[tuple[str, str, int]]) -> Model:
    """From (lang, word, count)."""
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], np.zeros((0, 0)))
    column = {x: i for i, x in enumerate(langs)}
    words = {w: i for i, w in enumerate(dict.fromkeys(r[1] for r in rows))}
    counts = np.zeros((len(words), len(langs)))
    np.add.at(counts, ([words[r[1]] for r in rows], [column[r[0]] for r in rows]), [r[2] for r in rows])
    parts, grams, first = [_evidence(counts, counts.sum(axis=0))], [], len(words)
    for order in ORDERS:
        seen: dict[str, int] = {}
        gram, word = [], []  # every n-gram of every word
        for w, i in words.items():
            padded = f" {w} "
            for k in range(len(padded) - order + 1):
                gram.append(seen.setdefault(padded[k : k + order], len(seen)))
                word.append(i)
        table = np.zeros((len(seen), len(langs)))
        np.add.at(table, gram, counts[word])
        grams.append({g: i + first for g, i in seen.items()})
        parts.append(_evidence(table, table.sum(axis=0)))
        first += len(parts[-1])
    return Model(langs, np.concatenate(parts), words, grams)


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    rows = only(docs, doc_id=id_col, text=text_col, lang=lang_col).where("text is not null and lang is not null and doc_id is not null")
    # the sample's ids are at most ``sample`` rows, so that table can be broadcast
    ids = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    chosen = rows.join(F.broadcast(ids), "doc_id").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen[lang].update(_WORD.findall(text.as_py().lower()))
            for lang, c in seen.items():
                yield pa.record_batch([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])

    counts = chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = staged(counts, "word-counts")
    found = counts.toArrow()  # the words of the sample, all of them
    return build(list(zip(*(found.column(c).to_pylist() for c in ("lang", "word", "n")))))


class Scorer:
    """Word evidence in rows of one matrix, so that a text is one product; starts afresh when full."""

    def __init__(self, model: Model, limit: int = _CACHE):
        self.model, self.limit = model, limit
        self.rows = np.zeros((limit + 1, len(model.langs)))
        self.at: dict[str, int] = {}

    def _row(self, word: str) -> int:
        if not any(map(str.isalpha, word)):
            return 0
        k = len(self.at) + 1
        self.at[word] = k
        self.rows[k] = self.model.word(word)
        return k

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not self.model.langs:
            return UND, 0.0
        counts = Counter(_WORD.findall(text.lower()))
        total, n, words = np.zeros(len(self.model.langs)), 0, list(counts)
        for lo in range(0, len(words), 50_000):
            part = words[lo : lo + 50_000]
            if len(self.at) + len(part) > self.limit:
                self.at.clear()
            get, row = self.at.get, self._row
            at = np.array([get(w) or row(w) for w in part])
            k = np.array([counts[w] for w in part], dtype=float) * (at > 0)
            total += k @ self.rows[at]
            n += int(k.sum())
        if not n:
            return UND, 0.0
        best = int(np.argmax(total))
        z = (total - total[best]) / n * min(n, EVIDENCE)
        return self.model.langs[best], 1.0 / float(np.exp(z).sum())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (or doc_id alone) with lang_pred and score."""
    keep = keep or [id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a bounded sample
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                found = [score(t.as_py()) for t in part.column(n)]
                yield pa.record_batch(
                    [*part.columns[:n], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    names=[*[f"c{i}" for i in range(n)], "lang_pred", "score"],
                )

    picked = only(docs, **{f"c{i}": c for i, c in enumerate(keep)}, text=text_col)
    schema = ", ".join(f"c{i} {picked.schema[f'c{i}'].dataType.simpleString()}" for i in range(n))
    out = picked.mapInArrow(run, f"{schema}, lang_pred string, score double")
    return out.toDF(*keep, "lang_pred", "score")


def training_rows(id_col: str = "doc_id") -> Column:
    """Documents whose crc32(id as text) mod 4 is not 2 may be learned from."""
    return F.crc32(F.col(id_col).cast("string")) % 4 != 2
