"""Hard negatives by a secondary-sort shuffle of packed (anchor, descending score, id) keys.

1. Vectors become integers, floor(scale * x), and are dealt by hash into chunks of bounded size. Every anchor is sent
   to every chunk: the chunk's vectors come first in the sorted partition and are held as one matrix, the anchors
   stream past it. No candidate is copied; anchors (a stated query set) are, once per chunk.
2. First pass: a chunk returns an anchor's best rows of its own label; the best of all chunks are its positives.
3. Second pass, with the positives' scores known: a chunk returns, for each positive, its first negatives within the window. The first of all
   rows are among the first of the chunks, so nothing is lost, and what is shuffled does not grow with the pairs.
4. Positives and negatives are packed into keys (anchor, descending score, positives first, id), dealt by anchor and sorted
   within partitions. One pass over the sorted keys opens a window for each positive it meets and writes a negative under each
   window that is open for its score, until the window is full or the scores have passed it. Only the open windows are held.

Scores are exact 64-bit integers; a product beyond 64 bits is refused (OverflowError). Ties go to the smaller id. Rows with
a null id or label, a null vector, or a null or non-finite component take no part; an empty vector scores zero with all, and a shorter one
has zeros for what it lacks. Equal rows count once. Different rows may share an id: each is a candidate (and an anchor) of its own, never a
partner of an anchor with its id. A positive of score zero has the negatives of score zero, one below zero has none. Empty tables and tables
without anchors give no rows; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_matrix, exact_products, finite_vector, only, staged

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
CHUNK, CELLS, ANCHORS = 8192, 1 << 23, 256  # vectors and components held of a chunk, anchors scored at once
_KEY = ">QQQBQ"  # anchor, its tag, descending score, 0 for a positive, id
_SIGN = 1 << 63


def window_ends(positive: int, low: int, high: int) -> tuple[int, int]:
    """The least and largest score s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def first_best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, the earlier of equal ones, in no order."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


def _scored(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple]:
    """(anchor id, tag, label, positives' scores, ids, labels, scores against the chunk) per anchor of a sorted stream
    in which the vectors of a chunk (kind 0) come before its anchors (kind 1), in order of id."""
    chunk, parts, held = None, [], None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        marks = np.stack([table.column("chunk").to_numpy(), table.column("kind").to_numpy()])
        cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), table.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            part, now, kind = table.slice(lo, hi - lo), int(marks[0, lo]), int(marks[1, lo])
            if now != chunk:
                chunk, parts, held = now, [], None
            if kind == 0:
                parts.append((part.column("vec_id").to_numpy(), part.column("label").to_numpy(), as_matrix(part.column("vector"), scale)))
                continue
            if held is None:
                width = max((p[2].shape[1] for p in parts), default=0)
                whole = np.zeros((sum(len(p[0]) for p in parts), width))
                at = 0
                for p in parts:
                    whole[at : at + len(p[0]), : p[2].shape[1]] = p[2]
                    at += len(p[0])
                held = [np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i in (0, 1)], whole
                parts = []
            (ids, labels), whole = held
            for a in range(0, part.num_rows, ANCHORS):
                some = part.slice(a, ANCHORS)
                scores = exact_products(as_matrix(some.column("vector"), scale), whole)
                named = zip(*(some.column(c).to_pylist() for c in ("vec_id", "tag", "label", "positives")))
                for (anchor, tag, label, positives), row in zip(named, scores):
                    yield anchor, tag, label, positives, ids, labels, row


def _rows(found: list[tuple]) -> pa.RecordBatch:
    cols = [np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in range(4)]
    return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["anchor_id", "tag", "vec_id", "score"])


def _best(scale: int, low: int, high: int, positives: int, negatives: int, second: bool):
    """First pass: an anchor's best rows of its label. Second: the first negatives of each of its windows."""

    def wanted(label, scored, ids, labels, row, anchor) -> np.ndarray:
        if not second:
            mine = np.flatnonzero((labels == label) & (ids != anchor))
            return mine[first_best(row[mine], positives)]
        others = np.flatnonzero((labels != label) & (ids != anchor))
        near, picked = row[others], []
        for p in set(scored):
            least, most = window_ends(p, low, high)
            inside = others[(near >= max(least, -_SIGN)) & (near <= min(most, _SIGN - 1))]
            picked.append(inside[first_best(row[inside], negatives)])
        return np.unique(np.concatenate(picked or [np.zeros(0, np.int64)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for anchor, tag, label, scored, ids, labels, row in _scored(batches, scale):
            at = wanted(label, scored, ids, labels, row, anchor)
            found.append((np.full(len(at), anchor), np.full(len(at), tag), ids[at], row[at]))
            n += len(at)
            if n >= 50_000:
                yield _rows(found)
                found, n = [], 0
        yield _rows(found)

    return run


def _pack(row) -> tuple[bytes, None]:
    kind, anchor, tag, score, vec_id = row
    return struct.pack(_KEY, anchor + _SIGN, tag + _SIGN, _SIGN - 1 - score, kind, vec_id + _SIGN), None


def _windows(low: int, high: int, negatives: int):
    def run(pairs: Iterator[tuple[bytes, None]]) -> Iterator[tuple]:
        owner, windows = None, []  # a window: its least and largest score, positive's id and score, negatives written
        for key, _ in pairs:
            anchor, tag, score, kind, vec_id = struct.unpack(_KEY, key)
            if owner != (anchor, tag):
                owner, windows = (anchor, tag), []
            score, vec_id = _SIGN - 1 - score, vec_id - _SIGN
            if kind == 0:
                windows.append([*window_ends(score, low, high), vec_id, score, 0])
                continue
            windows = [w for w in windows if w[4] < negatives and w[0] <= score]
            for w in windows:
                if score <= w[1]:
                    w[4] += 1
                    yield anchor - _SIGN, w[2], w[4], vec_id, w[3], score

    return run


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, chunk: int = CHUNK
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``vectors``: vec_id, embedding, label;
    ``is_anchor``: a condition on vec_id. Scores of a window lie between ``low`` and ``high`` per cent of the positive's, high at most 100."""
    spark = vectors.sparkSession
    if not 0 <= low <= high <= 100:
        raise ValueError("0 <= low <= high <= 100 must hold")
    rows = only(vectors, vec_id="vec_id", label="label", vector="embedding")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "vector")
    rows = staged(rows.where(f"vec_id is not null and label is not null and {finite_vector('vector')}").distinct(), "labelled")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    chunks = max(1, -(-size["n"] // max(1, min(chunk, CELLS // max(size["width"] or 1, 1)))))
    tag = F.xxhash64("vec_id", "label", "vector")
    nobody = F.lit(None).cast("array<long>")
    kept = rows.select(F.pmod(tag, F.lit(chunks)).cast("int").alias("chunk"), F.lit(0).alias("kind"), "vec_id", tag.alias("tag"), "label", "vector", nobody.alias("positives"))
    asked = rows.where(is_anchor).select("vec_id", tag.alias("tag"), "label", "vector")

    def past(anchors: DataFrame, second: bool) -> DataFrame:
        sent = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(1).alias("kind"), "vec_id", "tag", "label", "vector", "positives")
        dealt = kept.unionByName(sent).repartitionById(chunks, "chunk").sortWithinPartitions("chunk", "kind", "vec_id", "tag")
        return dealt.mapInArrow(_best(scale, low, high, positives, negatives, second), "anchor_id long, tag long, vec_id long, score long")

    first = Window.partitionBy("anchor_id", "tag").orderBy(F.desc("score"), "vec_id")
    best = past(asked.withColumn("positives", nobody), False).withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= positives).drop("_k")
    best = staged(best, "positives")
    scored = best.groupBy(F.col("anchor_id").alias("vec_id"), "tag").agg(F.collect_set("score").alias("positives"))
    found = past(asked.join(scored, ["vec_id", "tag"]), True)
    keyed = best.select(F.lit(0).alias("kind"), "anchor_id", "tag", "score", "vec_id").union(found.select(F.lit(1), "anchor_id", "tag", "score", "vec_id"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_order = keyed.rdd.map(_pack).repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:16]))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame(in_order.mapPartitions(_windows(low, high, negatives)), schema, verifySchema=False)
