"""Exact top-k inner products by MaxScore over sharded postings.

Vectors become integers, ``floor(scale * x)``. In a shard, each dimension is a term; its posting list holds the
shard's weights. A term's impact is its contribution above the least one in the shard: never negative, and
bounded by the ends of the list. For a query the terms are ordered by that bound. The vectors at
the heads of the first lists are scored, and the k-th best of them gives the threshold. Terms whose bounds
together stay below the threshold are non-essential: a vector without impact in the essential postings cannot enter.
Essential postings are traversed for the whole shard, a few terms at a time; the others are probed for those vectors only
whose partial score and the remaining bounds are competitive. Shards return k rows a query, which are merged.

Scores are exact: a table whose largest component, squared and times the dimensions, passes 2**62 is refused (OverflowError), since a product
might not fit 64 bits. Ties go to the smaller id. Vectors that are null or hold null or non-finite components take no part, nor do rows with
a null id; an empty vector scores zero. Missing components of a shorter vector count as zero. Rows that share an id are one candidate with the best of their scores, and
an id's own rows are no candidates of its query. Empty tables and tables without queries give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, staged

SCALE, TOP, SHARD, QUERIES = 256, 5, 8192, 2048
_LISTS, _TERMS = 8, 8  # lists whose heads give the first threshold; terms taken between two looks at the bounds


class Shard:
    """Postings of one shard: a row of weights per term, and the vectors at either end of each list."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, heads: int = 32):
        self.ids = ids
        columns = np.ascontiguousarray(weights.T)
        self.low, self.high = columns.min(axis=1), columns.max(axis=1)
        order = np.argsort(columns, axis=1, kind="stable")
        self.first, self.last = order[:, :heads], order[:, -heads:]
        # sums of products below 2**53 are exact in doubles, whose products are faster
        self.exact = int(np.abs(columns).max(initial=0)) ** 2 * len(columns) < 2**52
        self.columns = columns.astype(np.float64) if self.exact else columns

    def search(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (ids, scores) of this shard for one query, ties to the smaller id."""
        lo = np.where(q >= 0, q * self.low, q * self.high)  # the least contribution of each term
        bound = np.where(q >= 0, q * self.high, q * self.low) - lo  # its largest impact
        order = np.argsort(-bound, kind="stable")
        rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])  # rest[t]: bounds of terms t, t + 1, ...
        below = np.concatenate([np.cumsum(lo[order][::-1])[::-1], [0]])  # the same of their least contributions
        if self.exact and int(np.abs(q).max(initial=0)) * int(np.abs(self.columns).max(initial=0)) * len(q) < 2**53:
            w = q.astype(np.float64)
        else:
            w = q
        heads = [self.last[d] if q[d] >= 0 else self.first[d] for d in order[:_LISTS]]
        seed = np.unique(np.concatenate(heads))
        seed = seed[self.ids[seed] != own]
        scores = w @ self.columns[:, seed]
        _, one = np.unique(self.ids[seed], return_index=True)  # rows of one id count once for the threshold
        floor = np.partition(scores[one], len(one) - k)[len(one) - k] if len(one) >= k else None
        essential = len(order)
        if floor is not None:  # the fewest terms after which the others' bounds stay below the threshold
            total = rest + below[0]
            essential = int(np.searchsorted(-total, -floor, side="right"))
        alive, part = None, np.zeros(len(self.ids), dtype=w.dtype)
        for t in range(0, len(order), _TERMS):
            d = order[t : t + _TERMS]
            if alive is None:
                part = part + w[d] @ self.columns[d]
            else:
                part = part + w[d] @ self.columns[d[:, None], alive]
            if floor is not None and t + len(d) >= min(essential, len(order) // 2):
                far = part + (rest[min(t + _TERMS, len(order))] + below[min(t + _TERMS, len(order))])
                good = far >= floor
                if good.sum() < 0.7 * len(good):
                    alive = np.flatnonzero(good) if alive is None else alive[good]
                    part = part[good]
        ids = self.ids if alive is None else self.ids[alive]
        other = ids != own
        ids, part = ids[other], part[other]
        if len(ids) > k:
            near = part >= np.partition(part, len(part) - k)[len(part) - k]
            if len(np.unique(ids[near])) >= k:
                ids, part = ids[near], part[near]
        top = np.lexsort((ids, -part))
        _, one = np.unique(ids[top], return_index=True)  # rows of one id: the best counts
        top = top[np.sort(one)][:k]
        return ids[top], part[top].astype(np.int64)


def _search(k: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.column("vector").combine_chunks()
        lengths = rows.value_lengths().to_numpy()
        dim = int(lengths.max(initial=1))
        x = np.zeros((len(lengths), dim), dtype=np.int64)
        x[np.arange(dim) < lengths[:, None]] = rows.flatten().to_numpy()
        ids, query = table.column("vec_id").to_numpy(), table.column("is_query").to_numpy()
        out: list[tuple[np.ndarray, ...]] = []
        if (~query).any():
            shard = Shard(ids[~query], x[~query])
            for own, q in zip(ids[query].tolist(), x[query]):
                found, scores = shard.search(own, q, k)
                out.append((np.full(len(found), own, dtype=np.int64), found, scores))
        cols = [np.concatenate([o[i] for o in out] or [np.zeros(0, np.int64)]) for i in range(3)]
        return pa.table(cols, names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, is_query: Column, k: int = TOP, scale: int = SCALE, shard: int = SHARD, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score. ``is_query``: a condition on vec_id."""
    rows = only(vectors, vec_id="vec_id", vector="embedding").withColumn("vec_id", F.col("vec_id").cast("long"))
    finite = "vec_id is not null and vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    whole = rows.where(finite).select(
        "vec_id", F.transform("vector", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector"), is_query.alias("is_query")
    )
    size = rows.where(finite).agg(F.max(F.array_max(F.transform("vector", lambda x: F.abs(F.floor(x.cast("double") * scale).cast("double"))))), F.max(F.size("vector"))).first()
    if (size[0] or 0.0) ** 2 * (size[1] or 0) >= 2**62:
        raise OverflowError("inner products of floor(scale * x) may not fit 64 bits")
    whole = staged(whole.distinct(), "integers")
    n = whole.agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
    shards, blocks = max(1, -(-n["n"] // shard)), max(1, -(-n["q"] // queries))
    # each block of queries meets each shard once; a group holds one of either
    mine = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards))
    block = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    kept = whole.select("vec_id", "vector", F.lit(False).alias("is_query"), mine.cast("int").alias("shard")).withColumn("block", every(blocks))
    asked = whole.where("is_query").select("vec_id", "vector", "is_query", block.cast("int").alias("block")).withColumn("shard", every(shards))
    found = kept.unionByName(asked).groupBy("block", "shard").applyInArrow(_search(k), "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
