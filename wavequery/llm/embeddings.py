"""Near-duplicate vectors by Euclidean p-stable hashing, with exact cosine checks.

Vectors are normalised and projected on Gaussian directions; ``floor((x . a + b) / width)`` of
``hashes`` directions makes a bucket key, for each of ``tables`` tables. Vectors that share a bucket
(and a label) are compared exactly in double precision. A pair that shares several buckets counts
in the first of these tables only, so no pair list is ever shuffled: a bucket returns each vector's number of
links and a spanning forest.

Copies (equal label and vector) are compared once. A bucket of more than ``block`` vectors is dealt
out as pairs of blocks, each a task's piece of work of at most ``2 * block`` vectors.

At cosine 0.93 the chance that a pair meets is 0.998 with the default parameters, more for closer pairs.

Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label,
link with nothing. A null id takes part: its component is null unless a smaller id is reachable. Repeated rows are vectors of their own.
Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import multi_groups, only, staged
from .components import components

THRESHOLD, TABLES, HASHES, WIDTH, BLOCK, SEED = 0.93, 20, 6, 1.6, 1024, 7


def directions(dim: int, tables: int, hashes: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, tables * hashes)), rng.uniform(0, width, tables * hashes)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, by way of the largest component (no overflow)."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def bucket_keys(x: np.ndarray, tables: int, hashes: int, width: float, seed: int) -> np.ndarray:
    """One 64-bit key per row and table."""
    a, b = directions(x.shape[1], tables, hashes, width, seed)
    q = np.floor((x @ a + b) / width).astype(np.int64).reshape(len(x), tables, hashes)
    key = np.zeros((len(x), tables), dtype=np.uint64)
    for h in range(hashes):
        key = (key ^ q[:, :, h].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _hashed(tables: int, hashes: int, width: float, seed: int):
    """(node, vector) rows -> (node, keys); vectors of one length are hashed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1)
            sizes = rows.value_lengths().to_numpy()
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x = rows.take(pa.array(at)).flatten().to_numpy().reshape(len(at), dim).astype(np.float64)
                keys = bucket_keys(unit(x), tables, hashes, width, seed)
                flat = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * tables, keys.ravel())
                yield pa.record_batch([batch.column(0).take(pa.array(at)), flat], names=["node", "keys"])

    return run


def _linked(threshold: float):
    """Rows of one bucket (or pair of blocks) -> each node's link weight, and forest edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in multi_groups(batches, ["part", "label", "key", "one", "two"]):
            part, one, two = (g.column(c)[0].as_py() for c in ("part", "one", "two"))
            node, size, block = (g.column(c).to_numpy() for c in ("node", "size", "block"))
            keys = np.stack(g.column("keys").to_numpy())
            lengths = np.array([len(v) for v in g.column("vector")])
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                x = unit(np.array(g.column("vector").take(pa.array(at)).to_pylist(), dtype=np.float64))
                cos = x @ x.T
                i, j = np.nonzero(np.triu(cos >= threshold, 1))
                if one != two:  # pairs inside a block belong to that block's own group
                    cross = block[at[i]] != block[at[j]]
                    i, j = i[cross], j[cross]
                if not len(i):
                    continue
                i, j = at[i], at[j]
                first = ~(keys[i, :part] == keys[j, :part]).any(axis=1)
                i, j = i[first], j[first]
                if not len(i):
                    continue
                weight = np.bincount(i, weights=size[j], minlength=len(node)) + np.bincount(j, weights=size[i], minlength=len(node))
                a, b = _forest(i, j)
                on = np.flatnonzero(weight)
                yield pa.record_batch(
                    [
                        pa.array(np.concatenate([node[on], node[a]])),
                        pa.array(np.concatenate([node[on], node[b]])),
                        pa.array(np.concatenate([weight[on].astype(np.int64), np.zeros(len(a), np.int64)])),
                    ],
                    names=["a", "b", "links"],
                )

    return run


def _forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member) of each component of the pairs."""
    nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    root, u, v = np.arange(len(nodes)), at[: len(i)], at[len(i) :]
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH,
    block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    rows = only(vectors, vec_id="vec_id", vector="embedding", label="label")
    finite = "forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x != 0)"
    rows = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.expr(f"label is not null and vector is not null and {finite}"), F.struct(F.col("label").cast("long").alias("label"), "vector")).alias("of"),
    )
    whole = staged(rows, "vectors")
    valid = whole.where("of is not null")
    classes = valid.groupBy("of").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("size"))
    # numbers are given once, as the table is written; nothing but equality and order is asked of them
    classes = staged(classes.select(F.monotonically_increasing_id().alias("node"), "of", "of.*", "first_id", "size"), "classes")
    keyed = staged(classes.select("node", "vector").mapInArrow(_hashed(tables, hashes, width, seed), "node long, keys array<long>"), "keys")
    keyed = staged(classes.drop("of", "first_id").join(keyed, "node"), "keyed")
    spread = keyed.select("label", "node", F.posexplode("keys").alias("part", "key"))
    large = spread.groupBy("label", "part", "key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = staged(large.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n"), "large-buckets")
    entries = keyed.select("label", "node", "size", "vector", "keys", F.posexplode("keys").alias("part", "key"))
    if large.isEmpty():
        entries = entries.withColumns({"one": F.lit(0), "two": F.lit(0), "block": F.lit(0)})
    else:
        entries = entries.join(large, ["label", "part", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        entries = entries.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        entries = entries.withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)")))
        entries = entries.withColumns({"one": F.least("block", "with"), "two": F.greatest("block", "with")}).drop("with", "blocks")
    keys = ["part", "label", "key", "one", "two"]
    found = staged(
        entries.select(*keys, "node", "size", "block", "vector", "keys")
        .repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(_linked(threshold), "a long, b long, links long"),
        "links",
    )
    counts = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.where("a != b").select("a", "b"))
    nodes = classes.select("node", "of", "first_id", "size").join(counts, "node", "left").join(roots, "node", "left")
    nodes = staged(
        nodes.select("of", "first_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")),
        "nodes",
    )
    named = staged(nodes.groupBy("root").agg(F.min("first_id").alias("component_id")), "named")
    nodes = staged(nodes.join(named, "root").select("of", "n_links", "component_id"), "rooted")
    alone = whole.where("of is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    joined = valid.join(nodes, "of").select("vec_id", "n_links", "component_id")
    return joined.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
