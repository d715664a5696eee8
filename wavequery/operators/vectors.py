"""Vector operators: flatten, normalise, in-batch cosine, similarity-vs-score error, prototype blend.

In-batch cosine sums Gram matrices over blocks of dimensions (a batch has a fixed size B, so the pair count is n * B, never a
data-dependent square) and yields one row of B similarities per vector.

The prototype blend attends every vector to a prototype set. Instead of a cross join, prototypes are
broadcast in blocks of checked bytes; each Arrow batch of vectors does the attention as numpy matrix
products, and the blocks' softmax states are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavequery.functions import l2_norm, normalize
from wavequery.operators.ordering import with_positions
from wavequery.session import written

# Scores held at once inside a task of the prototype blend.
CHUNK_BYTES = 64 << 20


def flatten_matrix(df: DataFrame, col: str, out: str = "vec") -> DataFrame:
    """VEC-1: array<array<double>> (e.g. patches x features) -> one flat vector."""
    return df.withColumn(out, F.flatten(col))


def normalize_vectors(df: DataFrame, col: str = "embedding", out: str = "unit") -> DataFrame:
    """VEC-2: L2 norm and unit vector (zero vector -> nulls)."""
    return df.withColumn("norm", l2_norm(col)).withColumn(out, normalize(col))


#: Components of a vector that stand in one row while a batch's products are summed.
BLOCK_WIDTH = 4096
#: Similarities of finished batches that are put out at once.
CELLS = 1 << 20


def cosine_rows(df: DataFrame, col: str = "embedding", batch: str = "batch_id", idx: str = "idx", width: int = BLOCK_WIDTH) -> DataFrame:
    """VEC-3, one row per vector: (batch_id, i, js, sims) over the batch's vectors in ``idx`` order.

    Vectors are cut into blocks of ``width`` dimensions. A batch's blocks follow each other in one sorted partition, and the Gram
    matrix (B x B, a fixed size) is the sum of one numpy product per block: neither a row nor a task ever holds a batch of whole
    vectors. A similarity is null if a vector is null, zero, has a null component, or another length.
    """
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.coalesce(F.size(col), F.lit(0)) / width).cast("int") - 1)))
    whole = F.when(~F.exists(F.col(col), lambda x: x.isNull()), F.col(col).cast("array<double>"))
    cut = df.select(batch, F.col(idx).alias("i"), whole.alias("_v"), at.alias("_block"))
    cut = cut.select(batch, "_block", "i", F.slice("_v", F.col("_block") * width + 1, width).alias("_x"), F.size("_v").alias("_n"))
    sorted_blocks = cut.repartition(batch).sortWithinPartitions(batch, "_block", "i")
    kinds = {c: cut.schema[c].dataType.simpleString() for c in (batch, "i")}
    return sorted_blocks.mapInArrow(_gram(batch), f"`{batch}` {kinds[batch]}, i {kinds['i']}, js array<{kinds['i']}>, sims array<double>")


def _gram(batch: str):
    """Sums the Gram matrices of a batch's blocks in a stream sorted by (batch, block, i)."""

    def run(batches):
        held: list[tuple] = []  # slices of the block being read: lengths, components, whole lengths, i
        state: dict = {}
        done: list[tuple] = []  # batches whose similarities are not yet put out
        cells = 0  # of these

        def add() -> None:
            size, flat, total = (np.concatenate([h[k] for h in held]) if len(held) > 1 else held[0][k] for k in range(3))
            i = pa.concat_arrays([h[3] for h in held]) if len(held) > 1 else held[0][3]
            held.clear()
            width = int(size.max(initial=0))
            if len(flat) == width * len(size):
                x = flat.reshape(len(size), width)
            else:
                x = np.zeros((len(size), width))
                x[np.arange(width) < size[:, None]] = flat
            if "i" not in state:
                state.update(i=i, total=total, gram=x @ x.T)
                return
            # vectors that end before this block are not in it
            places = {v: k for k, v in enumerate(state["i"].to_pylist())}
            there = np.array([places[v] for v in i.to_pylist()])
            state["gram"][np.ix_(there, there)] += x @ x.T

        def finish(key) -> bool:
            nonlocal cells
            gram, total, i = state["gram"], state["total"], state["i"]
            b = len(total)
            norm = np.sqrt(np.diag(gram))
            with np.errstate(divide="ignore", invalid="ignore"):
                sims = gram / np.outer(norm, norm)
            null = (total[:, None] != total) | ~(total >= 0)[:, None] | (norm == 0)[:, None] | (norm == 0)
            state.clear()
            done.append((key, i, b, sims.ravel(), null.ravel()))
            cells += b * b
            return cells >= CELLS

        def put_out() -> pa.RecordBatch:
            """The batches done so far in one Arrow batch: one for each of them costs more to pass on than to work out."""
            nonlocal cells
            sizes = np.array([x[2] for x in done])
            ends = pa.array(np.concatenate([[0], np.cumsum(np.repeat(sizes, sizes))]), pa.int32())
            i = pa.concat_arrays([x[1] for x in done])
            others = [np.tile(np.arange(hi - b, hi), b) for hi, b in zip(np.cumsum(sizes), sizes)]
            js = pa.ListArray.from_arrays(ends, i.take(pa.array(np.concatenate(others))))
            sims = pa.array(np.concatenate([x[3] for x in done]), pa.float64(), mask=np.concatenate([x[4] for x in done]))
            keys = pa.array([x[0] for x in done], kind).take(pa.array(np.repeat(np.arange(len(done)), sizes)))
            out = pa.record_batch([keys, i, js, pa.ListArray.from_arrays(ends, sims)], names=[batch, "i", "js", "sims"])
            done.clear()
            cells = 0
            return out

        now = kind = None
        for piece in batches:
            if not piece.num_rows:
                continue
            names, block, x, ids = piece.column(batch), piece.column("_block").to_numpy(), piece.column("_x"), piece.column("i")
            kind = names.type
            # the piece's components once for all its batches
            size = np.nan_to_num(x.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            flat, at = x.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])
            total = piece.column("_n").to_numpy(zero_copy_only=False).astype(float)
            coded = names.dictionary_encode(null_encoding="encode").indices.to_numpy()
            cuts = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (coded[1:] != coded[:-1])) + 1).tolist(), piece.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                mark = (names[lo].as_py(), int(block[lo]))
                if held and mark != now:
                    add()
                if state and mark[0] != now[0] and finish(now[0]):
                    yield put_out()
                held.append((size[lo:hi], flat[at[lo] : at[hi]], total[lo:hi], ids.slice(lo, hi - lo)))
                now = mark
        if held:
            add()
            finish(now[0])
        if done:
            yield put_out()

    return run


def batch_cosine(df: DataFrame, col: str = "embedding", batch: str = "batch_id", idx: str = "idx") -> DataFrame:
    """VEC-3: (batch_id, i, j, sim) for every ordered pair inside a batch, including i = j."""
    cells = cosine_rows(df, col, batch, idx).select(batch, "i", F.explode(F.arrays_zip("js", "sims")).alias("_c"))
    return cells.select(batch, "i", F.col("_c.js").alias("j"), F.col("_c.sims").alias("sim"))


def similarity_mse(sim: DataFrame, scores: DataFrame, batch: str = "batch_id") -> DataFrame:
    """JN-4 + AGG-14: per batch, mean squared difference of similarity and score cells."""
    cells = sim.join(scores.select(batch, "i", "j", "score"), [batch, "i", "j"])
    return cells.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n_cells"), F.avg(F.pow(F.col("sim") - F.col("score"), 2)).alias("sim_mse")
    )


def similarity_mse_rows(sims: DataFrame, scores: DataFrame, batch: str = "batch_id") -> DataFrame:
    """JN-4 + AGG-14 on row vectors (``cosine_rows`` and ``pair_score_rows`` of the same batches): one row
    per example is shuffled, never a cell. Cells without a similarity (zero vector) stay out of the mean."""
    rows = sims.join(scores.select(batch, "i", "scores"), [batch, "i"])
    fits = F.size("sims") == F.size("scores")
    squares = F.filter(F.zip_with("sims", "scores", lambda a, b: F.pow(a - b, 2)), lambda x: x.isNotNull())
    squares = F.when(fits, squares).otherwise(F.raise_error(F.lit("similarity and score rows differ in length")))
    per_row = rows.select(batch, F.size("scores").cast("bigint").alias("_n"), squares.alias("_sq"))
    per_row = per_row.select(batch, "_n", F.size("_sq").alias("_k"), F.aggregate("_sq", F.lit(0.0), lambda acc, x: acc + x).alias("_s"))
    return per_row.groupBy(batch).agg(F.sum("_n").alias("n_cells"), F.try_divide(F.sum("_s"), F.sum("_k").cast("double")).alias("sim_mse"))


def combined_loss(a, b, weight: float = 0.5):
    """PRJ-11: weight * a + (1 - weight) * b (the reference uses 0.5 / 0.5)."""
    ca = F.col(a) if isinstance(a, str) else a
    cb = F.col(b) if isinstance(b, str) else b
    return F.lit(weight) * ca + F.lit(1.0 - weight) * cb


def mean_of_batches(per_batch: DataFrame, loss: str) -> DataFrame:
    """AGG-13: unweighted mean of per-batch losses (a batch counts once whatever its size)."""
    return per_batch.agg(F.avg(loss).alias(f"mean_{loss}"), F.count(F.lit(1)).alias("n_batches"))


def with_mean_of_batches(per_batch: DataFrame, loss: str | list[str], count: str, batch: str = "batch_id") -> DataFrame:
    """Per-batch rows (level 0) plus the AGG-13 mean over batches (level 1, batch null) in one rollup.

    ``count`` is the batch's cell count on level 0 and the number of batches on level 1.
    One aggregation over the per-batch table, so the plan that produced it runs once.
    """
    gid = F.grouping_id()
    return per_batch.rollup(batch).agg(
        gid.cast("int").alias("level"),
        F.when(gid == 0, F.sum(count)).otherwise(F.count(F.lit(1))).alias(count),
        *[F.avg(x).alias(x) for x in ([loss] if isinstance(loss, str) else loss)],
    )


def mean_prototypes(df: DataFrame, group: str = "label", col: str = "embedding") -> DataFrame:
    """Prototype per group: the dimension-wise mean vector (posexplode + partial aggregate + repack per group)."""
    long = df.select(group, F.posexplode(col).alias("d", "x"))
    means = long.groupBy(group, "d").agg(F.avg("x").alias("m"))
    return means.groupBy(group).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("proto")
    )


def _attend(block, col: str, n_heads: int, weights: bool):
    """The softmax state of Arrow batches of vectors over one block of prototypes: per head the maximum, the mass and the weighted sum."""

    def run(batches):
        k, v = block.value
        wk, wv = k.shape[1] // n_heads, v.shape[1] // n_heads
        step = max(1, CHUNK_BYTES // (8 * max(1, len(k)) * n_heads))
        for pdf in batches:
            for lo in range(0, len(pdf), step):
                part = pdf.iloc[lo : lo + step].copy()
                there = part[col].notna().to_numpy()
                q = np.zeros((len(part), k.shape[1]))
                if there.any():
                    q[there] = np.stack([np.asarray(x, dtype=np.float64) for x in part[col][there]])
                top, mass, acc, raw = np.empty((len(part), n_heads)), np.empty((len(part), n_heads)), np.empty((len(part), v.shape[1])), []
                for h in range(n_heads):
                    s = q[:, h * wk : (h + 1) * wk] @ k[:, h * wk : (h + 1) * wk].T * softmax_scale(wk)
                    top[:, h] = s.max(axis=1)
                    e = np.exp(s - top[:, h, None])
                    mass[:, h] = e.sum(axis=1)
                    acc[:, h * wv : (h + 1) * wv] = e @ v[:, h * wv : (h + 1) * wv]
                    raw.append(s)
                part["_top"], part["_mass"], part["_acc"] = list(top), list(mass), list(acc)
                if weights:
                    part["_raw"] = [[raw[h][r].tolist() for h in range(n_heads)] for r in range(len(part))]
                yield part

    return run


def _merged(partial: DataFrame, n_heads: int, weights: bool) -> DataFrame:
    """One state per row from those of the blocks, in one aggregation: with M the largest maximum of a head, masses and weighted sums are
    scaled by exp(maximum - M) and added; raw scores are put together in the blocks' order."""
    gathered = partial.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_block", "_top", "_mass", "_acc", *(["_raw"] if weights else [])))).alias("_p"))
    heads = F.array(*[F.lit(h) for h in range(n_heads)])
    top = F.transform(heads, lambda h: F.array_max(F.transform("_p", lambda p: F.get(p["_top"], h))))
    gathered = gathered.withColumn("_top", top)
    shrink = lambda p, h: F.exp(F.get(p["_top"], h) - F.get("_top", h))
    add = lambda f: F.aggregate(F.transform("_p", f), F.lit(0.0), lambda a, x: a + x)
    width = F.size(F.get("_p", F.lit(0))["_acc"])
    head_of = lambda d: F.floor(d * n_heads / width).cast("int")
    out = gathered.select(
        "_row", "_top",
        F.transform(heads, lambda h: add(lambda p: F.get(p["_mass"], h) * shrink(p, h))).alias("_mass"),
        F.transform(F.sequence(F.lit(0), width - 1), lambda d: add(lambda p: F.get(p["_acc"], d) * shrink(p, head_of(d)))).alias("_acc"),
        *([F.transform(heads, lambda h: F.flatten(F.transform("_p", lambda p: F.get(p["_raw"], h)))).alias("_raw")] if weights else []),
    )
    return out


def prototype_blend(df: DataFrame, prototypes: DataFrame, n_heads: int, col: str = "embedding", proto_key: str = "label",
                    proto_col: str = "proto", max_prototypes: int | None = None, value_col: str | None = None,
                    weights: bool = True, block_bytes: int = 64 << 20) -> DataFrame:
    """VEC-4 + PRJ-13: per head h, weights = softmax(q_h . k_h / sqrt(E)) over prototypes; out_h = sum w * v_h.

    Keys are ``proto_col``, values ``value_col`` (the keys, if not given), ordered by ``proto_key``.
    Adds ``blend`` array<double> (heads concatenated) and, with ``weights``, ``weights``
    array<array<double>> ([head][prototype]) and ``proto_keys`` (the prototype order); a null vector and an
    empty prototype table give nulls.

    Dense attention is a matrix product per Arrow batch. Prototypes are broadcast in blocks of at most ``block_bytes``, one
    at a time. The softmax over a block is a small state (maximum, mass, weighted sum) that merges with those of other blocks: beyond one
    block, the vectors are written once, each block's states are written beside them, and one aggregation merges
    these, so any number of prototypes gives the same result. ``max_prototypes`` is a caller's own limit.
    """
    value_col = value_col or proto_col
    shape = prototypes.agg(F.count(F.lit(1)), F.min(F.size(proto_col)), F.max(F.size(proto_col)), F.min(F.size(value_col)), F.max(F.size(value_col)))
    n, k_min, k_max, v_min, v_max = shape.first()
    if max_prototypes is not None and n > max_prototypes:
        raise ValueError(f"{n} prototypes exceed max_prototypes={max_prototypes}")
    nulls = {"weights": "array<array<double>>", "blend": "array<double>"}
    if not n:
        out = df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in nulls.items() if weights or c == "blend"])
        return out.withColumn("proto_keys", F.array().cast(T.ArrayType(prototypes.schema[proto_key].dataType))) if weights else out
    if k_min != k_max or v_min != v_max or k_max < 1 or v_max < 1:
        raise ValueError("prototypes differ in dimension or lack one")
    if k_max % n_heads or v_max % n_heads:
        raise ValueError(f"{n_heads} heads do not divide the dimensions {k_max} and {v_max}")
    step = max(1, block_bytes // (8 * (k_max + v_max)))
    listed = prototypes.select(F.col(proto_key).alias("key"), F.col(proto_col).alias("k"), F.col(value_col).alias("v"))
    state = "_top array<double>, _mass array<double>, _acc array<double>" + ", _raw array<array<double>>" * weights
    empty = [F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in state.split(", "))]
    keys = []

    def over(vectors: DataFrame, part: DataFrame) -> DataFrame:
        rows = part.orderBy("key").collect()  # at most block_bytes
        if weights:
            keys.extend(r["key"] for r in rows)
        block = df.sparkSession.sparkContext.broadcast(tuple(np.array([r[c] for r in rows], dtype=np.float64) for c in ("k", "v")))
        found = vectors.select("*", *empty)
        return found.mapInPandas(_attend(block, col, n_heads, weights), found.schema)

    if n <= step:
        states = over(df, listed)
    else:
        listed = with_positions(listed, ["key"], pos="pos").df
        vectors = written(df.withColumn("_row", F.monotonically_increasing_id()), "vectors")  # once, with their numbers
        partial = None
        for lo in range(0, n, step):
            found = over(vectors.select("_row", col), listed.where((F.col("pos") >= lo) & (F.col("pos") < lo + step)))
            found = written(found.drop(col).withColumn("_block", F.lit(lo)), "states")
            partial = found if partial is None else partial.unionByName(found)
        states = vectors.join(_merged(partial, n_heads, weights), "_row").drop("_row")
    width = v_max // n_heads
    share = lambda raw, h: F.transform(raw, lambda s: F.exp(s - F.get("_top", h)) / F.get("_mass", h))
    blend = F.transform("_acc", lambda x, d: x / F.get("_mass", F.floor(d / width).cast("int")))
    there = F.col(col).isNotNull()
    out = states.withColumn("blend", F.when(there, blend))
    if weights:
        out = out.withColumn("weights", F.when(there, F.transform("_raw", share)))
        out = out.withColumn("proto_keys", F.array(*[F.lit(x).cast(prototypes.schema[proto_key].dataType) for x in keys]))
    return out.select(*df.columns, *(["weights"] if weights else []), "blend", *(["proto_keys"] if weights else []))


def softmax_scale(e: int) -> float:
    """PRJ-13: 1 / sqrt(E)."""
    return 1.0 / math.sqrt(e)


__all__ = [
    "flatten_matrix",
    "normalize_vectors",
    "batch_cosine",
    "cosine_rows",
    "similarity_mse",
    "similarity_mse_rows",
    "combined_loss",
    "mean_of_batches",
    "mean_prototypes",
    "prototype_blend",
    "softmax_scale",
]
