"""Question/answer preparation: lookup, batching, in-batch answer agreement.

Plan shape of ``pair_scores`` (the centre of the reference):

    batched -> group by batch_id: questions (set), columns (j, record)    one exchange, bounded by B
            -> explode both -> probe (batch, q, j, record)                   ~ n * |Q_b| rows
    probe LEFT JOIN lookup ON (q, record)                                    one shuffle on the probe key
          -> group by (batch, q): looked-up answers as a vector over j      bounded by B
    rows (batch, i, q, answer) -> group by (batch, q): rows as a vector over i    bounded by B
          JOIN vectors ON (batch, q)                                         one row per batch and question
          -> one matrix product per row: scores of its rows over j; posexplode -> B^2 cells    generated last, never shuffled

The lookup is probed once per (batch, question, column), not once per cell, so
the shuffled volume is ~B times smaller than probing the B^2 cells. The lookup
side is unique per key, so a hot (question, record) key only skews the probe
side, which AQE's skew-join handling splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavequery.operators.ordering import Numbered


def lookup_last_wins(df: DataFrame, question: str = "question", record: str = "record_id", seq: str = "seq", answer: str = "answer") -> DataFrame:
    """AGG-1: (question, record) -> answer of the *last* row in file order; partial-aggregated ``max_by``."""
    return df.groupBy(question, record).agg(
        F.max_by(answer, seq).alias(answer), F.count(F.lit(1)).alias("n_rows"), F.max(seq).alias("last_seq")
    )


def assign_batches(numbered: Numbered, batch_size: int, drop_last: bool = True, pos: str = "pos") -> DataFrame:
    """WIN-1 + FLT-3: consecutive runs of ``batch_size`` in position order; optionally drop the short tail.

    The total is known from the numbering step, so drop-last is a literal filter (no window).
    """
    df = numbered.df
    if drop_last:
        keep = (numbered.total // batch_size) * batch_size
        df = df.where(F.col(pos) < keep)
    return df.withColumn("batch_id", F.expr(f"{pos} div {batch_size}")).withColumn("idx", (F.col(pos) % batch_size).cast("int"))


def pair_score_rows(
    batched: DataFrame,
    lookup: DataFrame,
    question: str = "question",
    record: str = "record_id",
    answer: str = "answer",
) -> DataFrame:
    """One row per (batch_id, i): ``scores`` and ``known`` arrays over the batch's columns j (in j order).

    Cell (i, j): if (question of row i, record of column j) is in the lookup, Dice of
    row i's answer and the looked-up answer (this overrides the diagonal); else 1 on
    the diagonal, 0 elsewhere. The looked-up answers and the rows are gathered per (batch, question)
    into vectors (bounded by B), so neither cells nor copies of a vector are shuffled; the cells of a
    (batch, question) are one product of matrices over the answers' elements (``_agreement``).
    """
    # one aggregation per batch (bounded: B columns, <= B questions) gives the probe set
    per_batch = batched.groupBy("batch_id").agg(
        F.collect_set(question).alias("_qs"),
        F.collect_list(F.struct(F.col("idx").alias("j"), F.col(record).alias("_rid"))).alias("_cols"),
    )
    probe = (
        per_batch.select("batch_id", F.explode("_qs").alias("_q"), "_cols")
        .select("batch_id", "_q", F.explode("_cols").alias("_c"))
        .select("batch_id", "_q", "_c.j", "_c._rid")
    )
    lk = lookup.select(F.col(question).alias("_q"), F.col(record).alias("_rid"), F.col(answer).alias("_la"))
    probed = probe.join(lk, ["_q", "_rid"], "left")
    vectors = probed.groupBy("batch_id", "_q").agg(F.sort_array(F.collect_list(F.struct("j", "_la"))).alias("_v"))
    rows = batched.select("batch_id", F.col("idx").alias("i"), F.col(question).alias("_q"), F.col(answer).alias("_gt"))
    rows = rows.groupBy("batch_id", "_q").agg(F.collect_list(F.struct("i", "_gt")).alias("_rows"))
    joined = rows.join(vectors, ["batch_id", "_q"]).select("batch_id", "_rows", "_v")
    kinds = {c: batched.schema[c].dataType.simpleString() for c in ("batch_id", "idx")}
    return joined.mapInArrow(_agreement, f"batch_id {kinds['batch_id']}, i {kinds['idx']}, scores array<double>, known array<boolean>")


#: Cells of the batches that ``_agreement`` puts out at once.
CELLS = 1 << 20


def _agreement(batches):
    """Score rows of Arrow batches of (batch_id, rows, columns): common elements by a product of 0/1 matrices over the elements both sides have."""
    for piece in batches:
        rows, cols = piece.column("_rows"), piece.column("_v")
        sizes = np.cumsum(rows.value_lengths().to_numpy().astype(np.int64) * cols.value_lengths().to_numpy())
        lo = 0
        while lo < piece.num_rows:
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + CELLS, side="right")))
            yield _score_rows(piece.column("batch_id").slice(lo, hi - lo), rows.slice(lo, hi - lo), cols.slice(lo, hi - lo))
            lo = hi


def _elements(answers: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the answers, where their elements begin, and which are null."""
    sizes = pc.fill_null(answers.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, np.concatenate([[0], np.cumsum(sizes)]), answers.is_null().to_numpy(zero_copy_only=False)


def _score_rows(batch: pa.Array, rows: pa.ListArray, cols: pa.ListArray) -> pa.RecordBatch:
    n_rows, n_cols = (x.value_lengths().to_numpy().astype(np.int64) for x in (rows, cols))
    i, truth = pc.struct_field(rows.flatten(), "i"), pc.struct_field(rows.flatten(), "_gt")
    j, found = pc.struct_field(cols.flatten(), "j"), pc.struct_field(cols.flatten(), "_la")
    (len_r, at_r, null_r), (len_c, at_c, null_c) = _elements(truth), _elements(found)
    coded = pa.concat_arrays([truth.flatten(), found.flatten()]).dictionary_encode(null_encoding="encode").indices.to_numpy()
    codes_r, codes_c = coded[: at_r[-1]], coded[at_r[-1] :]
    of_r, of_c = np.repeat(np.arange(len(len_r)), len_r), np.repeat(np.arange(len(len_c)), len_c)
    is_i, is_j = i.to_numpy(zero_copy_only=False), j.to_numpy(zero_copy_only=False)
    scores, known, nulls = [], [], []
    end_r, end_c = np.cumsum(n_rows), np.cumsum(n_cols)
    for r0, r1, c0, c1 in zip(end_r - n_rows, end_r, end_c - n_cols, end_c):
        r, c = slice(r0, r1), slice(c0, c1)
        in_r, in_c = slice(at_r[r0], at_r[r1]), slice(at_c[c0], at_c[c1])
        both = np.intersect1d(codes_r[in_r], codes_c[in_c])
        marks = []
        for codes, of, n in ((codes_r[in_r], of_r[in_r] - r0, r1 - r0), (codes_c[in_c], of_c[in_c] - c0, c1 - c0)):
            place = np.searchsorted(both, codes)
            hit = np.flatnonzero(place < len(both))
            hit = hit[both[place[hit]] == codes[hit]]
            mark = np.zeros((n, len(both)))
            mark[of[hit], place[hit]] = 1.0
            marks.append(mark)
        total = (len_r[r, None] + len_c[c]).astype(float)
        there = np.broadcast_to(~null_c[c], total.shape)
        with np.errstate(divide="ignore", invalid="ignore"):
            dice = marks[0] @ marks[1].T * 2.0 / total
        scores.append(np.where(there, dice, is_i[r, None] == is_j[c]).ravel())
        nulls.append((there & (null_r[r, None] | (total == 0))).ravel())
        known.append(there.ravel())
    ends = pa.array(np.concatenate([[0], np.cumsum(np.repeat(n_cols, n_rows))]), pa.int32())
    scores = pa.array(np.concatenate(scores), pa.float64(), mask=np.concatenate(nulls))
    lists = [pa.ListArray.from_arrays(ends, x) for x in (scores, pa.array(np.concatenate(known)))]
    return pa.record_batch([batch.take(pa.array(np.repeat(np.arange(len(batch)), n_rows))), i, *lists], names=["batch_id", "i", "scores", "known"])


def pair_scores(
    batched: DataFrame,
    lookup: DataFrame,
    question: str = "question",
    record: str = "record_id",
    answer: str = "answer",
) -> DataFrame:
    """JN-1 + JN-2 + FLT-1/2 + PRJ-10 + SET-1: (batch_id, i, j, score, known).

    The B x B cells are generated last, by exploding each row's vector: no cell is shuffled.
    """
    rows = pair_score_rows(batched, lookup, question, record, answer)
    cells = rows.select("batch_id", "i", F.posexplode(F.arrays_zip("scores", "known")).alias("j", "_x"))
    return cells.select("batch_id", "i", F.col("j").cast("int").alias("j"), F.col("_x.scores").alias("score"),
                        F.col("_x.known").alias("known"))


def matrix_from_rows(rows: DataFrame) -> DataFrame:
    """AGG-15 from row vectors: (batch_id, matrix) with rows in i order (B rows per batch)."""
    return rows.groupBy("batch_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "scores"))), lambda s: s["scores"]).alias("matrix")
    )


def score_matrix(pairs: DataFrame) -> DataFrame:
    """AGG-15: cells -> (batch_id, matrix array<array<double>>), rows by i, columns by j (B bounded)."""
    rows = pairs.groupBy("batch_id", "i").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("j", "score"))), lambda s: s["score"]).alias("row")
    )
    return rows.groupBy("batch_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "row"))), lambda s: s["row"]).alias("matrix")
    )


def batch_columns(batched: DataFrame, cols: list[str]) -> DataFrame:
    """AGG-16: one row per batch, each requested column as an array in ``idx`` order (B bounded)."""
    packed = batched.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("idx", *cols))).alias("_rows"))
    return packed.select("batch_id", *[F.transform("_rows", _field(c)).alias(c) for c in cols])


def _field(name: str):
    return lambda s: s[name]


def collate_batches(batched: DataFrame, cols: list[str], hook=None) -> DataFrame:
    """UDF-1: the batch hook. Rows -> one row per batch (AGG-16), then ``hook(df) -> df``
    (``DataFrame.transform``), so a user's collate step stays a Spark plan."""
    packed = batch_columns(batched, cols)
    return packed.transform(hook) if hook is not None else packed


def example_at(ordered: DataFrame, k: int, pos: str = "pos") -> DataFrame:
    """UDF-2: random access by position (a filter on the numbered rows; no collect)."""
    return ordered.where(F.col(pos) == k)
