"""Run monitoring: early stopping over an ordered loss history, loss-history union.

Early stopping (reference rule, per run in epoch order): score = -loss; the first
epoch sets ``best``; an epoch with ``score < best + delta`` increments the
counter, otherwise it becomes the new best and resets the counter; the stop flag
is sticky once ``counter >= patience``. A NaN loss is never an improvement.

With delta = 0 the best is a running maximum, so the state is three window
expressions. Any other delta makes ``best`` path-dependent: the general form
is an ordered fold, streamed over each run's sorted rows, and for delta >= 0 the fold composes
over chunks of a run (``early_stopping_chunked``), so that no task holds or streams a whole run.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavequery.schemas import DEFAULT_PATIENCE


def early_stopping(df: DataFrame, run: str = "run_id", epoch: str = "epoch", loss: str = "val_loss",
                   patience: int = DEFAULT_PATIENCE) -> DataFrame:
    """WIN-8, delta = 0: adds improved, best_loss, counter, stop."""
    w = Window.partitionBy(run).orderBy(epoch)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    score = -F.col(loss)
    valid = ~F.isnan(F.col(loss)) & F.col(loss).isNotNull()
    best_before = F.max(F.when(valid, score)).over(before)
    improved = valid & (best_before.isNull() | (score >= best_before))
    x = df.withColumn("improved", improved).withColumn("_rn", F.row_number().over(w))
    last_impr = F.max(F.when(F.col("improved"), F.col("_rn"))).over(upto)
    x = x.withColumn("counter", F.when(last_impr.isNull(), F.lit(0)).otherwise(F.col("_rn") - last_impr).cast("int"))
    x = x.withColumn("best_loss", -F.max(F.when(valid, score)).over(upto))
    x = x.withColumn("stop", F.max((F.col("counter") >= patience).cast("int")).over(upto) == 1)
    return x.drop("_rn")


_FOLDED = ["run", "epoch", "val_loss", "improved", "best_loss", "counter", "stop"]


def _fold_batches(patience: int, delta: float):
    """The reference rule over Arrow batches sorted by (run, epoch); the state of one run is carried between batches. Rows
    that bring a chunk and its state at the start (``early_stopping_chunked``) go on from there."""

    def run(batches):
        current, best, counter, stop = object(), None, 0, False
        for batch in batches:
            out = []
            for key, epoch, loss, *given in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, *given[:1]) != current:
                    current = (key, *given[:1])
                    best, counter, stop = given[1:] if given else (None, 0, False)
                valid = loss is not None and not math.isnan(loss)
                worse = best is not None and (not valid or -loss < best + delta)
                improved = valid and not worse
                if improved:
                    best, counter = -loss, 0
                elif worse:
                    counter += 1
                stop = stop or counter >= patience
                out.append((improved, None if best is None else -best, counter, stop))
            kinds = (pa.bool_(), pa.float64(), pa.int32(), pa.bool_())
            cols = [pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 4, kinds)]
            yield pa.record_batch([*batch.columns[:3], *cols], names=_FOLDED)

    return run


def _summary(losses: np.ndarray, delta: float) -> tuple[np.ndarray, ...]:
    """What a chunk does to any state that enters it. Only its records, scores not below any before them, can improve on a best
    from outside. Per record: score, place, and for the path from there the final best, the last improvement and the largest counter."""
    places = np.flatnonzero(~np.isnan(losses))
    scores = -losses[places]
    high = np.maximum.accumulate(scores)
    record = np.concatenate([[True], scores[1:] >= high[:-1]])[: len(scores)]
    scores, places = scores[record], places[record]
    m, n = len(scores), len(losses)
    after = np.maximum(np.searchsorted(scores, scores + delta), np.arange(m) + 1)  # the next improvement, m if there is none
    end, last, most = scores.copy(), places.copy(), n - 1 - places
    for i in range(m - 1, -1, -1):
        k = after[i]
        if k < m:
            end[i], last[i], most[i] = end[k], last[k], max(places[k] - places[i] - 1, most[k])
    return scores, places, end, last, most


def _summaries(delta: float):
    """One row per (run, chunk) of a stream sorted by (run, chunk, position)."""

    def run(batches):
        now, held, names = None, [], None

        def row() -> pa.RecordBatch:
            losses = np.concatenate(held)
            lists = [pa.array([x], pa.list_(k)) for x, k in zip(_summary(losses, delta), (pa.float64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))]
            return pa.record_batch([pa.array([now[0]], names), pa.array([now[1]], pa.int64()), pa.array([len(losses)], pa.int64()), *lists], names=["run", "_chunk", "n", "scores", "places", "ends", "lasts", "most"])

        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).type
            keys, chunks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            losses = batch.column(2).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)  # null as NaN
            cuts = [0, *(i for i in range(1, len(keys)) if (keys[i], chunks[i]) != (keys[i - 1], chunks[i - 1])), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if held and (keys[lo], chunks[lo]) != now:
                    yield row()
                    held.clear()
                now = keys[lo], chunks[lo]
                held.append(losses[lo:hi])
        if held:
            yield row()

    return run


def _carried(patience: int, delta: float):
    """The state at each chunk's start, from summaries sorted by (run, chunk)."""

    def run(batches):
        current, best, counter, stop = object(), None, 0, False
        for batch in batches:
            out = []
            for key, chunk, n, *lists in zip(*(c.to_pylist() for c in batch.columns)):
                if key != current:
                    current, best, counter, stop = key, None, 0, False
                out.append((key, chunk, best, counter, stop))
                scores, places, ends, lasts, most = lists
                i = 0 if best is None else int(np.searchsorted(np.array(scores), best + delta))
                if i < len(scores):
                    stop = stop or (best is not None and places[i] > 0 and counter + places[i] >= patience) or most[i] >= patience
                    best, counter = ends[i], n - 1 - lasts[i]
                elif best is not None:
                    counter += n
                    stop = stop or counter >= patience
                stop = stop or patience <= 0
            kinds = (batch.column(0).type, pa.int64(), pa.float64(), pa.int64(), pa.bool_())
            cols = [pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds)]
            yield pa.record_batch(cols, names=["run", "_chunk", "_best", "_counter", "_stop"])

    return run


def early_stopping_chunked(df: DataFrame, run: str = "run_id", epoch: str = "epoch", loss: str = "val_loss",
                           patience: int = DEFAULT_PATIENCE, delta: float = 0.0, chunk: int = 1 << 16) -> DataFrame:
    """WIN-8, delta >= 0, for runs of any length: the rows of ``early_stopping_fold``, with a run dealt over many tasks.

    1. Rows are numbered within their runs and cut into chunks of ``chunk`` epochs; each chunk is summarised on its own.
    2. The summaries, a few records per chunk, are chained per run: the state at each chunk's start.
    3. Each chunk is folded from its state. Rows are shuffled by (run, chunk) only.
    """
    from wavequery.operators.ordering import same, series_index

    if delta < 0:
        raise ValueError("chunks compose for delta >= 0 only; use early_stopping_fold")
    rows = df.select(F.col(run).alias("run"), F.col(epoch).cast("bigint").alias("epoch"), F.col(loss).cast("double").alias("val_loss"))
    kind = rows.schema["run"].dataType.simpleString()
    rows = series_index(rows, ["run"], ["epoch"], out="_t").withColumn("_chunk", F.expr(f"_t div {chunk}"))
    dealt = rows.select("run", "_chunk", "val_loss", "_t").repartition("run", "_chunk").sortWithinPartitions("run", "_chunk", "_t").drop("_t")
    lists = "scores array<double>, places array<bigint>, ends array<double>, lasts array<bigint>, most array<bigint>"
    summaries = dealt.mapInArrow(_summaries(delta), f"run {kind}, _chunk bigint, n bigint, {lists}")
    states = summaries.repartition("run").sortWithinPartitions("run", "_chunk")
    states = states.mapInArrow(_carried(patience, delta), f"run {kind}, _chunk bigint, _best double, _counter bigint, _stop boolean")
    started = same(rows, states, ["run", "_chunk"]).repartition("run", "_chunk").sortWithinPartitions("run", "_chunk", "_t")
    folded = started.select("run", "epoch", "val_loss", "_chunk", "_best", "_counter", "_stop").mapInArrow(
        _fold_batches(patience, delta), f"run {kind}, epoch bigint, val_loss double, improved boolean, best_loss double, counter int, stop boolean"
    )
    return folded.withColumnRenamed("run", run)


def early_stopping_fold(df: DataFrame, run: str = "run_id", epoch: str = "epoch", loss: str = "val_loss",
                        patience: int = DEFAULT_PATIENCE, delta: float = 0.0) -> DataFrame:
    """WIN-8, any delta: ordered fold per run; one output row per (run, epoch).

    The rule is sequential within a run. Runs are dealt to tasks, sorted, and streamed: time is linear
    in the epochs and only the running state is held, so no length needs a bound.
    """
    rows = df.select(F.col(run).alias("run"), F.col(epoch).cast("bigint").alias("epoch"), F.col(loss).cast("double").alias("val_loss"))
    kind = rows.schema["run"].dataType.simpleString()
    folded = rows.repartition("run").sortWithinPartitions("run", "epoch").mapInArrow(
        _fold_batches(patience, delta), f"run {kind}, epoch bigint, val_loss double, improved boolean, best_loss double, counter int, stop boolean"
    )
    return folded.withColumnRenamed("run", run)


def loss_history(train: DataFrame, valid: DataFrame, step: str = "step", loss: str = "loss") -> DataFrame:
    """SET-2 + SET-4: train and validation histories on one axis, tagged by split."""
    return train.select(F.lit("train").alias("split"), "*").unionByName(valid.select(F.lit("valid").alias("split"), "*"))
