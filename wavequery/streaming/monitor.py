"""ST-1: early-stopping monitor over a stream of run metrics.

``groupBy(run_id).applyInPandasWithState``: the state per run is
(best score, counter, stopped, last epoch). Within a micro-batch a run's rows
are applied in epoch order; a row whose epoch is not after the last applied
epoch is late: it is emitted with ``late = true`` and does not change the state.
Same rule as the batch form (``operators.runs``), including delta.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wavequery.schemas import DEFAULT_PATIENCE

OUTPUT_SCHEMA = (
    "run_id string, epoch bigint, val_loss double, improved boolean, best_loss double, counter int, stop boolean, late boolean"
)
STATE_SCHEMA = "best double, counter int, stopped boolean, last_epoch bigint"


def _monitor(patience: int, delta: float):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            best, counter, stopped, last_epoch = state.get
        else:
            best, counter, stopped, last_epoch = None, 0, False, None
        rows = pd.concat(list(pdfs), ignore_index=True).sort_values("epoch", kind="stable")
        out = []
        for epoch, loss in zip(rows["epoch"].tolist(), rows["val_loss"].tolist()):
            if last_epoch is not None and epoch <= last_epoch:
                out.append((key[0], epoch, loss, False, None if best is None else -best, counter, stopped, True))
                continue
            valid = loss is not None and not math.isnan(loss)
            score = -loss if valid else None
            if best is None:
                improved = valid
            else:
                improved = valid and not (score < best + delta)
            if improved:
                best, counter = score, 0
            elif best is not None:
                counter += 1
            stopped = stopped or counter >= patience
            last_epoch = epoch
            out.append((key[0], epoch, loss, improved, None if best is None else -best, counter, stopped, False))
        state.update((best, counter, stopped, last_epoch))
        yield pd.DataFrame(out, columns=["run_id", "epoch", "val_loss", "improved", "best_loss", "counter", "stop", "late"])

    return fn


def early_stop_monitor(metrics: DataFrame, patience: int = DEFAULT_PATIENCE, delta: float = 0.0) -> DataFrame:
    """Streaming (or batch) DataFrame of (run_id, epoch, val_loss) -> per-epoch monitor rows."""
    return metrics.groupBy("run_id").applyInPandasWithState(
        _monitor(patience, delta), OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )
