"""Run a streaming query to completion over staged files (``availableNow``) and read its sink.

Staging and sinks live in a fresh folder under the session's checkpoint
directory (the shared folder), never in a machine-local temporary path.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from wavequery.session import checkpoint_dir


def scratch(spark: SparkSession, tag: str) -> str:
    base = checkpoint_dir(spark)
    return os.path.join(base, "wavequery", f"{tag}-{uuid.uuid4().hex}")


def stage(parts: list[DataFrame], folder: str) -> None:
    """Append each frame in turn: later parts get later file times, so a file source sees them in order."""
    for part in parts:
        part.write.mode("append").parquet(folder)


def run_append(stream: DataFrame, sink: str, checkpoint: str, timeout_s: int | None = None) -> None:
    q = (
        stream.writeStream.format("parquet").outputMode("append").option("path", sink)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError("streaming query did not finish")
    if q.exception() is not None:
        raise q.exception()


def run_complete(stream: DataFrame, sink: str, checkpoint: str, timeout_s: int | None = None) -> None:
    """Complete-mode result kept as the last batch's full table (overwrite per batch, idempotent on replay)."""

    def write(batch_df: DataFrame, _batch_id: int) -> None:
        batch_df.write.mode("overwrite").parquet(sink)

    q = (
        stream.writeStream.outputMode("complete").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError("streaming query did not finish")
    if q.exception() is not None:
        raise q.exception()
