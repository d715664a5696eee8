"""ST-2: running accuracy per category over a stream of predictions.

Stream-static join of arriving predictions to the examples, the same built-in
parse/set-equality as the batch report, then a streaming aggregation whose
state is one row per category. Repeated predictions can be dropped by example key: with an event time and a delay the state holds the
keys of the last ``delay`` only, and rows that come later than that are dropped too; without, one entry per key for ever.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavequery.operators.evaluate import attach_predictions, mark_correct


def running_accuracy(predictions: DataFrame, examples: DataFrame, category: str = "question_type", key: str = "seq",
                     dedup: bool = False, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    if event_time is not None:
        predictions = predictions.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key]).drop(event_time)
    elif dedup:
        predictions = predictions.dropDuplicates([key])
    scored = mark_correct(attach_predictions(examples, predictions, key))
    agg = scored.groupBy(category).agg(
        F.sum(F.col("correct").cast("int")).cast("bigint").alias("correct"), F.count("correct").alias("total")
    )
    return agg.withColumn("acc_pct", F.try_divide(F.col("correct").cast("double"), F.col("total").cast("double")) * 100.0)
