"""Evaluation: prediction parsing, accuracy reports, point adjustment.

Accuracy reports are one aggregation each (partial aggregation per partition,
one shuffle of at most #categories rows per partition). The fixed category
list is added as zero-weight rows *before* the aggregation instead of joined
afterwards, so empty categories appear without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavequery.functions import parse_prediction, set_equal


def attach_predictions(examples: DataFrame, predictions: DataFrame, key: str = "seq", sep: str = ".") -> DataFrame:
    """JN-3 + PRJ-8: align generated text with its example by key (never by position), parse it to a list."""
    return examples.join(predictions, key).withColumn("prediction", parse_prediction("prediction", sep))


def mark_correct(scored: DataFrame, prediction: str = "prediction", truth: str = "answer") -> DataFrame:
    """PRJ-9: set equality of prediction and truth (AGG-11 passes ``truth='label'``)."""
    return scored.withColumn("correct", set_equal(prediction, truth))


def _category_rows(scored: DataFrame, cols: list[str], categories: list[tuple] | None) -> DataFrame:
    # a row without a truth (null) is not scored: it counts in neither column
    rows = scored.select(*cols, F.coalesce(F.col("correct").cast("int"), F.lit(0)).alias("_c"), F.col("correct").isNotNull().cast("int").alias("_n"))
    if not categories:
        return rows
    dim = scored.sparkSession.createDataFrame(categories, schema=", ".join(f"{c} string" for c in cols))
    zero = dim.select(*cols, F.lit(0).alias("_c"), F.lit(0).alias("_n"))
    return rows.unionByName(zero)


def _check_known(df: DataFrame, col: str, known: list[str]) -> DataFrame:
    return df.withColumn(
        col, F.when(F.col(col).isin(known), F.col(col)).otherwise(F.raise_error(F.concat(F.lit("unknown category: "), F.col(col))))
    )


def _ratio(correct: Column, total: Column) -> Column:
    # correct / total * 100, in the reference's order of operations
    return F.try_divide(correct.cast("double"), total.cast("double")) * 100.0


def accuracy_by(
    scored: DataFrame,
    category: str,
    categories: list[str] | None = None,
    keep_empty: bool = False,
    on_unknown: str = "keep",
) -> DataFrame:
    """AGG-8/9/11 + JN-7 + FLT-4: (category, correct, total, acc_pct).

    ``categories``: fixed list whose members always appear (total 0, acc null) when
    ``keep_empty``; ``on_unknown='error'`` fails on a value outside the list.
    """
    if on_unknown == "error" and categories:
        scored = _check_known(scored, category, categories)
    rows = _category_rows(scored, [category], [(c,) for c in categories] if categories else None)
    out = rows.groupBy(category).agg(F.sum("_c").cast("bigint").alias("correct"), F.sum("_n").cast("bigint").alias("total"))
    out = out.withColumn("acc_pct", _ratio(F.col("correct"), F.col("total")))
    return out if keep_empty else out.where(F.col("total") > 0)


def accuracy_detail(scored: DataFrame, first: str = "question_type", second: str = "attribute_type",
                    first_values: list[str] | None = None, second_values: list[str] | None = None) -> DataFrame:
    """AGG-10: (first x second), per first, per second and overall in one pass (GROUPING SETS).

    ``level`` is ``grouping_id()``: 0 = both, 1 = first only, 2 = second only, 3 = overall. With both value
    lists every cell of their grid appears (JN-7): empty ones with total 0 and no percentage.
    """
    rows = scored.select(first, second, F.col("correct").cast("int").alias("_c"))
    if first_values and second_values:
        grid = scored.sparkSession.createDataFrame([(a, b) for a in first_values for b in second_values], f"{first} string, {second} string")
        rows = rows.unionByName(grid.withColumn("_c", F.lit(None).cast("int")))
    return (
        rows.groupingSets([[first, second], [first], [second], []], first, second)
        .agg(
            F.grouping_id().cast("int").alias("level"),
            F.coalesce(F.sum("_c"), F.lit(0)).cast("bigint").alias("correct"),
            F.count("_c").alias("total"),
        )
        .withColumn("acc_pct", _ratio(F.col("correct"), F.col("total")))
    )


def elementwise_accuracy(df: DataFrame, pred: str = "pred", truth: str = "gt", by: str | None = None) -> DataFrame:
    """AGG-12: mean of (pred == truth); with ``by``, per group plus the overall row (group null)."""
    hit = (F.col(pred) == F.col(truth)).cast("double")
    if by is None:
        return df.agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    return df.rollup(by).agg(
        F.grouping_id().cast("int").alias("level"), F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n")
    )


def point_adjust_window(
    df: DataFrame, series: str = "series_id", t: str = "t", gt: str = "gt", pred: str = "pred", fill_first: bool = False
) -> DataFrame:
    """WIN-6 with windows per series (simple; a series is one task).

    Gaps-and-islands: the running count of ``gt = 0`` rows names each true run;
    ``max(pred)`` per (series, run) says whether the run was hit. The reference
    never back-fills index 0 (its loop stops before it): the series' first row
    keeps its own prediction unless ``fill_first``.
    """
    w = Window.partitionBy(series).orderBy(t)
    runs = df.withColumn("_run", F.sum(1 - F.col(gt)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("_first", F.lag(F.col(t)).over(w).isNull())
    hit = F.max(F.when(F.col(gt) == 1, F.col(pred))).over(Window.partitionBy(series, "_run"))
    fill = (F.col(gt) == 1) & (hit == 1)
    if not fill_first:
        fill = fill & ~F.col("_first")
    return runs.withColumn("adjusted", F.when(fill, F.lit(1)).otherwise(F.col(pred))).drop("_run", "_first")


def point_adjust(
    df: DataFrame, series: str = "series_id", t: str = "t", gt: str = "gt", pred: str = "pred", fill_first: bool = False,
    num_partitions: int | None = None, chunk: int = 1 << 16, pos: str | None = None,
) -> DataFrame:
    """WIN-6 for series of any length; a huge series is split over many tasks.

    1. Rows are numbered globally in (series, t) order (``with_positions``), unless they come with such positions in ``pos``.
    2. Per (series, chunk of ``chunk`` positions), the last ``gt = 0`` position is a partial
       aggregate; a window over these few rows carries it into the chunks after it.
    3. A window inside each chunk finishes it: every row gets its run, the last ``gt = 0`` position
       before it, or the series' start below zero. Positions are integers and unique, so no time value
       takes part and a run needs no other key.
    4. Whether a run was hit is a partial aggregation on the run, joined back (AQE splits a hot run).

    A null series is a series of its own.
    """
    from wavequery.operators.ordering import same, with_positions

    columns = [c for c in df.columns if c != pos]
    rows = df.withColumnRenamed(pos, "_pos") if pos else with_positions(df, [series, t], pos="_pos", num_partitions=num_partitions).df
    rows = rows.withColumn("_chunk", F.floor(F.col("_pos") / chunk).cast("bigint"))
    zero = F.when(F.col(gt) == 0, F.col("_pos"))
    chunks = rows.groupBy(series, "_chunk").agg(F.max(zero).alias("_zero"), F.min("_pos").alias("_at"))
    earlier = Window.partitionBy(series).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(
        series, "_chunk", F.max("_zero").over(earlier).alias("_carried"), F.min("_at").over(Window.partitionBy(series)).alias("_start")
    )
    inside = Window.partitionBy(series, "_chunk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = same(rows.withColumn("_last", F.max(zero).over(inside)), chunks, [series, "_chunk"])
    rows = rows.withColumn("_run", F.coalesce("_last", "_carried", -1 - F.col("_start")))
    hits = rows.where(F.col(gt) == 1).groupBy("_run").agg(F.max(pred).alias("_hit"))
    out = rows.join(hits, "_run", "left")
    fill = (F.col(gt) == 1) & (F.col("_hit") == 1)
    if not fill_first:
        fill = fill & (F.col("_pos") != F.col("_start"))
    return out.withColumn("adjusted", F.when(fill, F.lit(1)).otherwise(F.col(pred))).select(*columns, "adjusted")
