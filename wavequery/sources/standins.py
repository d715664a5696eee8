"""Stand-in inputs derived from the driver tables.

The reference's own inputs (annotation JSON, waveforms, predictions, run logs)
are not shipped at scale, so each is re-expressed over the driver tables. Every
function returns a DataFrame. The per-series time index comes from
``ordering.series_index``, one distributed numbering for every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavequery.operators.ordering import series_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(v: Column) -> Column:
    return F.round(v * 100).cast("bigint")


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation rows: (seq, question, question_type, attribute_type, record_id, answer).

    One row per order; the answer is the set of (return flag, line status) codes
    of its lines. Several orders share a customer, and the same priority
    repeats, so (question, record_id) has duplicates.
    """
    answers = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.sort_array(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("answer"))
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return (
        orders.join(customer, F.col("c_custkey") == F.col("o_custkey"))
        .join(answers, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_orderkey").alias("seq"),
            F.col("o_orderpriority").alias("question"),
            F.col("o_orderpriority").alias("question_type"),
            F.col("c_mktsegment").alias("attribute_type"),
            F.col("o_custkey").alias("record_id"),
            "answer",
        )
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated text per example: (seq, prediction) with surrounding whitespace."""
    code = F.when(F.col("l_quantity") > 6, F.concat("l_returnflag", "l_linestatus"))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.array_join(F.sort_array(F.collect_set(code)), ".").alias("body"))
        .select(
            F.col("l_orderkey").alias("seq"),
            F.concat(F.lit(" "), F.col("body"), F.lit("\n")).alias("prediction"),
        )
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form multi-lead signal: (record_id, lead, t, v, vc); own time index per lead."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    ev = series_index(ev, ["user_id", "event_type"], ["ts", "event_id"])
    return ev.select(
        F.col("user_id").alias("record_id"),
        F.col("event_type").alias("lead"),
        "t",
        F.col("value").alias("v"),
        _cents(F.col("value")).alias("vc"),
    )


def signal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``signals_one`` without positions, for what needs the order only: (record_id, at, v); ``at`` is what ``t`` numbers."""
    at = F.struct("ts", "event_id").alias("at")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("record_id"), at, F.col("value").alias("v"))


def signals_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form single-channel signal: (record_id, t, v, vc, n)."""
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    ev = series_index(ev, ["user_id"], ["ts", "event_id"], length="n")
    return ev.select(
        F.col("user_id").alias("record_id"), "t", F.col("value").alias("v"), _cents(F.col("value")).alias("vc"), "n"
    )


def _labels(events: DataFrame, *more: str) -> DataFrame:
    return events.select(
        F.col("user_id").alias("series_id"), *more, (F.col("value") > 20).cast("int").alias("gt"), (F.col("value") > 45).cast("int").alias("pred")
    )


def binary_labels(spark: SparkSession, sf_dir: str, position: str | None = None) -> DataFrame:
    """Ordered 0/1 ground truth and prediction per series: (series_id, t, gt, pred), with the global position if named."""
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    ev = series_index(ev, ["user_id"], ["ts", "event_id"], position=position)
    return _labels(ev, "t", *([position] if position else []))


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``binary_labels`` without an order, for what needs none: (series_id, gt, pred)."""
    return _labels(table(spark, sf_dir, "events"))


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation loss per (run, epoch), exact rationals: (run_id, epoch, val_loss)."""
    epoch = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("run_id"), epoch.alias("epoch"))
        .agg((F.sum(_cents(F.col("value"))).cast("double") / F.count(F.lit(1))).alias("val_loss"))
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-dimensional unit vectors in batches of 32: (vec_id, batch_id, idx, label, embedding)."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.expr("vec_id div 32").alias("batch_id"),
        (F.col("vec_id") % 32).alias("idx"),
        "label",
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token arrays per conversation turn; a conversation is a batch: (batch_id, turn, role, tok)."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("batch_id"), "turn", "role", F.split("text", r"\s+").alias("tok")
    )
