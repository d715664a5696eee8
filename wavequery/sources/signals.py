"""SRC-3: decoded signal samples as a table, joined to annotations by record path.

Waveform bytes are decoded upstream (per-record codec, not built here); this
reads the decoded long form ``(record_path, lead, t, v)`` from Parquet (column
pruning and filter push-down reach the scan) and packs it per (record, lead, chunk of samples).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavequery.operators.ordering import same

CHUNK = 1 << 16


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Long-form decoded samples; ``v`` as double (PRJ-15)."""
    df = spark.read.parquet(path)
    return df.withColumn("v", F.col("v").cast("double"))


def packed_signals(samples: DataFrame, record: str = "record_path", lead: str = "lead", chunk: int = CHUNK) -> DataFrame:
    """One row per (record, lead, part), samples sorted by t (PRJ-14): part p holds the samples from p * ``chunk`` on, so no
    row grows with the recording; one of up to ``chunk`` samples is one row. Rejects gaps and duplicate time indexes."""
    keys = [record, lead]
    whole = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    rows = F.sort_array(F.collect_list(F.struct("t", F.col("v").cast("double").alias("v"))))
    parts = samples.groupBy(*keys, F.floor(F.col("t") / chunk).alias("part")).agg(rows.alias("_s"))
    # the whole series starts at 0 and has as many samples as times, and no time is there twice
    ok = (F.col("_t0") == 0) & (F.col("_t1") == F.col("_n") - 1) & (F.size(F.array_distinct("_s.t")) == F.size("_s"))
    parts = same(parts, whole, keys).where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("series has gaps or duplicate time indexes"))))
    return parts.select(*keys, "part", F.col("_s.v").alias("v"), F.size("_s").cast("long").alias("n"))


def unpacked_signals(packed: DataFrame, record: str = "record_path", lead: str = "lead", chunk: int = CHUNK) -> DataFrame:
    """Long form of ``packed_signals`` of the same ``chunk``."""
    long = packed.select(record, lead, "part", F.posexplode("v").alias("_at", "v"))
    return long.select(record, lead, (F.col("part") * chunk + F.col("_at")).cast("bigint").alias("t"), "v")


def attach_signals(annotations: DataFrame, signals: DataFrame, ann_key: str = "ecg_path", sig_key: str = "record_path") -> DataFrame:
    """JN-5: several questions share a record; the signal side has one row per lead and part of a record.

    Only the record keys the annotations need are read from the signal side
    (a semi-join on the key first would add a shuffle; Catalyst/AQE pick the
    join strategy from the measured sizes).
    """
    return annotations.join(signals.withColumnRenamed(sig_key, ann_key), ann_key)
