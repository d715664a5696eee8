"""Flow 2: multi-lead signal -> combined series -> statistics, lags, patches -> prompts.

WIN-5 -> {WIN-3 -> WIN-4, AGG-5/6/7, AGG-17 -> TOP-5} -> PRJ-6. Statistics use the
combined series before padding; patches the padded one (as in the reference).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavequery.operators import signals as SG
from wavequery.operators.prompts import build_prompts


@dataclass
class SeriesFeatures:
    stats: DataFrame  # record_id, min_v, max_v, median_v, trend, n, lags
    patches_long: DataFrame  # record_id, patch_id, offset, v; series of any length
    combined: DataFrame  # record_id, t, v
    patch_len: int
    stride: int
    record: str

    @property
    def patches(self) -> DataFrame:
        """record_id, patches array<array<double>>: one row per series, so only for bounded ones."""
        packed = SG.pack(self.combined, [self.record], max_len=SG.MAX_FFT_SAMPLES)
        return SG.patches_packed(packed, self.patch_len, self.stride).select(self.record, "patches")


def series_features(samples: DataFrame, weights: DataFrame, patch_len: int = 16, stride: int = 8,
                    record: str = "record_id", lead: str = "lead") -> SeriesFeatures:
    combined = SG.combine_leads(samples, weights, record=record, lead=lead).withColumnRenamed("y", "v")
    combined = combined.withColumn("v", F.col("v").cast("double"))
    stats = SG.series_stats(combined, [record])
    lags = SG.top_lags_long(combined, [record])
    patches = SG.patches_long(combined, [record], patch_len, stride)
    return SeriesFeatures(stats.join(lags, record), patches, combined, patch_len, stride, record)


def prompts_for(examples: DataFrame, features: SeriesFeatures, evaluation: bool = False) -> DataFrame:
    return build_prompts(examples, features.stats, evaluation=evaluation)
