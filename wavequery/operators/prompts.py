"""Prompt assembly from series statistics (PRJ-4..7, JN-5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavequery.functions import answer_text, fixed4, int_list_text, trend_word

# --- fixed values (must equal the reference's prompt text) --------------------
PROMPT_START = "<|start_prompt|>"
DATASET_DESCRIPTION = "Dataset description: The dataset contains electrocardiogram (ECG) time-series data. "
TASK_DESCRIPTION = (
    "Task description: Given a patient's ECG signal, answer a clinical question related to cardiac health based on the ECG data. "
)
STATS_INTRO = "Input statistics: "
MIN_LABEL = "min value "
MAX_LABEL = "max value "
MEDIAN_LABEL = "median value "
TREND_LABEL = "the trend of the signal is "
LAGS_LABEL = "top 5 lags are: "
QUESTION_LABEL = "Question:"
PROMPT_END = "<|end_prompt|>"
SERIES_START = "<|start_ecg|>"
PROMPT_SUFFIX = "<|end_ecg|>Answer:"
# -----------------------------------------------------------------------------

# End-of-sequence text appended to the answer; depends on the tokenizer, so a parameter.
DEFAULT_EOS = "<|end_of_text|>"


def prompt_prefix(min_v="min_v", max_v="max_v", median_v="median_v", trend="trend", lags="lags", question="question"):
    """PRJ-6: the statistics prefix. No space after ``Question:`` (as in the reference)."""
    return F.concat(
        F.lit(PROMPT_START + DATASET_DESCRIPTION + TASK_DESCRIPTION + STATS_INTRO + MIN_LABEL),
        fixed4(min_v),
        F.lit(", " + MAX_LABEL),
        fixed4(max_v),
        F.lit(", " + MEDIAN_LABEL),
        fixed4(median_v),
        F.lit(", " + TREND_LABEL),
        trend_word(trend),
        F.lit(", " + LAGS_LABEL),
        int_list_text(lags),
        F.lit(". " + QUESTION_LABEL),
        F.col(question),
        F.lit(PROMPT_END + SERIES_START),
    )


def build_prompts(examples: DataFrame, features: DataFrame, record: str = "record_id", eos: str = DEFAULT_EOS,
                  evaluation: bool = False) -> DataFrame:
    """JN-5 + PRJ-6: join each example to its record's features (the record side is unique) and
    assemble (prompt_prefix, prompt_suffix, answer_text). ``evaluation`` blanks the answer (SEQ-6)."""
    joined = examples.join(features, record)
    ans = F.lit("") if evaluation else answer_text("answer")
    return joined.select(
        "*",
        prompt_prefix().alias("prompt_prefix"),
        F.lit(PROMPT_SUFFIX).alias("prompt_suffix"),
        F.concat(ans, F.lit(eos)).alias("answer_text"),
    )
