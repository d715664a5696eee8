"""Fixed schemas and category lists."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values (must equal the reference's) -------------------------------
# Question types, in the reference's report order.
QUESTION_TYPES = [
    "single-verify",
    "single-query",
    "single-choose",
    "comparison_irrelevant-verify",
    "comparison_consecutive-verify",
]
# Attribute types, in the reference's report order.
ATTRIBUTE_TYPES = ["scp_code", "numeric_feature", "heart_axis", "stage_of_infarction", "noise"]
# Question types covered by the detailed (question x attribute) report.
DETAIL_QUESTION_TYPES = ["single-verify", "single-query", "single-choose"]
# Split names and their codes.
SPLITS = {"train": 0, "valid": 1, "test": 2}
# Label value that marks a position without a training target.
IGNORE_INDEX = -100
# Default shuffle seed.
DEFAULT_SEED = 42
# Number of top autocorrelation lags kept.
TOP_K_LAGS = 5
# Longest token segment kept.
MAX_SEGMENT_TOKENS = 512
# Early-stopping patience default.
DEFAULT_PATIENCE = 5
# -----------------------------------------------------------------------------

ANNOTATION_SCHEMA = T.StructType(
    [
        T.StructField("template_id", T.LongType()),
        T.StructField("question_id", T.LongType()),
        T.StructField("sample_id", T.LongType()),
        T.StructField("question_type", T.StringType()),
        T.StructField("attribute_type", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.ArrayType(T.StringType())),
        T.StructField("ecg_id", T.ArrayType(T.LongType())),
        T.StructField("attribute", T.ArrayType(T.StringType())),
        T.StructField("ecg_path", T.StringType()),
    ]
)
