"""Column expressions. All are built-in Spark expressions (codegen, no Python)."""

from wavequery.functions.text import (
    answer_text,
    example_json,
    first_record_id,
    fixed4,
    fixed4_exact,
    int_list_text,
    pct_text,
    parse_example,
    parse_prediction,
    strip_ws,
    trend_word,
)
from wavequery.functions.sets import dice, set_equal
from wavequery.functions.arrays import l2_norm, normalize, dot, pad_left, replicate_pad

__all__ = [
    "answer_text",
    "example_json",
    "first_record_id",
    "fixed4",
    "fixed4_exact",
    "int_list_text",
    "pct_text",
    "parse_example",
    "parse_prediction",
    "strip_ws",
    "trend_word",
    "dice",
    "set_equal",
    "l2_norm",
    "normalize",
    "dot",
    "pad_left",
    "replicate_pad",
]
