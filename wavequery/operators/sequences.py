"""Token-sequence assembly (tokenizer-agnostic: segments arrive as token-id arrays).

Per sample: prefix + series positions + suffix + answer, each segment already
starting with the begin token; the begin token is kept on the prefix and dropped
from suffix and answer. Labels mark every non-answer position with -100. The
batch is left-padded to its longest sequence; the batch max is a partial
aggregate joined back on ``batch_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavequery.functions import pad_left
from wavequery.schemas import IGNORE_INDEX, MAX_SEGMENT_TOKENS


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def truncate(tok, max_len: int = MAX_SEGMENT_TOKENS) -> Column:
    """SEQ-1: keep the first ``max_len`` tokens of a segment (the right end is cut)."""
    return F.slice(_c(tok), 1, max_len)


def drop_begin(tok) -> Column:
    """SEQ-2: drop a segment's first (begin) token."""
    return F.slice(_c(tok), 2, F.greatest(F.size(_c(tok)) - 1, F.lit(0)))


def series_positions(n, series_token: int = -1) -> Column:
    """Placeholder ids for the ``n`` series (patch) positions between prefix and suffix."""
    return F.array_repeat(F.lit(series_token), _c(n) if not isinstance(n, int) else F.lit(n))


def assemble(df: DataFrame, prefix: str, suffix: str, answer: str, n_series, max_len: int = MAX_SEGMENT_TOKENS,
             series_token: int = -1) -> DataFrame:
    """SET-3 + SEQ-1/2/3/5: input ids, labels and the unpadded length per sample; flags truncated prompts."""
    p, s, a = truncate(prefix, max_len), truncate(suffix, max_len), truncate(answer, max_len)
    ser = series_positions(n_series, series_token)
    s_body, a_body = drop_begin(s), drop_begin(a)
    ids = F.concat(p, ser, s_body, a_body)
    n_ignored = F.size(p) + F.size(ser) + F.size(s_body)
    labels = F.concat(F.array_repeat(F.lit(IGNORE_INDEX), n_ignored), a_body)
    truncated = (F.size(_c(prefix)) > max_len) | (F.size(_c(suffix)) > max_len) | (F.size(_c(answer)) > max_len)
    return df.select("*", ids.alias("input_ids"), labels.alias("labels"), F.size(ids).alias("seq_len"), truncated.alias("truncated"))


def collate(df: DataFrame, batch: str = "batch_id", pad_id: int = 0) -> DataFrame:
    """WIN-7 + SEQ-4: left-pad ids (pad id), labels (-100) and the attention mask (0/1) to the batch max.

    The batch max is a partial aggregate joined back on the batch key, so a batch of any
    size (e.g. a whole conversation) is never gathered into one task.
    """
    mx = df.groupBy(batch).agg(F.max("seq_len").alias("max_len"))
    df = df.join(mx, batch)
    n_pad = F.col("max_len") - F.col("seq_len")
    return df.select(
        "*",
        pad_left("input_ids", "max_len", pad_id).alias("input_ids_padded"),
        pad_left("labels", "max_len", IGNORE_INDEX).alias("labels_padded"),
        F.concat(F.array_repeat(F.lit(0), n_pad), F.array_repeat(F.lit(1), F.col("seq_len"))).alias("attention_mask"),
    )


def target_count(labels) -> Column:
    """FLT-5: positions that carry a target (label != -100)."""
    return F.size(F.filter(_c(labels), lambda x: x != IGNORE_INDEX))


def generation_input(ids) -> Column:
    """SEQ-6: evaluation input drops the last position before generation."""
    return F.slice(_c(ids), 1, F.greatest(F.size(_c(ids)) - 1, F.lit(0)))
