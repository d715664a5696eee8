"""Text projections: answer text, prediction parsing, number formatting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def answer_text(answer="answer", sep: str = ".") -> Column:
    """Answer list joined into one text (PRJ-1)."""
    return F.array_join(_c(answer), sep)


def first_record_id(ids="ecg_id") -> Column:
    """First element of the record-id list; raises on an empty list under ANSI like the reference (PRJ-2)."""
    return _c(ids)[0]


def example_json(*cols) -> Column:
    """PRJ-3: an example row as compact JSON text (what travels with a sample)."""
    return F.to_json(F.struct(*cols))


def parse_example(text, schema) -> Column:
    """PRJ-3: JSON text back to a struct with a fixed schema (never ``eval``)."""
    return F.from_json(_c(text), schema)


def strip_ws(text) -> Column:
    """Strip leading/trailing whitespace of every kind (not only spaces, unlike ``trim``)."""
    return F.regexp_replace(_c(text), r"^\s+|\s+$", "")


def parse_prediction(text="prediction", sep: str = ".") -> Column:
    """Generated text -> list: strip whitespace, split on ``sep`` keeping empty pieces (PRJ-8)."""
    return F.split(strip_ws(text), _regex_literal(sep), -1)


def _regex_literal(s: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() else ch for ch in s)


def fixed4(x) -> Column:
    """Four-decimal text of a number (PRJ-4), rounded as Python does: by the exact binary value, a tie to the even digit.

    No Python worker. The product with 10,000 is taken as p + e without error (the factor has 14 bits, so the number is
    split once); p has a fraction of one half exactly where e or, if that is zero, the even digit decides. Numbers from 2**38 on, which have no
    more than 14 binary digits after the point, are formatted by their decimal text; infinite ones and NaN as ``inf`` and ``nan``.
    """
    v = _c(x).cast("double")
    a = F.abs(v)
    p = a * 10000.0
    spread = a * 134217729.0
    high = spread - (spread - a)
    e = (high * 10000.0 - p) + (a - high) * 10000.0
    whole = F.floor(p)
    over = p - whole
    up = F.when(over != 0.5, over > 0.5).when(e != 0.0, e > 0.0).otherwise(whole % 2 == 1)
    n = whole + up.cast("bigint")
    sign = F.when(F.startswith(v.cast("string"), F.lit("-")), "-").otherwise("")
    text = F.concat(sign, F.floor(n / 10000).cast("string"), F.lit("."), F.lpad((n % 10000).cast("string"), 4, "0"))
    return (
        F.when(F.isnan(v), F.lit("nan")).when(a == float("inf"), F.concat(sign, F.lit("inf"))).when(a >= float(1 << 38), F.format_string("%.4f", v)).when(v.isNotNull(), text)
    )


def fixed4_exact(x) -> Column:
    """Python's own formatting, Arrow-batched: what ``fixed4`` is tested against, and exact for numbers of any size."""
    return _fixed4_udf(_c(x))


@F.pandas_udf(T.StringType())
def _fixed4_udf(s: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else "{:.4f}".format(v) for v in s], dtype=object)


def pct_text(x) -> Column:
    """PRJ-16: percentage with 2 decimals as text."""
    return F.format_string("%.2f", _c(x))


def int_list_text(arr) -> Column:
    """Integer list rendered like Python's ``str(list)``: ``[0, 1, 2]`` (PRJ-5)."""
    return F.concat(F.lit("["), F.array_join(F.transform(_c(arr), lambda x: x.cast("string")), ", "), F.lit("]"))


def trend_word(trend) -> Column:
    """``upward`` if the trend is positive, else ``downward`` (flat counts as downward) (PRJ-7)."""
    return F.when(_c(trend) > 0, "upward").otherwise("downward")
