import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


@pytest.fixture
def docs(spark):
    """documents-like rows from (doc_id, text[, lang]) tuples, with further columns of clashing names."""

    def make(rows, clash=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            for c in ("fp", "score", "sequence_id", "start", "key", "found", "c0", "kinds", "_bin", "held_out", "node"):
                df = df.selectExpr("*", f"'x' as {c}")
        return df

    return make
