"""A training corpus from raw documents: language, toxicity, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; ``run`` writes a
stage's rows to the shared folder and reads them again for the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavequery.llm import langid, packing, secrets, simhash, toxicity
from wavequery.llm.common import only, staged, table
from wavequery.llm.queries import WORDS

#: The stages train, tokenise and enumerate bit flips; SQL cannot express them.
ORACLE_SQL = None
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_CONFIDENCE = 0.5


def _documents(docs: DataFrame) -> DataFrame:
    return only(docs, **{c: c for c in COLUMNS})


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (null, no letters) or of no clear one."""
    docs = _documents(docs)
    model = langid.fit(docs.where(langid.training_rows()))
    found = langid.predict(docs.withColumn("_text", F.col("text")), model, text_col="_text", keep=COLUMNS)
    return found.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= MIN_CONFIDENCE)).select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents predicted as toxic."""
    docs = _documents(docs)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.training_rows())
    return toxicity.score(docs, model, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that with the smallest id."""
    docs = _documents(docs)
    return simhash.representatives(docs, staged(simhash.near_duplicates(docs), "groups"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document; secrets in its text are masked."""
    return secrets.redacted(_documents(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the final texts with their places in windows of 2048 tokens."""
    return packing.pack_documents(docs, WORDS)


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", deduplicate), ("secrets", mask_secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
