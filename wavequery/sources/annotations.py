"""Annotation and prompt-bank readers, prepared-data and evaluation sinks."""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavequery.schemas import ANNOTATION_SCHEMA, SPLITS
from wavequery.sources.json_array import SPLIT_BYTES, read_json_arrays


def split_path(root: str, split: str) -> str:
    """SRC-2: split name -> annotation file; unknown split is rejected."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}; expected one of {sorted(SPLITS)}")
    return os.path.join(root, f"template_{split}.json")


def read_annotations(spark: SparkSession, path: str, split: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """SRC-1: JSON arrays of annotations with the fixed schema, plus ``seq``, the position over the file or the folder's files in name order.

    A large array is read by many tasks, of ``split_bytes`` at least, and positions come with the rows: no shuffle, no numbering
    (``json_array``). For a store that only Spark can open, use ``read_annotations_whole``. ``file_positions`` numbers rows by
    (template_id, question_id, sample_id) instead (WIN-9).
    """
    rows = read_json_arrays(spark, path, split_bytes)
    df = rows.select(F.from_json("value", ANNOTATION_SCHEMA).alias("_r"), "seq").select("_r.*", "seq")
    return df if split is None else df.withColumn("split", F.lit(split))


def read_annotations_whole(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """SRC-1 by Spark's multi-line reader: the same rows, one task per file, from any store that Spark reads."""
    from wavequery.operators.ordering import with_positions

    df = spark.read.schema(ANNOTATION_SCHEMA).option("multiLine", True).json(path)
    # a file is never split, so the increasing id follows its order; numbering makes the positions gapless
    df = df.select("*", F.col("_metadata.file_path").alias("_file")).withColumn("_row", F.monotonically_increasing_id())
    df = with_positions(df, ["_file", "_row"], pos="seq").df.drop("_file", "_row")
    return df if split is None else df.withColumn("split", F.lit(split))


def read_split(spark: SparkSession, root: str, split: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    return read_annotations(spark, split_path(root, split), split, split_bytes)


def write_array(records: DataFrame, path: str, order: list[str], record: str = "record") -> None:
    """One JSON array of the ``record`` structs in a (unique) order, over as many files as the shuffle has partitions:
    in name order they are the array's text, so that no task writes it whole."""
    from wavequery.operators.ordering import with_positions

    numbered = with_positions(records, order, pos="_pos")
    before = F.when(F.col("_pos") == 0, "[").otherwise(",")
    after = F.when(F.col("_pos") == numbered.total - 1, "]").otherwise("")
    lines = numbered.df.repartitionByRange("_pos").sortWithinPartitions("_pos")
    lines.select(F.concat(before, F.to_json(record), after).alias("value")).write.text(path)


def file_positions(annotations: DataFrame, pos: str = "seq") -> DataFrame:
    """WIN-9: example position by (template_id, question_id, sample_id), numbered without a single-partition sort."""
    from wavequery.operators.ordering import with_positions

    keys = ["template_id", "question_id", "sample_id"]
    return with_positions(annotations.drop(pos) if pos in annotations.columns else annotations, keys, pos=pos).df


def as_qa(annotations: DataFrame, *more: str) -> DataFrame:
    """Annotation rows -> the (seq, question, question_type, attribute_type, record_id, answer) shape (PRJ-2), and ``more`` of their columns."""
    return annotations.select(
        "seq", "question", "question_type", "attribute_type", F.col("ecg_id")[0].alias("record_id"), "answer", *[
            c for c in ("ecg_path", "split") if c in annotations.columns
        ], *more
    )


def read_prompt_bank(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-4 source side: every ``<name>.txt`` in ``folder`` as (name, content), whole text per file. A name may also be
    a folder with the one file that Spark's writer left there."""
    df = spark.read.text(os.path.join(folder, "*.txt"), wholetext=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt(?:/[^/]*)?$", 1)
    return df.select(name.alias("name"), F.col("value").alias("content"))


def prompt_for(datasets: DataFrame, bank: DataFrame, data_col: str = "data") -> DataFrame:
    """SRC-4: a dataset name containing ``ETT`` uses the ``ETT`` entry, any other name its own.

    An equi-join on the resolved name; the bank is one row per file (small), AQE
    broadcasts it when its measured size allows.
    """
    resolved = F.when(F.col(data_col).contains("ETT"), F.lit("ETT")).otherwise(F.col(data_col))
    return datasets.withColumn("_name", resolved).join(
        bank.withColumnRenamed("name", "_name"), "_name", "left"
    ).drop("_name")


def prepared_path(root: str, split: str, seed: int, shuffle: bool, source: str, mode: str = "grouped", num_data: int | None = None) -> str:
    """SNK-1 key: one folder per everything that decides which rows come in which order."""
    name = quote(source, safe="")  # 'a/b' and 'a_b' stay apart
    tag = f"split={split}/seed={seed}/shuffle={int(bool(shuffle))}/mode={mode}/num_data={num_data or 0}/source={name}"
    return os.path.join(root, tag)


def fingerprint(source: DataFrame) -> str:
    """Row count and sum of row hashes: the same for the same rows in any order (one aggregation)."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in source.columns]).cast("decimal(38,0)")
    found = source.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row), F.lit(0)).alias("h")).first()
    return f"{found['n']}-{found['h']}-{','.join(f'{f.name}:{f.dataType.simpleString()}' for f in source.schema)}"


def _manifest(spark: SparkSession, path: str):
    """(file context, path of the manifest): Hadoop's own file calls, so any store that Spark writes to."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(os.path.join(path, "current.json"))
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()), at


def published(spark: SparkSession, path: str) -> dict | None:
    """The manifest of ``path``, or None where none has been published. Any other failure is raised."""
    files, at = _manifest(spark, path)
    if not files.util().exists(at):
        return None
    return json.loads("".join(r["value"] for r in spark.read.text(at.toString(), wholetext=True).collect()))


def publish(spark: SparkSession, path: str, manifest: dict) -> None:
    """Put the manifest in place by one rename: readers see the old one or the new one."""
    files, at = _manifest(spark, path)
    jvm = spark._jvm
    draft = jvm.org.apache.hadoop.fs.Path(os.path.join(path, f"draft-{uuid.uuid4().hex}"))
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    out = files.create(draft, flags, spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$CreateOpts"), 0))
    out.write(json.dumps(manifest).encode())
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark._sc._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    files.rename(draft, at, over)


def write_prepared(prepared: DataFrame, lookup: DataFrame, path: str, source: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """SNK-1: materialise the ordered list and the lookup together; reuse both while ``source``, what they were prepared
    from, has the same rows (without it, always).

    Both are written into a new version folder. They count only when the manifest points there, and it is put in place by
    one rename after both are whole: a failure in between leaves what was published before, and no half of it.
    """
    spark = prepared.sparkSession
    mark = fingerprint(source) if source is not None else None
    current = published(spark, path)
    if current is None or current["source"] != mark:
        current = {"version": f"v-{uuid.uuid4().hex}", "source": mark}
        prepared.write.parquet(os.path.join(path, current["version"], "rows"))
        lookup.write.parquet(os.path.join(path, current["version"], "lookup"))
        publish(spark, path, current)
    version = os.path.join(path, current["version"])
    return spark.read.parquet(os.path.join(version, "rows")), spark.read.parquet(os.path.join(version, "lookup"))


def write_evaluation(scored: DataFrame, path: str) -> None:
    """SNK-2: example fields + parsed prediction, written as Parquet."""
    scored.write.mode("errorifexists").parquet(path)
