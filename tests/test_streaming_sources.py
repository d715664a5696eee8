import json
import os
import tempfile

import pytest

from wavequery.operators.runs import early_stopping
from wavequery.sources import annotations as A
from wavequery.streaming.accuracy import running_accuracy
from wavequery.streaming.monitor import early_stop_monitor
from wavequery.streaming.runner import run_append, run_complete, scratch, stage


def _metrics(spark, rows):
    return spark.createDataFrame(rows, "run_id string, epoch long, val_loss double")


def test_stream_monitor_survives_restart_and_flags_late_rows(spark):
    root = scratch(spark, "test-monitor")
    src, sink, ckpt = f"{root}/in", f"{root}/out", f"{root}/ckpt"
    waves = [
        [("a", 0, 3.0), ("a", 1, 2.0), ("b", 0, 1.0)],
        [("a", 2, 2.0), ("a", 3, 4.0), ("a", 1, 9.0), ("b", 1, 5.0)],  # ("a", 1) arrives again: late
    ]
    schema = "run_id string, epoch long, val_loss double"
    for w in waves:
        stage([_metrics(spark, w)], src)
        run_append(early_stop_monitor(spark.readStream.schema(schema).parquet(src), patience=1), sink, ckpt)
    out = {(r.run_id, r.epoch, r.late): (r.improved, r.counter, r.stop) for r in spark.read.parquet(sink).collect()}
    assert out[("a", 1, True)] == (False, 0, False)
    batch = early_stopping(_metrics(spark, waves[0] + waves[1][:2] + waves[1][3:]), patience=1).collect()
    for r in batch:
        assert out[(r.run_id, r.epoch, False)] == (r.improved, r.counter, r.stop)


def test_stream_accuracy_equals_batch(spark):
    examples = spark.createDataFrame(
        [(i, "single-verify" if i % 2 else "single-query", ["yes"]) for i in range(10)],
        "seq long, question_type string, answer array<string>",
    )
    preds = spark.createDataFrame([(i, " yes\n" if i % 3 else "no") for i in range(10)], "seq long, prediction string")
    root = scratch(spark, "test-acc")
    stage([preds.repartition(3)], f"{root}/in")
    stream = spark.readStream.schema(preds.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    run_complete(running_accuracy(stream, examples), f"{root}/out", f"{root}/ckpt")
    got = {r.question_type: (r.correct, r.total) for r in spark.read.parquet(f"{root}/out").collect()}
    batch = {r.question_type: (r.correct, r.total) for r in running_accuracy(preds, examples).collect()}
    assert got == batch and sum(t for _, t in got.values()) == 10


def _write_split(folder, split, records):
    path = os.path.join(folder, f"template_{split}.json")
    with open(path, "w") as f:
        json.dump(records, f, indent=2)
    return path


def _record(i, q, answer, ecg):
    return {
        "template_id": 1, "question_id": 0, "sample_id": i, "question_type": "single-verify", "attribute_type": "scp_code",
        "question": q, "answer": answer, "ecg_id": [ecg], "attribute": ["x"], "ecg_path": f"p/{ecg}",
    }


def test_read_annotations_and_splits(spark):
    folder = tempfile.mkdtemp(prefix="wq-ann-")
    _write_split(folder, "train", [_record(0, "q", ["yes"], 5), _record(1, "q", ["no"], 5), _record(2, "r", ["yes", "no"], 6)])
    df = A.read_split(spark, folder, "train")
    assert df.count() == 3 and set(df.columns) >= {"seq", "split", "ecg_path"}
    qa = A.as_qa(df)
    assert [r.record_id for r in qa.orderBy("seq").collect()] == [5, 5, 6]
    with pytest.raises(ValueError):
        A.split_path(folder, "dev")


def test_positions_over_a_folder_of_files_have_no_gaps(spark):
    folder = tempfile.mkdtemp(prefix="wq-ann-")
    for name, ids in (("b", [7, 5]), ("a", [9, 1, 4]), ("c", [])):
        with open(os.path.join(folder, f"{name}.json"), "w") as f:
            json.dump([_record(i, "q", ["yes"], i) for i in ids], f)
    got = {r.seq: r.sample_id for r in A.read_annotations(spark, folder).collect()}
    assert got == dict(enumerate([9, 1, 4, 7, 5]))


def test_prompt_bank_ett_mapping(spark):
    folder = tempfile.mkdtemp(prefix="wq-bank-")
    for name, text in (("ETT", "ett text\nline 2"), ("ECG", "ecg text")):
        with open(os.path.join(folder, f"{name}.txt"), "w") as f:
            f.write(text)
    bank = A.read_prompt_bank(spark, folder)
    ds = spark.createDataFrame([("ETTh1",), ("ECG",)], "data string")
    got = {r.data: r.content for r in A.prompt_for(ds, bank).collect()}
    assert got == {"ETTh1": "ett text\nline 2", "ECG": "ecg text"}


def test_prepared_sink_is_keyed_by_split_and_reused(spark):
    root = scratch(spark, "test-prep")
    a = spark.createDataFrame([(1,)], "x int")
    train = A.prepared_path(root, "train", 42, True, "src")
    valid = A.prepared_path(root, "valid", 42, True, "src")
    others = [A.prepared_path(root, "train", 42, True, "src", mode="file"), A.prepared_path(root, "train", 42, True, "src", num_data=3)]
    assert len({train, valid, *others}) == 4
    assert A.prepared_path(root, "train", 42, True, "a/b") != A.prepared_path(root, "train", 42, True, "a_b")
    assert train != valid
    A.write_prepared(a, a, train)
    rows, _ = A.write_prepared(spark.createDataFrame([(2,)], "x int"), a, train)  # both exist: reused
    assert [r.x for r in rows.collect()] == [1]
    rows_v, _ = A.write_prepared(spark.createDataFrame([(3,)], "x int"), a, valid)
    assert [r.x for r in rows_v.collect()] == [3]


def test_watermark_deduplication_drops_repeats_and_late_rows_and_sheds_state(spark):
    from wavequery.streaming.accuracy import running_accuracy

    examples = spark.createDataFrame([(i, "q", ["yes"]) for i in range(40)], "seq long, question_type string, answer array<string>")
    day = lambda i, d, text="yes": (i, text, d)
    waves = [
        [day(i, i) for i in range(10)],  # days 0 to 9
        [day(i, i) for i in range(8, 20)] + [day(9, 9), day(12, 12)],  # 8 and 9 again
        [day(i, i) for i in range(30, 40)] + [day(19, 19, "no")],  # 19 again, with another text
        [day(2, 2, "no"), day(25, 25, "no"), day(39, 39)],  # 2 is late, 39 again; 25 is new but later than the delay
    ]
    root = scratch(spark, "test-dedup")
    schema = "seq long, prediction string, at timestamp"
    held, results = [], []
    for wave in waves:
        rows = spark.createDataFrame(wave, "seq long, prediction string, d int")
        rows.selectExpr("seq", "prediction", "timestamp_seconds((d + 100) * 86400) as at").coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = running_accuracy(spark.readStream.schema(schema).parquet(f"{root}/in"), examples, event_time="at", delay="5 days")
        q = stream.writeStream.outputMode("complete").foreachBatch(lambda df, _: results.append([tuple(r) for r in df.collect()]))
        q = q.option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start()
        q.awaitTermination()
        held.append(min(p["stateOperators"][-1]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]))
        last = results[-1]
    assert last == [("q", 30, 30, 100.0)]  # 0 to 19 and 30 to 39, each once, by their first text
    assert held[-1] <= 12  # keys of the last days only, not all 30
