"""JSON arrays read by byte ranges, atomic publishing of prepared data, prompt banks written by Spark."""

import json
import os
import random
import tempfile

import pytest

from wavequery.sources import annotations as A
from wavequery.sources import json_array as J
from wavequery.streaming.runner import scratch

ODD = ['a"b{', "}]\\", '[{"x":1}]', '\\"', "plain", 'é漢"\\\\"', "", "\\" * 5, "{{[["]


def _records(n, seed=0):
    rng = random.Random(seed)
    return [{"q": rng.choice(ODD) * rng.randrange(4), "n": {"k": [1, {"z": rng.choice(ODD)}]}, "i": i} for i in range(n)]


def _text(records, seed=0):
    rng = random.Random(seed)
    return ", \n".join(json.dumps(r, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for r in records)


def _folder(**files):
    folder = tempfile.mkdtemp(prefix="wq-array-")
    for name, text in files.items():
        with open(os.path.join(folder, f"{name}.json"), "w", encoding="utf-8") as f:
            f.write(text)
    return folder


def _by_ranges(path, split_bytes):
    found = J.ranges(path, split_bytes)
    states = J.chain(found, [json.loads(json.dumps(J.summary(r))) for r in found])
    return [(seq, json.loads(text)) for r in states for seq, text in J.records(r)]


@pytest.mark.parametrize("split_bytes", [1, 3, 17, 250, 1 << 20])
def test_ranges_of_any_size_give_the_same_records(split_bytes):
    records = _records(40 if split_bytes < 17 else 400)
    path = os.path.join(_folder(a="﻿ [ " + _text(records) + " ]\n"), "a.json")
    assert _by_ranges(path, split_bytes) == list(enumerate(records))


def test_pieces_of_any_size_give_the_same_records(monkeypatch):
    records = _records(300)
    path = os.path.join(_folder(a="[" + _text(records) + "]"), "a.json")
    for piece in (1, 2, 5, 64):
        monkeypatch.setattr(J, "_PIECE", piece)
        assert _by_ranges(path, 700) == list(enumerate(records))


def test_arrays_over_files_other_elements_and_empty_files():
    r = _records(60)
    whole = _folder(a="[" + _text(r[:20]) + "]", b="", c="[]", d=" [1, null, \"{\", [{\"k\": 2}], " + _text(r[20:25]) + "]", e="[" + _text(r[25:40]), f=",\n" + _text(r[40:]) + "]")
    assert _by_ranges(whole, 100) == list(enumerate(r))
    assert _by_ranges(_folder(), 100) == [] and _by_ranges(_folder(a="[]"), 1) == []


@pytest.mark.parametrize("text", ['{"a": 1}', '[{"a": 1}', '[{"a": "x]', '[{"a": 1}]]', '[{"a": {"b": 1}]'])
def test_what_is_no_array_is_refused(text):
    with pytest.raises(ValueError):
        _by_ranges(_folder(a=text), 4)


def test_compressed_and_missing_files_are_refused():
    folder = _folder()
    open(os.path.join(folder, "a.json.gz"), "wb").write(b"xx")
    with pytest.raises(ValueError, match="compressed"):
        J.ranges(folder, 10)
    with pytest.raises(FileNotFoundError):
        J.ranges(os.path.join(folder, "none"), 10)


def _annotation(i):
    return {
        "template_id": 1, "question_id": i % 7, "sample_id": i, "question_type": "single-verify", "attribute_type": "scp_code",
        "question": ODD[i % len(ODD)] + f" {i}", "answer": ["yes", "no"][: i % 3], "ecg_id": [i % 50], "attribute": None if i % 5 else ["{x}"], "ecg_path": f"p/{i}",
    }


def test_one_large_array_is_read_by_many_tasks_like_the_json_reader(spark):
    path = os.path.join(_folder(train=json.dumps([_annotation(i) for i in range(3000)], indent=1)), "train.json")
    by_ranges = A.read_annotations(spark, path, split_bytes=40_000)
    assert by_ranges.rdd.getNumPartitions() >= 8
    tasks = by_ranges.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(tasks) == 3000 and sum(n > 0 for n in tasks) >= 8
    got, want = by_ranges, A.read_annotations_whole(spark, path)
    assert got.schema.fieldNames() == want.schema.fieldNames()
    assert got.orderBy("seq").collect() == want.orderBy("seq").collect()


def test_written_arrays_are_one_array_over_files(spark):
    path = f"{scratch(spark, 'test-array')}/template_train.json"
    rows = spark.range(5000).selectExpr("struct(id as sample_id, concat('q', id, '\"{') as question) as record", "id")
    A.write_array(rows.repartition(7), path, ["id"])
    back = A.read_annotations(spark, path, split_bytes=10_000)
    assert [(r.seq, r.sample_id, r.question) for r in back.orderBy("seq").collect()] == [(i, i, f'q{i}"{{') for i in range(5000)]
    empty = f"{scratch(spark, 'test-array')}/template_valid.json"
    A.write_array(rows.where("id < 0"), empty, ["id"])
    assert A.read_annotations(spark, empty).count() == 0


def test_small_ranges_grow_with_the_array(spark):
    path = os.path.join(_folder(train=json.dumps([_annotation(i) for i in range(3000)])), "train.json")
    cores = spark.sparkContext.defaultParallelism
    back = A.read_annotations(spark, path, split_bytes=200)
    assert back.rdd.getNumPartitions() <= J.RANGES_PER_CORE * cores
    assert [(r.seq, r.sample_id) for r in back.orderBy("seq").collect()] == [(i, i) for i in range(3000)]
    assert J.fitted(path, 1 << 30, cores) == 1 << 30 and J.fitted(path, 1, 1 << 30) == 1
    assert J.fitted(_folder(), 7, cores) == 7


def test_annotation_files_reads_each_array_once(spark):
    from wavequery.plans import catalog

    root = scratch(spark, "test-tables")
    spark.range(40).selectExpr("id as o_orderkey", "id % 5 as o_custkey", "concat('q', id % 3, '\"{') as o_orderpriority").write.parquet(f"{root}/orders.parquet")
    spark.range(5).selectExpr("id as c_custkey", "'M' as c_mktsegment").write.parquet(f"{root}/customer.parquet")
    spark.range(80).selectExpr("id div 2 as l_orderkey", "if(id % 2 = 0, 'A', 'R') as l_returnflag", "'F' as l_linestatus").write.parquet(f"{root}/lineitem.parquet")
    found = catalog.QUERIES["annotation_files"](spark, root)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan json_array") == 3 and "Join" not in plan and "Exchange" not in plan
    want = [(["train", "valid", "test"][i % 3], i, i // 3, f'q{i % 3}"{{', i % 5, "AF.RF") for i in range(40)]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_a_changed_file_is_noticed(spark):
    folder = _folder(a="[" + _text(_records(50)) + "]")
    rows = J.read_json_arrays(spark, folder, 500)
    with open(os.path.join(folder, "a.json"), "a") as f:
        f.write(" " * 2000)
    with pytest.raises(Exception, match="has changed"):
        rows.count()


# ----------------------------------------------------------------------------- SNK-1

def _prepared(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "x int")
    return rows, rows.selectExpr("x * 10 as y")


def test_prepared_data_is_rebuilt_when_its_source_changes(spark):
    root = scratch(spark, "test-publish")
    for values, want in (([1, 2], [1, 2]), ([2, 1], [1, 2]), ([1, 3], [1, 3]), ([1, 1], [1, 1])):
        rows, lookup = _prepared(spark, values)
        got, found = A.write_prepared(rows, lookup, f"{root}/p", source=rows)
        assert sorted(r.x for r in got.collect()) == want and sorted(r.y for r in found.collect()) == [10 * v for v in want]


def test_a_failure_between_the_writes_publishes_nothing(spark):
    root = scratch(spark, "test-publish")
    old, old_lookup = _prepared(spark, [1, 2])
    A.write_prepared(old, old_lookup, f"{root}/p", source=old)
    new, _ = _prepared(spark, [5])
    broken = new.selectExpr("raise_error('lost') as y")
    with pytest.raises(Exception, match="lost"):
        A.write_prepared(new, broken, f"{root}/p", source=new)  # its rows are written, its lookup is not
    got, found = A.write_prepared(old, old_lookup, f"{root}/p", source=old)
    assert sorted(r.x for r in got.collect()) == [1, 2] and sorted(r.y for r in found.collect()) == [10, 20]
    with pytest.raises(Exception, match="lost"):
        A.write_prepared(new, broken, f"{root}/q", source=new)
    assert A.published(spark, f"{root}/q") is None
    got, found = A.write_prepared(new, new.selectExpr("x as y"), f"{root}/q", source=new)
    assert [r.x for r in got.collect()] == [5] == [r.y for r in found.collect()]


def test_only_a_missing_manifest_counts_as_absent(spark):
    root = scratch(spark, "test-publish")
    rows, lookup = _prepared(spark, [1])
    A.write_prepared(rows, lookup, f"{root}/p", source=rows)
    version = A.published(spark, f"{root}/p")["version"]
    A.publish(spark, f"{root}/p", {"version": version + "-gone", "source": A.fingerprint(rows)})
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        A.write_prepared(rows, lookup, f"{root}/p", source=rows)


def test_prompt_bank_of_names_written_by_spark(spark):
    root = scratch(spark, "test-bank")
    for name, text in (("ETT", "ett"), ("ECG", "ecg\nmore")):
        spark.createDataFrame([(text,)], "content string").coalesce(1).write.text(f"{root}/{name}.txt")
    found = A.prompt_for(spark.createDataFrame([("ETTm2",), ("ECG",), ("none",)], "data string"), A.read_prompt_bank(spark, root))
    assert {r.data: r.content for r in found.collect()} == {"ETTm2": "ett\n", "ECG": "ecg\nmore\n", "none": None}
