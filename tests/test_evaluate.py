import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from wavequery.functions import parse_prediction, set_equal
from wavequery.operators import evaluate as EV
from wavequery.schemas import QUESTION_TYPES


def test_prediction_parsing_and_set_equality(spark):
    df = spark.createDataFrame(
        [(1, "yes.", ["yes"]), (2, "", ["yes"]), (3, "\n yes \t", ["yes"]), (4, "0.5", ["0.5"]), (5, "b.a.a", ["a", "b"])],
        "seq long, prediction string, answer array<string>",
    )
    out = df.select("seq", parse_prediction("prediction").alias("p"), set_equal(parse_prediction("prediction"), "answer").alias("ok"))
    got = {r.seq: (r.p, r.ok) for r in out.collect()}
    assert got[1] == (["yes", ""], False)
    assert got[2] == ([""], False)
    assert got[3] == (["yes"], True)
    assert got[4] == (["0", "5"], False)  # an answer containing the separator never matches
    assert got[5][1] is True  # order and duplicates ignored


def _scored(spark, data):
    return spark.createDataFrame(data, "question_type string, attribute_type string, correct boolean")


def test_accuracy_empty_and_unknown_categories(spark):
    scored = _scored(spark, [("single-verify", "noise", True), ("single-verify", "noise", False), ("mystery", "noise", True)])
    out = EV.accuracy_by(scored, "question_type", categories=QUESTION_TYPES, keep_empty=True)
    got = {r.question_type: (r.correct, r.total, r.acc_pct) for r in out.collect()}
    assert got["single-verify"] == (1, 2, 50.0)
    assert got["single-query"] == (0, 0, None)  # empty: total 0, ratio null
    assert got["mystery"] == (1, 1, 100.0)  # unknown category kept as its own row
    assert len(got) == 6
    shown = EV.accuracy_by(scored, "question_type", categories=QUESTION_TYPES)  # FLT-4: only categories with data
    assert {r.question_type for r in shown.collect()} == {"single-verify", "mystery"}
    with pytest.raises(Exception):
        EV.accuracy_by(scored, "question_type", categories=QUESTION_TYPES, on_unknown="error").collect()


def test_accuracy_detail_grouping_sets(spark):
    scored = _scored(spark, [("a", "x", True), ("a", "y", False), ("b", "x", True)])
    out = {(r.question_type, r.attribute_type, r.level): (r.correct, r.total) for r in EV.accuracy_detail(scored).collect()}
    assert out[("a", "x", 0)] == (1, 1)
    assert out[("a", None, 1)] == (1, 2)
    assert out[("b", None, 1)] == (1, 1)
    assert out[(None, "x", 2)] == (2, 2)
    assert out[(None, None, 3)] == (2, 3)


def test_class_accuracy_uses_label_lists(spark):
    df = spark.createDataFrame(
        [("single-verify", ["a", "b"], ["b", "a", "a"]), ("single-verify", ["a"], ["b"])],
        "question_type string, prediction array<string>, label array<string>",
    )
    out = EV.accuracy_by(EV.mark_correct(df, "prediction", "label"), "question_type").collect()[0]
    assert (out.correct, out.total) == (1, 2)


def _adjust_py(gt, pred, fill_first=False):
    """Plain restatement: a hit in a run of gt=1 marks the run; index 0 only with fill_first."""
    out = list(pred)
    n = len(gt)
    i = 0
    while i < n:
        if gt[i] == 1:
            j = i
            while j < n and gt[j] == 1:
                j += 1
            if any(pred[k] == 1 for k in range(i, j)):
                for k in range(i, j):
                    if k > 0 or fill_first:
                        out[k] = 1
            i = j
        else:
            i += 1
    return out


def _adjust_spark(spark, gt, pred, fill_first=False, parts=None):
    df = spark.createDataFrame([(0, t, g, p) for t, (g, p) in enumerate(zip(gt, pred))], "series_id int, t int, gt int, pred int")
    return [r.adjusted for r in EV.point_adjust(df, fill_first=fill_first, num_partitions=parts).orderBy("t").collect()]


def test_point_adjust_golden(spark):
    assert _adjust_spark(spark, [1, 1, 1], [0, 1, 0]) == [0, 1, 1]
    assert _adjust_spark(spark, [1, 1, 1], [0, 1, 0], fill_first=True) == [1, 1, 1]
    assert _adjust_spark(spark, [0, 1, 1, 0], [1, 0, 1, 1]) == [1, 1, 1, 1]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 1)), min_size=1, max_size=30))
def test_point_adjust_matches_restatement_and_is_idempotent(spark, pairs):
    gt = [g for g, _ in pairs]
    pred = [p for _, p in pairs]
    once = _adjust_spark(spark, gt, pred, parts=4)  # one series cut over several partitions
    assert once == _adjust_py(gt, pred)
    assert _adjust_spark(spark, gt, once) == once


def test_elementwise_accuracy(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 0, 1), (2, 0, 0), (2, 1, 1)], "series_id int, gt int, pred int")
    out = {r.series_id: r.accuracy for r in EV.elementwise_accuracy(df, by="series_id").collect()}
    assert out == {1: 0.5, 2: 1.0, None: 0.75}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 1), st.integers(0, 1)), min_size=1, max_size=60),
       st.integers(1, 7), st.booleans())
def test_distributed_point_adjust_equals_window_form(spark, rows_, parts, fill_first):
    data = [(sid, t, g, p) for t, (sid, g, p) in enumerate(rows_)]
    df = spark.createDataFrame(data, "series_id long, t long, gt int, pred int")
    a = {(r.series_id, r.t): r.adjusted for r in EV.point_adjust(df, num_partitions=parts, fill_first=fill_first).collect()}
    b = {(r.series_id, r.t): r.adjusted for r in EV.point_adjust_window(df, fill_first=fill_first).collect()}
    assert a == b


@pytest.mark.parametrize("shift", [0, -37, 1_700_000_000_000_000_000])
def test_point_adjust_at_any_time_scale_and_with_null_series(spark, shift):
    import random

    rnd = random.Random(5)
    data = [(sid, t + shift, rnd.randint(0, 1) if rnd.random() < 0.8 else 1, rnd.randint(0, 1)) for sid in (1, 2, None) for t in range(200)]
    df = spark.createDataFrame(data, "series_id long, t long, gt int, pred int")
    b = {(r.series_id, r.t): r.adjusted for r in EV.point_adjust_window(df).collect()}
    small = EV.point_adjust(df, num_partitions=3, chunk=16)
    for out in (small, small.coalesce(1), df.limit(0).withColumn("adjusted", F.lit(0)).union(small)):
        assert {(r.series_id, r.t): r.adjusted for r in out.collect()} == b


def test_unscored_rows_count_nowhere(spark):
    df = spark.createDataFrame([("q", "a", True), ("q", "a", None), ("r", "a", None)], "question_type string, attribute_type string, correct boolean")
    got = {r.question_type: (r.correct, r.total, r.acc_pct) for r in EV.accuracy_by(df, "question_type", keep_empty=True).collect()}
    assert got == {"q": (1, 1, 100.0), "r": (0, 0, None)}
    top = EV.accuracy_detail(df).where("level = 3").collect()[0]
    assert (top.correct, top.total) == (1, 1)


def test_accuracy_detail_shows_empty_cells_of_the_grid(spark):
    df = spark.createDataFrame([("a", "x", True), ("a", "x", False), ("a", "z", None)], "question_type string, attribute_type string, correct boolean")
    out = {(r.question_type, r.attribute_type): (r.correct, r.total, r.acc_pct)
           for r in EV.accuracy_detail(df, first_values=["a", "b"], second_values=["x", "y"]).where("level = 0").collect()}
    assert out == {("a", "x"): (1, 2, 50.0), ("a", "y"): (0, 0, None), ("a", "z"): (0, 0, None), ("b", "x"): (0, 0, None), ("b", "y"): (0, 0, None)}
