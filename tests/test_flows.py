from pyspark.sql import functions as F

from wavequery.functions import fixed4, fixed4_exact, pct_text
from wavequery.plans.features import prompts_for, series_features
from wavequery.plans.report import accuracy_report
from wavequery.sources.annotations import file_positions
from wavequery.sources.signals import attach_signals, packed_signals, unpacked_signals
from wavequery.sources import standins as S

SF = "/root/testdata/sf0.001"


def test_four_decimals_are_those_of_the_exact_binary_value(spark):
    import math
    import random
    import struct

    rng = random.Random(3)
    values = [0.03125, 0.00015, 12.5, -0.03125, 0.0, -0.0, -0.00001, 1e-300, 0.99995, 0.999949999, 123456789.00005, 2.5e-5, 7.5e-5, float("nan"), float("inf"), -float("inf"), 1e15, 2.0**38]
    values += [k / 32 for k in range(-200, 200)] + [k * 0.00005 for k in range(-500, 500)] + [rng.uniform(-1e4, 1e4) for _ in range(2000)]
    for k in range(2000):  # ties and their neighbours of all sizes
        tie = (2 * rng.randrange(1 << rng.randrange(1, 44)) + 1) / 20000
        values += [tie, math.nextafter(tie, math.inf), math.nextafter(tie, -math.inf)]
    bits = (rng.getrandbits(64) for _ in range(20000))
    values += [x for x in (struct.unpack("d", struct.pack("Q", b))[0] for b in bits) if abs(x) < 2**38]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, None)], "i int, x double")
    got = {r.i: (r.a, r.b) for r in df.select("i", fixed4("x").alias("a"), fixed4_exact("x").alias("b")).collect()}
    assert got.pop(-1)[0] is None
    assert [(values[i], g[0]) for i, g in got.items() if g[0] != f"{values[i]:.4f}"] == []
    assert all(g[1] == f"{values[i]:.4f}" for i, g in got.items() if not math.isnan(values[i]))
    assert spark.range(1).select(pct_text(F.lit(66.666)).alias("p")).collect()[0].p == "66.67"


def test_series_features_and_prompts(spark):
    sig = S.signals(spark, SF).select("record_id", "lead", "t", "v")
    weights = spark.createDataFrame(
        [(lead, k, 1) for lead in ("click", "error", "purchase", "signup", "view") for k in range(3)], "lead string, k int, w bigint"
    )
    feats = series_features(sig, weights, patch_len=4, stride=2)
    st = feats.stats.collect()
    assert st and all(len(r.lags) == min(5, r.n) and r.min_v <= r.median_v <= r.max_v for r in st)
    p = {r.record_id: r.patches for r in feats.patches.collect()}
    n = {r.record_id: r.n for r in st}
    assert all(len(p[k]) == (n[k] + 2 - 4) // 2 + 1 for k in p)
    qa = S.qa(spark, SF)
    prompts = prompts_for(qa, feats).select("prompt_prefix", "answer_text").limit(3).collect()
    assert all(r.prompt_prefix.startswith("<|start_prompt|>") and r.prompt_prefix.endswith("<|start_ecg|>") for r in prompts)
    blank = prompts_for(qa, feats, evaluation=True).select("answer_text").limit(1).collect()[0]
    assert blank.answer_text == "<|end_of_text|>"


def test_accuracy_report_drop_last(spark):
    qa = S.qa(spark, SF)
    preds = S.predictions(spark, SF)
    full = accuracy_report(qa, preds)
    total = sum(r.total for r in full["question_type"].collect())
    assert total == qa.count()
    cut = accuracy_report(qa, preds, batch_size=32, drop_last=True)
    assert sum(r.total for r in cut["question_type"].collect()) == (total // 32) * 32
    assert len(full["attribute_type"].collect()) >= 5


def test_file_positions_and_signal_join(spark):
    ann = spark.createDataFrame(
        [(1, 0, 2, "p/a"), (1, 0, 1, "p/b"), (0, 5, 9, "p/a")], "template_id long, question_id long, sample_id long, ecg_path string"
    )
    pos = {(r.template_id, r.sample_id): r.seq for r in file_positions(ann).collect()}
    assert pos == {(0, 9): 0, (1, 1): 1, (1, 2): 2}
    samples = spark.createDataFrame(
        [("p/a", "I", t, float(t)) for t in range(3)] + [("p/b", "I", t, 1.0) for t in range(2)],
        "record_path string, lead string, t long, v double",
    )
    joined = attach_signals(ann, packed_signals(samples))
    got = {(r.ecg_path, r.sample_id): r.v for r in joined.collect()}
    assert got[("p/a", 2)] == [0.0, 1.0, 2.0] and got[("p/b", 1)] == [1.0, 1.0] and len(got) == 3


def test_packed_signals_do_not_grow_with_the_recording(spark):
    rows = [(r, "I", t, float(t * 3 + n)) for r, n in (("p/a", 1), ("p/a2", 4), ("p/b", 8), (None, 23)) for t in range(n)]
    df = spark.createDataFrame(rows, "record_path string, lead string, t long, v double")
    packed = packed_signals(df, chunk=4)
    assert packed.selectExpr("max(size(v))").first()[0] == 4 and packed.count() == 1 + 1 + 2 + 6
    assert sorted(map(tuple, unpacked_signals(packed, chunk=4).collect()), key=repr) == sorted(rows, key=repr)
    for bad in (rows[:1] + rows[3:5], rows + rows[-1:], [r for r in rows if r[2] != 8], [r for r in rows if not 4 <= r[2] < 8]):
        try:
            packed_signals(spark.createDataFrame(bad, df.schema), chunk=4).collect()
            raise AssertionError("expected a failure")
        except Exception as e:
            assert "gaps or duplicate" in str(e)
